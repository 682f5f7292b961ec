"""Incremental classification: reads arrive as files, the index is a static table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from readloom.operators.index import Index
from readloom.operators.search import SearchParams, best_by_taxon, search
from readloom.schema import READS


def stream_reads(spark: SparkSession, folder: str, max_files: int = 64) -> DataFrame:
    """A stream over Parquet files of reads; ordinals count within a file, so its name is part of a read's key."""
    reads = spark.readStream.schema(READS).option("maxFilesPerTrigger", max_files).parquet(folder)
    return reads.withColumn("read_ord", F.struct(F.col("_metadata.file_path").alias("file"), F.col("read_ord").alias("read_ord")))


def classify_stream(reads: DataFrame, index: Index | DataFrame, out: str, checkpoint: str, params: SearchParams = SearchParams()) -> StreamingQuery:
    """Classifies each micro-batch and writes it to out/batch=N; a batch that is repeated after a failure overwrites itself."""
    def one(batch: DataFrame, batch_id: int) -> None:
        best_by_taxon(search(batch, index, params)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return reads.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

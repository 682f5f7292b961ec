"""One query an operator, over its whole table with production parameters."""
from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession, functions as F

from readloom.llm import ann, base, chat, codes, decontaminate, language, lines, near, ngram, packing, suffix


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op2_language(spark: SparkSession, sf: str) -> DataFrame:
    return language.identify(table(spark, sf, "documents"))


def op3_codes(spark: SparkSession, sf: str) -> DataFrame:
    path = base.shared_dir(spark)
    codes.write_codes(table(spark, sf, "documents"), path)
    return codes.read_codes(spark, path)


def op4_chat(spark: SparkSession, sf: str) -> DataFrame:
    probe = spark.createDataFrame([(-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf, "conversations").select(*probe.columns).unionAll(probe)
    return chat.digest(chat.read_back(chat.format_conversations(turns)))


def op5_ann(spark: SparkSession, sf: str) -> DataFrame:
    return ann.search(table(spark, sf, "embeddings"))


def op6_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"))


def op7_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op8_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf, "documents"), near.NearParams(shingle=4))


def op10_lm_score(spark: SparkSession, sf: str) -> DataFrame:
    return ngram.score_documents(table(spark, sf, "documents"))


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("op")} | {"pipeline": corpus_pipeline.run}
ORACLES: dict[str, str] = {"op4_chat": chat.ORACLE, "op8_suffix_dedup": suffix.ORACLE, "op9_near_dedup": near.ORACLE}

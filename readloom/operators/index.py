"""The labelled collection as tables: chunks, bins and seed positions.

A chunk is the unit of a search: its references are laid end to end in (tax_id, ord) order, so a seed may lie across
two neighbours, and limits on seed occurrences hold within a chunk.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from readloom.functions.sequence import normalize
from readloom.schema import InvalidParameter


#: Characters of the pieces that a sequence is cut into, one within the other. A substring costs as much as what lies before it.
BLOCKS = (8192, 128)
#: Characters of a chunk within which bins find those that follow them.
STRETCH = 1 << 16


def chunk_limit(gb: float) -> int:
    """Bytes of a chunk; single precision, then truncated."""
    if not gb > 0:
        raise InvalidParameter("chunk size must be positive")
    return int(np.float32(gb) * np.float32(1e9))


def stable(df: DataFrame) -> DataFrame:
    """The same rows in the same partitions however often they are read: a checkpoint where the session has a folder for it,
    else kept on the executors' disks, where a lost partition is computed again from the same shuffle."""
    if df.sparkSession.sparkContext.getCheckpointDir():
        return df.checkpoint()
    return df.persist(StorageLevel.DISK_ONLY)


ORDER = ("tax_id", "ord", "gi")
#: Places of a partition in the numbers of monotonically_increasing_id.
_PART = 33
#: Records whose sizes are one row of the fold.
FOLD_ROWS = 1 << 16


def _numbered(df: DataFrame, *order: str) -> DataFrame:
    """Sorted over all partitions, with `at`: partition << 33 | place, a unique number that rises with the order. Equal
    records have a number each."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("seq")
    ordered = df.repartitionByRange(n, *order, tie).sortWithinPartitions(*order, tie)
    return stable(ordered.withColumn("at", F.monotonically_increasing_id()))


def _size_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, bytes) -> (at of the first, sizes) of runs of at most FOLD_ROWS records."""
    for batch in batches:
        at, size = (batch.column(c).to_numpy() for c in ("at", "bytes"))
        for i in range(0, len(at), FOLD_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(at[i:i + 1]), pa.array([size[i:i + FOLD_ROWS].tobytes()], pa.binary())], names=["at", "sizes"])


def _closes(limit: int):
    """Runs of sizes in order -> the numbers of the records that fill a chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = 0
        for batch in batches:
            for first, blob in zip(batch.column("at").to_pylist(), batch.column("sizes")):
                total = np.cumsum(np.frombuffer(blob.as_py(), np.int64))
                done, out = 0, []
                while (k := int(np.searchsorted(total, done + limit - used))) < len(total):
                    out.append(first + k)
                    done, used = int(total[k]), 0
                used += int(total[-1]) - done
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["at"])
    return run


def assign_chunks(refs: DataFrame, limit: int) -> DataFrame:
    """refs with chunk_id: records in (tax_id, ord, gi) order fill a chunk until its bytes reach the limit.

    Whatever a record adds beyond the limit is dropped from the count, so where chunks end is a fold in order. It runs over
    sizes alone, eight bytes a record, streamed through one task, which jumps from one end of a chunk to the next; all
    else is in parallel. The ends come to the driver, one a chunk, and a record's chunk is how many lie before it.
    """
    size = (F.length("seq") + F.length(F.concat_ws("-", F.col("gi").cast("string"), F.col("tax_id").cast("string"))) + 3).cast("bigint")
    t = _numbered(refs, *ORDER)
    sizes = t.select("at", size.alias("bytes")).mapInArrow(_size_blocks, "at bigint, sizes binary")
    ends = sorted(r.at for r in sizes.repartition(1).sortWithinPartitions("at").mapInArrow(_closes(limit), "at bigint").collect())
    by_part: dict[int, list[int]] = {}
    for x in ends:
        by_part.setdefault(x >> _PART, []).append(x)
    rows, before = [], 0
    for part in range(int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))):
        own = by_part.get(part, [])
        rows.append((part, before, own))
        before += len(own)
    state = refs.sparkSession.createDataFrame(rows, "part int, before bigint, ends array<bigint>")
    t = t.join(F.broadcast(state), F.shiftright("at", _PART).cast("int") == F.col("part"))
    chunk = F.col("before") + F.size(F.filter("ends", lambda x: x < F.col("at")))
    return t.withColumn("chunk_id", chunk.cast("bigint")).select(*refs.columns, "chunk_id")


def single_chunk(refs: DataFrame) -> DataFrame:
    return refs.withColumn("chunk_id", F.lit(0).cast("bigint"))


def bins(refs: DataFrame, normalized: bool = True) -> DataFrame:
    """refs with bin_id, start and end: half-open places in the chunk's concatenation (exclusive running sums of lengths).

    Sums run within the partitions of one sort, plus what the partitions before hold of the chunk; so one chunk of the
    whole collection is as many tasks as any other.
    """
    seq = normalize(F.col("seq")) if normalized else F.col("seq")
    length = F.length("seq").cast("bigint")
    t = _numbered(refs.withColumn("seq", seq), "chunk_id", *ORDER).withColumn("part", F.shiftright("at", _PART).cast("int"))
    held = t.groupBy("chunk_id", "part").agg(F.sum(length).alias("held"), F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("chunk_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row a partition
    before = held.select("chunk_id", "part", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}_before") for c in ("held", "n")])
    names = [c for c in t.columns if c != "at"]
    own = T.StructType([*t.select(*names).schema.fields, T.StructField("n_own", T.LongType()), T.StructField("own", T.LongType())])
    t = t.select(*names).mapInArrow(_running, own).join(F.broadcast(before), ["chunk_id", "part"])
    t = t.withColumns({"bin_id": (F.col("n_before") + F.col("n_own")).cast("bigint"), "start": (F.col("held_before") + F.col("own")).cast("bigint")})
    return t.withColumn("end", F.col("start") + length).select(*refs.columns, "bin_id", "start", "end")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the records and the characters that the partition holds of a record's chunk before it; rows are sorted by chunk."""
    last, n, total = None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        chunk, size = batch.column("chunk_id").to_numpy(zero_copy_only=False), pc.fill_null(pc.utf8_length(batch.column("seq")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(chunk[1:] != chunk[:-1]) + 1])
        run = np.diff(np.concatenate([first, [len(chunk)]]))
        place = np.arange(len(chunk)) - np.repeat(first, run)
        before = np.cumsum(size) - size
        before -= np.repeat(before[first], run)
        if last == chunk[0]:
            place[:run[0]] += n
            before[:run[0]] += total
        last, n, total = chunk[-1], int(place[-1]) + 1, int(before[-1] + size[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place), pa.array(before)], names=[*batch.schema.names, "n_own", "own"])


def _over_ends(solid: DataFrame, size: int) -> DataFrame:
    """(chunk_id, bin_id, start, ext, last): the last size - 1 characters of each bin with the size - 1 that follow it in its chunk.

    A bin meets those that follow it in the stretch of STRETCH characters where it ends. Each goes to all stretches that
    may ask for its first characters, so none is looked for beyond a stretch, and no task holds a chunk.
    """
    k = size - 1
    stretch = lambda x: F.floor(x / STRETCH)
    asks = stretch(F.col("end"))
    within = F.sequence(stretch(F.greatest(F.col("start") - k, F.lit(0))), stretch(F.col("start")))
    own = F.right("seq", F.lit(k))
    ends = solid.select("chunk_id", "bin_id", "start", "end", F.left("seq", F.lit(k)).alias("head"), own.alias("own"), F.explode(F.array_union(within, F.array(asks))).alias("stretch"))
    w = W.partitionBy("chunk_id", "stretch").orderBy("start").rowsBetween(1, k)
    tail = F.left(F.array_join(F.collect_list("head").over(w), ""), F.lit(k))
    ends = ends.withColumn("tail", tail).where(F.col("stretch") == asks).withColumn("ext", F.concat("own", "tail"))
    return ends.select("chunk_id", "bin_id", (F.col("end") - F.length("own")).alias("start"), "ext", F.least(F.length("own") - 1, F.length("ext") - size).alias("last"))


def seed_positions(binned: DataFrame, size: int) -> DataFrame:
    """(chunk_id, kmer, site, bin_id) of every substring of the concatenation, attributed to the bin of its first character.

    Those within a bin come from its text alone, those that go on into the next bins, which may be several short ones, from
    the ends of texts.
    """
    solid = binned.where(F.length("seq") > 0)
    flat = solid.select("chunk_id", "bin_id", "start", F.col("seq").alias("ext"), (F.length("seq") - size).alias("last"))
    if size > 1:
        flat = flat.unionAll(_over_ends(solid, size))
    flat = flat.where(F.col("last") >= 0)
    for block in BLOCKS:
        if block == BLOCKS[-1]:  # a few long texts are few tasks
            flat = flat.repartition(int(flat.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chunk_id", "start")
        piece = F.substr("ext", F.col("i") + 1, F.lit(block + size - 1))
        flat = (flat.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(block))))
                .select("chunk_id", "bin_id", (F.col("start") + F.col("i")).alias("start"), piece.alias("ext"), F.least(F.col("last") - F.col("i"), F.lit(block - 1)).alias("last")))
    flat = flat.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("last"))))
    return flat.select("chunk_id", F.substr("ext", F.col("i") + 1, F.lit(size)).alias("kmer"), (F.col("start") + F.col("i")).alias("site"), "bin_id")


def seed_counts(positions: DataFrame) -> DataFrame:
    """(chunk_id, kmer, n_hits): exact occurrences of each seed in each chunk."""
    return positions.groupBy("chunk_id", "kmer").agg(F.count(F.lit(1)).alias("n_hits"))


def seed_table(binned: DataFrame, size: int) -> DataFrame:
    """seed_positions with n_hits, the occurrences of the seed in the chunk."""
    positions = seed_positions(binned, size)
    return positions.join(seed_counts(positions), ["chunk_id", "kmer"])


#: Characters of the pieces that windows are cut from, and of those that these are cut from.
TEXT = (1 << 18, 1 << 12)


def text_blocks(binned: DataFrame) -> DataFrame:
    """(chunk_id, bin_id, block, piece): the texts in pieces of TEXT[-1] characters."""
    flat = binned.select("chunk_id", "bin_id", F.lit(0).cast("bigint").alias("block"), F.col("seq").alias("piece"))
    for size in TEXT:
        i = F.explode(F.sequence(F.lit(0), F.greatest(F.length("piece") - 1, F.lit(0)), F.lit(size))).alias("i")
        flat = flat.select("chunk_id", "bin_id", "block", "piece", i).select("chunk_id", "bin_id", (F.col("block") + F.floor(F.col("i") / TEXT[-1])).cast("bigint").alias("block"), F.substr("piece", F.col("i") + 1, F.lit(size)).alias("piece"))
    return flat


def write_index(binned: DataFrame, path: str, seed_size: int = 18) -> None:
    """The index as three tables: bins, seeds of one size (sorted, so that scans skip what no read has), and text blocks."""
    binned.write.mode("overwrite").partitionBy("chunk_id").parquet(f"{path}/bins")
    stored = binned.sparkSession.read.parquet(f"{path}/bins")
    n = int(binned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seed_table(stored, seed_size).repartitionByRange(n, "kmer", "chunk_id").sortWithinPartitions("kmer", "chunk_id").write.mode("overwrite").parquet(f"{path}/seeds")
    text_blocks(stored).write.mode("overwrite").parquet(f"{path}/blocks")


@dataclass(frozen=True)
class Index:
    """bins, and where they are stored seeds of seed_size and text blocks."""
    bins: DataFrame
    seeds: DataFrame | None = None
    seed_size: int = 0
    blocks: DataFrame | None = None


def read_index(spark: SparkSession, path: str) -> Index:
    seeds = spark.read.parquet(f"{path}/seeds")
    first = seeds.select(F.length("kmer").alias("n")).head()
    return Index(spark.read.parquet(f"{path}/bins"), seeds, first.n if first else 0, spark.read.parquet(f"{path}/blocks"))

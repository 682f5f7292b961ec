"""Shared plumbing: written intermediate tables, Arrow text buffers, word and shingle hashes, connected components."""
from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of text that one vectorised step takes at once; arrays of eight bytes a character stay small next to an executor.
SLICE = 1 << 20


# --- Spark -----------------------------------------------------------------------------------------------------------

def parts(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session has them: the cluster sets them to its input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one only where that is unset and there is one machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="readloom-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/readloom-{uuid.uuid4().hex}"


#: Whether a query's shuffle files go when it ends. Otherwise they wait until the driver's JVM collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read again: lineage ends here, and a lost executor loses nothing.
    What was shuffled for them leaves the executors' disks."""
    path, conf = shared_dir(df.sparkSession), df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of `cut` which nothing reads again, as what was made of them is written."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def documents(df: DataFrame, *more: str) -> DataFrame:
    """doc_id and text alone (and more), so that other columns clash with nothing; rows without doc_id are left out."""
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *more).where(F.col("doc_id").isNotNull())


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)


# --- Arrow -----------------------------------------------------------------------------------------------------------

def long_array(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]] if len(at) else raw, at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most limit bytes, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def binary_column(blocks: list[bytes]) -> pa.Array:
    return pa.array(blocks, pa.binary())


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from rows sorted by key: a group never spans two tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cut_at = int(np.searchsorted(k, k[-1], "left")) if k[0] <= k[-1] else 0
        if held and (cut_at or held[-1].column(key)[0].as_py() != k[0]):
            if held[-1].column(key)[0].as_py() != k[0]:
                yield pa.Table.from_batches(held)
                held = []
        if cut_at:
            yield pa.Table.from_batches([*held, batch.slice(0, cut_at)])
            held = [batch.slice(cut_at)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def starts_of(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts, and the end."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]])


def give_back() -> None:
    """Returns freed memory to the system, which C's allocator and Arrow's keep for themselves otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


# --- hashes ----------------------------------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = np.uint64(0x9E3779B97F4A7C13)  # 3 modulo 8
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_33 = np.uint64(33)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; a new array."""
    h = h ^ (h >> _33)
    h *= M1
    h ^= h >> _33
    h *= M2
    h ^= h >> _33
    return h


def powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _POWERS[int(base)] = have = np.multiply.accumulate(have)
    return have[:n]


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words between the six ASCII spaces, of all rows: hashes, start bytes, end bytes, and the offsets of each row's words."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, np.zeros(len(offsets), np.int64)
    if lower:
        raw = lower_ascii(raw)
    solid = ~_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:n]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | edge[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(np.where(solid, _BYTE[raw], np.uint64(0)) * powers(_R, n), out=total[1:])
    h = (total[e] - total[s]) * powers(_R_INV, n)[s] + (e - s).astype(np.uint64)
    return mix(h), s, e, np.searchsorted(s, offsets, "left")


def sequence_hash(h: np.ndarray) -> np.uint64:
    """Of a whole sequence of word hashes."""
    value = (np.cumsum(h * powers(_R, len(h)))[-1] if len(h) else np.uint64(0)) ^ np.uint64(len(h) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    return mix(np.array([value]))[0]


def shingle_sets(h: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of k-word shingles of each row, sorted, and the offsets of rows. Fewer words than k make one shingle."""
    n = len(at) - 1
    count = np.diff(at)
    have = np.maximum(count - k + 1, (count > 0).astype(np.int64))
    to = np.concatenate([[0], np.cumsum(have)])
    out = np.empty(to[-1], np.uint64)
    if len(h) >= k:
        rolled = h[:len(h) - k + 1].copy()
        for j in range(1, k):
            rolled *= M1
            rolled += h[j:len(h) - k + 1 + j]
        rolled = mix(rolled)
    keep = np.ones(len(out), bool)
    for i in range(n):
        a, b = to[i], to[i + 1]
        if a == b:
            continue
        if count[i] < k:
            out[a] = sequence_hash(h[at[i]:at[i + 1]])
        else:
            part = out[a:b]
            part[:] = rolled[at[i]:at[i] + b - a]
            part.sort()
            np.not_equal(part[1:], part[:-1], out=keep[a + 1:b])
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[to]


# --- graphs ----------------------------------------------------------------------------------------------------------

class Forest:
    """Union-find over small integers; the smallest member is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def components(edges: DataFrame) -> DataFrame:
    """(v, component): the smallest vertex reachable over edges (a, b), for vertices with an edge.

    Alternates large-star and small-star steps until the edges no longer change. Every step is an aggregate with
    partial sums and a join, so a vertex with very many edges is no task of its own; each result is written out.
    """
    spark = edges.sparkSession
    now = cut(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("c")).where("v <> c").distinct())
    seen = None
    while True:
        sign = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("v", "c").cast("decimal(20,0)")).alias("h")).head()
        if sign == seen or not sign.n:
            break
        seen = sign
        both = now.unionAll(now.select(F.col("c").alias("v"), F.col("v").alias("c")))
        least = both.groupBy("v").agg(F.least(F.min("c"), F.first("v")).alias("m"))
        large = both.where("c > v").join(least, "v").select(F.col("c").alias("v"), F.col("m").alias("c")).unionAll(
            least.where("m < v").select("v", F.col("m").alias("c")))
        large = large.where("v <> c").distinct()
        low = large.groupBy("v").agg(F.min("c").alias("m"))
        small = large.join(low, "v").select(F.col("c").alias("v"), F.col("m").alias("c")).unionAll(low.select("v", F.col("m").alias("c")))
        now = cut(small.where("v <> c").select(F.greatest("v", "c").alias("v"), F.least("v", "c").alias("c")).distinct())
    least = now.groupBy("v").agg(F.min("c").alias("component"))
    return least.unionAll(now.select(F.col("c").alias("v"), F.col("c").alias("component")).distinct())

"""Token ids in directly addressable codes.

An id is split into chunks of eight bits, lowest first. Level k holds the k-th chunk of every id that has one, and a
bitmap that says which of them go on in level k + 1; a rank directory counts the set bits before every 512th. Token i
of a shard is read by one byte a level and one rank between levels, without decoding what lies around it.

A shard file (little endian): magic, counts of levels, documents and tokens, then the document ids, the first token of
each document, and for each level its size, chunks, bitmap words and rank directory.

Shards are cut from documents in ascending doc_id order and stored as rows (part, shard, first_doc, base, tokens, file)
of a Parquet table in the shared folder, since executors have no other file system in common. `base` counts the
partition's tokens before the shard; the offsets of partitions are as many numbers as there are partitions.

Rows without doc_id are left out; null and empty texts are one end token; equal rows follow each other.
"""
from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from readloom.llm import base as B, tokens as T

MAGIC = b"RLDAC001"
STRIDE = 512
#: Text bytes of a shard.
SHARD = 1 << 21
TABLE = "part int, shard bigint, first_doc bigint, base bigint, tokens bigint, file binary"


def pack(docs: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> bytes:
    levels, now = [], ids.astype(np.uint32)
    while True:
        more = now >= 256
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (STRIDE // 8), np.uint8)])
        count = np.bitwise_count(bits.reshape(-1, STRIDE // 8)).sum(1, dtype=np.uint32) if len(bits) else np.zeros(0, np.uint32)
        rank = np.concatenate([[0], np.cumsum(count)]).astype("<u4")
        levels.append((len(now), (now & 255).astype(np.uint8), bits, rank))
        now = now[more] >> 8
        if not len(now):
            break
    out = [MAGIC, struct.pack("<QQQ", len(levels), len(docs), len(ids)), docs.astype("<i8").tobytes(), starts.astype("<u8").tobytes()]
    for n, chunk, bits, rank in levels:
        out += [struct.pack("<QQQ", n, len(bits), len(rank)), chunk.tobytes(), bits.tobytes(), rank.tobytes()]
    return b"".join(out)


class Codes:
    """A shard file, read in place."""

    def __init__(self, file: bytes):
        if file[:8] != MAGIC:
            raise ValueError("not a shard of codes")
        n_levels, n_docs, self.size = struct.unpack_from("<QQQ", file, 8)
        at = 32
        self.docs = np.frombuffer(file, "<i8", n_docs, at)
        self.starts = np.frombuffer(file, "<u8", n_docs, at + 8 * n_docs).astype(np.int64)
        at += 16 * n_docs
        self.levels = []
        for _ in range(n_levels):
            n, n_bits, n_rank = struct.unpack_from("<QQQ", file, at)
            at += 24
            chunk, bits = np.frombuffer(file, np.uint8, n, at), np.frombuffer(file, np.uint8, n_bits, at + n)
            rank = np.frombuffer(file, "<u4", n_rank, at + n + n_bits)
            at += n + n_bits + 4 * n_rank
            self.levels.append((chunk, bits, rank))

    def token(self, i: int) -> int:
        """One id, by rank from level to level."""
        if not 0 <= i < self.size:
            raise IndexError(i)
        value, shift = 0, 0
        for chunk, bits, rank in self.levels:
            value |= int(chunk[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // STRIDE
            before = np.bitwise_count(bits[block * STRIDE // 8:i >> 3]).sum(dtype=np.int64) + int(bits[i >> 3] & (1 << (i & 7)) - 1).bit_count()
            i, shift = int(rank[block]) + int(before), shift + 8
        return value

    def tokens(self) -> np.ndarray:
        """All ids."""
        value = np.zeros(0, np.uint32)
        for chunk, bits, _ in reversed(self.levels):
            whole = chunk.astype(np.uint32)
            more = np.flatnonzero(np.unpackbits(bits, count=len(chunk), bitorder="little").view(bool))
            whole[more] += value << np.uint32(8)
            value = whole
        return value

    def document(self, k: int) -> tuple[int, int]:
        """First token of document k, and the one after its last."""
        return int(self.starts[k]), int(self.starts[k + 1]) if k + 1 < len(self.starts) else self.size


def encode_shards(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, base = TaskContext.get().partitionId(), 0, 0
        enc = T.encoder(tokenizer)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            docs = B.long_array(batch.column("doc_id"))
            _, at = B.text_bytes(batch.column("text"))
            for i, j in B.slices(at, SHARD):
                ids = [np.concatenate([x, end]) for x in enc.encode(batch.column("text").slice(i, j - i).to_pylist())]
                starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
                file = pack(docs[i:j], starts[:-1], np.concatenate(ids))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((part, pa.int32()), (shard, pa.int64()), (int(docs[i]), pa.int64()), (base, pa.int64()), (int(starts[-1]), pa.int64()), (file, pa.binary()))], names=["part", "shard", "first_doc", "base", "tokens", "file"])
                shard, base = shard + 1, base + int(starts[-1])
    return run


def write_codes(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0) -> None:
    """Shard files of all texts in ascending doc_id order, with the end token after each."""
    d = B.documents(docs).repartitionByRange(B.parts(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id")
    d.mapInArrow(encode_shards(tokenizer, end_id), TABLE).write.option("compression", "none").parquet(path)


def digest(first: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base, file in zip(batch.column("part").to_pylist(), batch.column("base").to_pylist(), batch.column("file")):
                c = Codes(file.as_py())
                ids, spans = c.tokens().astype("<u4", copy=False), [c.document(k) for k in range(len(c.docs))]
                crc = [zlib.crc32(ids[a:b].data) for a, b in spans]
                yield pa.RecordBatch.from_arrays([pa.array(c.docs.astype(np.int64)), pa.array([first[part] + base + a for a, _ in spans], pa.int64()), pa.array([b - a for a, b in spans], pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
    return run


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    t = spark.read.schema(TABLE).parquet(path)
    first, total = {}, 0
    for r in t.groupBy("part").agg(F.sum("tokens").alias("n")).orderBy("part").collect():  # a number a partition
        first[r.part], total = total, total + r.n
    return t.select("part", "base", "file").mapInArrow(digest(first), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")

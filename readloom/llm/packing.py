"""Packing of documents to fixed windows with lexical neighbours.

Documents are encoded once and written. Document frequencies and the average length are those of the whole table. Its
rows are then dealt by the rarer of their two heaviest shared terms, by those weights, and put in order of both, so that
documents about the same lie together, and cut into shards: a shard holds at most `shard_docs` documents and about `shard_bytes` of text (or one
longer document), whatever the input. Whole windows of a document stand alone. Its rest is a seed: a BM25 index over
the tokens of the shard's documents, queried with every term of the seed that another document has, returns the unused
ones most like the seed, which fill its window in that order; the last is cut so that the window is full, and what is left of it stays unused. Documents without a
neighbour follow in the order of the shard. What a shard has at its end is cut to powers of two, which need no padding.

Rows without doc_id are left out; null and empty texts are one end token; every row is packed, repeated ones too.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from readloom.llm import base as B, tokens as T

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
CODED = "doc_id bigint, bytes bigint, ids binary"
#: Ids between stages: two bytes each, as a vocabulary of up to 65536 has them, or four with a leading zero byte.
SMALL = 1 << 16


def held(ids: np.ndarray) -> bytes:
    return ids.astype("<u2").tobytes() if not len(ids) or ids.max() < SMALL else b"\0" + ids.astype("<u4").tobytes()


def unheld(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4", offset=1) if len(raw) % 2 else np.frombuffer(raw, "<u2").astype("<u4")


@dataclass(frozen=True)
class PackParams:
    window: int = 1024
    tokenizer: str = "byte_bpe_50k.json"
    end_id: int = 0
    shard_docs: int = 4096
    shard_bytes: int = 4 << 20
    k1: float = 1.2
    b: float = 0.75


@dataclass(frozen=True)
class Corpus:
    """Of the whole table: documents, tokens a document, and by token the documents that have it."""
    n: int
    average: float
    df: np.ndarray

    @cached_property
    def idf(self) -> np.ndarray:
        return np.log(1 + (self.n - self.df + 0.5) / (self.df + 0.5))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of held ones, and the offsets of its rows."""
    raw, at = B.text_bytes(column)
    if not (np.diff(at) % 2).any():
        return raw.view("<u2"), at // 2
    ids = [unheld(raw[i:j].tobytes()) for i, j in zip(at[:-1], at[1:])]
    return np.concatenate(ids), np.concatenate([[0], np.cumsum([len(x) for x in ids])])


def term_counts(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, tf) of rows of ids, by row and term; one sort for all rows."""
    n = len(at) - 1
    kind, bits = (np.uint32, 16) if n <= SMALL and (not len(ids) or ids.max() < SMALL) else (np.uint64, 32)
    key = np.repeat(np.arange(n, dtype=kind) << kind(bits), np.diff(at))
    key |= ids.astype(kind, copy=False)
    key.sort()
    edge = B.starts_of(key)
    key = key[edge[:-1]]
    return (key >> kind(bits)).astype(np.int64), (key & kind((1 << bits) - 1)).astype(np.int64), np.diff(edge).astype(np.float64)


def term_weights(term: np.ndarray, tf: np.ndarray, size: np.ndarray | int, all_: Corpus, p: PackParams) -> np.ndarray:
    return all_.idf[term] * tf * (p.k1 + 1) / (tf + p.k1 * (1 - p.b + p.b * size / max(1.0, all_.average)))


#: Weights are whole multiples of 1 / SCALE, so that sums are exact in any order.
SCALE = 64
#: Seeds whose scores over frequent terms are computed at once, and neighbours that are put in order at once.
SEEDS, FIRST = 128, 64


class Bm25:
    """An inverted index over the tokens of a shard's documents, weighted by the whole table; a document's query is all of its terms.

    Terms that more than one in 16 of the documents have are columns of a matrix, as their postings would be walked over and
    over; the others have postings. Scores are the same sums either way.
    """

    def __init__(self, ids: list[np.ndarray], all_: Corpus, p: PackParams):
        n = len(ids)
        doc, term, tf = term_counts(np.concatenate(ids), np.concatenate([[0], np.cumsum([len(x) for x in ids])]))
        weight = np.rint(SCALE * term_weights(term, tf, np.bincount(doc, tf, n)[doc], all_, p)).astype(np.float32)
        order = np.argsort(term, kind="stable")
        edge = B.starts_of(term[order])
        size = np.diff(edge)
        number = np.empty(len(term), np.int64)
        number[order] = np.repeat(np.arange(len(size)), size)
        frequent = size > max(8, n // 16)
        column = np.cumsum(frequent) - 1
        here = frequent[number]
        self.weights = np.zeros((n, int(frequent.sum())), np.float32)
        self.weights[doc[here], column[number[here]]] = weight[here]
        self.at, self.docs, self.postings, self.n = edge, doc[order], weight[order], n
        rare = ~here & (size[number] > 1)  # a term of one document finds nothing
        first = np.concatenate([[0], np.cumsum(np.bincount(doc[rare], minlength=n))])
        self.query, self.first = number[rare], first
        self.scores: dict[int, np.ndarray] = {}

    def score(self, i: int, unused: np.ndarray) -> np.ndarray:
        if i not in self.scores:
            rows = np.arange(i, min(self.n, i + SEEDS))
            rows = rows[unused[rows] | (rows == i)]
            self.scores = dict(zip(rows.tolist(), (self.weights[rows] > 0).astype(np.float32) @ self.weights.T))
        q = self.query[self.first[i]:self.first[i + 1]]
        start, size = self.at[q], self.at[q + 1] - self.at[q]
        place = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
        return self.scores[i] + np.bincount(self.docs[place], self.postings[place], self.n)

    def neighbours(self, i: int, unused: np.ndarray) -> Iterator[int]:
        """Unused documents that share a term with document i, most similar first, equal ones in order."""
        score = np.where(unused, self.score(i, unused), 0).astype(np.int64)
        key = score * self.n + np.arange(self.n - 1, -1, -1)
        some = np.flatnonzero(score > 0)
        while len(some):
            if len(some) > FIRST:
                part = np.argpartition(-key[some], FIRST)
                now, some = some[part[:FIRST]], some[part[FIRST:]]
            else:
                now, some = some, some[:0]
            yield from now[np.argsort(-key[now])].tolist()


def fill(index: Bm25, seed: int, unused: np.ndarray) -> Iterator[int]:
    """The seed, its neighbours, and then what else is unused, in order."""
    yield seed
    yield from index.neighbours(seed, unused)
    yield from np.flatnonzero(unused).tolist()


def pack_shard(sizes: np.ndarray, index: Bm25, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length)."""
    n = len(sizes)
    done = sizes // window * window
    for i in range(n):
        for s in range(0, int(done[i]), window):
            yield [(i, s, window)]
    unused = sizes > done
    cursor = 0
    while True:
        while cursor < n and not unused[cursor]:
            cursor += 1
        if cursor == n:
            return
        now, room, seed = [], window, cursor
        for i in fill(index, seed, unused):
            take = int(min(room, sizes[i] - done[i]))
            now.append((i, int(done[i]), take))
            done[i] += take
            room -= take
            unused[i] = done[i] < sizes[i]
            if not room:
                break
        if not room:
            yield now
            continue
        left, pieces = window - room, iter(now)
        piece = next(pieces)
        for bit in reversed(range(window.bit_length())):  # the end of the shard, in powers of two
            need, seq = left & 1 << bit, []
            while need:
                i, s, k = piece
                take = min(need, k)
                seq.append((i, s, take))
                need -= take
                piece = (i, s + take, k - take) if take < k else next(pieces, None)
            if seq:
                yield seq


def shards(batches: Iterator[pa.RecordBatch], p: PackParams) -> Iterator[pa.Table]:
    kept, rows, size = [], 0, 0
    for batch in batches:
        off = np.concatenate([[0], np.cumsum(B.long_array(batch.column("bytes")))])
        for i, j in B.slices(off, p.shard_bytes):
            for a in range(i, j, p.shard_docs):
                b = min(j, a + p.shard_docs)
                if kept and (rows + b - a > p.shard_docs or size + off[b] - off[a] > p.shard_bytes):
                    yield pa.Table.from_batches(kept)
                    kept, rows, size = [], 0, 0
                kept.append(batch.slice(a, b - a))
                rows, size = rows + b - a, size + off[b] - off[a]
    if kept:
        yield pa.Table.from_batches(kept)


def encode(p: PackParams):
    """(doc_id, text) -> (doc_id, bytes of text, ids)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = T.encoder(p.tokenizer), np.array([p.end_id], np.uint32)
        for batch in batches:
            _, off = B.text_bytes(batch.column("text"))
            for i, j in B.slices(off, p.shard_bytes):
                ids = [held(np.concatenate([x, end])) for x in enc.encode(batch.column("text").slice(i, j - i).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(np.diff(off[i:j + 1])), B.binary_column(ids)], names=["doc_id", "bytes", "ids"])
    return run


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ids -> (term, df, documents, tokens), summed over the task; term -1 has the last two."""
    T.forget()
    df, n, tokens = np.zeros(0, np.int64), 0, 0
    for batch in batches:
        ids, at = flat(batch.column("ids"))
        for i, j in B.slices(at):
            _, t, _ = term_counts(ids[at[i]:at[j]], at[i:j + 1] - at[i])
            more = np.bincount(t, minlength=len(df))
            more[:len(df)] += df
            df = more
        n, tokens = n + len(at) - 1, tokens + len(ids)
    term = np.flatnonzero(df)
    zero = np.zeros(len(term), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(term, -1)), pa.array(np.append(df[term], 0)), pa.array(np.append(zero, n)), pa.array(np.append(zero, tokens))], names=["term", "df", "docs", "tokens"])


def corpus(coded: DataFrame) -> Corpus:
    """At most a row a token of the vocabulary comes to the driver."""
    rows = coded.select("ids").mapInArrow(count_terms, "term bigint, df bigint, docs bigint, tokens bigint").groupBy("term").agg(F.sum("df").alias("df"), F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).collect()
    df = np.zeros(max([r.term for r in rows], default=-1) + 1, np.int64)
    for r in rows:
        if r.term >= 0:
            df[r.term] = r.df
    n = sum(r.docs for r in rows)
    return Corpus(n, sum(r.tokens for r in rows) / max(1, n), df)


def heaviest(w: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Where each row has its greatest weight; the first place of equal ones."""
    at = B.starts_of(row)
    most = np.flatnonzero(w == np.repeat(np.maximum.reduceat(w, at[:-1]), np.diff(at)))
    return most[B.starts_of(row[most])[:-1]]


def route(all_: Corpus, parts: int, p: PackParams):
    """Adds the two heaviest terms that another document has, the rarer first, and a hash of that one for the partition.

    No more documents come together than have the term, so one that more have than a partition should hold is split by
    doc_id into as many hashes as it takes.
    """
    splits = np.maximum(1, -(-all_.df * parts // max(1, all_.n))).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.forget()
        idf = np.where(all_.df > 1, all_.idf, 0)  # weights are above 0 else; a document's length scales them alike
        for batch in batches:
            ids, at = flat(batch.column("ids"))
            two = np.empty(len(at) - 1, np.int64)
            for i, j in B.slices(at):
                row, t, f = term_counts(ids[at[i]:at[j]], at[i:j + 1] - at[i])
                w = idf[t] * f / (f + p.k1 * (1 - p.b + p.b * np.diff(at[i:j + 1]).astype(np.float64)[row] / max(1.0, all_.average)))
                a = heaviest(w, row)
                w[a] = -1
                a, b = t[a], t[heaviest(w, row)]
                later = (all_.df[a] > all_.df[b]) | (all_.df[a] == all_.df[b]) & (a > b)
                two[i:j] = np.where(later, b, a) << 32 | np.where(later, a, b)
            salt = B.mix(B.long_array(batch.column("doc_id")).view(np.uint64)) % splits[two >> 32]
            part = B.mix((two >> 32).astype(np.uint64) << np.uint64(32) | salt).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(two), pa.array(part)], names=["doc_id", "bytes", "ids", "route", "part"])
    return run


def pack_partition(p: PackParams, all_: Corpus):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.forget()
        seq = TaskContext.get().partitionId() << 36
        for table in shards(batches, p):
            docs = B.long_array(table["doc_id"])
            ids = [unheld(x) for x in table["ids"].to_pylist()]
            sizes = np.array([len(x) for x in ids])
            out = []
            for pieces in pack_shard(sizes, Bm25(ids, all_, p), p.window):
                at = 0
                for i, s, k in pieces:
                    out.append((int(docs[i]), s, k, zlib.crc32(ids[i][s:s + k].tobytes()), int(sizes[i]), seq, at))
                    at += k
                seq += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=[f.split()[0] for f in SCHEMA.split(", ")])
    return run


def pack(docs: DataFrame, p: PackParams = PackParams()) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents (doc_id, text)."""
    n = B.parts(docs.sparkSession)
    coded = B.cut(B.documents(docs).mapInArrow(encode(p), CODED))
    all_ = corpus(coded)
    routed = coded.mapInArrow(route(all_, n, p), CODED + ", route bigint, part bigint")
    return routed.repartition(n, "part").sortWithinPartitions("route", "doc_id").mapInArrow(pack_partition(p, all_), SCHEMA)

"""Benchmark decontamination: every passage of every document is a query to a BM25 index of the test items.

Items are indexed in units of at most `unit` words. A passage is `passage` words, and passages overlap by half. The
score of a unit is its BM25 score divided by what the unit would score for itself, so one threshold fits all lengths.
All units above `threshold` are retrieved by block-max WAND: terms carry their largest contribution, postings carry it
for each block of `block` units, and a unit is scored only where the bounds of the terms up to the pivot, in its block,
reach the threshold. The bounds of whole batches of passages are summed at once first, which ends nearly all of them.

A retrieved item is verified in the words around the passage: the share of the question's five-word shingles and the
share of the answer's words that occur there. The answer is what follows the last question mark, or the last sentence.

The index is broadcast; it holds at most `items_at_once` items and `bytes_at_once` of text, and more items are searched
in several rounds, so its size is bounded whatever the benchmark.

Null, empty and blank texts and items match nothing. Rows without doc_id or item_id are left out; repeated documents
are searched once for each row; an item_id that repeats counts as one item with the best of its texts.
"""
from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from readloom.llm import base as B


@dataclass(frozen=True)
class DecontaminateParams:
    passage: int = 64
    unit: int = 48
    threshold: float = 0.5
    k1: float = 1.2
    b: float = 0.75
    block: int = 4
    shingle: int = 5
    question: float = 0.6
    answer: float = 0.6
    items_at_once: int = 20000
    bytes_at_once: int = 32 << 20


def hash_words(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return B.words(raw, np.array([0, len(raw)]))[0]


def split_item(text: str) -> tuple[str, str]:
    """Question and answer."""
    at = text.rfind("?")
    if at >= 0 and text[at + 1:].strip():
        return text[:at + 1], text[at + 1:]
    ends = [m.end() for m in re.finditer(r"[.!?]\s+", text.rstrip())]
    if ends:
        return text[:ends[-1]], text[ends[-1]:]
    words = text.split()
    cut = max(1, len(words) * 2 // 3)
    return " ".join(words[:cut]), " ".join(words[cut:])


def units_of(w: np.ndarray, p: DecontaminateParams) -> list[np.ndarray]:
    starts = [max(0, min(s, len(w) - p.unit)) for s in range(0, len(w), p.unit)]
    return [w[s:s + p.unit] for s in starts]


def statistics(groups: Iterator[list[tuple[int, str]]], p: DecontaminateParams) -> tuple[Counter, int, float]:
    """Units that have each word, units, and words a unit, of the items of all groups."""
    df, n, words = Counter(), 0, 0
    for group in groups:
        for _, t in group:
            for u in units_of(hash_words(t), p):
                df.update(set(u.tolist()))
                n, words = n + 1, words + len(u)
    return df, n, words / n if n else 1.0


class Index:
    """Units of items: postings by term with contributions, block by block. `whole` has the statistics, else the items themselves."""

    def __init__(self, items: list[tuple[int, str]], p: DecontaminateParams, whole: tuple[Counter, int, float] | None = None):
        self.p = p
        self.cache: dict[int, tuple] = {}
        self.items = [(i, *[hash_words(x) for x in (t, *split_item(t))]) for i, t in items]
        units = [(k, u) for k, (_, w, _, _) in enumerate(self.items) for u in units_of(w, p)]
        self.unit_item = np.array([k for k, _ in units], np.int64)
        df, n, avg = whole or statistics([items], p)
        self.terms = np.array(sorted({h for _, w in units for h in w.tolist()}), np.uint64)
        number = {h: i for i, h in enumerate(self.terms.tolist())}
        postings: list[list[tuple[int, float]]] = [[] for _ in number]
        for u, (_, w) in enumerate(units):
            part = {h: np.log(1 + (n - df[h] + 0.5) / (df[h] + 0.5)) * tf * (p.k1 + 1) / (tf + p.k1 * (1 - p.b + p.b * len(w) / avg)) for h, tf in Counter(w.tolist()).items()}
            whole = sum(part.values())
            for h, x in part.items():
                postings[number[h]].append((u, x / whole))
        self.at = np.concatenate([[0], np.cumsum([len(x) for x in postings])]).astype(np.int64)
        flat = [y for x in postings for y in x]
        self.unit, self.score = np.array([u for u, _ in flat], np.int64), np.array([s for _, s in flat])
        self.most = np.maximum.reduceat(self.score, self.at[:-1]) if len(flat) else np.zeros(0)
        term = np.repeat(np.arange(len(postings)), np.diff(self.at))
        block = self.unit // p.block
        edge = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])) if len(flat) else np.zeros(0, np.int64)
        self.bound_block, self.bound = block[edge], np.maximum.reduceat(self.score, edge) if len(flat) else np.zeros(0)
        self.bound_at = np.searchsorted(term[edge], np.arange(len(postings) + 1))
        self.n_blocks = int(block.max()) + 1 if len(flat) else 0

    def lists(self, term: int) -> tuple[list, list, dict, float]:
        """Units, scores, bounds by block and largest score of a term, as Python values: they are read one at a time."""
        x = self.cache.get(term)
        if x is None:
            (a, b), (c, d) = self.at[term:term + 2].tolist(), self.bound_at[term:term + 2].tolist()
            x = self.cache[term] = (self.unit[a:b].tolist(), self.score[a:b].tolist(), dict(zip(self.bound_block[c:d].tolist(), self.bound[c:d].tolist())), float(self.most[term]))
        return x

    def wand(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """All units that score at least the threshold for a set of terms, unit by unit."""
        goal, size, out = self.p.threshold - 1e-9, self.p.block, []
        cursors = [[x[0][0], 0, *x] for x in map(self.lists, terms.tolist())]  # unit, place, units, scores, bounds, most
        while True:
            cursors.sort(key=itemgetter(0))
            total, pivot = 0.0, -1
            for k, x in enumerate(cursors):
                total += x[5]
                if total >= goal:
                    pivot = k
                    break
            if pivot < 0:
                return out
            u = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == u:
                pivot += 1
            involved, block = cursors[:pivot + 1], u // size
            if sum([x[4].get(block, 0.0) for x in involved]) < goal:  # no unit of this block can do it
                to = (block + 1) * size
                if pivot + 1 < len(cursors):
                    to = min(to, cursors[pivot + 1][0])
            else:
                to, value = u + 1, 0.0
                for x in involved:
                    k = bisect_left(x[2], u, x[1])
                    if k < len(x[2]) and x[2][k] == u:
                        value += x[3][k]
                if value >= goal:
                    out.append((u, value))
            ended = False
            for x in involved:
                x[1] = k = bisect_left(x[2], to, x[1])
                if k < len(x[2]):
                    x[0] = x[2][k]
                else:
                    x[0], ended = -1, True
            if ended:
                cursors = [x for x in cursors if x[0] >= 0]

    def search(self, h: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(row, first word of the passage, unit, score) for all passages of rows of words."""
        if not len(self.terms) or not len(h):
            return
        half = self.p.passage // 2
        term = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        known = np.flatnonzero(self.terms[term] == h)
        row = np.searchsorted(at, known, "right") - 1
        step = (known - at[row]) // half
        first = np.concatenate([[0], np.cumsum(np.diff(at) // half + 2)])  # a number for each passage of each row
        one = first[row] + step
        size = np.uint64(len(self.terms))
        key = np.unique(np.concatenate([one, one + 1]).astype(np.uint64) * size + np.tile(term[known], 2).astype(np.uint64))
        passage, t = (key // size).astype(np.int64), (key % size).astype(np.int64)
        goal = self.p.threshold - 1e-9
        edge = B.starts_of(passage)
        alive = np.add.reduceat(self.most[t], edge[:-1]) >= goal if len(t) else np.zeros(0, bool)
        for a, b in zip(edge[:-1][alive].tolist(), edge[1:][alive].tolist()):
            terms = t[a:b]
            n = self.bound_at[terms + 1] - self.bound_at[terms]
            place = np.repeat(self.bound_at[terms] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            if np.bincount(self.bound_block[place], self.bound[place]).max() < goal:
                continue
            r = int(np.searchsorted(first, passage[a], "right")) - 1
            for u, s in self.wand(terms):
                yield r, int(passage[a] - first[r] - 1) * half, u, s

    def verify(self, words: np.ndarray, start: int, item: int) -> tuple[float, float]:
        """Shares of the question's shingles and of the answer's words around a passage."""
        _, whole, question, answer = self.items[item]
        k = self.p.shingle
        near = words[max(0, start - len(whole)):max(0, start) + self.p.passage + len(whole)]
        q, _ = B.shingle_sets(question, np.array([0, len(question)]), min(k, max(1, len(question))))
        n, _ = B.shingle_sets(near, np.array([0, len(near)]), min(k, max(1, len(question))))
        share = float(np.isin(q, n).mean()) if len(q) else 1.0
        return share, float(np.isin(answer, near).mean()) if len(answer) else 1.0


def find(index: Index, ids: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = B.long_array(batch.column("doc_id"))
            raw, off = B.text_bytes(batch.column("text"))
            for i, j in B.slices(off):
                h, _, _, at = B.words(raw[off[i]:off[j]], off[i:j + 1] - off[i])
                best: dict[tuple[int, int], list[float]] = {}
                for r, start, u, s in index.search(h, at):
                    k = int(index.unit_item[u])
                    q, a = index.verify(h[at[r]:at[r + 1]], start, k)
                    old = best.setdefault((r, ids[k]), [0.0, 0.0, 0.0])
                    if (min(q, a), q, s) > (min(old[1:]), old[1], old[0]):
                        best[r, ids[k]] = [max(s, old[0]), q, a]
                    else:
                        old[0] = max(s, old[0])
                if best:
                    yield pa.RecordBatch.from_arrays([pa.array([int(docs[i + r]) for r, _ in best], pa.int64()), pa.array([k for _, k in best], pa.int64()), *[pa.array([v[c] for v in best.values()], pa.float64()) for c in range(3)]], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])
    return run


def rounds(items: DataFrame, p: DecontaminateParams) -> Iterator[list[tuple[int, str]]]:
    """Items in groups by hash, twice as many as the bounds ask for, so that uneven groups stay within them."""
    t = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    shard = F.pmod(F.xxhash64("item_id", "text"), F.lit(1 << 20))
    size = t.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text").cast("bigint")), F.lit(0)).alias("b")).head()
    n = max(1, -(-size.n // p.items_at_once), -(-4 * size.b // p.bytes_at_once))
    n = n if n == 1 else 2 * n
    for k in range(n):
        part = t if n == 1 else t.where(F.pmod(shard, F.lit(n)) == k)
        rows = part.orderBy("item_id", "text").collect()
        if rows:
            yield [(r.item_id, r.text) for r in rows]


def contaminated(docs: DataFrame, items: DataFrame, p: DecontaminateParams = DecontaminateParams()) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, contaminated): every item retrieved for a document."""
    d = B.documents(docs)
    schema = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double"
    whole = statistics(rounds(items, p), p)
    found = [d.mapInArrow(find(Index(group, p, whole), [i for i, _ in group]), schema) for group in rounds(items, p)]
    if not found:
        found = [d.sparkSession.createDataFrame([], schema)]
    out = reduce(DataFrame.unionAll, found)
    return out.withColumn("contaminated", (F.col("question_overlap") >= p.question) & (F.col("answer_overlap") >= p.answer))


def drop_contaminated(docs: DataFrame, items: DataFrame, p: DecontaminateParams = DecontaminateParams()) -> DataFrame:
    """docs without those that hold a test item; every column stays."""
    bad = contaminated(docs, items, p).where("contaminated").select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["__bad"], "left_anti")



"""Nearest neighbours by largest inner product, in a hierarchical k-means tree with best-bin-first search.

The tree is fitted on a bounded, documented sample (`sample` vectors, by hash order); every vector is put in a leaf by
descent. A query walks the tree through a priority queue, nearest centroid first, and visits as many leaves as reach
`recall` on sample queries against brute force; that number is found by widening it step by step. Neighbours are
compared in double precision.

Equal vectors are one candidate that carries the 21 smallest of their ids: with ties going to smaller ids, no query can
return others. Neighbouring leaves are bundled up to about `block` candidates, and a query has one row a bundle that
says which of its leaves are visited; only those are searched. Bundles are split into blocks of `block` candidates, and
queries of much visited bundles likewise, so no bundle becomes one task.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part. Rows
without vec_id are left out. A vec_id that repeats counts once for each different vector.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from readloom.llm import base as B


@dataclass(frozen=True)
class AnnParams:
    k: int = 20
    sample: int = 20000
    leaf: int = 256
    branch: int = 8
    recall: float = 0.94
    queries: int = 400
    block: int = 2048
    seed: int = 3


class Tree:
    """Centroids of a k-means tree. Node 0 is the root; leaves are numbered in order."""

    def __init__(self):
        self.children: list[list[int]] = []
        self.centers: list[np.ndarray] = []
        self.leaf: list[int] = []
        self.sizes: list[int] = []

    def add(self) -> int:
        self.children.append([])
        self.centers.append(None)
        self.leaf.append(-1)
        return len(self.leaf) - 1

    @property
    def n_leaves(self) -> int:
        return len(self.sizes)

    def fit(self, x: np.ndarray, target: int, branch: int, rng: np.random.Generator) -> int:
        node = self.add()
        if len(x) > target and len(x) > branch:
            c = x[rng.choice(len(x), branch, replace=False)]
            for _ in range(8):
                own = nearest(x, c)
                c = np.stack([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(len(c))])
            own = nearest(x, c)
            used = np.unique(own)
            if len(used) > 1:
                self.centers[node] = c[used]
                self.children[node] = [self.fit(x[own == i], target, branch, rng) for i in used]
                return node
        self.leaf[node] = self.n_leaves
        self.sizes.append(len(x))
        return node

    def assign(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
            elif len(rows):
                own = nearest(x[rows], self.centers[node])
                todo += [(c, rows[own == i]) for i, c in enumerate(self.children[node])]
        return out

    def bundles(self, scale: float, block: int) -> np.ndarray:
        """Bundle of each leaf: leaves in a row, of `block` vectors at most by their sample sizes times `scale`, or one leaf."""
        out, held = [], 0.0
        for size in self.sizes:
            held += size * scale
            fresh = not out or held > block
            out.append(out[-1] + 1 if out and fresh else out[-1] if out else 0)
            if fresh:
                held = size * scale
        return np.array(out, np.int32)

    def visit(self, q: np.ndarray, m: int) -> list[list[int]]:
        """The first m leaves of each query, best bin first."""
        inner = [i for i, c in enumerate(self.children) if c]
        place = {c: k for k, c in enumerate(c for i in inner for c in self.children[i])}
        far = -(q @ np.concatenate([self.centers[i] for i in inner]).T) if inner else np.zeros((len(q), 0))
        out = []
        for s in far:
            s, heap, leaves = s.tolist(), [(0.0, 0)], []
            while heap and len(leaves) < m:
                _, node = heapq.heappop(heap)
                if self.leaf[node] >= 0:
                    leaves.append(self.leaf[node])
                else:
                    for c in self.children[node]:
                        heapq.heappush(heap, (s[place[c]], c))
            out.append(leaves)
        return out


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1) - 2 * (x @ c.T)).argmin(1)


def calibrate(tree: Tree, x: np.ndarray, total: int, p: AnnParams, rng: np.random.Generator) -> int:
    """Fewest leaf visits with the wanted recall on the sample, widened by a sixteenth at a time.

    Of the k nearest among all `total` vectors, the sample holds its share, so that many are looked for in it.
    """
    q = rng.choice(len(x), min(p.queries, len(x)), replace=False)
    leaf = tree.assign(x)
    s = x[q] @ x.T
    s[np.arange(len(q)), q] = -np.inf
    k = min(-(-p.k * len(x) // total), len(x) - 1)
    if k < 1:
        return tree.n_leaves
    true = np.argpartition(-s, k - 1, axis=1)[:, :k]
    place = np.stack([np.argsort(o)[leaf[t]] for o, t in zip(tree.visit(x[q], tree.n_leaves), true)])
    m = 1
    while m < tree.n_leaves and (place < m).mean() < p.recall:
        m = min(tree.n_leaves, max(m + 1, m * 17 // 16))
    return m


def valid(vectors: DataFrame) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    t = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"), bad.alias("bad"), some.alias("some"))
    t = t.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce("bad", F.lit(False)) & F.coalesce("some", F.lit(False))).select("vec_id", "v")
    size = t.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()  # one row
    return t.where(F.size("v") == (size[0].n if size else 0))


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def search(vectors: DataFrame, p: AnnParams = AnnParams(), every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each vector whose id is divisible by `every`, itself excluded."""
    n = B.parts(vectors.sparkSession)
    keep = p.k + 1
    v = valid(vectors)
    first = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    few = v.distinct().withColumn("n", first).where(F.col("n") <= keep)
    cls = B.cut(few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("cid", F.col("ids")[0]))
    rows = cls.select("v").orderBy(F.xxhash64("v"), "v").limit(p.sample).collect()  # bounded by p.sample
    empty = vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if not rows:
        return empty
    x = np.array([r.v for r in rows])
    total = cls.count()
    rng = np.random.default_rng(p.seed)
    tree = Tree()
    tree.fit(x, max(8, p.leaf * len(x) // max(total, 1)), p.branch, rng)
    m = calibrate(tree, x, total, p, rng)
    bundle = tree.bundles(total / len(x), p.block)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = tree.assign(matrix(b.column("v")))
            yield pa.RecordBatch.from_arrays([pa.array(bundle[leaf]), pa.array(leaf), b.column("cid"), b.column("ids"), b.column("v")], names=["bundle", "leaf", "cid", "ids", "v"])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = matrix(b.column("v"))
            for i in range(0, len(q), 256):
                found = tree.visit(q[i:i + 256], m)
                leaf = np.concatenate(found).astype(np.int32)
                asks = np.repeat(np.arange(len(found)), [len(r) for r in found]) + i
                order = np.lexsort((leaf, asks))
                leaf, asks = leaf[order], asks[order]
                own = bundle[leaf]  # ascends with the leaf
                start = np.flatnonzero(np.concatenate([[True], (asks[1:] != asks[:-1]) | (own[1:] != own[:-1])]))
                lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(leaf)), pa.int32()), pa.array(leaf))
                at = pa.array(asks[start])
                yield pa.RecordBatch.from_arrays([pa.array(own[start]), lists, b.column("qid").take(at), b.column("v").take(at)], names=["bundle", "leaves", "qid", "v"])

    vec = "array<double>"
    placed = B.cut(cls.select("cid", "ids", "v").mapInArrow(assign, f"bundle int, leaf int, cid bigint, ids array<bigint>, v {vec}"))
    asked = v.where(F.pmod("vec_id", F.lit(every)) == 0)
    q = asked.groupBy("v").agg(F.min("vec_id").alias("qid"))
    seen = B.cut(q.select("qid", "v").mapInArrow(visits, f"bundle int, leaves array<int>, qid bigint, v {vec}"))
    # both tables have a row a bundle, and there are at most as many bundles as sample vectors
    parts = lambda df, name: df.groupBy("bundle").agg(F.ceil(F.count(F.lit(1)) / p.block).cast("int").alias(name))
    split = F.broadcast(parts(placed, "nc").join(parts(seen, "nq"), "bundle"))
    part = lambda c, of: F.pmod(F.xxhash64(c), F.col(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = placed.join(split, "bundle").withColumn("bc", part("cid", "nc")).withColumn("bq", each("nq")).select("bundle", "bc", "bq", "leaf", "cid", "ids", "v")
    right = seen.join(split, "bundle").withColumn("bq", part("qid", "nq")).withColumn("bc", each("nc")).select("bundle", "bc", "bq", "leaves", "qid", "v")

    def meet(cand: pa.Table, ask: pa.Table) -> pa.Table:
        """The best of one block, in the leaves that they visit, for each of its queries: a row a query."""
        c, qs = matrix(cand["v"]), matrix(ask["v"])
        qid, size, score, vec = [], [0], [], []
        if len(c) and len(qs):
            lists = cand["ids"].combine_chunks()
            flat, off = B.long_array(lists.flatten()), np.concatenate([[0], np.cumsum(B.long_array(lists.value_lengths()))])
            asked_id = B.long_array(ask["qid"].combine_chunks())
            held, leaf = np.unique(cand["leaf"].to_numpy(), return_inverse=True)
            wanted = ask["leaves"].combine_chunks()
            n = B.long_array(wanted.value_lengths())
            wish = wanted.flatten().to_numpy()
            at = np.searchsorted(held, wish).clip(max=len(held) - 1)
            visited = np.zeros((len(qs), len(held)), bool)
            visited[np.repeat(np.arange(len(qs)), n), at] |= held[at] == wish
        for i in range(0, len(qs) if len(c) else 0, 256):
            part = qs[i:i + 256]
            s = np.where(visited[i:i + 256, leaf], part @ c.T, -np.inf)
            take = min(len(c), keep + 4)
            top = np.argpartition(-s, take - 1, axis=1)[:, :take] if take < len(c) else np.broadcast_to(np.arange(len(c)), s.shape)
            exact = np.einsum("qd,qkd->qk", part, c[top])
            real = np.take_along_axis(s, top, 1) > -np.inf
            for k in range(len(part)):
                own = top[k][real[k]]
                if not len(own):
                    continue
                n = off[own + 1] - off[own]
                ids = flat[np.repeat(off[own] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                worse = -np.repeat(exact[k][real[k]], n)
                order = np.lexsort((ids, worse))[:keep]
                qid.append(asked_id[i + k])
                size.append(size[-1] + len(order))
                score.append(worse[order])
                vec.append(ids[order])
        z = lambda x, t: pa.array(np.concatenate(x) if x else [], t)
        best = pa.StructArray.from_arrays([z(score, pa.float64()), z(vec, pa.int64())], names=["worse", "vec_id"])
        return pa.table({"qid": pa.array(qid, pa.int64()), "best": pa.ListArray.from_arrays(pa.array(size, pa.int32()), best)})

    near = left.groupBy("bundle", "bc", "bq").cogroup(right.groupBy("bundle", "bc", "bq")).applyInArrow(meet, "qid bigint, best array<struct<worse:double,vec_id:bigint>>")
    top = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, keep)
    best = near.groupBy("qid").agg(top.alias("best")).select("qid", F.explode("best").alias("x")).select("qid", (-F.col("x.worse")).alias("score"), "x.vec_id")
    mine = asked.join(q.select("v", "qid"), "v").select(F.col("vec_id").alias("query_id"), "qid").distinct()
    pairs = mine.join(best, "qid").where("query_id <> vec_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= p.k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score").repartition(n)

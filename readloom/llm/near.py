"""Near-duplicate documents by a chosen-path set similarity join.

Every document's set of word shingles is branched along trees. At a node each set chooses its smallest token under the
node's own hash, and goes on to the child of that token; sets of similarity s stay together with probability s a level.
Independent trees raise the recall: at similarity 0.8, two levels and 16 trees miss a pair with probability 0.36^16.
Small nodes are compared exhaustively on minwise signatures, large ones are branched on. What is compared close
enough is confirmed on the full sets, and confirmed links make connected components.

Equal sets are one class from the start, so groups of exact copies cost nothing. Dense groups of near copies are joined
in two rounds: first one link for each member, confirmed; then those members that look close to a document of another
component meet in their nodes with their full sets, where an inverted index compares them with all others. No pair
that could join two components is skipped, and no pair but a confirmed link leaves a node.

Rows without doc_id are left out; null, empty and blank texts link with nothing. Rows of one doc_id are one document,
which is linked with whatever one of its texts is linked with; each row is returned, with its own n_shingles.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from readloom.llm import base as B


@dataclass(frozen=True)
class NearParams:
    shingle: int = 5
    #: Links have 100 * intersection >= percent * union.
    percent: int = 80
    trees: int = 16
    levels: int = 2
    signature: int = 128
    #: Signature agreement from which a pair is compared on full sets: 4.5 standard deviations below the threshold.
    look: float = 0.64
    #: Members up to which a node is compared exhaustively at once; larger ones are compared in blocks or branched.
    small: int = 256
    branch: int = 4096


_U32 = np.uint32
_SEEDS = np.random.default_rng(91).integers(1, 2**63, 4096, dtype=np.uint64) | np.uint64(1)


def sketch(sets: np.ndarray, at: np.ndarray, p: NearParams) -> tuple[np.ndarray, np.ndarray]:
    """Of non-empty sets: node keys after p.levels levels (rows x trees) and signatures (rows x p.signature, one byte each)."""
    n = len(at) - 1
    size = np.diff(at)
    low = (sets >> np.uint64(16)).astype(_U32)
    sig = np.empty((n, p.signature), np.uint8)
    for j in range(p.signature):
        a = low * _U32(int(_SEEDS[j]) & 0xFFFFFFFF | 1)
        a ^= a >> _U32(15)
        a *= _U32(int(_SEEDS[j]) >> 32 | 1)
        sig[:, j] = np.minimum.reduceat(a, at[:-1]) * _U32(0x9E3779B1) >> _U32(24)
    keys = np.empty((n, p.trees), np.uint64)
    for t in range(p.trees):
        node = np.full(n, _SEEDS[1024 + t], np.uint64)
        for level in range(p.levels):
            h = (sets ^ np.repeat(node, size)) * _SEEDS[2048 + t * p.levels + level]
            h ^= h >> np.uint64(32)
            h *= B.M1
            node = B.mix(node ^ np.minimum.reduceat(h, at[:-1]))
        keys[:, t] = node
    return keys, sig


def describe(p: NearParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            raw, at = B.text_bytes(batch.column("text"))
            for i, j in B.slices(at):
                h, _, _, w = B.words(raw[at[i]:at[j]], at[i:j + 1] - at[i])
                sets, to = B.shingle_sets(h, w, p.shingle)
                size = np.diff(to)
                solid = np.flatnonzero(size)
                nodes, sigs = [None] * (j - i), [None] * (j - i)
                f = np.zeros((2, j - i), np.uint64)
                if len(solid):
                    tight = np.concatenate([to[solid], to[-1:]])
                    keys, sig = sketch(sets, tight, p)
                    f[0, solid] = np.add.reduceat(B.mix(sets), tight[:-1])
                    f[1, solid] = np.add.reduceat(B.mix(sets ^ _SEEDS[7]), tight[:-1])
                    for x, r in enumerate(solid):
                        nodes[r], sigs[r] = keys[x].tobytes(), sig[x].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(size.astype(np.int64)), pa.array(f[0].view(np.int64)), pa.array(f[1].view(np.int64)), B.binary_column(nodes), B.binary_column(sigs)],
                    names=["doc_id", "n_shingles", "f1", "f2", "nodes", "sig"])
    return run


def explode_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, at = B.text_bytes(batch.column("nodes"))
        keys = np.frombuffer(raw.tobytes(), np.int64)
        ids = np.repeat(B.long_array(batch.column("cid")), np.diff(at) // 8)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids)], names=["node", "cid"])


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal signature bytes, all rows of a against all of b."""
    out = np.empty((len(a), len(b)), np.float32)
    step = max(1, (1 << 22) // max(1, b.size))
    for i in range(0, len(a), step):
        out[i:i + step] = (a[i:i + step, None, :] == b[None, :, :]).mean(2, dtype=np.float32)
    return out


def first_links(ids: np.ndarray, sig: np.ndarray, p: NearParams) -> list[np.ndarray]:
    """One link for each member: to the most similar of the members before it, in blocks."""
    out = []
    for i in range(1, len(ids), p.small):
        rows = np.arange(i, min(i + p.small, len(ids)))
        near = np.concatenate([np.arange(min(p.small, i)), rows]) if i > p.small else np.arange(rows[-1] + 1)
        est = agreement(sig[rows], sig[near])
        est[near[None, :] >= rows[:, None]] = 0
        best = est.argmax(1)
        ok = est[np.arange(len(rows)), best] >= p.look
        out.append(np.stack([ids[rows[ok]], ids[near[best[ok]]]], 1))
    return out


def cross_nodes(node: np.uint64, ids: np.ndarray, sig: np.ndarray, comp: np.ndarray, p: NearParams, depth: int = 0) -> list[tuple[np.uint64, np.ndarray]]:
    """Nodes and those members that look close to one of another component. Members of the largest component are not compared with each other."""
    value, inverse, count = np.unique(comp, return_inverse=True, return_counts=True)
    if len(value) < 2:
        return []
    rest = np.flatnonzero(inverse != count.argmax())
    if len(ids) > p.branch and depth < 6 and len(rest) > p.small:
        out = []
        places = B.mix(node + np.arange(64, dtype=np.uint64)) % np.uint64(p.signature)  # by node, so that trees stay independent
        for c in places[np.sort(np.unique(places, return_index=True)[1])][:4].astype(np.int64):  # each member goes to the child of its token
            order = np.argsort(sig[:, c], kind="stable")
            for a, b in zip((s := B.starts_of(sig[order, c]))[:-1], s[1:]):
                if b - a > 1:
                    g = order[a:b]
                    child = B.mix(np.array([node ^ _SEEDS[3000 + c]]) + sig[g[:1], c])[0]
                    out += cross_nodes(child, ids[g], sig[g], comp[g], p, depth + 1)
        return out
    close = np.zeros(len(ids), bool)
    for i in range(0, len(rest), p.small):
        r = rest[i:i + p.small]
        x, y = np.nonzero((agreement(sig[r], sig) >= p.look) & (inverse[r][:, None] != inverse[None, :]))
        close[r[x]] = close[y] = True
    return [(node, ids[close])] if close.any() else []


def links_in_nodes(p: NearParams):
    """(node, cid, sig) -> links to confirm, one for each member."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in B.runs(batches, "node"):
            node, ids = B.long_array(table["node"]), B.long_array(table["cid"])
            sig = B.text_bytes(table["sig"])[0].reshape(len(ids), -1)
            at, out = B.starts_of(node), []
            for a, b in zip(at[:-1], at[1:]):
                order = np.argsort(ids[a:b]) + a
                out += first_links(ids[order], sig[order], p)
            if out and len(both := np.concatenate(out)):
                both = np.unique(np.sort(both, 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])
    return run


def rest_in_nodes(p: NearParams):
    """(node, cid, sig, comp) -> (node, cid, comp) of the members that must be compared on full sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in B.runs(batches, "node"):
            node, ids, comp = (B.long_array(table[c]) for c in ("node", "cid", "comp"))
            sig = B.text_bytes(table["sig"])[0].reshape(len(ids), -1)
            at = B.starts_of(node)
            for a, b in zip(at[:-1], at[1:]):
                order = np.argsort(ids[a:b]) + a
                own = dict(zip(ids[order].tolist(), comp[order].tolist()))
                for key, some in cross_nodes(node[a:a + 1].view(np.uint64)[0], ids[order], sig[order], comp[order], p):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), key, np.uint64).view(np.int64)), pa.array(some), pa.array([own[x] for x in some.tolist()], pa.int64())], names=["node", "cid", "comp"])
    return run


def compare_nodes(p: NearParams):
    """(node, cid, comp, text) -> confirmed links (a, b) that connect the components of a node; no pair leaves a node unless it is a link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in B.runs(batches, "node"):
            node, ids, comp = (B.long_array(table[c]) for c in ("node", "cid", "comp"))
            raw, off = B.text_bytes(table["text"])
            at, out = B.starts_of(node), []
            for a, b in zip(at[:-1], at[1:]):
                out += exact_links(ids[a:b], comp[a:b], raw[off[a]:off[b]], off[a:b + 1] - off[a], p)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in out], pa.int64()), pa.array([max(x) for x in out], pa.int64())], names=["a", "b"])
    return run


def exact_links(ids: np.ndarray, comp: np.ndarray, raw: np.ndarray, off: np.ndarray, p: NearParams) -> list[tuple[int, int]]:
    """Links of the members of one node between different components, by an inverted index of their full sets."""
    sets, size = [], []
    for i, j in B.slices(off):
        h, _, _, w = B.words(raw[off[i]:off[j]], off[i:j + 1] - off[i])
        s, to = B.shingle_sets(h, w, p.shingle)
        sets.append(s)
        size.append(np.diff(to))
    sets, size = np.concatenate(sets), np.concatenate(size)
    to = np.concatenate([[0], np.cumsum(size)])
    order = np.argsort(sets, kind="stable")
    member = np.repeat(np.arange(len(ids)), size)[order]
    starts = B.starts_of(sets[order])
    rank = np.empty(len(sets), np.int64)
    rank[order] = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    value, own, count = np.unique(comp, return_inverse=True, return_counts=True)
    trees, out = B.Forest(len(value)), []
    for x in np.flatnonzero(own != count.argmax()).tolist():
        r = rank[to[x]:to[x + 1]]
        shared = np.zeros(len(ids), np.int64)
        for k, m in B.slices(np.concatenate([[0], np.cumsum(starts[r + 1] - starts[r])]), 1 << 18):  # long texts have very many postings
            s = starts[r[k:m]]
            n = starts[r[k:m] + 1] - s
            place = np.repeat(s - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            shared += np.bincount(member[place], minlength=len(ids))
        for y in np.flatnonzero((100 * shared >= p.percent * (size[x] + size - shared)) & (shared > 0)).tolist():
            if trees.join(int(own[x]), int(own[y])):
                out.append((int(ids[x]), int(ids[y])))
    return out


def confirm_pairs(p: NearParams):
    """Pairs with both texts -> those whose full sets are similar enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = B.long_array(batch.column("a")), B.long_array(batch.column("b"))
            (ra, oa), (rb, ob) = B.text_bytes(batch.column("ta")), B.text_bytes(batch.column("tb"))
            keep = np.zeros(len(a), bool)
            for i, j in B.slices(oa + ob, B.SLICE // 2):
                raw = np.concatenate([ra[oa[i]:oa[j]], rb[ob[i]:ob[j]]])
                at = np.concatenate([oa[i:j + 1] - oa[i], ob[i + 1:j + 1] - ob[i] + oa[j] - oa[i]])
                h, _, _, w = B.words(raw, at)
                sets, to = B.shingle_sets(h, w, p.shingle)
                n = j - i
                for x in range(n):
                    one, two = sets[to[x]:to[x + 1]], sets[to[n + x]:to[n + x + 1]]
                    merged = np.concatenate([one, two])
                    merged.sort()
                    shared = int(np.count_nonzero(merged[1:] == merged[:-1]))
                    keep[i + x] = shared > 0 and 100 * shared >= p.percent * (len(merged) - shared)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])
    return run


def near_duplicates(docs: DataFrame, p: NearParams = NearParams()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text)."""
    d = B.documents(docs)
    if not _repeats(d):
        return _near_duplicates(d, p)
    rows = B.cut(d.distinct().withColumn("row", F.monotonically_increasing_id()))
    found = _near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"), p).select(F.col("doc_id").alias("row"), "n_shingles", F.col("component_id").alias("part"))
    found = B.cut(found.join(rows.select("row", "doc_id"), "row"))
    first = found.groupBy("doc_id").agg(F.min("part").alias("to"))  # all rows of a document are in one component
    joined = B.components(found.join(first, "doc_id").select(F.col("part").alias("a"), F.col("to").alias("b")))
    found = found.join(joined.select(F.col("v").alias("part"), "component"), "part", "left").withColumn("whole", F.coalesce("component", "part"))
    least = found.groupBy("whole").agg(F.min("doc_id").alias("component_id"))
    named = found.join(least, "whole").select("row", "n_shingles", "component_id")
    one = rows.join(named, "row").select(F.col("doc_id").alias("id"), F.col("text").alias("own"), "n_shingles", "component_id")
    out = d.join(one, (d["doc_id"] == one["id"]) & d["text"].eqNullSafe(one["own"])).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def _near_duplicates(d: DataFrame, p: NearParams) -> DataFrame:
    """Of documents with an id each."""
    n = B.parts(d.sparkSession)
    facts = B.cut(B.map_batches(d, describe(p), "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, nodes binary, sig binary"))
    classes = facts.where("n_shingles > 0").groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("cid"))
    heads = facts.join(classes.select("cid"), F.col("doc_id") == F.col("cid"), "left_semi").select(F.col("doc_id").alias("cid"), "nodes", "sig")
    records = B.map_batches(heads.select("cid", "nodes"), explode_nodes, "node bigint, cid bigint")
    shared = records.groupBy("node").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("node")
    members = B.cut(records.join(shared, "node").join(heads.select("cid", "sig"), "cid").select("node", "cid", "sig"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        side = lambda k: d.select(F.col("doc_id").alias(k), F.col("text").alias(f"t{k}"))
        whole = pairs.join(side("a"), "a").join(side("b"), "b")
        return B.cut(B.map_batches(whole, confirm_pairs(p), "a bigint, b bigint"))

    grouped = lambda df: df.repartition(n, "node").sortWithinPartitions("node")
    one = confirmed(B.map_batches(grouped(members), links_in_nodes(p), "a bigint, b bigint").distinct())
    comp = B.components(one)
    labelled = members.join(comp.select(F.col("v").alias("cid"), "component"), "cid", "left").select("node", "cid", "sig", F.coalesce("component", "cid").alias("comp"))
    rest = B.map_batches(grouped(labelled), rest_in_nodes(p), "node bigint, cid bigint, comp bigint").distinct()
    whole = rest.join(d.select(F.col("doc_id").alias("cid"), "text"), "cid")
    two = B.cut(B.map_batches(grouped(whole), compare_nodes(p), "a bigint, b bigint"))
    comp = B.components(one.unionAll(two)).select(F.col("v").alias("cid"), "component")
    named = classes.join(comp, "cid", "left").select("f1", "f2", "n_shingles", F.coalesce("component", "cid").alias("class_id"))
    found = facts.select("doc_id", "n_shingles", "f1", "f2").join(named, ["f1", "f2", "n_shingles"], "left")
    out = found.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def _repeats(d: DataFrame) -> bool:
    row = d.agg(F.count("doc_id").alias("n"), F.count_distinct("doc_id").alias("m")).head()
    return row.n != row.m


def keep_one(docs: DataFrame, p: NearParams = NearParams(), before: DataFrame | None = None) -> DataFrame:
    """docs without all but one document of each group, that of the smallest doc_id; every column stays.

    before (doc_id, text) has the texts from before lines were taken out of some. Near copies whose shared lines are gone
    no longer look alike, so documents are linked by those texts as well, if they hold every line of the text of today.
    """
    links = near_duplicates(docs, p).select("doc_id", "component_id")
    if before is not None:
        hashes = lambda text: F.transform(F.split(text, "\n", -1), lambda x: F.xxhash64(x))
        now = B.documents(docs).select(F.col("doc_id").alias("id"), hashes("text").alias("now")).distinct()
        holds = F.size(F.array_except("now", hashes("text"))) == 0
        then = B.documents(before).join(now, (F.col("doc_id") == F.col("id")) & holds, "left_semi")  # else rows of one doc_id multiply
        both = B.cut(links.unionAll(near_duplicates(B.cut(then), p).select("doc_id", "component_id")))
        joined = B.components(both.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")))
        links = links.select("doc_id").join(joined.select(F.col("v").alias("doc_id"), F.col("component").alias("component_id")), "doc_id", "left").select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))
    kept = links.where("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, docs["doc_id"] == kept["__kept"], "left_semi")


#: op9 over the table documents, for DuckDB.
ORACLE = r"""WITH RECURSIVE
  d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS sh FROM d),
  x AS (SELECT doc_id, unnest(sh) AS g FROM s),
  pairs AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS n FROM x p JOIN x q ON p.g = q.g AND p.doc_id < q.doc_id GROUP BY 1, 2),
  links AS (SELECT a, b FROM pairs JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 100 * n >= 80 * (len(p.sh) + len(q.sh) - n)),
  both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
  reach(v, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.b, r.c FROM reach r JOIN both_ways l ON l.a = r.v),
  named AS (SELECT v, min(c) AS component_id FROM reach GROUP BY v)
  SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN named ON v = doc_id"""

import math
import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from readloom.llm import decontaminate as D, packing, queries
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.01"


def brute_scores(docs, items, p):
    """Every passage against every unit, by the formula."""
    units = []
    for i, t in items:
        w = brute.words(t)
        for s in range(0, len(w), p.unit):
            s = max(0, min(s, len(w) - p.unit))
            units.append((i, w[s:s + p.unit]))
    df = Counter(x for _, w in units for x in set(w))
    n, avg = len(units), np.mean([len(w) for _, w in units])
    part = []
    for i, w in units:
        c = {x: math.log(1 + (n - df[x] + .5) / (df[x] + .5)) * f * (p.k1 + 1) / (f + p.k1 * (1 - p.b + p.b * len(w) / avg)) for x, f in Counter(w).items()}
        part.append((i, c, sum(c.values())))
    out, half = defaultdict(float), p.passage // 2
    for d, t in docs:
        w = brute.words(t)
        for s in range(-half, len(w), half):
            terms = set(w[max(0, s):s + p.passage])
            for i, c, whole in part:
                v = sum(c[x] for x in terms & c.keys()) / whole
                if v >= p.threshold - 1e-9:
                    out[d, i] = max(out[d, i], v)
    return out


def test_like_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id < 700").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    p = D.DecontaminateParams(threshold=0.3)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in D.contaminated(df, spark.createDataFrame(items, "item_id long, text string"), p).collect()}
    want = brute_scores(docs, items, p)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got) and len(got) > 10


def test_planted(spark):
    got = {(r.doc_id, r.item_id) for r in queries.op7_decontaminate(spark, SF).where("contaminated").collect()}
    items = {i: t for i, t in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = set()
    for d, t in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        s = brute.shingles(t, 5)
        want |= {(d, i) for i, x in items.items() if len(brute.shingles(x, 5) & s) >= 0.8 * len(brute.shingles(x, 5))}
    assert got == want and len(got) > 10


def test_edges(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    long = " ".join(word() for _ in range(300))
    items = [(1, "What is the name of the river by the town of kabo? The lomu."), (2, long), (3, None), (4, ""), (None, "x y z"), (5, "single"), (1, "What is the name of the river by the town of kabo? The lomu.")]
    filler = lambda n: " ".join(word() for _ in range(n))
    docs = [(1, filler(50) + " " + items[0][1].upper() + " " + filler(500)), (2, filler(333) + " " + long + " " + filler(10)), (3, None), (4, ""), (5, filler(3000)), (6, items[0][1]), (6, items[0][1]), (7, "what is the name of the river by the town of kabo?"), (None, long)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    for p in (D.DecontaminateParams(), D.DecontaminateParams(items_at_once=1)):
        got = sorted((r.doc_id, r.item_id) for r in D.contaminated(d, b, p).where("contaminated").collect())
        assert got == [(1, 1), (2, 2), (6, 1), (6, 1)] if p.items_at_once > 1 else {(1, 1), (2, 2), (6, 1)} <= set(got)
    assert sorted(r.doc_id for r in D.drop_contaminated(d.where("doc_id is not null"), b).collect()) == [3, 4, 5, 7]
    assert D.contaminated(d.limit(0), b).collect() == [] and D.contaminated(d, b.limit(0)).collect() == []


def check_pieces(rows, docs):
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = defaultdict(list)
    for i, t in docs:
        ids[i].append([*tk.encode(t or "", add_special_tokens=False).ids, 0])
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        x = ids[r.doc_id][0]
        assert r.doc_tokens == len(x) and zlib.crc32(np.array(x[r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        by_doc[r.doc_id].append((r.start, r.length))
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert by_doc.keys() == ids.keys()
    for i, copies in ids.items():
        assert Counter(k for s, n in by_doc[i] for k in range(s, s + n)) == Counter({k: len(copies) for k in range(len(copies[0]))})
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at and n > 0
            at += n
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding == 0


def test_packing_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check_pieces(queries.op6_packing(spark, SF).collect(), docs)


def test_packing_edges(spark):
    docs = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (4, "x y " * 40000), (5, " "), (-1, "q " * 511)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 start", "2 length")
    check_pieces(packing.pack(df).collect(), docs)
    check_pieces(packing.pack(df, packing.PackParams(shard_docs=2)).collect(), docs)
    assert packing.pack(df.limit(0)).collect() == []


def test_neighbours_share_words(spark):
    a, b = "apple pear plum fig ", "iron zinc lead tin "
    docs = [(i, (a if i % 2 else b) * 60 + f"n{i}") for i in range(40)]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()
    seqs = defaultdict(set)
    for r in rows:
        seqs[r.sequence_id].add(r.doc_id % 2)
    assert sum(len(s) == 1 for s in seqs.values()) > 0.5 * len(seqs)

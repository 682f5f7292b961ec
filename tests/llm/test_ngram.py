import math
import zlib
from collections import Counter

import brute
import numpy as np
from pyspark.sql import functions as F
from readloom.llm import ngram as N, queries

SF = "/root/testdata/sf0.01"


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, u in ((1, 1), (5, 6), (1000, 1000), (3000, 10**6), (4000, 10**12), (700, 701)):
        v = np.sort(rng.choice(u, n, replace=False)) if u < 10**7 else np.unique(rng.integers(0, u, n))
        ef = N.EliasFano(*N.EliasFano.build(v, u))
        x = np.unique(np.concatenate([v, rng.integers(0, u, 500), [0, u - 1]]))
        at, hit = ef.successor(x)
        assert (at == np.searchsorted(v, x)).all() and (hit == np.isin(x, v)).all()


def plain(docs, exact=True):
    p = N.LmParams()
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs}
    toks = [(i, [*brute.words(t), None]) for i, t in docs]
    c, big, ctx, types = Counter(), Counter(), Counter(), Counter()
    for i, w in toks:
        if not held[i]:
            c.update(w)
            big.update(zip([0, *w], w))
    for (a, _), k in big.items():
        ctx[a] += k
        types[a] += 1
    n, v = sum(c.values()), len(c)
    out = {}
    for i, w in toks:
        base = [(c[x] + .5) / (n + .5 * (v + 1)) for x in w]
        full = [max(big[a, x] - p.discount, 0) / ctx[a] + p.discount * types[a] / ctx[a] * u if ctx[a] else u for a, x, u in zip([0, *w], w, base)]
        out[i] = (held[i], len(w), sum(c[x] > 0 for x in w), n, sum(map(math.log10, base)), sum(map(math.log10, full)))
    return out


def check(rows, want):
    for r in rows:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert abs(r.base_score - w[4]) <= 1e-9 * max(1, abs(w[4])) and abs(r.score - w[5]) <= 0.02 * r.n_tokens


def test_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.op10_lm_score(spark, SF).collect()
    assert len(rows) == len(docs)
    check(rows, plain(docs))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "A a a\tB"), (4, "a b a b " * 20000), (5, "é É x"), (8, "a b"), (9, "zz")]
    df = spark.createDataFrame(docs + [(None, "a")], "doc_id long, text string").selectExpr("*", "1 block", "2 bucket", "3 blob")
    check(N.score_documents(df).collect(), plain(docs))
    assert N.score_documents(df.limit(0)).collect() == []
    again = spark.createDataFrame([(3, "a b"), (3, "a b")], "doc_id long, text string")
    assert [r.train_tokens for r in N.score_documents(again).collect()] == [6 * (zlib.crc32(b"3") % 5 != 1)] * 2
    held = [i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    alone = N.score_documents(spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string").where(F.lit(True))).collect()
    assert all(r.train_tokens == 0 and r.base_score == 0 and r.score == 0 for r in alone)

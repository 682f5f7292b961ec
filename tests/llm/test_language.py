import zlib

import numpy as np
from pyspark.sql import functions as F
from readloom.llm import language, queries

SF = "/root/testdata/sf0.01"


def test_gradients():
    p = language.LanguageParams(hidden=3)
    net = language.ByteGru(["a", "b"], 3, 1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(0)
    ids, target = rng.integers(0, 5, (6, 4)), np.array([0, 1, 0, 1])
    mask = (np.arange(6)[:, None] < np.array([6, 3, 5, 6])).astype(np.float64)
    _, g = net.gradients(ids, mask, target)
    for k in net.w:
        for at in list(np.ndindex(net.w[k].shape))[:12]:
            old, e = net.w[k][at], 1e-2
            net.w[k][at] = old + e
            up, _ = net.gradients(ids, mask, target)
            net.w[k][at] = old - e
            down, _ = net.gradients(ids, mask, target)
            net.w[k][at] = old
            assert abs((up - down) / (2 * e) - g[k][at]) < 2e-3, (k, at)
    assert p.hidden == 3


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op2_language(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    right = np.mean([r.lang_pred == docs[r.doc_id].lang for r in held])
    print("held-out accuracy", right)
    assert right > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 34 !", "fr"), (4, "the and of the", None), (5, "le la les des " * 50000, "fr"), (6, "the and of " * 30, "en"), (6, "the and of " * 30, "en"), (None, "x", "en"), (7, "la le des " * 30, "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit(1), "held_out": F.lit(1)})
    p = language.LanguageParams(steps=60)
    got = sorted(language.identify(df, p, positions=True).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in got] == [1, 2, 3, 4, 5, 6, 6, 7]
    assert [r.lang_pred for r in got[:3]] == ["und"] * 3 and all(r.lang_pred in ("en", "fr") for r in got[3:])
    assert all(len(r.labels) == len((t or "").encode()) for r, (_, t, _) in zip(got, [x for x in rows if x[0]]))
    assert {r.lang_pred for r in language.identify(df.where("lang is null"), p).collect()} == {"und"}
    assert language.identify(df.limit(0), p).collect() == []

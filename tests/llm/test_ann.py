import numpy as np
from pyspark.sql import functions as F
from readloom.llm import ann, queries

SF = "/root/testdata/sf0.01"


def brute(rows, k=20, every=20):
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None and None not in v]
    rows = [(i, v) for i, v in rows if np.isfinite(v).all() and v.any()]
    out = {}
    for i, q in rows:
        if i % every == 0:
            s = sorted((-float((q * v).sum()), j) for j, v in rows if j != i)[:k]
            out[i] = [(j, -d) for d, j in s]
    return out


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_and_scores(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got, want = by_query(queries.op5_ann(spark, SF)), brute(rows)
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    hit = np.mean([len({j for j, _ in got[q]} & {j for j, _ in want[q]}) / len(want[q]) for q in want])
    print("recall", hit)
    assert hit >= 0.9
    v = {i: np.array(x, np.float32).astype(float) for i, x in rows}
    assert all(abs(s - v[q] @ v[j]) < 1e-9 for q in got for j, s in got[q])


def test_edges(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)] + [(i, [1.0, 2.0, 0.5, 0.0]) for i in range(100, 200)]
    rows += [(200, None), (201, [0.0] * 4), (202, [1.0, None, 0.0, 0.0]), (203, [float("nan")] * 4), (204, [float("inf"), 0.0, 0.0, 0.0]), (220, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"leaf": F.lit(1), "ids": F.lit(2)})
    p = ann.AnnParams(leaf=8, recall=1.0, block=4)
    got, want = by_query(ann.search(df, p)), brute(rows[:-1])
    assert {q: [j for j, _ in x] for q, x in got.items()} == {q: [j for j, _ in x] for q, x in want.items()}
    few = spark.createDataFrame([(0, [1.0, 2.0]), (3, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert by_query(ann.search(few)) == {0: [(3, 4.0)]}
    assert ann.search(few.limit(0)).collect() == [] and ann.search(few.where("vec_id = 0")).collect() == []

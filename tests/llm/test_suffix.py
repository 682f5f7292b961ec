import hashlib
import random

from readloom.llm import suffix

SF = "/root/testdata/sf0.01"


def brute(docs, length=100):
    first, out = {}, []
    for i, t in sorted(set(docs), key=lambda r: r[0]):
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            first[b[s:s + length]] = min(first.get(b[s:s + length], (i, s)), (i, s))
    for i, t in docs:
        b = (t or "").encode()
        dead = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if first[b[s:s + length]] < (i, s):
                dead[s:s + length] = b"\x01" * length
        left = bytes(c for c, d in zip(b, dead) if not d)
        runs = sum(1 for k, d in enumerate(dead) if d and (not k or not dead[k - 1]))
        out.append((i, len(b), len(b) - len(left), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out)


def rows(df):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_documents_like_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(suffix.remove_repeats(spark.read.parquet(f"{SF}/documents.parquet"))) == brute(docs)


def test_edges(spark):
    rng = random.Random(5)
    p = "".join(rng.choice("ab") for _ in range(300))
    q = "".join(rng.choice("abcdefgh é") for _ in range(400))
    docs = [(1, None), (2, ""), (3, "x" * 99), (4, "x" * 100), (5, "x" * 1000), (6, p), (7, q + p[:150]), (8, p[50:149] + q), (9, q * 3), (10, "é" * 90), (11, p + p), (12, q[100:300]), (-4, q[:200]), (9, q * 3), (13, "y" * 3_000_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 block", "2 bucket", "'x' blob")
    got = [r for r in rows(suffix.remove_repeats(df)) if r[0] != 13]
    assert got == brute([d for d in docs if d[0] != 13])
    big = [r for r in rows(suffix.remove_repeats(df)) if r[0] == 13]
    assert big[0][1:4] == (3_000_000, 2_999_999, 1)
    assert rows(suffix.remove_repeats(spark.createDataFrame([], "doc_id long, text string"))) == []


def test_rows_of_one_document(spark):
    rng = random.Random(8)
    a, b, c = ("".join(rng.choice("abcdefgh ") for _ in range(150)) for _ in range(3))
    for docs in ([(1, a), (2, b), (2, a)], [(2, a), (2, b + a), (2, a)], [(2, b + a), (2, a + b), (1, c)], [(3, a), (2, c + a), (2, a + c), (2, c + a), (3, a + b)]):
        assert rows(suffix.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)

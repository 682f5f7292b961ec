import brute
import pytest
from pyspark.sql import functions as F
from readloom.llm import near, queries

SF = "/root/testdata/sf0.01"
ROWS = [(1, "a b c d e f g h i j"), (2, "A B C D E F G H I J"), (3, None), (4, ""), (5, " \t"), (6, "x"), (7, "X"), (8, "x y"), (9, "é É"), (10, "w " * 30000)]


def rows(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def test_documents_like_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(queries.op9_near_dedup(spark, SF)) == brute.near(docs)


@pytest.mark.parametrize("k", [4, 5])
def test_edges(spark, k):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({"node": F.lit(1), "sig": F.lit("x"), "f1": F.lit(0)})
    assert rows(near.near_duplicates(df, near.NearParams(shingle=k))) == brute.near(ROWS, k)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert rows(near.near_duplicates(none)) == []
    again = spark.createDataFrame([*ROWS, ROWS[0], (None, "a b c")], "doc_id long, text string")
    assert len(rows(near.near_duplicates(again))) == len(ROWS) + 1


def test_dense_group(spark):
    base = [f"w{i}" for i in range(120)]
    docs = [(j, " ".join(base[:20 + j % 90] + [f"x{j}"] + base[21 + j % 90:])) for j in range(600)]
    assert rows(near.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), near.NearParams(shingle=4, small=32, branch=128))) == brute.near(docs)
    kept = near.keep_one(spark.createDataFrame(docs, "doc_id long, text string"), near.NearParams(shingle=4))
    assert [r.doc_id for r in kept.collect()] == [0]


def plain_rows(docs, k):
    """Rows of one doc_id are one document."""
    found = {i: (n, c) for i, n, c, _ in brute.near([(x, t) for x, (_, t) in enumerate(docs)], k)}
    rows_ = {}
    for x, (i, _) in enumerate(docs):
        rows_.setdefault(i, []).append(x)
    links = [(found[x][1], x) for x in found] + [(r[0], y) for r in rows_.values() for y in r]
    comp = brute.components(range(len(docs)), links)
    least = {}
    for x, (i, _) in enumerate(docs):
        least[comp[x]] = min(least.get(comp[x], i), i)
    return sorted((i, found[x][0], least[comp[x]], least[comp[x]] == i) for x, (i, _) in enumerate(docs))


def test_rows_of_one_document(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    for docs in ([(1, a), (2, b), (2, a)], [(5, a), (2, b), (2, a), (3, b), (3, c), (7, c), (7, c), (9, None), (9, "z")], [(1, None), (1, ""), (1, a)]):
        assert rows(near.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), near.NearParams(shingle=4))) == plain_rows(docs, 4)


def test_texts_of_before(spark):
    """Two documents that were near copies before their shared lines went; a text that is not from before is not used."""
    a, b, c = ("\n".join(" ".join(f"{x}{k}{i}" for i in range(20)) for k in range(9)) for x in "abc")
    before = spark.createDataFrame([(1, a), (2, a + "\nsome other line here"), (3, b), (4, b)], "doc_id long, text string")
    now = spark.createDataFrame([(1, a), (2, "some other line here"), (3, b), (4, c), (5, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in near.keep_one(now, before=before).collect()) == [1, 3, 4, 5]
    assert near.keep_one(now).count() == 5


def test_rows_of_one_document_do_not_multiply(spark, monkeypatch):
    """What keep_one writes of texts grows with the rows of a doc_id, not with their square."""
    docs = spark.createDataFrame([(i, f"line {i} of this\nand some more words {i}") for i in range(5)] * 12, "doc_id long, text string")
    cut, written = near.B.cut, []

    def counted(df):
        out = cut(df)
        written.append(out.count() if "text" in out.columns else 0)
        return out

    monkeypatch.setattr(near.B, "cut", counted)
    assert near.keep_one(docs, before=docs).count() == 60
    assert max(written) <= 60

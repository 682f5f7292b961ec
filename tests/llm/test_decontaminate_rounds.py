from readloom.llm import decontaminate as D

SF = "/root/testdata/sf0.01"


def test_rounds_do_not_change_scores(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    n = items.count()
    found = []
    for at_once in (n, n // 2):
        p = D.DecontaminateParams(threshold=0.3, items_at_once=at_once)
        found.append({(r.doc_id, r.item_id): r.score for r in D.contaminated(docs, items, p).collect()})
    one, more = found
    assert one and one.keys() == more.keys() and all(abs(one[k] - more[k]) < 1e-9 for k in one)

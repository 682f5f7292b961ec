import zlib

import compare
import numpy as np
import public_tokenizers
from readloom.llm import chat, codes, queries, tokens
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.01"
TEXTS = ["", None, " ", "  ", "a  b", "a \nb", "x\n y", "x\n \ny", " lead", "trail ", "tab\t x", "a  b", "a 　b", "<|endoftext|> x<|endoftext|>", "don't  I'll", "é ß 日本 語", "a\r\n b", "\n ", "1 2  3 . . ,", "a.\nB a\n\nb .\n!x a\n.b \nq q\n r\n", "x\n", "\nx", "a.\n\n.b c\n", "it's we'll. I'm", "x_y z9.a ²a a² ª", "\n a", "é.\nÉ", "a. .b ..c\n,"]


def ids_of(tk, t):
    return [*tk.encode(t or "", add_special_tokens=False).ids, 0]


def test_pieces_are_the_library_s_ids(spark):
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    more = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(300).collect()]
    enc = tokens.Encoder("byte_bpe_50k.json")
    for got, t in zip(enc.encode(TEXTS + more), TEXTS + more):
        assert got.tolist() == ids_of(tk, t)[:-1], repr(t)[:80]


def test_random_access():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 1 << k, 3000) for k in (4, 8, 16, 25, 32)]).astype(np.uint32)
    rng.shuffle(ids)
    c = codes.Codes(codes.pack(np.array([5, 9]), np.array([0, 7]), ids))
    assert (c.tokens() == ids).all() and c.document(0) == (0, 7) and c.document(1) == (7, len(ids))
    assert all(c.token(i) == ids[i] for i in range(0, len(ids), 7))


def check(spark, df, docs):
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, at = [], 0
    for i, t in sorted(docs, key=lambda r: r[0]):
        x = ids_of(tk, t)
        want.append((i, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    assert sorted(tuple(r) for r in df.collect()) == want


def test_documents(spark):
    check(spark, queries.op3_codes(spark, SF), [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()])


def test_edges(spark, tmp_path):
    docs = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (-7, "w " * 200000)]
    codes.write_codes(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 part", "2 file"), f"{tmp_path}/a")
    check(spark, codes.read_codes(spark, f"{tmp_path}/a"), docs)
    codes.write_codes(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/b")
    assert codes.read_codes(spark, f"{tmp_path}/b").collect() == []


def test_chat_like_sql(spark):
    ours, theirs, a, b = compare.both(spark, SF, queries.op4_chat, queries.ORACLES["op4_chat"])
    assert ours == theirs and a == b and len(a) > 10


def test_chat_edges(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "\\<|\\|<\\|"), (2, 0, None, "x"), (3, 0, "system", ""), (3, 1, "user", "q\n"), (3, 1, "user", "q\n"), (None, 0, "user", "<|im_start|>"), (4, None, "user", "a" * 100000), (4, 1, "assistant", "é日")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 segments", "2 formatted")
    back = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    for c in {r[0] for r in rows}:
        mine = sorted(((r[1] is not None, r[1]), r[2] or "", r[3] or "") for r in rows if r[0] == c)
        assert [(t.role, t.text) for t in back[c].turns] == [(b, x) for _, b, x in mine]
        assert "".join(back[c].learned) == "".join(x for _, b, x in mine if b == "assistant")
    assert [back[c].valid for c in (1, 2, 3, 4)] == [True, False, False, True]
    plain = chat.format_conversations(df).drop("valid")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plain and "Arrow" not in plain
    assert chat.read_back(chat.format_conversations(df.limit(0))).collect() == []

import math
import random
from collections import Counter, defaultdict

import numpy as np
from readloom.llm import packing


def test_related_documents_of_other_shards_meet(spark):
    """Pairs that share rare words, far apart by doc_id, with shards of a few documents."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(4))
    common = [word() for _ in range(40)]
    docs = []
    for i in range(100):
        own = word()
        for j in (i, 10_000 + 37 * i):
            docs.append((j, " ".join([own] * 100 + rng.choices(common, k=20))))
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), packing.PackParams(shard_docs=16)).collect()
    seqs = defaultdict(set)
    for r in rows:
        seqs[r.doc_id].add(r.sequence_id)
    assert sum(bool(seqs[i] & seqs[10_000 + 37 * i]) for i in range(100)) >= 50  # by hash of doc_id about 5


def test_statistics_of_the_whole_table(spark):
    docs = spark.createDataFrame([(i, "apple pear" if i % 2 else "iron") for i in range(50)], "doc_id long, text string").repartition(5)
    all_ = packing.corpus(docs.mapInArrow(packing.encode(packing.PackParams()), packing.CODED))
    assert all_.n == 50 and all_.df[0] == 50 and 25 in all_.df


def test_neighbours_like_plain_bm25():
    """The order of all neighbours of every document, against a sum over dictionaries with the same rounding."""
    rng = np.random.default_rng(4)
    ids = [np.concatenate([rng.zipf(1.3, rng.integers(1, 200)) % 3000 + 1, [0]]).astype(np.uint32) for _ in range(300)]
    df = np.zeros(3001, np.int64)
    for x in ids:
        df[np.unique(x)] += 1
    p, all_ = packing.PackParams(), packing.Corpus(300, float(np.mean([len(x) for x in ids])), df)
    tf = [Counter(x.tolist()) for x in ids]
    index, unused = packing.Bm25(ids, all_, p), rng.random(300) < 0.8
    for i in range(0, 300, 7):
        scores = {}
        for j in np.flatnonzero(unused).tolist():
            total = 0
            for t in tf[i].keys() & tf[j].keys():
                idf = math.log(1 + (300 - df[t] + 0.5) / (df[t] + 0.5))
                f = tf[j][t]
                total += round(packing.SCALE * idf * f * (p.k1 + 1) / (f + p.k1 * (1 - p.b + p.b * len(ids[j]) / all_.average)))
            if total:
                scores[j] = total
        assert list(index.neighbours(i, unused)) == sorted(scores, key=lambda j: (-scores[j], j))


def test_terms_of_many_rows_at_once():
    """Terms of rows counted together, with ids in two bytes and in four, like a Counter a row; of equal weights the first."""
    rng = np.random.default_rng(2)
    for most in (300, 1 << 20):
        ids = [np.append(rng.integers(1, most, rng.integers(0, 50)), 0).astype(np.uint32) for _ in range(200)]
        flat, at = packing.flat(packing.B.binary_column([packing.held(x) for x in ids]))
        row, term, tf = packing.term_counts(flat, at)
        assert list(zip(row, term, tf)) == [(i, t, n) for i, x in enumerate(ids) for t, n in sorted(Counter(x.tolist()).items())]
    assert packing.heaviest(np.array([1.0, 3, 3, -1, 0, 0]), np.array([0, 0, 0, 1, 2, 2])).tolist() == [1, 3, 4]

"""Seed positions against plain Python, and that no step of theirs gathers a chunk."""
import random
import re

import pytest

from readloom.operators import index as I


def bins_of(spark, chunks: dict[int, list[str]]):
    rows = []
    for chunk, texts in chunks.items():
        at = 0
        for i, text in enumerate(texts):
            rows.append((chunk, i, at, at + len(text), text))
            at += len(text)
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, "chunk_id long, bin_id long, start long, end long, seq string").repartition(5)


def plain(chunks: dict[int, list[str]], size: int) -> list[tuple]:
    out = []
    for chunk, texts in chunks.items():
        whole, owner = "".join(texts), [i for i, text in enumerate(texts) for _ in text]
        out += [(chunk, whole[s:s + size], s, owner[s]) for s in range(len(whole) - size + 1)]
    return sorted(out)


@pytest.mark.parametrize("size", [1, 2, 5, 18])
@pytest.mark.parametrize("stretch", [1, 7, 1 << 16])
def test_positions_go_over_the_ends_of_bins(spark, monkeypatch, size, stretch):
    monkeypatch.setattr(I, "STRETCH", stretch)
    r = random.Random(size)
    text = lambda n: "".join(r.choice("abé") for _ in range(n))
    chunks = {0: [text(r.choice([0, 1, 1, 2, 3, 17, 18, 40, 300])) for _ in range(60)], 1: [text(1) for _ in range(30)], 2: [text(9000)], 3: [text(4), ""], 4: [""]}
    assert sorted(map(tuple, I.seed_positions(bins_of(spark, chunks), size).collect())) == plain(chunks, size)


def test_no_task_holds_a_chunk(spark):
    """Texts were put in order by chunk alone, so one task read all of a chunk's."""
    plan = I.seed_positions(bins_of(spark, {0: ["some text", "and more"]}), 18)._jdf.queryExecution().optimizedPlan().toString()
    by = re.findall(r"Window \[.*\], \[([^\]]*)\], \[", plan)
    assert by and all("stretch" in keys for keys in by)
    assert not re.search(r"\bseq#\d+", "".join(x for x in plan.splitlines() if "Window [" in x))

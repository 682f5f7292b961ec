import pyarrow as pa
from readloom.llm import packing, tokens


def test_later_stages_give_the_encoder_back():
    """A worker that encoded holds no remembered pieces while it counts, routes and packs."""
    p = packing.PackParams()
    docs = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2], pa.int64()), "text": ["the quick brown fox", "the lazy dog"]})
    coded = list(packing.encode(p)(iter([docs])))
    assert tokens._LOADED
    rows = [r for b in packing.count_terms(iter(coded)) for r in b.to_pylist()]
    assert not tokens._LOADED and sum(r["docs"] for r in rows) == 2
    assert [b.to_pydict() for b in packing.encode(p)(iter([docs]))] == [b.to_pydict() for b in coded]

import compare
import pytest
from readloom.plans import queries as core

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_same_rows_as_sql(spark, name):
    ours, theirs, a, b = compare.both(spark, SF, core.QUERIES[name], core.ORACLES[name])
    assert ours == theirs
    assert len(a) == len(b) and a == b

"""Every registered query with an SQL twin equals DuckDB on the smallest scale; the others must run."""

import pytest
from compare import compare, duck

from checks import load

SF = "/root/testdata/sf0.001"
QUERIES, SQL = load()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        _, verdict = compare(spark, con, QUERIES[name], SQL[name], SF)
        assert verdict == "ok"
    else:
        assert QUERIES[name](spark, SF).count() > 0


def test_entry_runs(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    assert df.columns == ["meeting_id", "speaker_id", "speaker_name", "speaking_ms", "speaking_share", "place"] and df.count() > 0

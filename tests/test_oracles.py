"""Every registered query with an oracle returns the oracle's rows (DuckDB on
the same parquet tables)."""

import pytest

import __spark_entry__ as E
from compare import same_rows

QUERIES = E.queries()
ORACLES = E.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    want = duck.execute(ORACLES[name]).df()
    ok, why = same_rows(got, want)
    assert ok, f"{name}: {why}"


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns
    assert df.count() >= 0

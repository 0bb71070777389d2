"""Every registered query against its DuckDB oracle at sf0.001 (the driver's check at small size)."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as E
from regspark.fixtures import BASE_TABLES
from regspark.plans.catalog import ORACLES, QUERIES
from tools.check_oracles import digest

SF = "/root/testdata/sf0.001"
NAMES = list(QUERIES)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in BASE_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle_but_discovery():
    assert set(QUERIES) - set(ORACLES) == {"discover_inputs"}
    assert set(QUERIES) <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql()) <= set(E.queries())


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["pan", "row_id", "gstin_count", "raw_gstin_count", "status"]
    assert df.count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF).toPandas()
    if name not in E.oracle_sql():
        assert len(sdf) > 0
        return
    odf = con.execute(E.oracle_sql()[name]).fetchdf()
    assert digest(sdf) == digest(odf)

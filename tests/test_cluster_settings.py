"""Key queries under the cluster settings (no static broadcast, so shuffled joins run)
still equal their oracles."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as E
from regspark.fixtures import BASE_TABLES
from regspark.session import CLUSTER_SETTINGS
from tools.check_oracles import digest

SF = "/root/testdata/sf0.001"
NAMES = ["status_by_pan", "apply_results", "append_new_gstins", "details_upsert_all", "details_upsert_first",
         "update_details_outcomes", "enrich_left", "map_pans_pan_data", "map_pans_gstin_data", "ingest_pages_status",
         "pending_pans", "batch_numbers", "legacy_pan_rows"]


@pytest.fixture(scope="module")
def cluster(spark):
    conf = dict(CLUSTER_SETTINGS, **{"spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"})
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    c = duckdb.connect()
    for t in BASE_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    yield c
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


@pytest.mark.parametrize("name", NAMES)
def test_query_without_broadcast(spark, cluster, name):
    df = E.queries()[name](spark, SF)
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
    assert digest(df.toPandas()) == digest(cluster.execute(E.oracle_sql()[name]).fetchdf())

"""A key holding a third of all rows: hot keys are found from a sample and salted, so
the key is spread over many tasks; results equal the plain join; nothing is dropped."""

from __future__ import annotations

import datetime as dt

import pytest

from pyspark.sql import functions as F

from regspark.operators import enrich as en
from regspark.operators import merge as mg
from regspark.operators.schema import GSTIN_DATA_SCHEMA, conform
from regspark.operators.skew import SkewConfig, hot_keys, hot_keys_by_column, salted_join

AS_OF = dt.datetime(2025, 1, 1)
HOT = "27HOTTT0000H1Z5"
CFG = SkewConfig(salts=8, share=0.03, sample_fraction=0.2)
OFF = SkewConfig(enabled=False)


def _results(spark, n=30000):
    g = F.when(F.col("id") % 3 == 0, F.lit(HOT)).otherwise(
        F.concat(F.lit("27"), F.lpad((F.col("id") % 5000).cast("string"), 12, "0"), F.lit("Z")))
    return spark.range(n).select(
        F.concat(F.lit("PAN"), (F.col("id") % 997).cast("string")).alias("pan"), F.col("id").alias("ord"),
        g.alias("gstin"), F.lit("Active").alias("gstin_status"), F.lit("KA").alias("state"),
        F.lit(None).cast("string").alias("result"))


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001


def test_hot_key_detection(spark):
    assert hot_keys(_results(spark), "gstin", CFG) == [HOT]
    assert hot_keys(_results(spark), "gstin", OFF) == []
    assert hot_keys(_results(spark), "gstin", SkewConfig()) == [HOT]   # a share, so alike at every size
    assert hot_keys_by_column(_results(spark), ["pan", "gstin"], CFG) == {"pan": [], "gstin": [HOT]}


@pytest.fixture()
def no_broadcast(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def test_salted_anti_join_equals_plain_and_spreads(spark, no_broadcast):
    res = _results(spark)
    old = conform(spark.range(0, 5000, 2).select(
        F.col("id").alias("row_id"),
        F.concat(F.lit("27"), F.lpad(F.col("id").cast("string"), 12, "0"), F.lit("Z")).alias("gstin")),
        GSTIN_DATA_SCHEMA)
    salted = mg.append_new(old, mg.new_gstin_rows(res, AS_OF), skew=CFG)
    plain = mg.append_new(old, mg.new_gstin_rows(res, AS_OF), skew=OFF)
    assert _same(salted, plain)
    assert salted.where(F.col("gstin") == HOT).count() == 10000           # whole, not capped
    new = mg.new_gstin_rows(res, AS_OF)
    keys = old.select("gstin").distinct()
    salted_plan = _plan(salted_join(new, keys, "gstin", "left_anti", [HOT], 8))
    assert "LeftAnti" in salted_plan and "hashpartitioning(gstin#" in salted_plan and "_salt" in salted_plan
    assert "_salt" not in _plan(new.join(keys, "gstin", "left_anti"))
    # the hot key's rows take every salt value, i.e. 8 join partitions instead of one
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in new.columns]), F.lit(8))
    assert new.where(F.col("gstin") == HOT).select(salt.alias("s")).distinct().count() == 8


def test_salted_upsert_and_enrich_equal_plain(spark, no_broadcast):
    target = conform(_results(spark).select(F.col("ord").alias("row_id"), F.col("pan").alias("pan_reference"),
                                            "gstin", "gstin_status", "state"), GSTIN_DATA_SCHEMA)
    details = spark.createDataFrame([(HOT, "Hot Co", "01/01/2020", ["1", "2"]),
                                     ("27000000000001Z", "Cold", "", [])],
                                    "gstin string, trade_name string, registration_date string, hsn_codes array<string>")
    a = mg.upsert_details_all(target, details, skew=CFG)
    assert _same(a, mg.upsert_details_all(target, details, skew=OFF))
    assert a.where(F.col("trade_name") == "Hot Co").count() == 10000
    sheet = target.select("row_id", F.col("gstin").alias("GSTIN"))
    e = en.enrich(sheet, en.codes_text(details), AS_OF, skew=CFG)
    assert _same(e, en.enrich(sheet, en.codes_text(details), AS_OF, skew=OFF))
    assert e.where(F.col("Trade_Name") == "Hot Co").count() == 10000
    looked = en.lookup_details(target.select("gstin"), details, skew=CFG)
    assert _same(looked, en.lookup_details(target.select("gstin"), details, skew=OFF))


def test_pipeline_skew_config_passes_through(spark, sf_dir, no_broadcast):
    from regspark.fixtures import fixture
    from regspark.plans.pipelines import map_pans

    sheet = fixture(spark, sf_dir, "pan_sheet")
    old = conform(fixture(spark, sf_dir, "gstin_sheet"), GSTIN_DATA_SCHEMA)
    res = fixture(spark, sf_dir, "lookup_results")
    low = SkewConfig(salts=4, share=0.001, min_hits=1, sample_fraction=1.0)   # every busy PAN/GSTIN is "hot"
    p1, g1 = map_pans(sheet, old, res, AS_OF)
    p2, g2 = map_pans(sheet, old, res, AS_OF, skew=low)
    assert _same(p1, p2) and _same(g1, g2)


def test_null_keys_and_equal_rows_spread(spark, no_broadcast):
    rows = spark.range(3000).select(F.when(F.col("id") % 2 == 0, F.lit("K")).alias("gstin"))
    one = spark.createDataFrame([("K", 1)], "gstin string, v int")
    out = salted_join(rows, one, "gstin", "left", ["K"], 8).withColumn("p", F.spark_partition_id())
    parts = {r["gstin"]: r["n"] for r in out.groupBy("gstin").agg(F.count_distinct("p").alias("n")).collect()}
    assert out.count() == 3000 and parts["K"] > 2 and parts[None] > 2

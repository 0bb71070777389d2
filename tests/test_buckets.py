"""Tables bucketed by key: later runs leave the landed side unshuffled; hot keys, NULL keys, repeated runs, the state of
the stream, observed counts and two writers of one folder."""

from __future__ import annotations

import datetime as dt
import glob
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from regspark.fixtures import fixture
from regspark.operators import merge as mg
from regspark.operators import results as rs
from regspark.operators.schema import GSTIN_DATA_SCHEMA, PAN_DATA_SCHEMA, conform
from regspark.operators.skew import SkewConfig
from regspark.plans import pipelines as pl
from regspark.session import scratch_path
from regspark.sources import buckets as bk
from regspark.sources import io as sio
from regspark.streaming import apply_results as ar

AS_OF = dt.datetime(2025, 1, 1)
HOT = "AAAAA0000A"
LOW = SkewConfig(share=0.03, sample_fraction=1.0, min_hits=1)


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001


@pytest.fixture(autouse=True)
def no_broadcast(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _rows(spark, n=6000):
    """A third of the rows hold one key, some none."""
    pan = (F.when(F.col("id") % 3 == 0, F.lit(HOT)).when(F.col("id") % 100 != 1, F.concat(F.lit("P"), F.col("id") % 500)))
    return spark.range(n).select(pan.alias("pan"), F.col("id").alias("v"))


def _landed(spark, rows, skew=LOW):
    path = scratch_path(spark, "t-bucketed")
    bk.write_bucketed(rows.where("v < 1000"), path, "pan", 4, SkewConfig(enabled=False))  # here the key lies in its bucket
    bk.write_bucketed(rows.where("v >= 1000"), path, "pan", 4, skew)
    return path


def test_rows_stay_whole_and_hot_keys_lie_beside(spark):
    rows = _rows(spark)
    t = bk.read_bucketed(spark, _landed(spark, rows))
    assert _same(t.cold.unionByName(t.hot), rows)
    assert [r[0] for r in t.keys.collect()] == [HOT]
    assert t.hot.where(F.col("pan") == HOT).count() == rows.where(F.col("pan") == HOT).where("v >= 1000").count()
    assert t.cold.where("pan is null").count() == 0


@pytest.mark.parametrize("most", [10_000, 0])
def test_semi_join_leaves_the_landed_side_where_it_is(spark, monkeypatch, most):
    monkeypatch.setattr(bk, "MAX_BROADCAST_KEYS", most)
    rows = _rows(spark)
    t = bk.read_bucketed(spark, _landed(spark, rows))
    wanted = spark.createDataFrame([(HOT,), ("P7",), ("P9",), ("absent",), (None,)], "pan string").distinct()
    cold, hot = bk.rows_of(t, wanted)
    assert _same(cold.unionByName(hot), rows.join(wanted, "pan", "left_semi"))
    plan = _plan(cold)
    assert "Bucketed: true" in plan and "SortMergeJoin" in plan
    scan = plan[plan.index("SortMergeJoin"):]
    assert "Exchange" not in scan[:scan.index("Bucketed: true")]  # the first child is the landed side
    if most:
        assert "hashpartitioning(pan" not in _plan(hot).split("BroadcastExchange")[0]


def test_table_of_another_session_is_registered_again(spark):
    rows = _rows(spark, 300)
    path = _landed(spark, rows)
    spark.sql(f"DROP TABLE {bk._name(path)}")  # an external table: its files stay
    t = bk.read_bucketed(spark, path)
    assert _same(t.cold.unionByName(t.hot), rows)
    bk.write_bucketed(rows, path, "pan", 99, LOW)
    again = bk.read_bucketed(spark, path)
    assert again.buckets == 4 and again.cold.count() + again.hot.count() == 600
    with pytest.raises(ValueError):
        bk.write_bucketed(rows, path, "v", 4)
    with pytest.raises(FileNotFoundError):
        bk.read_bucketed(spark, scratch_path(spark, "absent"))


def _responses(spark, n=3000):
    g = F.when(F.col("id") % 3 == 0, F.lit("27HOTTT0000H1Z5")).when(F.col("id") % 50 != 1, F.concat(
        F.lit("27"), F.lpad((F.col("id") % 700).cast("string"), 12, "0"), F.lit("Z")))
    return spark.range(n).select(F.lit("P").alias("pan"), F.col("id").alias("ord"), g.alias("gstin"), F.lit("Active").alias("gstin_status"),
                                 F.lit("KA").alias("state"), F.lit(None).cast("string").alias("result"))


@pytest.mark.parametrize("skew", [LOW, SkewConfig(enabled=False)])
def test_indexed_append_equals_plain_and_may_be_repeated(spark, skew):
    res = _responses(spark)
    old = conform(spark.range(0, 300, 2).select(F.col("id").alias("row_id"), F.concat(
        F.lit("27"), F.lpad(F.col("id").cast("string"), 12, "0"), F.lit("Z")).alias("gstin")), GSTIN_DATA_SCHEMA)
    rows, index = scratch_path(spark, "t-rows"), scratch_path(spark, "t-index")
    bk.add_keys(old, index, "gstin", 0, 4)
    first = pl.append_run(spark, res.where("ord < 900"), rows, index, 1, AS_OF, skew)
    want = mg.fresh_rows(old, mg.new_gstin_rows(res.where("ord < 900"), AS_OF))
    assert _same(first, want) and first.count() > 300
    assert _same(pl.append_run(spark, res.where("ord < 900"), rows, index, 1, AS_OF, skew), want)  # the run again
    second = pl.append_run(spark, res, rows, index, 2, AS_OF, skew)
    assert _same(second, mg.fresh_rows(conform(old, GSTIN_DATA_SCHEMA).unionByName(want), mg.new_gstin_rows(res, AS_OF)))
    table = spark.read.parquet(rows)
    assert table.count() == want.count() + second.count()


def test_indexed_append_does_not_shuffle_the_index(spark):
    index = scratch_path(spark, "t-index")
    res = _responses(spark)
    bk.add_keys(res, index, "gstin", 0, 4)
    plan = _plan(bk.unknown_rows(mg.new_gstin_rows(res, AS_OF), bk.read_bucketed(spark, index), 1, []))
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1


def test_null_keys_are_unknown(spark):
    index = scratch_path(spark, "t-index")
    bk.add_keys(spark.createDataFrame([("A",)], "gstin string"), index, "gstin", 0, 2)
    rows = spark.createDataFrame([("A", 1), (None, 2), ("B", 3)], "gstin string, v int")
    for hot in ([], ["A"], ["B"]):
        out = bk.unknown_rows(rows, bk.read_bucketed(spark, index), 1, hot)
        assert sorted(r["v"] for r in out.collect()) == [2, 3]


# -- the state of the stream ---------------------------------------------------------------------

def test_second_run_reads_the_state_and_its_own_epochs_only(spark, sf_dir):
    lr, sheet = fixture(spark, sf_dir, "lookup_results"), conform(fixture(spark, sf_dir, "pan_sheet"), PAN_DATA_SCHEMA)
    old = conform(fixture(spark, sf_dir, "gstin_sheet"), GSTIN_DATA_SCHEMA)
    landing, out, ckpt = (scratch_path(spark, n) for n in ("t-land", "t-out", "t-sck"))

    def run():
        return ar.stream_map_pans(spark, landing, sheet, old, out, ckpt, AS_OF)

    ar.land_results(lr.where("ord % 2 = 0"), landing, files=2)
    run()
    for file in glob.glob(os.path.join(out, "pan_updates", "epoch=0", "*.parquet")):
        with open(file, "wb") as f:
            f.write(b"not read again")
        crc = os.path.join(os.path.dirname(file), f".{os.path.basename(file)}.crc")
        if os.path.exists(crc):
            os.remove(crc)
    # a run that died while it wrote its state
    spark.range(1).write.parquet(os.path.join(out, "pan_state", f"upto-{99:010d}-{'0' * 32}", "cold"))
    ar.land_results(lr.where("ord % 2 = 1"), landing, files=2)
    pan, _ = run()
    batch = rs.apply_results(sheet, rs.rollup_results(lr), AS_OF)
    assert _same(pan, batch)
    assert _same(run()[0], batch)  # nothing new: the state as it is


def test_state_is_not_shuffled(spark):
    path = scratch_path(spark, "t-state")
    parts = rs.rollup_parts(_responses(spark).withColumn("pan", F.concat(F.lit("P"), F.col("ord") % 90)))
    bk.write_bucketed(rs.combine_parts(parts), path, "pan", 8, SkewConfig(enabled=False), placed=True)
    state = bk.read_bucketed(spark, path).cold
    both = rs.add_to_state(state, parts, 8)
    assert _same(rs.with_status(both), rs.merge_parts(parts.unionByName(parts)))
    assert "Exchange" not in _plan(both).split("SortMergeJoin")[1].split("Bucketed: true")[0]
    spark.conf.set("spark.sql.shuffle.partitions", "16")  # of a later session
    try:
        plan = _plan(rs.add_to_state(state, parts, 8))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert "Exchange" not in plan.split("SortMergeJoin")[1].split("Bucketed: true")[0]


# -- counts observed on the writes; two writers ----------------------------------------------------

def test_run_mapping_writes_what_map_pans_gives(spark, sf_dir):
    sheet, old = fixture(spark, sf_dir, "pan_sheet"), conform(fixture(spark, sf_dir, "gstin_sheet"), GSTIN_DATA_SCHEMA)
    lr = fixture(spark, sf_dir, "lookup_results")
    root = scratch_path(spark, "t-wb")
    version, counts = pl.run_mapping(sheet, old, lr, AS_OF, root)
    p, g = pl.map_pans(sheet, old, lr, AS_OF)
    wp, wg = sio.read_two_tables(spark, root)
    assert _same(wp, p) and _same(wg, g) and sio.current_version(spark, root) == version
    assert counts["gstin_rows"] == g.count() and counts["unique_gstins"] == g.select("gstin").distinct().count()
    empty = lr.where("false")
    _, counts = pl.run_mapping(sheet, old, empty, AS_OF, root)
    assert counts["added_gstin_rows"] == 0 and counts["gstin_rows"] == old.count()


def test_two_writers_get_two_numbers(spark):
    root = scratch_path(spark, "t-wb")
    p = spark.createDataFrame([("A",)], "pan string")
    base = sio.write_two_tables(p, p, root)
    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(lambda _: sio.write_two_tables(p, p, root), range(4)))
    numbers = [os.path.basename(v).split("-")[1] for v in done]
    assert len(set(numbers)) == 4 and sio.current_version(spark, root) == max(done)
    with pytest.raises(sio.VersionConflict):
        sio.write_two_tables(p, p, root, based_on=base)
    newer = sio.write_two_tables(p, p, root, based_on=max(done))
    assert sio.current_version(spark, root) == newer

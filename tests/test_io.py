"""S1-S11 round trips and T1 resume."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import functions as F

from regspark.fixtures import fixture
from regspark.operators.schema import GSTIN_DATA_SCHEMA, conform
from regspark.session import scratch_path
from regspark.sources import io as sio
from regspark.streaming.apply_results import land_results, stream_apply_results

AS_OF = dt.datetime(2025, 1, 1)


def test_csv_tokens_become_null(spark):
    path = scratch_path(spark, "t-csv")
    df = spark.createDataFrame([("1", "NA", "x "), ("2", "N/A", " y"), ("3", "null", "z"), ("4", "", "w"),
                                ("5", "ok", None)], "id string, a string, b string")
    sio.write_csv(df, path)
    back = {r["id"]: (r["a"], r["b"]) for r in sio.read_sheet(spark, path).collect()}
    assert back == {"1": (None, "x "), "2": (None, " y"), "3": (None, "z"), "4": (None, "w"), "5": ("ok", None)}
    exact = {r["id"]: r["a"] for r in sio.read_csv_text(spark, path).collect()}
    assert exact["4"] == "" and exact["1"] == "NA"


def test_two_table_versions(spark):
    root = scratch_path(spark, "t-wb")
    p1 = spark.createDataFrame([("A",)], "pan string")
    g1 = spark.createDataFrame([("G",)], "gstin string")
    v1 = sio.write_two_tables(p1, g1, root)
    v2 = sio.write_two_tables(p1.union(p1), g1, root)
    assert v1 != v2 and os.path.isdir(v1)                      # the previous version is kept (S9)
    p, _ = sio.read_two_tables(spark, root)
    assert p.count() == 2
    assert sorted(sio.table_names(spark, v2)) == ["gstin_data", "pan_data"]
    assert sio.table_names(spark, os.path.join(root, "missing")) == []


def test_checkpoint_roundtrip_and_missing(spark, sf_dir):
    path = scratch_path(spark, "t-ckpt")
    done, flat = sio.read_checkpoint(spark, path)                # absent -> empty
    assert done.count() == 0 and flat.count() == 0
    lr = fixture(spark, sf_dir, "lookup_results")
    keys = lr.select("pan").distinct()
    sio.write_checkpoint(keys, lr, path, batch=0, as_of=AS_OF)
    done, flat = sio.read_checkpoint(spark, path)
    assert done.count() == keys.count()
    cols = ["pan", "ord", "gstin", "gstin_status", "state", "result"]
    assert flat.select(cols).exceptAll(lr.select(cols)).count() == 0
    assert lr.select(cols).exceptAll(flat.select(cols)).count() == 0
    assert done.agg(F.max("timestamp")).first()[0] == AS_OF


def test_discover_inputs_reads_no_content(spark):
    root = scratch_path(spark, "t-up")
    sio.write_csv(spark.createDataFrame([("a",)], "x string"), os.path.join(root, "a"))
    spark.createDataFrame([("a",)], "x string").write.parquet(os.path.join(root, "b"))
    df = sio.discover_inputs(spark, root)
    plan = df._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
    assert "content" not in plan.split("ReadSchema")[-1].split("\n")[0]
    rows = df.collect()
    assert {r["extension"] for r in rows if r["accepted"]} == {"csv"}
    assert all(not r["accepted"] for r in rows if r["extension"] != "csv")


def test_run_log_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "t-log")
    jobs = fixture(spark, sf_dir, "jobs")
    sio.write_run_log(jobs, path)
    back = sio.read_run_log(spark, path)
    assert back.count() == jobs.count()
    a = back.select("job_id", "created_at", F.col("parameters.limit").alias("max_pans"))
    b = jobs.select("job_id", "created_at", "max_pans")
    assert a.exceptAll(b).count() == 0


def test_stream_resume_equals_batch(spark, sf_dir):
    lr = fixture(spark, sf_dir, "lookup_results")
    old = conform(fixture(spark, sf_dir, "gstin_sheet"), GSTIN_DATA_SCHEMA)
    landing, sink, ckpt = (scratch_path(spark, n) for n in ("t-land", "t-sink", "t-sck"))
    half = F.pmod(F.hash("pan"), F.lit(2))
    land_results(lr.where(half == 0), landing, files=2)
    first = stream_apply_results(spark, landing, old, sink, ckpt, AS_OF).count()
    land_results(lr.where(half == 1), landing, files=2)               # more responses arrive
    out = stream_apply_results(spark, landing, old, sink, ckpt, AS_OF)  # resumes from the checkpoint
    from regspark.operators.merge import append_new, new_gstin_rows
    batch = append_new(old, new_gstin_rows(lr, AS_OF))
    assert first < out.count() == batch.count()
    assert out.exceptAll(batch).count() == 0 and batch.exceptAll(out).count() == 0


def test_landed_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "t-landed")
    lr = fixture(spark, sf_dir, "lookup_results")
    sio.write_landed(lr, path, "lookup_results")
    back = sio.read_landed(spark, path, "lookup_results")
    assert back.schema == sio.LANDED_SCHEMAS["lookup_results"]
    assert back.exceptAll(lr).count() == 0 and lr.exceptAll(back).count() == 0


def test_unfinished_version_is_not_current(spark):
    root = scratch_path(spark, "t-wb")
    p = spark.createDataFrame([("A",)], "pan string")
    v1 = sio.write_two_tables(p, p, root)
    p.write.parquet(os.path.join(root, f"v-{9:010d}-{'0' * 32}", "pan_data"))  # a write that died half-way
    assert sio.current_version(spark, root) == v1
    assert sio.current_version(spark, os.path.join(root, "absent")) is None


def test_csv_quotes_line_breaks_and_file_order(spark):
    path = scratch_path(spark, "t-csv")
    df = spark.createDataFrame([(i, '12, "A" Block\nX', f"v{i}") for i in range(40)], "k int, a string, b string")
    for part, rows in enumerate((df.where("k < 3"), df.where("k >= 3"))):  # files of unequal size
        sio.write_csv(rows.orderBy("k"), os.path.join(path, f"part={part}"), single_file=True)
    back = sio.read_sheet(spark, path).orderBy("row_id").collect()
    assert [r["k"] for r in back] == [str(i) for i in range(40)]
    assert {r["a"] for r in back} == {'12, "A" Block\nX'}


def test_one_large_csv_is_split(spark):
    path = scratch_path(spark, "t csv")  # a blank in the path
    df = spark.range(120_000).select(F.col("id").cast("string").alias("k"), F.lit('a "quoted, b" c').alias("a"), F.lit("x" * 60).alias("b"))
    sio.write_csv(df.orderBy(F.col("k").cast("long")), path, single_file=True)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(2 << 20))
    try:
        assert not sio.holds_line_breaks(spark, path)
        sheet = sio.read_sheet(spark, path)
        assert sheet.select("k").rdd.getNumPartitions() > 3
        ids = [(r.row_id, int(r.k)) for r in sheet.select("row_id", "k").collect()]
        assert len({i for i, _ in ids}) == 120_000 and [k for _, k in sorted(ids)] == list(range(120_000))
        whole = sio.read_sheet(spark, path, multi_line=True)
        assert whole.select("k").rdd.getNumPartitions() == 1 and whole.count() == 120_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_run_log_keeps_every_field(spark):
    path = scratch_path(spark, "t-log")
    job = spark.sql("""SELECT 'j' AS job_id, 'f.csv' AS filename, 'failed' AS status, 'batch' AS type, 'boom' AS error,
        array('G1') AS gstins, named_struct('total', 1L, 'processed', 1L, 'successful', 0L, 'failed', 1L,
        'processed_count', 1L, 'timestamp', TIMESTAMP_NTZ '2025-01-01 00:00:00') AS progress,
        array(named_struct('gstin', 'G1', 'success', false, 'error', 'x')) AS results, 'w.xlsx' AS excel_file,
        true AS headless, false AS test_mode, 5 AS max_pans, false AS resume""")
    sio.write_run_log(job, path)
    r = sio.read_run_log(spark, path).first()
    assert (r["error"], r["type"], r["gstins"], r["excel_file"]) == ("boom", "batch", ["G1"], "w.xlsx")
    assert r["progress"]["failed"] == 1 and r["results"][0]["error"] == "x" and r["parameters"]["limit"] == 5
    assert r["file_path"] is None and r["result_file"] is None  # nothing invented


def test_stream_of_scattered_items_equals_batch(spark, sf_dir):
    """PANs spread over all files, one file a micro-batch."""
    from regspark.operators.results import apply_results, rollup_results
    from regspark.operators.schema import PAN_DATA_SCHEMA
    from regspark.streaming.apply_results import stream_map_pans

    lr, sheet = fixture(spark, sf_dir, "lookup_results"), conform(fixture(spark, sf_dir, "pan_sheet"), PAN_DATA_SCHEMA)
    old = conform(fixture(spark, sf_dir, "gstin_sheet"), GSTIN_DATA_SCHEMA)
    landing, out, ckpt = (scratch_path(spark, n) for n in ("t-land", "t-out", "t-sck"))
    land_results(lr, landing, files=3)
    pan, _ = stream_map_pans(spark, landing, sheet, old, out, ckpt, AS_OF, bytes_per_trigger=1)
    assert spark.read.parquet(os.path.join(out, "pan_updates")).select("epoch").distinct().count() == 3
    batch = apply_results(sheet, rollup_results(lr), AS_OF)
    assert pan.exceptAll(batch).count() == 0 and batch.exceptAll(pan).count() == 0

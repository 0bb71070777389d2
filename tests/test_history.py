"""Run states and progress (S11, Q7), table-wide ids (U1, J6), details history (O1), activity (O4), ages."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from regspark.operators import activity, history, merge, ordering, runlog
from regspark.operators.schema import GSTIN_DATA_SCHEMA, conform
from regspark.session import AS_OF, scratch_path
from regspark.sources import io

T0 = dt.datetime(2025, 1, 1)


def at(n):
    return T0 + dt.timedelta(hours=n)


def _change(spark, rows):
    return spark.createDataFrame([(j, s, t, f"{j}.csv") for j, s, t in rows],
                                 "job_id string, status string, changed_at timestamp_ntz, filename string").withColumn(
        "parameters", F.struct(F.lit(True).alias("headless"), F.lit(False).alias("test_mode"), F.lit(None).cast("int").alias("limit"),
                               F.lit(False).alias("resume")))


def test_run_states(spark):
    path, to = scratch_path(spark, "log"), scratch_path(spark, "log2")
    io.append_run_changes(_change(spark, [("a", "processing", at(2)), ("b", "queued", at(1))]), path)
    io.append_run_changes(_change(spark, [("a", "queued", at(1)), ("c", "queued", at(1)), ("d", "queued", at(5))]), path)
    io.append_run_changes(_change(spark, [("a", "completed", at(2)), ("c", "removed", at(9)), ("d", "processing", at(4))]), path)
    want = {"a": "completed", "b": "queued", "d": "queued"}  # of equal times the later status; a late old change is no change
    assert {r.job_id: r.status for r in io.read_run_states(spark, path).collect()} == want
    io.compact_run_log(spark, path, to)
    assert spark.read.text(to).count() == 3
    io.append_run_changes(_change(spark, [("b", "failed", at(3))]), to)
    assert {r.job_id: r.status for r in io.read_run_states(spark, to).collect()} == {**want, "b": "failed"}
    with pytest.raises(ValueError, match="changed_at"):
        io.append_run_changes(_change(spark, []).drop("changed_at"), to)


def test_progress_report(spark):
    path = scratch_path(spark, "log")
    result = "array<struct<gstin:string,success:boolean,error:string>>"
    rows = [("details", "completed", at(1), "r1", ["x", "y", "z"], [("x", True, None), ("y", False, "late")], None),
            ("mapping", "processing", None, None, None, None, (None, None, None, None, 7, at(3))),
            ("done", "completed", at(4), "r2", None, None, (10, 10, 9, 1, None, None)),
            ("newer", "failed", at(9), "r3", [], [], None), ("bare", "queued", None, None, None, None, None)]
    jobs = spark.createDataFrame([(*r[:2], f"{r[0]}.csv", *r[2:]) for r in rows],
                                 "job_id string, status string, filename string, end_time timestamp_ntz, result_file string, gstins array<string>, "
                                 f"results {result}, progress struct<total:bigint,processed:bigint,successful:bigint,failed:bigint,"
                                 "processed_count:bigint,timestamp:timestamp_ntz>")
    jobs = jobs.withColumns({"headless": F.lit(False), "test_mode": F.lit(False), "max_pans": F.lit(None).cast("int"), "resume": F.lit(False)})
    io.write_run_log(jobs, path)
    got = {r.job_id: (r.total, r.processed, r.successful, r.failed, r.percent_done, r.first_error, r.is_latest)
           for r in runlog.progress_report(io.read_run_log(spark, path)).collect()}
    assert got == {"details": (3, 2, 1, 1, 67, "late", False), "mapping": (None, 7, None, None, None, None, False),
                   "done": (10, 10, 9, 1, 100, None, True), "newer": (0, 0, 0, 0, None, None, False),
                   "bare": (None, None, None, None, None, None, False)}
    none = io.read_run_log(spark, path).where("status = 'queued'")
    assert [r.is_latest for r in runlog.progress_report(none).collect()] == [False]


def test_dense_ids(spark):
    rows = spark.createDataFrame([(i % 7, str(i % 3), 0) for i in range(100)], "o int, s string, row_id long").repartition(5)
    got = ordering.dense_ids(rows, ["o", "s"], scratch_path(spark, "ids"), start=40).collect()
    assert sorted(r.row_id for r in got) == list(range(41, 141))
    by_id = [(r.o, r.s) for r in sorted(got, key=lambda r: r.row_id)]
    assert by_id == sorted(by_id)
    assert ordering.dense_ids(rows.where("false"), ["o"], scratch_path(spark, "ids")).collect() == []


def test_append_twice_gives_unique_ids(spark):
    old = conform(spark.createDataFrame([(5, "P", "G0")], "row_id long, pan_reference string, gstin string"), GSTIN_DATA_SCHEMA)
    item = [("P", 9, "27ABCDE1234F1Z5"), ("P", 9, "27ABCDE1234F1Z5"), ("Q", 3, "27ABCDE1234F1Z6"), ("Q", 4, "short")]
    results = spark.createDataFrame([(*r, "Active", "KA", None) for r in item],
                                    "pan string, ord long, gstin string, gstin_status string, state string, result string")
    table = merge.append_numbered(old, merge.new_gstin_rows(results, AS_OF), scratch_path(spark, "a"))
    assert sorted((r.row_id, r.gstin) for r in table.collect()) == [(5, "G0"), (6, "27ABCDE1234F1Z6"), (7, "27ABCDE1234F1Z5"), (8, "27ABCDE1234F1Z5")]
    again = merge.append_numbered(table, merge.new_gstin_rows(results, AS_OF), scratch_path(spark, "a"))
    assert again.count() == 4
    details = spark.createDataFrame([("27ABCDE1234F1Z5", "N", "d", ["1"])], "gstin string, trade_name string, registration_date string, hsn_codes array<string>")
    done = merge.upsert_details_first(again, details, AS_OF).where("trade_name = 'N'").collect()
    assert [r.row_id for r in done] == [7]


LOAD = "gstin string, trade_name string, registration_date string, hsn_codes array<string>"


def test_history_of_loads(spark):
    def load(*rows):
        return spark.createDataFrame([(g, n, "d", c) for g, n, c in rows], LOAD)

    h = history.first_load(load(("A", "a", ["1"]), ("B", None, []), ("B", None, []), (None, "x", [])), at(0))
    h = history.apply_load(h, load(("A", "a", ["1"]), ("B", "", []), ("C", "c", None)), at(1))  # NULL and empty differ
    same = history.apply_load(h, load(("A", "a", ["1"])), at(2))
    assert sorted(map(tuple, same.drop("row_hash").collect()), key=str) == sorted(map(tuple, h.drop("row_hash").collect()), key=str)
    h = history.apply_load(same, load(("A", "a", ["1", "2"]), ("B", None, [])), at(3))
    got = sorted((r.gstin, r.trade_name, r.hsn_codes, r.valid_from, r.valid_to) for r in h.collect() if r.gstin != "B")
    assert got == [("A", "a", ["1"], at(0), at(3)), ("A", "a", ["1", "2"], at(3), None), ("C", "c", None, at(1), None)]
    b = sorted(((r.trade_name, r.valid_from, r.valid_to) for r in h.collect() if r.gstin == "B"), key=lambda r: r[1])
    assert b == [(None, at(0), at(1)), ("", at(1), at(3)), (None, at(3), None)]
    then = {r.gstin: r.trade_name for r in history.as_of_time(h, at(1)).collect()}
    assert then == {"A": "a", "B": "", "C": "c"}


def test_hsn_activity(spark):
    rows = [("A", "01012030"), ("A", "010199"), ("A", "01"), ("B", "0101"), ("B", "0101"), ("C", "9"), (None, "01"), ("D", None), ("D", "")]
    got = {(r.level, r.hsn_code): r.gstins for r in activity.hsn_activity(spark.createDataFrame(rows, "gstin string, hsn_code string")).collect()}
    assert got == {(0, ""): 3, (2, "01"): 2, (4, "0101"): 2, (6, "010120"): 1, (6, "010199"): 1, (8, "01012030"): 1}


def test_hsn_activity_holds_no_set_of_gstins(spark):
    """Random codes with repeats and a hot GSTIN against plain sets; GSTINs are sorted (which spills), not kept in a hash table."""
    import random

    from regspark.operators.skew import SkewConfig

    rng = random.Random(5)
    rows = [("G0" if rng.random() < 0.3 else f"G{rng.randrange(200)}", "".join(rng.choice("01é") for _ in range(rng.randrange(10))))
            for _ in range(4000)]
    rows += [(None, "0101"), ("G1", None)]
    df = spark.createDataFrame(rows, "gstin string, hsn_code string").repartition(5)
    want = {}
    for g, c in rows:
        for n in (0, 2, 4, 6, 8):
            if g and c and len(c) >= n:
                want.setdefault((n, c[:n]), set()).add(g)
    for skew in (SkewConfig(sample_fraction=1.0, share=0.1), SkewConfig(enabled=False)):
        out = activity.hsn_activity(df, skew=skew)
        assert {(r.level, r.hsn_code): r.gstins for r in out.collect()} == {k: len(v) for k, v in want.items()}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "HashAggregate(keys=" in x and "gstin" in x.split("functions=")[0]]


def test_registration_ages(spark):
    texts = ["01/07/2017", "2017-07-01", " 01-07-2017 ", "01 Jul 2017", "01.07.2017", "31/02/2017", "soon", "", None, "01/01/2026",
             "02/01/2024", "01/01/2024", "01/01/2015", "02/01/2015"]
    df = spark.createDataFrame([(t,) for t in texts], "registration_date string")
    got = [(r.bucket, r.n) for r in activity.registration_ages(df, T0).collect()]
    assert got == [("under 1 year", 1), ("1 to 2 years", 1), ("5 to 9 years", 6), ("10 years and more", 1), ("in the future", 1),
                   ("unreadable", 2), ("missing", 2)]


def test_own_names(spark):
    from regspark.operators import names

    firms = spark.createDataFrame([("G1", "Acme Traders Pvt. Ltd."), ("G2", "ACME TRADERS"), ("G3", "M/s Böhm & Sons"), ("G4", "Ltd"),
                                   ("G5", None), ("G3", "Bohm"), (None, "Zed")], "gstin string, trade_name string")
    own = spark.createDataFrame([(1, "The Acme-Traders Limited"), (2, "böhm and sons"), (3, "zed"), (4, "Pvt Ltd"), (5, None), (2, "BOHM")],
                                "id int, name string")
    got = sorted((r.id, r.matches, r.gstin, r.match) for r in names.match_names(own, firms).collect())
    assert got == [(1, 2, None, "ambiguous"), (2, 1, "G3", "unique"), (2, 1, "G3", "unique"), (3, 0, None, "none"),
                   (4, 0, None, "none"), (5, 0, None, "none")]

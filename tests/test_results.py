"""A1-A5, J1, J3, J4, L1, L2, L4, P7, P8 on hand-made rows and against brute force."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from regspark.operators import ordering as od
from regspark.operators import results as rs
from regspark.operators import validate as va
from regspark.operators.schema import PAN_DATA_SCHEMA, conform

AS_OF = dt.datetime(2025, 1, 1)
ITEM = "pan string, ord long, gstin string, gstin_status string, state string, result string"


def test_status_rules(spark):
    rows = [
        # hit + error -> Success, count only 15-character ids
        ("P1", 1, "A" * 15, "Active", "KA", None), ("P1", 2, "A" * 14, "Active", "KA", None),
        ("P1", 3, None, None, None, "Error: boom"),
        # error + no records -> No GSTINs found
        ("P2", 1, None, None, None, "Error: x"), ("P2", 2, None, None, None, "No records found"),
        # two errors -> the first in item order
        ("P3", 5, None, None, None, "Error: second"), ("P3", 2, None, None, None, "Error: first"),
        # neither -> Unknown
        ("P4", 0, None, None, None, "Timed out"),
        # only a short id -> not a success, and no error -> Unknown
        ("P5", 0, "B" * 14, "Active", "KA", None),
    ]
    df = spark.createDataFrame(rows, ITEM)
    got = {r["pan"]: (r["gstin_count"], r["raw_gstin_count"], r["status"]) for r in rs.rollup_results(df).collect()}
    assert got == {"P1": (1, 2, "Success"), "P2": (0, 0, "No GSTINs found"), "P3": (0, 0, "Error: first"),
                   "P4": (0, 0, "Unknown"), "P5": (0, 1, "Unknown")}


def _sheet(spark):
    rows = [(0, "ABCDE1234F", "a"), (1, "abcde1234f", "b"), (2, " ABCDE1234F", "c"), (3, "QWERT1234Y", "d"),
            (4, None, "e"), (5, "BAD", "f"), (6, "ZZZZZ0000Z", "g")]
    return conform(spark.createDataFrame(rows, "row_id long, pan string, name string"), PAN_DATA_SCHEMA)


def test_first_by_key_and_pending(spark):
    sheet = _sheet(spark)
    valid = va.normalize_valid_pans(sheet, keep=["name"])
    assert sorted(map(tuple, valid.collect())) == [("ABCDE1234F", 0, "a"), ("QWERT1234Y", 3, "d"),
                                                    ("ZZZZZ0000Z", 6, "g")]
    done = spark.createDataFrame([("QWERT1234Y",), ("QWERT1234Y",), ("NOTIN0000X",)], "pan string")
    pend = rs.pending_pans(valid, done)
    assert sorted(r["pan"] for r in pend.collect()) == ["ABCDE1234F", "ZZZZZ0000Z"]
    assert [r["pan"] for r in od.first_n(pend, 1).collect()] == ["ABCDE1234F"]


def test_apply_results_first_row_only(spark):
    sheet = _sheet(spark)
    res = spark.createDataFrame([("ABCDE1234F", 1, "X" * 15, "Active", "KA", None),
                                 ("NOTIN0000X", 0, None, None, None, "No records found")], ITEM)
    out = {r["row_id"]: (r["gstin_count"], r["status"], r["last_updated"])
           for r in rs.apply_results(sheet, rs.rollup_results(res), AS_OF).collect()}
    assert out[0] == (1, "Success", AS_OF)
    assert out[1] == (None, None, None) and out[2] == (None, None, None)
    assert len(out) == 7
    # raw match: the key equals the raw text of row 0 only
    raw = {r["row_id"]: r["status"] for r in rs.apply_results(sheet, rs.rollup_results(res), AS_OF, "raw").collect()}
    assert raw[0] == "Success" and raw[1] is None


def test_apply_results_raw_skips_lowercase(spark):
    sheet = conform(spark.createDataFrame([(0, "abcde1234f")], "row_id long, pan string"), PAN_DATA_SCHEMA)
    res = spark.createDataFrame([("ABCDE1234F", 1, "X" * 15, "Active", "KA", None)], ITEM)
    assert rs.apply_results(sheet, rs.rollup_results(res), AS_OF, "raw").first()["status"] is None
    assert rs.apply_results(sheet, rs.rollup_results(res), AS_OF).first()["status"] == "Success"


def test_global_position_matches_brute_force(spark):
    random.seed(7)
    ids = random.sample(range(0, 5000), 700)
    df = spark.createDataFrame([(i, f"k{i}") for i in ids], "row_id long, k string")
    got = {r["row_id"]: (r["position"], r["batch_no"]) for r in od.cut_batches(df, 10).collect()}
    small = {r["row_id"]: r["position"] for r in od.global_position(df, bucket_rows=7).collect()}
    for pos, i in enumerate(sorted(ids), start=1):
        assert got[i] == (pos, (pos - 1) // 10)
        assert small[i] == pos


def test_explode_nested(spark):
    item = "struct<ord:bigint,gstin:string,gstin_status:string,state:string,result:string>"
    df = spark.createDataFrame([({"P": [(2, "G2", "A", "S", None), (1, "G1", "A", "S", None)]},),
                                ({"Q": [(0, None, None, None, "No records found")]},)],
                               f"results map<string,array<{item}>>")
    rows = sorted(tuple(r) for r in rs.explode_nested_results(df).collect())
    assert rows == [("P", 0, 2, "G2", "A", "S", None), ("P", 1, 1, "G1", "A", "S", None),
                    ("Q", 0, 0, None, None, None, "No records found")]
    m = spark.createDataFrame([({"P": ["G1", "G2"]},)], "pan_gstin_map map<string,array<string>>")
    assert sorted(tuple(r) for r in rs.explode_pan_gstin_map(m).collect()) == [("P", "G1", "Active"),
                                                                                ("P", "G2", "Active")]


def test_key_presence_and_invalid_rows(spark):
    sheet = _sheet(spark)
    kp = va.key_presence(sheet).first()
    assert (kp["n_rows"], kp["n_present"], kp["all_missing"]) == (7, 6, False)
    empty = spark.createDataFrame([], "row_id long, pan string")
    assert va.key_presence(empty).first()["all_missing"] is True
    inv = [(r["row_id"], r["sheet_row"], r["pan"]) for r in va.invalid_pan_rows(sheet).collect()]
    assert inv == [(5, 7, "BAD")]
    sp = va.split_gstins(spark.createDataFrame([("X" * 15,), ("X" * 14,), (None,)], "gstin string"))
    assert [r["is_valid"] for r in sp.collect()] == [True, False, False]
    assert F is not None


def test_hot_key_rollup_matches_brute_force(spark):
    """One PAN holds a third of all result items; results equal a plain Python rollup."""
    random.seed(3)
    rows = []
    for i in range(3000):
        pan = "HOTPN0000H" if i % 3 == 0 else f"PAN{i % 97:02d}0000X"
        kind = random.random()
        if kind < 0.6:
            rows.append((pan, i, "G" * random.choice([14, 15]), "Active", "KA", None))
        elif kind < 0.8:
            rows.append((pan, i, None, None, None, random.choice(["Error: a", "Error: b", "No records found"])))
        else:
            rows.append((pan, i, None, None, None, "Timed out"))
    df = spark.createDataFrame(rows, ITEM).repartition(8)
    got = {r["pan"]: (r["gstin_count"], r["raw_gstin_count"], r["status"]) for r in rs.rollup_results(df).collect()}
    expect = {}
    for pan in {r[0] for r in rows}:
        items = sorted((r for r in rows if r[0] == pan), key=lambda r: r[1])
        n15 = sum(1 for r in items if r[2] is not None and len(r[2]) == 15)
        nraw = sum(1 for r in items if r[2] is not None)
        errs = [r[5] for r in items if r[5] and "Error" in r[5]]
        if n15:
            st = "Success"
        elif any(r[5] == "No records found" for r in items):
            st = "No GSTINs found"
        else:
            st = errs[0] if errs else "Unknown"
        expect[pan] = (n15, nraw, st)
    assert got == expect


def test_retry_failed_and_key_validation(spark):
    from regspark.plans.pipelines import ValidationError, check_key_column

    sheet = _sheet(spark)
    valid = va.normalize_valid_pans(sheet)
    done = spark.createDataFrame([("ABCDE1234F",), ("QWERT1234Y",)], "pan string")
    failed = spark.createDataFrame([("QWERT1234Y",)], "pan string")
    assert sorted(r["pan"] for r in rs.pending_pans(valid, done).collect()) == ["ZZZZZ0000Z"]
    again = rs.pending_pans(valid, done, retry_failed=True, failed=failed)
    assert sorted(r["pan"] for r in again.collect()) == ["QWERT1234Y", "ZZZZZ0000Z"]
    check_key_column(sheet)   # has values: no error
    empty = spark.createDataFrame([(0, None)], "row_id long, pan string")
    for bad in (empty, empty.drop("pan")):
        try:
            check_key_column(bad)
        except ValidationError:
            pass
        else:
            raise AssertionError("expected a validation error")


def test_first_error_of_many_texts(spark):
    """A PAN whose every item has an error text of its own, equal texts at several places, and ties in the order."""
    rows = [("HOTPN0000H", 5000 - i, None, None, None, f"Error: {i % 1700}") for i in range(5000)]
    rows += [("TIEPN0000T", 1, None, None, None, t) for t in ("Error: b", "Error: a", None)]
    rows += [("ONEPN0000O", 2, None, None, None, "Error: late"), ("ONEPN0000O", 1, None, None, None, "Error: twice"),
             ("ONEPN0000O", 9, None, None, None, "Error: twice"), ("NILPN0000N", 1, None, None, None, None)]
    got = {r["pan"]: r["status"] for r in rs.rollup_results(spark.createDataFrame(rows, ITEM).repartition(7)).collect()}
    assert got == {"HOTPN0000H": f"Error: {4999 % 1700}", "TIEPN0000T": "Error: a", "ONEPN0000O": "Error: twice", "NILPN0000N": "Unknown"}


def test_stale_gstins(spark):
    from regspark.operators.merge import stale_gstins

    day = lambda n: AS_OF - dt.timedelta(days=n)
    rows = [("A" * 15, day(91)), ("A" * 15, day(200)), ("B" * 15, day(90)), ("C" * 15, day(300)), ("C" * 15, day(1)),
            ("D" * 15, None), ("E" * 15, None), ("E" * 15, day(2)), ("short", None), (None, None)]
    df = spark.createDataFrame(rows, "gstin string, last_updated timestamp_ntz")
    assert sorted(map(tuple, stale_gstins(df, AS_OF).collect()), key=str) == [("A" * 15, day(91)), ("D" * 15, None)]
    assert stale_gstins(df, AS_OF, days=0).count() == 5

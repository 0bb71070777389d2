"""J2, U1, J5, J6, J7, J8, F10 on hand-made rows."""

from __future__ import annotations

import datetime as dt

import pytest

from regspark.operators import enrich as en
from regspark.operators import merge as mg
from regspark.operators.schema import GSTIN_DATA_SCHEMA, conform

AS_OF = dt.datetime(2025, 1, 1)
ITEM = "pan string, ord long, gstin string, gstin_status string, state string, result string"
G1, G2, G3 = "27AAAAA0000A1Z5", "27BBBBB0000B1Z5", "27CCCCC0000C1Z5"


def _old(spark):
    rows = [(1, "AAAAA0000A", G1, "Active", "KA"), (2, "AAAAA0000A", None, None, None)]
    return conform(spark.createDataFrame(rows, "row_id long, pan_reference string, gstin string, "
                                               "gstin_status string, state string"), GSTIN_DATA_SCHEMA)


def test_append_new_keeps_repeats_and_drops_existing(spark):
    res = spark.createDataFrame([
        ("AAAAA0000A", 10, G1, "Active", "KA", None),       # existing -> dropped
        ("BBBBB0000B", 11, G2, "Active", "KA", None),       # new
        ("BBBBB0000B", 12, G2, "Active", "KA", None),       # same new one twice -> kept twice
        ("CCCCC0000C", 13, G2, "Active", "MH", None),       # same GSTIN under another PAN -> kept
        ("CCCCC0000C", 14, G3[:14], "Active", "MH", None),  # 14 characters -> not a row
        ("DDDDD0000D", 0, None, None, None, "No records found")], ITEM)
    out = mg.append_new(_old(spark), mg.new_gstin_rows(res, AS_OF))
    rows = sorted((r["row_id"], r["gstin"], r["last_updated"]) for r in out.collect())
    assert rows == [(1, G1, None), (2, None, None), (11, G2, AS_OF), (12, G2, AS_OF), (13, G2, AS_OF)]
    dedup = mg.append_new(_old(spark), mg.new_gstin_rows(res, AS_OF), dedup=True)
    assert sorted(r["row_id"] for r in dedup.collect()) == [1, 2, 11]


def _target(spark):
    rows = [(1, "P", G1, "Old name", "01/01/2000", "9999"), (2, "P", G1, "Old2", None, None),
            (3, "Q", G2, "Keep", "02/02/2002", "1111"), (4, "R", G3, None, None, None)]
    return conform(spark.createDataFrame(rows, "row_id long, pan_reference string, gstin string, trade_name string, "
                                               "registration_date string, hsn_codes string"), GSTIN_DATA_SCHEMA)


def _details(spark):
    return spark.createDataFrame([(G1, "", "05/05/2017", ["1234", "5678"]), (G2, "New", "", [])],
                                 "gstin string, trade_name string, registration_date string, hsn_codes array<string>")


def test_upsert_all_rows(spark):
    out = {r["row_id"]: (r["trade_name"], r["registration_date"], r["hsn_codes"], r["last_updated"])
           for r in mg.upsert_details_all(_target(spark), _details(spark)).collect()}
    assert out[1] == ("Old name", "05/05/2017", "1234, 5678", None)   # blank name does not overwrite
    assert out[2] == ("Old2", "05/05/2017", "1234, 5678", None)       # every row with the GSTIN
    assert out[3] == ("New", "02/02/2002", "1111", None)              # empty list keeps old codes
    assert out[4] == (None, None, None, None)                         # no details


def test_upsert_first_row_stamped(spark):
    out = {r["row_id"]: (r["trade_name"], r["registration_date"], r["hsn_codes"], r["last_updated"])
           for r in mg.upsert_details_first(_target(spark), _details(spark), AS_OF).collect()}
    assert out[1] == ("Old name", "05/05/2017", "1234, 5678", AS_OF)
    assert out[2] == ("Old2", None, None, None)
    assert out[3] == ("New", "02/02/2002", "1111", AS_OF)
    assert out[4] == (None, None, None, None)


def test_lookup_details_errors(spark):
    req = spark.createDataFrame([(G1,), (G1,), (G3,), ("short",)], "gstin string")
    rows = sorted((r["gstin"], r["error"]) for r in en.lookup_details(req, _details(spark)).collect())
    assert rows == [(G1, None), (G1, None), (G3, "No records found")]


def test_enrich_no_fanout_and_key_rules(spark):
    sheet = spark.createDataFrame([(0, G1), (1, G1), (2, G2 + " "), (3, None), (4, G3)],
                                  "row_id long, GSTIN string")
    det = en.codes_text(_details(spark))
    out = {r["row_id"]: (r["Trade_Name"], r["Registration_Date"], r["HSN_Codes"], r["Last_Updated"])
           for r in en.enrich(sheet, det, AS_OF).collect()}
    assert len(out) == 5 and en.enrich(sheet, det, AS_OF).count() == 5
    assert out[0] == ("", "05/05/2017", "1234, 5678", "2025-01-01 00:00:00")
    assert out[1] == out[0]
    assert out[2][:3] == (None, None, None)         # unstripped left key finds no row
    assert out[3][:3] == (None, None, None)         # NULL id
    assert out[4][:3] == ("", "", "")               # looked up, nothing landed


def test_distinct_codes_first_order(spark):
    codes = spark.createDataFrame([("G", 5, "b"), ("G", 1, "a"), ("G", 3, "b"), ("G", 9, ""), ("G", 2, "c")],
                                  "gstin string, pos long, hsn_code string")
    assert en.distinct_codes(codes).first()["hsn_codes"] == ["a", "c", "b"]


def test_details_errors_and_duplicates(spark):
    from regspark.operators.enrich import lookup_details
    from regspark.plans import pipelines as pl

    a, b, c = "27AAAAA0000A1Z1", "27BBBBB0000B1Z2", "27CCCCC0000C1Z3"
    details = spark.createDataFrame(
        [(a, "B", "", ["2"], None), (a, "A", "", ["1"], None), (a, None, None, None, "No records found"),
         (b, None, None, None, "No records found")],
        "gstin string, trade_name string, registration_date string, hsn_codes array<string>, error string")
    asked = spark.createDataFrame([(a,), (b,), (c,), ("short",)], "gstin string")
    got = sorted((r["gstin"], r["trade_name"], r["error"]) for r in lookup_details(asked, details).collect())
    assert got == [(a, "A", None), (b, None, "No records found"), (c, None, "No records found")]
    target = conform(spark.createDataFrame([(0, a, "old"), (0, b, "old"), (1, a, "old")],
                                           "row_id long, gstin string, trade_name string"), GSTIN_DATA_SCHEMA)
    rows = sorted((r["gstin"], r["row_id"], r["trade_name"], r["last_updated"] is not None)
                  for r in pl.update_details(target, asked, details, AS_OF).collect())
    assert rows == [(a, 0, "A", True), (a, 1, "old", False), (b, 0, "old", False)]
    _, progress = pl.details_run_outcomes(target, asked, details)
    assert (progress.first()["successful"], progress.first()["failed"]) == (1, 2)
    for call in (pl.update_details, pl.details_run_outcomes):
        with pytest.raises(pl.ValidationError):
            call(target, asked.where("gstin = 'short'"), details, *([AS_OF] if call is pl.update_details else []))


def test_tables_without_row_ids_are_refused(spark):
    from regspark.plans import pipelines as pl

    sheet = spark.createDataFrame([("ABCDE1234F",)], "pan string")
    with pytest.raises(ValueError, match="row_id"):
        pl.map_pans(sheet, sheet, sheet, AS_OF)
    with pytest.raises(ValueError, match="row_id"):
        mg.upsert_details_first(sheet, sheet, AS_OF)

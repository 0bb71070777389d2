"""Header search, contact columns, column repair, legacy conversion, export."""

from __future__ import annotations

import datetime as dt

import pytest

from regspark.operators import schema as sc

AS_OF = dt.datetime(2025, 1, 1)


@pytest.mark.parametrize("cols,expect,first", [
    (["Name", "PAN NO.", "x"], "PAN NO.", None),
    (["pan_number", "other"], "pan_number", None),
    (["Company", "PAN"], "PAN", "Company"),
    (["Company", "PAN_NO"], "PAN_NO", "Company"),
    (["Name", "Email"], None, None),
])
def test_find_pan_column(cols, expect, first):
    assert sc.find_pan_column(cols) == expect
    assert sc.find_pan_column(cols, first_match=True) == (first or expect)


def test_find_gstin_column():
    assert sc.find_gstin_column(["GSTIN Status", "GSTIN"]) == "GSTIN"
    assert sc.find_gstin_column(["GSTIN Status", "GSTIN"], first_match=True) == "GSTIN Status"
    assert sc.find_gstin_column(["gst_no", "x"]) == "gst_no"
    assert sc.find_gstin_column(["x"]) is None


def test_contact_column():
    assert sc.contact_column(["NAME", "name"], "Name") == "name"
    assert sc.contact_column(["EMAIL"], "Email") == "EMAIL"
    assert sc.contact_column(["x"], "Phone") is None


def test_is_legacy_layout():
    assert sc.is_legacy_layout(["pan_data"]) and not sc.is_legacy_layout(["pan_data", "gstin_data", "x"])


def test_convert_legacy(spark):
    rows = [(0, " abcde1234f", "A", "27ABCDE1234F1Z5", "Active", None),
            (1, "ABCDE1234F", "B", "27ABCDE1234F2Z5", None, "KA"),
            (2, "BAD", "C", "27ABCDE1234F3Z5", "x", "y"),
            (3, "XYZAB9999K", "D", None, None, None),
            (4, "1234567890", "E", "271234567890Z55", "s", "t")]
    df = spark.createDataFrame(rows, "row_id long, `PAN NO.` string, NAME string, gstin string, "
                                     "`GSTIN Status` string, State string")
    pan, gst = sc.convert_legacy(df, AS_OF)
    p = {r["pan"]: (r["row_id"], r["name"], r["email"]) for r in pan.collect()}
    assert p == {"ABCDE1234F": (0, "A", None), "XYZAB9999K": (3, "D", None)}
    g = sorted((r["row_id"], r["pan_reference"], r["gstin"], r["gstin_status"], r["state"]) for r in gst.collect())
    assert g == [(0, "ABCDE1234F", "27ABCDE1234F1Z5", "Active", ""), (1, "ABCDE1234F", "27ABCDE1234F2Z5", "", "KA"),
                 (4, "1234567890", "271234567890Z55", "s", "t")]
    assert list(gst.columns) == list(sc.GSTIN_DATA_SCHEMA)


def test_convert_legacy_without_pan_column(spark):
    df = spark.createDataFrame([(0, "x")], "row_id long, Name string")
    with pytest.raises(sc.LayoutError):
        sc.convert_legacy(df, AS_OF)


def test_ensure_and_drop_and_export(spark):
    df = spark.createDataFrame([("P", "G", "S", 1)], "PAN_Reference string, GSTIN string, `GSTIN Status` string, x int")
    assert sc.simplified_export(df).columns == ["PAN_Reference", "GSTIN", "GSTIN Status"]
    assert sc.simplified_export(df.drop("GSTIN Status")).columns == ["PAN_Reference", "GSTIN"]
    assert sc.simplified_export(df.drop("GSTIN")).columns == ["PAN_Reference", "GSTIN Status", "x"]
    e = sc.ensure_columns(df, {"x": None, "Trade_Name": sc.GSTIN_DATA_SCHEMA["trade_name"]})
    assert e.columns[-1] == "Trade_Name" and "x" in e.columns
    assert sc.drop_if_present(e, ["Trade_Name", "absent"]).columns == df.columns

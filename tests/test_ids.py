"""F1-F6, F9-F11, S4, P-functions on hand-made edge rows (FIXTURES.md section 5)."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from regspark.functions import ids, text

PY_WS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0        　"


def py_norm(v):
    return None if v is None else str(v).strip().upper()


def py_valid(v):
    if v is None:
        return False
    p = str(v).strip().upper()
    return (len(p) == 10 and p[:5].isascii() and p[:5].isalpha() and p[5:9].isascii() and p[5:9].isdigit()
            and p[9].isascii() and p[9].isalpha())


EDGE_PANS = ["abcde1234f", " ABCDE1234F ", "\tABCDE1234F\n", "ABCDE12345", "ABCD1234EF", "ABCDE1234",
             "ABCDE1234FG", "", None, "ÉBCDE1234F", "ABCDE1234F"]


def test_normalize_and_validate_edge_pans(spark):
    df = spark.createDataFrame([(p,) for p in EDGE_PANS], "pan string")
    rows = df.select("pan", ids.normalize_id("pan").alias("n"), ids.is_valid_pan("pan").alias("ok")).collect()
    for r in rows:
        assert r["n"] == py_norm(r["pan"]), r
        assert r["ok"] == py_valid(r["pan"]), r
    valid = {r["pan"] for r in rows if r["ok"]}
    assert valid == {"abcde1234f", " ABCDE1234F ", "\tABCDE1234F\n", "ABCDE1234F"}


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet=PY_WS, max_size=3),
                          st.text(alphabet="abcXYZ019 É-", max_size=12),
                          st.text(alphabet=PY_WS, max_size=3)), min_size=1, max_size=20))
def test_strip_matches_python(spark, parts):
    values = [a + b + c for a, b, c in parts]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = dict(df.select("i", ids.strip_ws("v").alias("s")).collect())
    for i, v in enumerate(values):
        assert got[i] == v.strip(), repr(v)


def test_gstin_length_rule(spark):
    vals = ["X" * 14, "X" * 15, "X" * 16, None, ""]
    df = spark.createDataFrame([(v,) for v in vals], "gstin string")
    got = [r["ok"] for r in df.select(ids.is_valid_gstin("gstin").alias("ok")).collect()]
    assert got == [False, True, False, False, False]


def test_legacy_pair_rule(spark):
    df = spark.createDataFrame([(" abcde1234f ", "27ABCDE1234F1Z5"), ("ABCDE1234F", "27ABCDE1234F1Z"),
                                (None, "27ABCDE1234F1Z5"), ("1234567890", " 27abcde1234f1z5\t")],
                               "pan string, gstin string")
    got = [r[0] for r in df.select(ids.legacy_pair_ok("pan", "gstin")).collect()]
    assert got == [True, False, False, True]


def test_na_tokens_and_non_empty(spark):
    df = spark.createDataFrame([("NA", "x"), ("N/A", None), ("null", "y"), ("", "z"), ("keep", "w")],
                               "a string, old string")
    rows = df.select(ids.null_if_tokens("a").alias("a"), ids.non_empty_or(F.col("a"), F.col("old")).alias("m")).collect()
    assert [r["a"] for r in rows] == [None, None, None, None, "keep"]
    assert [r["m"] for r in rows] == ["NA", "N/A", "null", "z", "keep"]


def test_text_helpers(spark):
    df = spark.createDataFrame([("0123456789ab", "completed", True, False, 10, True, "12", "uploads/a.b/file.XLSX"),
                                ("x", "failed", None, True, None, None, "1x", "noext")],
                               "id string, st string, h boolean, t boolean, lim int, r boolean, lt string, p string")
    r = df.select(text.short_id("id"), text.capitalize_first("st"), text.run_label("h", "t", "lim", "r"),
                  text.parse_limit("lt"), text.file_extension("p"), text.export_name("p"), text.backup_name("p"),
                  text.percent(F.lit(1), F.lit(3)), text.percent(F.lit(1), F.lit(0))).collect()
    assert list(r[0]) == ["01234567...", "Completed", "Headless, Full Mode, Limit: 10, Resume Enabled", 12, "xlsx",
                          "file_simplified.csv", "uploads/a.b/file_backup.XLSX", 33, None]
    assert list(r[1]) == ["x...", "Failed", "UI Mode, Test Mode", None, "", "noext_simplified.csv",
                          "noext_backup", 33, None]


def test_codes_roundtrip(spark):
    df = spark.createDataFrame([(["1234", "5678"],), ([],)], "c array<string>")
    rows = df.select(text.join_codes("c").alias("j")).select("j", text.split_codes("j").alias("back")).collect()
    assert rows[0]["j"] == "1234, 5678" and rows[0]["back"] == ["1234", "5678"]
    assert rows[1]["j"] == "" and rows[1]["back"] == []

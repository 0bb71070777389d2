"""Registered queries: one Spark plan per operator or pipeline of the inventory,
each paired (where SQL can express it) with an oracle text DuckDB runs on the
same tables.

Every query reads the driver's tables through the derived fixtures (FIXTURES.md)
and runs over them whole. Column names and types agree on both sides.
"""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regspark import fixture_pages as fp
from regspark.fixtures import FIXTURE_SQL, _REF, _closure, fixture
from regspark.functions.ids import WHITESPACE_CLASS, is_valid_pan, normalize_id
from regspark.functions.text import not_available, parse_limit, export_name, backup_name, file_extension, stamp
from regspark.operators import activity as ac
from regspark.operators import enrich as en
from regspark.operators import history as hs
from regspark.operators import merge as mg
from regspark.operators import names as nm
from regspark.operators import ordering as od
from regspark.operators import pages as pg
from regspark.operators import results as rs
from regspark.operators import runlog as rl
from regspark.operators import schema as sc
from regspark.operators import validate as va
from regspark.plans import pipelines as pl
from regspark.session import AS_OF, AS_OF_SQL, scratch_path
from regspark.sources import buckets as bk
from regspark.sources import io as sio
from regspark.streaming.apply_results import land_results, stream_apply_results, stream_map_pans

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def fx(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return fixture(spark, sf_dir, name)


def nullable_counts(df: DataFrame, *cols: str) -> DataFrame:
    """Integer columns that hold NULLs are presented as DOUBLE (as a sheet cell holds a
    number), in the Spark query and its oracle alike: Spark hands a nullable long to
    pandas as float64, DuckDB as Int64, and the two print differently."""
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


# --------------------------------------------------------------------------- oracle text

WS = WHITESPACE_CLASS
PAT = r"^[A-Z]{5}[0-9]{4}[A-Z]$"


def STRIP(x: str) -> str:  # noqa: N802
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def NORM(x: str) -> str:  # noqa: N802
    return f"upper({STRIP(x)})"


def oracle(fixtures, ctes, select: str) -> str:
    parts = [f"{n} AS ({_REF.sub(lambda m: m.group(1), FIXTURE_SQL[n]).strip()})" for n in _closure(fixtures)]
    parts += [f"{k} AS ({v.strip()})" for k, v in ctes]
    return "WITH " + ",\n".join(parts) + "\n" + select.strip()


NR = "'No records found'"
C_V = ("v", f"SELECT row_id, {NORM('pan')} AS pan, name, address FROM pan_sheet WHERE pan IS NOT NULL")
C_FIRSTS = ("firsts", f"""
SELECT pan, min(row_id) AS row_id, arg_min(name, row_id) AS name, arg_min(address, row_id) AS address
FROM v WHERE regexp_matches(pan, '{PAT}') GROUP BY pan""")


def c_rollup(src: str = "lookup_results", order: str = "ord", name: str = "r"):
    anyc = " OR ".join(f"contains(coalesce({c}, ''), {NR})" for c in ("gstin", "gstin_status", "state", "result"))
    return (name, f"""
SELECT pan, count(*) FILTER (WHERE length(gstin) = 15) AS gstin_count, count(gstin) AS raw_gstin_count,
  CASE WHEN count(*) FILTER (WHERE length(gstin) = 15) > 0 THEN 'Success'
       WHEN bool_or({anyc}) THEN 'No GSTINs found'
       WHEN count(*) FILTER (WHERE contains(coalesce(result, ''), 'Error')) > 0
         THEN arg_min(result, {order}) FILTER (WHERE contains(coalesce(result, ''), 'Error'))
       ELSE 'Unknown' END AS status
FROM {src} GROUP BY pan""")


C_ROLLUP = c_rollup()
C_CODES = [
    ("cf", "SELECT gstin, hsn_code, min(pos) AS pos FROM details_hsn WHERE coalesce(hsn_code, '') <> '' "
           "GROUP BY gstin, hsn_code"),
    ("codes", "SELECT gstin, string_agg(hsn_code, ', ' ORDER BY pos, hsn_code) AS codes FROM cf GROUP BY gstin"),
    ("dd", "SELECT d.gstin, d.trade_name, d.registration_date, c.codes FROM details d LEFT JOIN codes c USING (gstin)"),
]
C_DDREQ = ("ddreq", "SELECT * FROM dd WHERE gstin IN (SELECT gstin FROM requested_gstins WHERE length(gstin) = 15)")
GSTIN_COLS = "row_id, pan_reference, gstin, gstin_status, state, trade_name, registration_date, hsn_codes, last_updated"
C_OLD = ("old", """
SELECT row_id, pan_reference, gstin, gstin_status, state, CAST(NULL AS VARCHAR) AS trade_name,
  CAST(NULL AS VARCHAR) AS registration_date, CAST(NULL AS VARCHAR) AS hsn_codes,
  CAST(NULL AS TIMESTAMP) AS last_updated FROM gstin_sheet""")


def c_new(src: str = "lookup_results"):
    return ("newrows", f"""
SELECT ord AS row_id, pan AS pan_reference, gstin, gstin_status, state, CAST(NULL AS VARCHAR) AS trade_name,
  CAST(NULL AS VARCHAR) AS registration_date, CAST(NULL AS VARCHAR) AS hsn_codes, {AS_OF_SQL} AS last_updated
FROM {src} l WHERE length(gstin) = 15 AND NOT EXISTS (SELECT 1 FROM gstin_sheet s WHERE s.gstin = l.gstin)""")


APPEND_SELECT = f"SELECT {GSTIN_COLS} FROM old UNION ALL SELECT {GSTIN_COLS} FROM newrows"
PAN_DATA_SELECT = f"""
SELECT s.row_id, s.pan, s.name, CAST(NULL AS VARCHAR) AS email, CAST(NULL AS VARCHAR) AS phone, s.address,
  CAST(u.gstin_count AS DOUBLE) AS gstin_count, CASE WHEN u.row_id IS NOT NULL THEN {AS_OF_SQL} END AS last_updated,
  u.status
FROM pan_sheet s LEFT JOIN upd u USING (row_id)"""


# --------------------------------------------------------------------------- shared Spark inputs

def _sheet(spark, d):
    return sc.conform(fx(spark, d, "pan_sheet"), sc.PAN_DATA_SCHEMA)


def _gstin_sheet(spark, d):
    return sc.conform(fx(spark, d, "gstin_sheet"), sc.GSTIN_DATA_SCHEMA)


def _valid(spark, d):
    return va.normalize_valid_pans(fx(spark, d, "pan_sheet"), keep=["name", "address"])


def _details_arrays(spark, d):
    return fp.details_landed(spark, d)


# --------------------------------------------------------------------------- F1 F4 F5 A3 F7 F8

@register("normalize_valid_pans", oracle(["pan_sheet"], [C_V, C_FIRSTS], "SELECT pan, row_id, name, address FROM firsts"))
def q_normalize_valid_pans(spark, d):
    return _valid(spark, d)


@register("invalid_pan_report", oracle(["pan_sheet"], [], f"""
SELECT row_id, row_id + 2 AS sheet_row, {NORM('pan')} AS pan FROM pan_sheet
WHERE pan IS NOT NULL AND NOT regexp_matches({NORM('pan')}, '{PAT}')"""))
def q_invalid_pan_report(spark, d):
    return va.invalid_pan_rows(fx(spark, d, "pan_sheet"))


@register("invalid_pan_sample", oracle(["pan_sheet"], [], f"""
SELECT row_id, row_id + 2 AS sheet_row, {NORM('pan')} AS pan FROM pan_sheet
WHERE pan IS NOT NULL AND NOT regexp_matches({NORM('pan')}, '{PAT}') ORDER BY row_id LIMIT 5"""))
def q_invalid_pan_sample(spark, d):
    """the first five invalid rows shown in the log (a top-5 report)."""
    return od.first_n(va.invalid_pan_rows(fx(spark, d, "pan_sheet")), 5)


@register("all_keys_missing", oracle(["pan_sheet"], [], """
SELECT count(*) AS n_rows, count(pan) AS n_present, count(pan) = 0 AS all_missing FROM pan_sheet"""))
def q_all_keys_missing(spark, d):
    return va.key_presence(fx(spark, d, "pan_sheet"))


# --------------------------------------------------------------------------- J1 L1 L2 L4

C_PENDING = ("pending", "SELECT f.pan, f.row_id FROM firsts f WHERE NOT EXISTS (SELECT 1 FROM done_keys k WHERE k.pan = f.pan)")


def _pending(spark, d):
    return rs.pending_pans(_valid(spark, d).select("pan", "row_id"), fx(spark, d, "done_keys"))


@register("pending_pans", oracle(["pan_sheet", "done_keys"], [C_V, C_FIRSTS, C_PENDING], "SELECT pan, row_id FROM pending"))
def q_pending_pans(spark, d):
    return _pending(spark, d)


@register("pending_pans_limit", oracle(["pan_sheet", "done_keys"], [C_V, C_FIRSTS, C_PENDING],
                                       "SELECT pan, row_id FROM pending ORDER BY row_id LIMIT 10"))
def q_pending_pans_limit(spark, d):
    """L1: the run option "process at most 10 PANs" after resume."""
    return od.first_n(_pending(spark, d), 10)


@register("pending_pans_test_mode", oracle(["pan_sheet", "done_keys"], [C_V, C_FIRSTS, C_PENDING],
                                           "SELECT pan, row_id FROM pending ORDER BY row_id LIMIT 1"))
def q_pending_pans_test_mode(spark, d):
    """L2: test mode looks up the first pending PAN only."""
    return od.first_n(_pending(spark, d), 1)


@register("batch_numbers", oracle(["pan_sheet", "done_keys"], [C_V, C_FIRSTS, C_PENDING], """
SELECT pan, row_id, position, (position - 1) // 10 AS batch_no
FROM (SELECT pan, row_id, row_number() OVER (ORDER BY row_id) AS position FROM pending) t"""))
def q_batch_numbers(spark, d):
    return od.cut_batches(_pending(spark, d), 10).select("pan", "row_id", "position", "batch_no")


# --------------------------------------------------------------------------- J3 A1 A2 A4 A5 J4

@register("status_by_pan", oracle(["pan_sheet", "lookup_results"], [C_V, C_FIRSTS, C_ROLLUP], """
SELECT f.pan, f.row_id, r.gstin_count, r.raw_gstin_count, r.status FROM firsts f LEFT JOIN r USING (pan)"""))
def q_status_by_pan(spark, d):
    valid = _valid(spark, d).select("pan", "row_id")
    return rs.status_by_pan(valid, fx(spark, d, "lookup_results")).select(
        "pan", "row_id", "gstin_count", "raw_gstin_count", "status")


C_UPD = ("upd", "SELECT f.row_id, r.gstin_count, r.status FROM firsts f JOIN r USING (pan)")


@register("apply_results", oracle(["pan_sheet", "lookup_results"], [C_V, C_FIRSTS, C_ROLLUP, C_UPD], PAN_DATA_SELECT))
def q_apply_results(spark, d):
    return nullable_counts(
        rs.apply_results(_sheet(spark, d), rs.rollup_results(fx(spark, d, "lookup_results")), AS_OF), "gstin_count")


@register("apply_results_raw", oracle(["pan_sheet", "lookup_results"], [
    C_ROLLUP,
    ("rawfirst", "SELECT pan, min(row_id) AS row_id FROM pan_sheet WHERE pan IS NOT NULL GROUP BY pan"),
    ("upd", "SELECT f.row_id, r.gstin_count, r.status FROM rawfirst f JOIN r USING (pan)")], PAN_DATA_SELECT))
def q_apply_results_raw(spark, d):
    """J4 with the original raw-text match: lower-case or padded rows are never updated."""
    return nullable_counts(rs.apply_results(_sheet(spark, d), rs.rollup_results(fx(spark, d, "lookup_results")),
                                            AS_OF, match="raw"), "gstin_count")


# --------------------------------------------------------------------------- P7 F2 J2 U1

@register("append_new_gstins", oracle(["gstin_sheet", "lookup_results"], [C_OLD, c_new()], APPEND_SELECT))
def q_append_new_gstins(spark, d):
    return mg.append_new(_gstin_sheet(spark, d), mg.new_gstin_rows(fx(spark, d, "lookup_results"), AS_OF))


@register("export_simplified", oracle(["gstin_sheet", "lookup_results"], [C_OLD, c_new()], f"""
SELECT pan_reference AS "PAN_Reference", gstin AS "GSTIN", gstin_status AS "GSTIN Status"
FROM ({APPEND_SELECT}) t"""))
def q_export_simplified(spark, d):
    return pl.export_simplified(q_append_new_gstins(spark, d))


# --------------------------------------------------------------------------- C1-C6 F3 U2 P9 (legacy)

def _legacy_df(spark, d):
    """The old one-sheet layout with sheet-style headers."""
    return fx(spark, d, "legacy_sheet").select(
        "row_id", F.col("pan_no").alias("PAN NO."), F.col("name").alias("NAME"),
        F.col("gstin"), F.col("gstin_status").alias("GSTIN Status"), F.col("state").alias("State"))


@register("legacy_pan_rows", oracle(["legacy_sheet"], [
    ("lv", f"SELECT row_id, {NORM('pan_no')} AS pan, name FROM legacy_sheet WHERE pan_no IS NOT NULL"),
    ("lf", f"SELECT pan, min(row_id) AS row_id, arg_min(name, row_id) AS name FROM lv "
           f"WHERE regexp_matches(pan, '{PAT}') GROUP BY pan")], """
SELECT row_id, pan, name, CAST(NULL AS VARCHAR) AS email, CAST(NULL AS VARCHAR) AS phone,
  CAST(NULL AS VARCHAR) AS address, CAST(NULL AS DOUBLE) AS gstin_count, CAST(NULL AS TIMESTAMP) AS last_updated,
  CAST(NULL AS VARCHAR) AS status FROM lf"""))
def q_legacy_pan_rows(spark, d):
    pan_data, _ = sc.convert_legacy(_legacy_df(spark, d), AS_OF)
    return nullable_counts(pan_data, "gstin_count")


@register("legacy_gstin_rows", oracle(["legacy_sheet"], [], f"""
SELECT row_id, {NORM('pan_no')} AS pan_reference, {NORM('gstin')} AS gstin,
  coalesce(gstin_status, '') AS gstin_status, coalesce(state, '') AS state, CAST(NULL AS VARCHAR) AS trade_name,
  CAST(NULL AS VARCHAR) AS registration_date, CAST(NULL AS VARCHAR) AS hsn_codes, {AS_OF_SQL} AS last_updated
FROM legacy_sheet
WHERE length(coalesce({NORM('pan_no')}, '')) = 10 AND length(coalesce({NORM('gstin')}, '')) = 15"""))
def q_legacy_gstin_rows(spark, d):
    _, gstin_data = sc.convert_legacy(_legacy_df(spark, d), AS_OF)
    return gstin_data


@register("legacy_orphans", oracle(["legacy_sheet"], [
    ("lv", f"SELECT row_id, {NORM('pan_no')} AS pan FROM legacy_sheet WHERE pan_no IS NOT NULL"),
    ("lp", f"SELECT DISTINCT pan FROM lv WHERE regexp_matches(pan, '{PAT}')")], f"""
SELECT row_id, {NORM('pan_no')} AS pan_reference, {NORM('gstin')} AS gstin,
  coalesce(gstin_status, '') AS gstin_status, coalesce(state, '') AS state, CAST(NULL AS VARCHAR) AS trade_name,
  CAST(NULL AS VARCHAR) AS registration_date, CAST(NULL AS VARCHAR) AS hsn_codes, {AS_OF_SQL} AS last_updated
FROM legacy_sheet
WHERE length(coalesce({NORM('pan_no')}, '')) = 10 AND length(coalesce({NORM('gstin')}, '')) = 15
  AND {NORM('pan_no')} NOT IN (SELECT pan FROM lp)"""))
def q_legacy_orphans(spark, d):
    """Legacy GSTIN rows whose PAN is not a valid PAN row."""
    pan_data, gstin_data = sc.convert_legacy(_legacy_df(spark, d), AS_OF)
    return sc.legacy_orphans(pan_data, gstin_data)


# --------------------------------------------------------------------------- F9 J5 J6 J7 A6 A8

@register("split_gstins", oracle(["requested_gstins"], [], """
SELECT gstin, coalesce(length(gstin) = 15, false) AS is_valid FROM requested_gstins"""))
def q_split_gstins(spark, d):
    return va.split_gstins(fx(spark, d, "requested_gstins"))


def _found(spark, d):
    return mg.requested_with_details(fx(spark, d, "requested_gstins"), _details_arrays(spark, d))


@register("details_upsert_all", oracle(["gstin_sheet", "details", "details_hsn", "requested_gstins"],
                                       C_CODES + [C_DDREQ], """
SELECT s.row_id, s.pan_reference, s.gstin, s.gstin_status, s.state,
  nullif(u.trade_name, '') AS trade_name, nullif(u.registration_date, '') AS registration_date,
  nullif(u.codes, '') AS hsn_codes, CAST(NULL AS TIMESTAMP) AS last_updated
FROM gstin_sheet s LEFT JOIN ddreq u USING (gstin)"""))
def q_details_upsert_all(spark, d):
    return mg.upsert_details_all(_gstin_sheet(spark, d), _found(spark, d))


C_HITS_FIRST = [
    ("fr", "SELECT gstin, min(row_id) AS row_id FROM gstin_sheet WHERE gstin IS NOT NULL GROUP BY gstin"),
    ("hits", "SELECT fr.row_id, u.trade_name, u.registration_date, u.codes FROM fr JOIN ddreq u USING (gstin)"),
]
UPSERT_FIRST_SELECT = f"""
SELECT s.row_id, s.pan_reference, s.gstin, s.gstin_status, s.state,
  nullif(h.trade_name, '') AS trade_name, nullif(h.registration_date, '') AS registration_date,
  nullif(h.codes, '') AS hsn_codes, CASE WHEN h.row_id IS NOT NULL THEN {AS_OF_SQL} END AS last_updated
FROM gstin_sheet s LEFT JOIN hits h USING (row_id)"""


@register("details_upsert_first", oracle(["gstin_sheet", "details", "details_hsn", "requested_gstins"],
                                         C_CODES + [C_DDREQ] + C_HITS_FIRST, UPSERT_FIRST_SELECT))
def q_details_upsert_first(spark, d):
    return mg.upsert_details_first(_gstin_sheet(spark, d), _found(spark, d), AS_OF)


@register("update_details", oracle(["gstin_sheet", "details", "details_hsn", "requested_gstins"],
                                   C_CODES + [C_DDREQ] + C_HITS_FIRST, UPSERT_FIRST_SELECT))
def q_update_details(spark, d):
    """Q2: the table after a details run over every requested id."""
    return pl.update_details(_gstin_sheet(spark, d), fx(spark, d, "requested_gstins"),
                             _details_arrays(spark, d), AS_OF)


C_OUTCOMES = ("outc", """
SELECT q.gstin,
  CASE WHEN dd.gstin IS NULL THEN 'No records found'
       WHEN NOT EXISTS (SELECT 1 FROM gstin_sheet s WHERE s.gstin = q.gstin) THEN 'Failed to update Excel file' END AS error
FROM requested_gstins q LEFT JOIN dd USING (gstin) WHERE length(q.gstin) = 15""")


@register("update_details_outcomes", oracle(["gstin_sheet", "details", "details_hsn", "requested_gstins"],
                                            C_CODES + [C_OUTCOMES], "SELECT gstin, error IS NULL AS success, error FROM outc"))
def q_update_details_outcomes(spark, d):
    """J7 + A6 per id: each requested valid GSTIN, success or its error."""
    outcomes, _ = pl.details_run_outcomes(_gstin_sheet(spark, d), fx(spark, d, "requested_gstins"),
                                          _details_arrays(spark, d))
    return outcomes


@register("batch_progress", oracle(["gstin_sheet", "details", "details_hsn", "requested_gstins"],
                                   C_CODES + [C_OUTCOMES], """
SELECT count(*) AS total, count(*) AS processed, count(*) FILTER (WHERE error IS NULL) AS successful,
  count(*) FILTER (WHERE error IS NOT NULL) AS failed,
  CAST(round(100.0 * count(*) / nullif(count(*), 0)) AS BIGINT) AS percent_done FROM outc"""))
def q_batch_progress(spark, d):
    _, progress = pl.details_run_outcomes(_gstin_sheet(spark, d), fx(spark, d, "requested_gstins"),
                                          _details_arrays(spark, d))
    return progress


@register("single_details", oracle(["gstin_sheet", "details", "details_hsn", "requested_gstins"], C_CODES + [
    ("ddreq", "SELECT * FROM dd WHERE gstin = (SELECT min(gstin) FROM gstin_sheet)")] + C_HITS_FIRST,
    UPSERT_FIRST_SELECT))
def q_single_details(spark, d):
    """Q6: one id (the smallest GSTIN of the table) looked up and written to its first row."""
    target = _gstin_sheet(spark, d)
    one = target.agg(F.min("gstin").alias("gstin"))
    return pl.single_details(target, one, _details_arrays(spark, d), AS_OF)


@register("single_details_latest", oracle(["gstin_sheet", "details", "details_hsn", "requested_gstins"], C_CODES + [
    ("ddreq", "SELECT * FROM dd WHERE gstin = (SELECT min(gstin) FROM gstin_sheet)")] + C_HITS_FIRST,
    UPSERT_FIRST_SELECT))
def q_single_details_latest(spark, d):
    """A9 -> Q6: the tables of the latest completed run in the log, updated as a new version."""
    base, target = scratch_path(spark, "runs"), _gstin_sheet(spark, d)
    log = fx(spark, d, "jobs").withColumn(
        "result_file", F.when(F.col("result_file").isNotNull(), F.concat(F.lit(base + "/"), F.col("job_id"))))
    sio.write_two_tables(_sheet(spark, d), target, rl.latest_completed(log).first()["result_file"])
    root = pl.update_latest(spark, log, target.agg(F.min("gstin").alias("gstin")), _details_arrays(spark, d), AS_OF)
    return sio.read_two_tables(spark, root)[1]


@register("update_details_from_pages", oracle(
    ["gstin_sheet", "lookup_results", "details", "details_hsn", "requested_gstins"], C_CODES + [C_DDREQ] + C_HITS_FIRST,
    UPSERT_FIRST_SELECT))
def q_update_details_from_pages(spark, d):
    """Q5 -> Q2: details extracted from landed pages, each page landed twice; pages that report an error update nothing."""
    pages = fp.detail_pages(spark, d)
    return pl.update_details(_gstin_sheet(spark, d), fx(spark, d, "requested_gstins"),
                             pg.extract_details(pages.unionByName(pages)), AS_OF)


@register("details_display", oracle(["details"], [], """
SELECT gstin, coalesce(nullif(trade_name, ''), 'Not available') AS trade_name_display,
  coalesce(nullif(registration_date, ''), 'Not available') AS registration_date_display FROM details"""))
def q_details_display(spark, d):
    return fx(spark, d, "details").select(
        "gstin", not_available("trade_name").alias("trade_name_display"),
        not_available("registration_date").alias("registration_date_display"))


# --------------------------------------------------------------------------- J8 C7 F6 P10 (enrichment)

ENRICH_SHEET = ("sh", """
SELECT row_id, pan_reference AS "PAN_Reference",
  CASE WHEN row_id % 11 = 3 THEN concat(gstin, ' ') ELSE gstin END AS "GSTIN",
  gstin_status AS "GSTIN Status", state AS "State" FROM gstin_sheet""")
ENRICH_SELECT = f"""
SELECT sh.*,
  CASE WHEN sh."GSTIN" IS NOT NULL AND sh."GSTIN" = {STRIP('sh."GSTIN"')} THEN coalesce(dd.trade_name, '') END AS "Trade_Name",
  CASE WHEN sh."GSTIN" IS NOT NULL AND sh."GSTIN" = {STRIP('sh."GSTIN"')} THEN coalesce(dd.registration_date, '') END
    AS "Registration_Date",
  CASE WHEN sh."GSTIN" IS NOT NULL AND sh."GSTIN" = {STRIP('sh."GSTIN"')} THEN coalesce(dd.codes, '') END AS "HSN_Codes",
  '2025-01-01 00:00:00' AS "Last_Updated"
FROM sh LEFT JOIN dd ON sh."GSTIN" = dd.gstin"""


def _enrich_input(spark, d):
    g = fx(spark, d, "gstin_sheet")
    return g.select(
        "row_id", F.col("pan_reference").alias("PAN_Reference"),
        F.when(F.col("row_id") % 11 == 3, F.concat("gstin", F.lit(" "))).otherwise(F.col("gstin")).alias("GSTIN"),
        F.col("gstin_status").alias("GSTIN Status"), F.col("state").alias("State"),
        F.lit(None).cast("string").alias("Trade_Name"), F.lit(None).cast("string").alias("HSN_Codes"))


@register("enrich_left", oracle(["gstin_sheet", "details", "details_hsn"], C_CODES + [ENRICH_SHEET], ENRICH_SELECT))
def q_enrich_left(spark, d):
    return en.enrich(_enrich_input(spark, d), en.codes_text(_details_arrays(spark, d)), AS_OF)


@register("enrich_sheet", oracle(["gstin_sheet", "details", "details_hsn"], C_CODES + [ENRICH_SHEET], ENRICH_SELECT))
def q_enrich_sheet(spark, d):
    """Q3 end to end: the sheet goes out as CSV, is read back as text (S2), enriched
    and written as a new file (S10), which is what is returned."""
    src = scratch_path(spark, "enrich-in")
    sio.write_csv(_enrich_input(spark, d), src)
    sheet = sio.read_sheet(spark, src, row_id=None).withColumn("row_id", F.col("row_id").cast("long"))
    out = pl.enrich_sheet(sheet, en.codes_text(_details_arrays(spark, d)), AS_OF)
    dst = scratch_path(spark, "enrich-out")
    sio.write_csv(out, dst)
    back = sio.read_csv_text(spark, dst)
    return back.select(
        F.col("row_id").cast("long").alias("row_id"), *[F.col(f"`{c}`") for c in back.columns if c != "row_id"])


# --------------------------------------------------------------------------- X1-X9, Q5

EXTRACT_SELECT = """
SELECT pan, ord // 1000 AS page_no, row_number() OVER (PARTITION BY pan, ord // 1000 ORDER BY ord) - 1 AS row_no,
  CAST(ord AS VARCHAR) AS serial, gstin, gstin_status, state, length(gstin) <> 15 AS bad_length
FROM lookup_results WHERE gstin IS NOT NULL"""
OUTCOME_TEXT = "CASE WHEN result = 'No records found' THEN 'No records found' ELSE 'Error: Results table not found' END"


@register("extract_result_rows", oracle(["lookup_results"], [], EXTRACT_SELECT))
def q_extract_result_rows(spark, d):
    return pg.extract_result_rows(fp.lookup_pages(spark, d))


@register("page_outcomes", oracle(["lookup_results"], [], f"""
SELECT pan, ord // 1000 AS page_no, CAST(NULL AS VARCHAR) AS outcome, count(*) AS n_rows
FROM lookup_results WHERE gstin IS NOT NULL GROUP BY pan, ord // 1000
UNION ALL
SELECT pan, CAST(0 AS BIGINT), {OUTCOME_TEXT}, CAST(0 AS BIGINT) FROM lookup_results WHERE result IS NOT NULL"""))
def q_page_outcomes(spark, d):
    return pg.page_outcomes(fp.lookup_pages(spark, d))


@register("page_headers", oracle(["lookup_results"], [], """
SELECT DISTINCT pan, ord // 1000 AS page_no, CAST(0 AS BIGINT) AS table_no,
  'S.No | GSTIN/UIN | GSTIN/UIN Status | State' AS headers FROM lookup_results WHERE gstin IS NOT NULL"""))
def q_page_headers(spark, d):
    h = pg.table_headers(fp.lookup_pages(spark, d))
    return h.withColumn("headers", F.array_join("headers", " | "))


C_IDS = ("ids", "SELECT DISTINCT gstin FROM requested_gstins WHERE length(gstin) = 15")
DETAILS_SELECT = """
SELECT i.gstin, dd.trade_name, dd.registration_date,
  CASE WHEN dd.gstin IS NOT NULL THEN coalesce(dd.codes, '') END AS hsn_codes,
  CASE WHEN dd.gstin IS NULL THEN 'No records found' END AS error
FROM ids i LEFT JOIN dd USING (gstin)"""


@register("extract_details", oracle(["requested_gstins", "details", "details_hsn"], C_CODES + [C_IDS], DETAILS_SELECT))
def q_extract_details(spark, d):
    return pg.details_with_text(pg.extract_details(fp.detail_pages(spark, d)))


@register("extract_details_alt", oracle(["details", "details_hsn"], [], """
SELECT h.gstin, h.pos // 1000 AS page_no, d.trade_name, d.registration_date,
  string_agg(h.hsn_code, ', ' ORDER BY h.pos, h.hsn_code) AS hsn_codes
FROM details_hsn h JOIN details d USING (gstin) GROUP BY h.gstin, h.pos // 1000, d.trade_name, d.registration_date"""))
def q_extract_details_alt(spark, d):
    return pg.details_with_text(pg.extract_details_alt(fp.detail_pages_alt(spark, d)).drop("error"))


C_ITEMS = ("items", f"""
SELECT pan, ord // 1000 AS page_no, row_number() OVER (PARTITION BY pan, ord // 1000 ORDER BY ord) - 1 AS item_no,
  CAST(ord AS VARCHAR) AS serial, gstin, gstin_status, state, CAST(NULL AS VARCHAR) AS result
FROM lookup_results WHERE gstin IS NOT NULL
UNION ALL
SELECT pan, CAST(0 AS BIGINT), CAST(0 AS BIGINT), NULL, NULL, NULL, NULL, {OUTCOME_TEXT}
FROM lookup_results WHERE result IS NOT NULL""")


@register("ingest_pages_results", oracle(["lookup_results"], [C_ITEMS], "SELECT * FROM items"))
def q_ingest_pages_results(spark, d):
    items, _, _ = pl.ingest_pages(fp.lookup_pages(spark, d), fp.detail_pages(spark, d))
    return items


@register("ingest_pages", oracle(["lookup_results"], [C_ITEMS], "SELECT * FROM items"))
def q_ingest_pages(spark, d):
    """Q5 end to end: result pages parsed once and written as this run's landed
    ``lookup_results`` table, which is what is returned (read back)."""
    items, _, _ = pl.ingest_pages(fp.lookup_pages(spark, d), fp.detail_pages(spark, d),
                                  items_dir=scratch_path(spark, "items"))
    return items


@register("ingest_pages_status", oracle(["lookup_results"], [
    C_ITEMS, ("items2", "SELECT *, page_no * 1000000 + item_no AS seq FROM items"), c_rollup("items2", "seq")],
    "SELECT pan, gstin_count, raw_gstin_count, status FROM r"))
def q_ingest_pages_status(spark, d):
    """Q5 -> A4: the status of every PAN computed from its landed pages (items written once)."""
    _, status, _ = pl.ingest_pages(fp.lookup_pages(spark, d), fp.detail_pages(spark, d),
                                   items_dir=scratch_path(spark, "items"))
    return status.select("pan", "gstin_count", "raw_gstin_count", "status")


@register("ingest_pages_details", oracle(["requested_gstins", "details", "details_hsn"], C_CODES + [C_IDS], DETAILS_SELECT))
def q_ingest_pages_details(spark, d):
    _, _, det = pl.ingest_pages(fp.lookup_pages(spark, d), fp.detail_pages(spark, d))
    return pg.details_with_text(det)


# --------------------------------------------------------------------------- P7 P8 P14

@register("nested_results_explode", oracle(["lookup_results"], [], """
SELECT pan, row_number() OVER (PARTITION BY pan, ord // 1000 ORDER BY ord) - 1 AS item_no,
  ord, gstin, gstin_status, state, result FROM lookup_results"""))
def q_nested_results_explode(spark, d):
    nested = fp.nested_results(spark, d)
    as_json = nested.select(F.to_json("results").alias("value"))          # P14 encode
    back = as_json.select(F.from_json("value", nested.schema["results"].dataType).alias("results"))  # decode
    return rs.explode_nested_results(back)


@register("pan_gstin_map_explode", oracle(["lookup_results"], [], """
SELECT pan, gstin, 'Active' AS gstin_status FROM lookup_results WHERE length(gstin) = 15"""))
def q_pan_gstin_map_explode(spark, d):
    return rs.explode_pan_gstin_map(fp.pan_gstin_map(spark, d))


# --------------------------------------------------------------------------- run log: L3 P11 P12 P13 A9 U3 C9 P4

RUN_HISTORY_SELECT = """
SELECT job_id, concat(substr(job_id, 1, 8), '...') AS short_id, filename, created_at,
  concat(upper(substr(status, 1, 1)), lower(substr(status, 2))) AS status_label,
  concat(CASE WHEN coalesce(headless, false) THEN 'Headless' ELSE 'UI Mode' END, ', ',
         CASE WHEN coalesce(test_mode, false) THEN 'Test Mode' ELSE 'Full Mode' END,
         CASE WHEN coalesce(max_pans, 0) <> 0 THEN concat(', Limit: ', CAST(max_pans AS VARCHAR)) ELSE '' END,
         CASE WHEN coalesce(resume, false) THEN ', Resume Enabled' ELSE '' END) AS params_label
FROM jobs ORDER BY created_at DESC, job_id DESC"""


@register("run_history", oracle(["jobs"], [], RUN_HISTORY_SELECT))
def q_run_history(spark, d):
    return rl.run_history(fx(spark, d, "jobs"))


@register("latest_completed", oracle(["jobs"], [], """
SELECT job_id, result_file, end_time FROM jobs WHERE status = 'completed' AND result_file IS NOT NULL
ORDER BY end_time DESC, job_id DESC LIMIT 1"""))
def q_latest_completed(spark, d):
    return rl.latest_completed(fx(spark, d, "jobs"))


@register("drop_runs", oracle(["jobs"], [], """
SELECT job_id, filename, status, created_at FROM jobs j
WHERE NOT EXISTS (SELECT 1 FROM jobs f WHERE f.status = 'failed' AND f.job_id = j.job_id)"""))
def q_drop_runs(spark, d):
    jobs = fx(spark, d, "jobs")
    return rl.drop_runs(jobs, jobs.where(F.col("status") == "failed")).select("job_id", "filename", "status", "created_at")


LIMIT_TEXT_SQL = """CASE CAST(job_id AS BIGINT) % 4 WHEN 0 THEN coalesce(CAST(max_pans AS VARCHAR), '')
  WHEN 1 THEN '' WHEN 2 THEN concat(job_id, 'x') ELSE job_id END"""


def _limit_text():
    k = F.col("job_id").cast("long") % 4
    return (F.when(k == 0, F.coalesce(F.col("max_pans").cast("string"), F.lit("")))
            .when(k == 1, F.lit("")).when(k == 2, F.concat("job_id", F.lit("x"))).otherwise(F.col("job_id")))


@register("run_limits", oracle(["jobs"], [], f"""
SELECT job_id, limit_text,
  CAST(CASE WHEN regexp_matches(limit_text, '^[0-9]+$') THEN TRY_CAST(limit_text AS INTEGER) END AS DOUBLE) AS max_pans
FROM (SELECT job_id, {LIMIT_TEXT_SQL} AS limit_text FROM jobs) t"""))
def q_run_limits(spark, d):
    """The limit field of the run form parsed (blank or non-digit -> none)."""
    jobs = fx(spark, d, "jobs").select("job_id", _limit_text().alias("limit_text"))
    return nullable_counts(jobs.select("job_id", "limit_text", parse_limit("limit_text").alias("max_pans")), "max_pans")


UPLOAD_SQL = """concat('uploads/', replace(filename, '.csv',
  CASE CAST(job_id AS BIGINT) % 4 WHEN 0 THEN '.csv' WHEN 1 THEN '.XLSX' WHEN 2 THEN '.xls' ELSE '.txt' END))"""


def _upload():
    k = F.col("job_id").cast("long") % 4
    ext = (F.when(k == 0, F.lit(".csv")).when(k == 1, F.lit(".XLSX")).when(k == 2, F.lit(".xls"))
           .otherwise(F.lit(".txt")))
    return F.concat(F.lit("uploads/"), F.replace(F.col("filename"), F.lit(".csv"), ext))


@register("export_names", oracle(["jobs"], [], f"""
SELECT job_id, path, lower(regexp_extract(path, '\\.([^./]*)$', 1)) AS extension,
  lower(regexp_extract(path, '\\.([^./]*)$', 1)) IN ('xlsx', 'xls', 'csv') AS accepted,
  concat(regexp_replace(regexp_replace(path, '^.*/', ''), '\\.[^.]*$', ''), '_simplified.csv') AS simplified_name,
  concat(regexp_replace(regexp_replace(path, '^.*/', ''), '\\.[^.]*$', ''), '_simplified_1735689600.csv') AS download_name,
  concat(regexp_replace(path, '\\.[^./]*$', ''), '_backup', regexp_extract(path, '\\.[^./]*$', 0)) AS backup_name
FROM (SELECT job_id, {UPLOAD_SQL} AS path FROM jobs) t"""))
def q_export_names(spark, d):
    """C9 + P4: extension test of an upload, download name and backup name."""
    p = fx(spark, d, "jobs").select("job_id", _upload().alias("path"))
    ext = file_extension("path")
    return p.select("job_id", "path", ext.alias("extension"), ext.isin("xlsx", "xls", "csv").alias("accepted"),
                    export_name("path").alias("simplified_name"),
                    export_name("path", as_of=AS_OF).alias("download_name"), backup_name("path").alias("backup_name"))


# --------------------------------------------------------------------------- A7 A10

@register("processed_count", oracle(["done_keys"], [], f"""
SELECT count(*) AS processed_count, {AS_OF_SQL} AS timestamp FROM done_keys"""))
def q_processed_count(spark, d):
    """A7 over a checkpoint written and read back."""
    path = scratch_path(spark, "checkpoint")
    done = fx(spark, d, "done_keys")
    lr = fx(spark, d, "lookup_results").join(done, "pan", "left_semi")
    sio.write_checkpoint(done, lr, path, batch=0, as_of=AS_OF)
    keys, _ = sio.read_checkpoint(spark, path)
    return rl.processed_count(keys)


@register("run_summary", oracle(["pan_sheet", "gstin_sheet", "lookup_results"], [C_V, C_FIRSTS, C_OLD, c_new()], f"""
SELECT 'unique_pans' AS metric, count(*) AS value FROM firsts
UNION ALL SELECT 'invalid_pan_rows', count(*) FROM pan_sheet WHERE pan IS NOT NULL AND NOT regexp_matches({NORM('pan')}, '{PAT}')
UNION ALL SELECT 'gstin_rows', count(*) FROM ({APPEND_SELECT}) t
UNION ALL SELECT 'unique_gstins', count(DISTINCT gstin) FROM ({APPEND_SELECT}) t
UNION ALL SELECT 'added_gstin_rows', count(*) FROM newrows"""))
def q_run_summary(spark, d):
    """A10: counts reported at the end of a run, as (metric, value) rows."""
    pan = fx(spark, d, "pan_sheet").where(F.col("pan").isNotNull()).select(normalize_id("pan").alias("pan"))
    valid = is_valid_pan("pan", normalized=True)
    old = _gstin_sheet(spark, d)
    new = mg.fresh_rows(old, mg.new_gstin_rows(fx(spark, d, "lookup_results"), AS_OF))
    table = old.select("gstin", F.lit(0).alias("added")).unionByName(new.select("gstin", F.lit(1).alias("added")))
    return rl.run_summary(
        pan.agg(F.count_distinct(F.when(valid, F.col("pan"))).alias("unique_pans"), F.count_if(~valid).alias("invalid_pan_rows")),
        table.agg(F.count(F.lit(1)).alias("gstin_rows"), F.count_distinct("gstin").alias("unique_gstins"),
                  F.sum("added").alias("added_gstin_rows")))


# --------------------------------------------------------------------------- Q1 composed

def _map_pans(spark, d, limit=None):
    return pl.map_pans(fx(spark, d, "pan_sheet"), _gstin_sheet(spark, d), fx(spark, d, "lookup_results"), AS_OF,
                       done=fx(spark, d, "done_keys"), resume=True, limit=limit)


def _q1_ctes(limit: int | None):
    lim = f" ORDER BY row_id LIMIT {limit}" if limit is not None else ""
    return [C_V, C_FIRSTS, C_PENDING,
            ("chosen", f"SELECT pan FROM (SELECT pan, row_id FROM pending{lim}) p UNION SELECT pan FROM done_keys"),
            ("lr", "SELECT * FROM lookup_results WHERE pan IN (SELECT pan FROM chosen)"),
            c_rollup("lr"), C_UPD, C_OLD, c_new("lr")]


Q1_FIX = ["pan_sheet", "gstin_sheet", "lookup_results", "done_keys"]


@register("map_pans_pan_data", oracle(Q1_FIX, _q1_ctes(None), PAN_DATA_SELECT))
def q_map_pans_pan_data(spark, d):
    return nullable_counts(_map_pans(spark, d)[0], "gstin_count")


@register("map_pans_gstin_data", oracle(Q1_FIX, _q1_ctes(None), APPEND_SELECT))
def q_map_pans_gstin_data(spark, d):
    return _map_pans(spark, d)[1]


@register("map_pans_limited_pan_data", oracle(Q1_FIX, _q1_ctes(50), PAN_DATA_SELECT))
def q_map_pans_limited_pan_data(spark, d):
    """Q1 with resume and the run option "at most 50 new PANs"."""
    return nullable_counts(_map_pans(spark, d, limit=50)[0], "gstin_count")


@register("map_pans_limited_gstin_data", oracle(Q1_FIX, _q1_ctes(50), APPEND_SELECT))
def q_map_pans_limited_gstin_data(spark, d):
    return _map_pans(spark, d, limit=50)[1]


def _map_resumed(spark, d):
    """S7 -> S6 -> Q1: responses of the done PANs exist in the checkpoint only."""
    path, done, lr = scratch_path(spark, "checkpoint"), fx(spark, d, "done_keys"), fx(spark, d, "lookup_results")
    sio.write_checkpoint(done, lr.join(done, "pan", "left_semi"), path, batch=0, as_of=AS_OF)
    keys, results = sio.read_checkpoint(spark, path)
    return pl.map_pans(fx(spark, d, "pan_sheet"), _gstin_sheet(spark, d), lr.join(done, "pan", "left_anti"), AS_OF,
                       done=keys, resume=True, checkpointed=results)


@register("map_pans_resumed_pan_data", oracle(Q1_FIX, _q1_ctes(None), PAN_DATA_SELECT))
def q_map_pans_resumed_pan_data(spark, d):
    return nullable_counts(_map_resumed(spark, d)[0], "gstin_count")


@register("map_pans_resumed_gstin_data", oracle(Q1_FIX, _q1_ctes(None), APPEND_SELECT))
def q_map_pans_resumed_gstin_data(spark, d):
    return _map_resumed(spark, d)[1]


C_PAGE_ITEMS = [C_ITEMS, ("page_items", "SELECT *, page_no * 4294967296 + item_no AS ord FROM items")]
C_PAGE_LR = ("lr", "SELECT * FROM page_items WHERE pan IN (SELECT pan FROM firsts)")


def _map_from_pages(spark, d):
    return pl.map_from_pages(spark, fx(spark, d, "pan_sheet"), _gstin_sheet(spark, d), fp.lookup_pages(spark, d),
                             scratch_path(spark, "landed-items"), AS_OF)


@register("map_from_pages_pan_data", oracle(["pan_sheet", "gstin_sheet", "lookup_results"], [
    C_V, C_FIRSTS, *C_PAGE_ITEMS, C_PAGE_LR, c_rollup("lr"), C_UPD], PAN_DATA_SELECT))
def q_map_from_pages_pan_data(spark, d):
    """Q5 -> S12 -> Q1: the PAN table mapped from landed result pages."""
    return nullable_counts(_map_from_pages(spark, d)[0], "gstin_count")


@register("map_from_pages_gstin_data", oracle(["pan_sheet", "gstin_sheet", "lookup_results"], [
    C_V, C_FIRSTS, *C_PAGE_ITEMS, C_PAGE_LR, C_OLD, c_new("lr")], APPEND_SELECT))
def q_map_from_pages_gstin_data(spark, d):
    return _map_from_pages(spark, d)[1]


# --------------------------------------------------------------------------- T1 streaming

@register("stream_apply_results", oracle(["gstin_sheet", "lookup_results"], [C_OLD, c_new()], APPEND_SELECT))
def q_stream_apply_results(spark, d):
    """The landed responses as a file stream into one sink."""
    landing = scratch_path(spark, "landing")
    land_results(fx(spark, d, "lookup_results"), landing)
    return stream_apply_results(spark, landing, _gstin_sheet(spark, d), scratch_path(spark, "sink"),
                                scratch_path(spark, "stream-ckpt"), AS_OF)


def _stream_map_pans(spark, d):
    landing = scratch_path(spark, "landing")
    land_results(fx(spark, d, "lookup_results"), landing)
    return stream_map_pans(spark, landing, fx(spark, d, "pan_sheet"), _gstin_sheet(spark, d),
                           scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ckpt"), AS_OF)


@register("stream_map_pans_pan_data", oracle(["pan_sheet", "lookup_results"], [C_V, C_FIRSTS, C_ROLLUP, C_UPD],
                                             PAN_DATA_SELECT))
def q_stream_map_pans_pan_data(spark, d):
    """T1 with foreachBatch: per-batch rollups applied to the PAN table."""
    return nullable_counts(_stream_map_pans(spark, d)[0], "gstin_count")


@register("stream_map_pans_gstin_data", oracle(["gstin_sheet", "lookup_results"], [C_OLD, c_new()], APPEND_SELECT))
def q_stream_map_pans_gstin_data(spark, d):
    return _stream_map_pans(spark, d)[1]


def _stream_two_runs(spark, d):
    """Every response, landed in two halves with a run after each: the second run goes on from the first one's state."""
    landing, out, ckpt = (scratch_path(spark, n) for n in ("landing", "stream-out", "stream-ckpt"))
    lr = fx(spark, d, "lookup_results")
    for half in (0, 1):
        land_results(lr.where(F.col("ord") % 2 == half), landing)
        tables = stream_map_pans(spark, landing, fx(spark, d, "pan_sheet"), _gstin_sheet(spark, d), out, ckpt, AS_OF)
    return tables


@register("stream_resumed_pan_data", oracle(["pan_sheet", "lookup_results"], [C_V, C_FIRSTS, C_ROLLUP, C_UPD], PAN_DATA_SELECT))
def q_stream_resumed_pan_data(spark, d):
    """T1 resumed: PANs whose items lie in the landings of both runs."""
    return nullable_counts(_stream_two_runs(spark, d)[0], "gstin_count")


# --------------------------------------------------------------------------- repeated runs on bucketed tables

BUCKETS = 8


def _landed_by_pan(spark, d):
    """The responses landed in two loads, bucketed by ``pan``."""
    path, lr = scratch_path(spark, "by-pan"), fx(spark, d, "lookup_results")
    for half in (0, 1):
        bk.write_bucketed(lr.where(F.col("ord") % 2 == half), path, "pan", BUCKETS)
    return bk.read_bucketed(spark, path)


@register("status_by_pan_bucketed", ORACLES["status_by_pan"])
def q_status_by_pan_bucketed(spark, d):
    """J3, A1-A5 over responses that lie bucketed by ``pan``."""
    chosen = pl.select_responses(fx(spark, d, "pan_sheet"), _landed_by_pan(spark, d))
    return rs.status_by_pan(chosen.valid, chosen.results).select("pan", "row_id", "gstin_count", "raw_gstin_count", "status")


@register("append_indexed_runs", oracle(["gstin_sheet", "lookup_results"], [C_OLD, c_new()], f"""
SELECT {GSTIN_COLS} FROM old UNION ALL SELECT {GSTIN_COLS} FROM newrows n
WHERE row_id % 2 = 0 OR NOT EXISTS (SELECT 1 FROM newrows e WHERE e.gstin = n.gstin AND e.row_id % 2 = 0)"""))
def q_append_indexed_runs(spark, d):
    """J2, U1 in two runs (responses of even and of odd order): the second one knows what the first appended."""
    rows, index = scratch_path(spark, "appended"), scratch_path(spark, "gstin-index")
    lr, out = fx(spark, d, "lookup_results"), _gstin_sheet(spark, d)
    bk.add_keys(out, index, "gstin", 0, BUCKETS)
    for run in (1, 2):
        out = out.unionByName(pl.append_run(spark, lr.where(F.col("ord") % 2 == run - 1), rows, index, run, AS_OF))
    return out


@register("run_summary_observed", oracle(Q1_FIX, _q1_ctes(None), f"""
SELECT 'unique_pans' AS metric, count(*) AS value FROM firsts
UNION ALL SELECT 'invalid_pan_rows', count(*) FROM pan_sheet WHERE pan IS NOT NULL AND NOT regexp_matches({NORM('pan')}, '{PAT}')
UNION ALL SELECT 'gstin_rows', count(*) FROM ({APPEND_SELECT}) t
UNION ALL SELECT 'unique_gstins', count(DISTINCT gstin) FROM ({APPEND_SELECT}) t
UNION ALL SELECT 'added_gstin_rows', count(*) FROM newrows"""))
def q_run_summary_observed(spark, d):
    """A10 of a whole Q1 run, observed while its tables are written."""
    _, counts = pl.run_mapping(fx(spark, d, "pan_sheet"), _gstin_sheet(spark, d), fx(spark, d, "lookup_results"), AS_OF,
                               scratch_path(spark, "workbook"), done=fx(spark, d, "done_keys"), resume=True)
    return spark.createDataFrame(sorted(counts.items()), "metric string, value bigint")


# --------------------------------------------------------------------------- IO round trips

@register("two_table_roundtrip", oracle(Q1_FIX, _q1_ctes(None), APPEND_SELECT))
def q_two_table_roundtrip(spark, d):
    """S8 -> C4 -> S1: Q1's tables written as a new version, detected and read back."""
    root = scratch_path(spark, "workbook")
    pan_data, gstin_data = _map_pans(spark, d)
    version = sio.write_two_tables(pan_data, gstin_data, root)
    if sc.is_legacy_layout(sio.table_names(spark, version)):
        raise RuntimeError("written version lacks a table")
    _, g = sio.read_two_tables(spark, root)
    return g


@register("two_table_roundtrip_pan", oracle(Q1_FIX, _q1_ctes(None), PAN_DATA_SELECT))
def q_two_table_roundtrip_pan(spark, d):
    """S8 -> S1: the PAN table of a second version, read back."""
    root = scratch_path(spark, "workbook")
    pan_data, gstin_data = _map_pans(spark, d)
    sio.write_two_tables(_sheet(spark, d), _gstin_sheet(spark, d), root)
    sio.write_two_tables(pan_data, gstin_data, root)
    return nullable_counts(sio.read_two_tables(spark, root)[0], "gstin_count")


@register("export_from_two_tables", oracle(Q1_FIX, _q1_ctes(None), f"""
SELECT pan_reference AS "PAN_Reference", gstin AS "GSTIN", gstin_status AS "GSTIN Status" FROM ({APPEND_SELECT}) t"""))
def q_export_from_two_tables(spark, d):
    """Q4: the current version's GSTIN table projected for download and written as CSV."""
    root = scratch_path(spark, "workbook")
    sio.write_two_tables(*_map_pans(spark, d), root)
    _, g = sio.read_two_tables(spark, root)
    out = scratch_path(spark, "export")
    sio.write_csv(pl.export_simplified(g), out)
    return sio.read_csv_text(spark, out)


@register("csv_roundtrip", oracle(["gstin_sheet"], [], """
SELECT CAST(row_id AS VARCHAR) AS row_id, pan_reference, gstin,
  CASE WHEN row_id % 5 = 1 THEN NULL ELSE gstin_status END AS gstin_status, state FROM gstin_sheet"""))
def q_csv_roundtrip(spark, d):
    """S10 -> S2/S3 + S4: a CSV whose missing values are spelled NA / N/A / null / '' comes
    back with NULLs and every column as text."""
    g = fx(spark, d, "gstin_sheet")
    tok = F.element_at(F.array(F.lit("NA"), F.lit("N/A"), F.lit("null"), F.lit("")),
                       (F.col("row_id") % 4 + 1).cast("int"))
    dirty = g.select("row_id", "pan_reference", "gstin",
                     F.when(F.col("row_id") % 5 == 1, tok).otherwise(F.col("gstin_status")).alias("gstin_status"),
                     "state")
    path = scratch_path(spark, "csv")
    sio.write_csv(dirty, path)
    return sio.read_sheet(spark, path, row_id=None).select("row_id", "pan_reference", "gstin", "gstin_status", "state")


@register("run_log_roundtrip", oracle(["jobs"], [], """
SELECT job_id, filename, status, created_at, CAST(max_pans AS DOUBLE) AS "limit",
  file_path, start_time, end_time, result_file, error FROM jobs"""))
def q_run_log_roundtrip(spark, d):
    """The run log written as JSON lines keyed by job id and read back."""
    path = scratch_path(spark, "runlog")
    sio.write_run_log(fx(spark, d, "jobs"), path)
    log = sio.read_run_log(spark, path)
    return nullable_counts(log.select("job_id", "filename", "status", "created_at",
                                      F.col("parameters.limit").alias("limit"),
                                      "file_path", "start_time", "end_time", "result_file", "error"), "limit")


@register("run_report", oracle(["jobs"], [], RUN_HISTORY_SELECT))
def q_run_report(spark, d):
    """Q7: history report over the persisted run log (S11 -> L3, P11, P12)."""
    path = scratch_path(spark, "runlog")
    sio.write_run_log(fx(spark, d, "jobs"), path)
    return pl.run_report(sio.read_run_log(spark, path))


@register("checkpoint_roundtrip", oracle(["lookup_results", "done_keys"], [], """
SELECT pan, ord, gstin, gstin_status, state, result FROM lookup_results WHERE pan IN (SELECT pan FROM done_keys)"""))
def q_checkpoint_roundtrip(spark, d):
    """S7 -> S6: done keys and their results checkpointed in two batches and read back flat."""
    path = scratch_path(spark, "checkpoint")
    done = fx(spark, d, "done_keys")
    lr = fx(spark, d, "lookup_results").join(done, "pan", "left_semi")
    half = F.pmod(F.hash("pan"), F.lit(2))
    for b in (0, 1):
        sio.write_checkpoint(done.where(half == b), lr.where(half == b), path, batch=b, as_of=AS_OF)
    _, flat = sio.read_checkpoint(spark, path)
    return flat

# --------------------------------------------------------------------------- X9: pages that cannot be read

BROKEN = "substr(gstin, 11, 1) = '5'"


@register("details_broken_pages", oracle(["requested_gstins", "details", "details_hsn"], C_CODES + [C_IDS, ("x", DETAILS_SELECT)], f"""
SELECT gstin, CASE WHEN NOT bad THEN trade_name END AS trade_name, CASE WHEN NOT bad THEN registration_date END AS registration_date,
  CASE WHEN NOT bad THEN hsn_codes END AS hsn_codes, CASE WHEN error IS NOT NULL THEN error WHEN bad THEN 'unreadable' END AS error
FROM (SELECT *, {BROKEN} AS bad FROM x) t"""))
def q_details_broken_pages(spark, d):
    """Pages landed as bytes, some cut within a character: an error record each, all other rows as ever."""
    pages = fp.detail_pages(spark, d).select("gstin", F.concat(
        F.col("html").cast("binary"), F.when(F.expr(BROKEN), F.lit(bytearray(b"\xe2\x82"))).otherwise(F.lit(bytearray()))).alias("html"))
    read = pg.details_with_text(pg.extract_details(pages))
    return read.withColumn("error", F.when(F.col("error").startswith("'utf-8'"), "unreadable").otherwise(F.col("error")))


# --------------------------------------------------------------------------- Q7, S11: progress and state changes

def _jobs_with_results(spark, d):
    """The run log's jobs with nested results (details runs) or checkpoint progress (mapping runs)."""
    e = F.col("job_id").cast("long")
    jobs = fx(spark, d, "jobs")
    ids = F.transform(F.sequence(F.lit(1).cast("long"), e % 6 + 2), lambda i: F.concat(F.lit("G"), i.cast("string")))

    def result(g, i):
        bad = (e + i) % 3 == 0
        return F.struct(g.alias("gstin"), (~bad).alias("success"), F.when(bad, F.concat(F.lit("No records found: "), g)).alias("error"))

    details = e % 2 == 0
    null = F.lit(None)
    progress = F.struct(null.cast("long").alias("total"), null.cast("long").alias("processed"), null.cast("long").alias("successful"),
                        null.cast("long").alias("failed"), (e % 50).alias("processed_count"), F.col("start_time").alias("timestamp"))
    return jobs.withColumns({
        "gstins": F.when(details, ids),
        "results": F.when(details, F.transform(F.slice(ids, 1, (e % 6).cast("int")), result)),
        "progress": F.when(~details, progress)})


@register("run_progress", oracle(["jobs"], [("h", RUN_HISTORY_SELECT), ("latest", """
SELECT job_id FROM jobs WHERE status = 'completed' AND result_file IS NOT NULL ORDER BY end_time DESC, job_id DESC LIMIT 1"""),
    ("j", """
SELECT job_id, e, CASE WHEN e % 2 = 0 THEN e % 6 + 2 END AS total, CASE WHEN e % 2 = 0 THEN e % 6 ELSE e % 50 END AS processed,
  CASE WHEN e % 2 = 0 THEN len(list_filter(range(0, e % 6), lambda i: (e + i) % 3 <> 0)) END AS successful,
  CASE WHEN e % 2 = 0 THEN len(list_filter(range(0, e % 6), lambda i: (e + i) % 3 = 0)) END AS failed,
  CASE WHEN e % 2 = 0 THEN list_min(list_filter(range(0, e % 6), lambda i: (e + i) % 3 = 0)) END AS first_failed,
  CASE WHEN e % 2 <> 0 THEN start_time END AS progress_at
FROM (SELECT *, CAST(job_id AS BIGINT) AS e FROM jobs) t""")], """
SELECT h.*, CAST(total AS DOUBLE) AS total, processed, CAST(successful AS DOUBLE) AS successful, CAST(failed AS DOUBLE) AS failed,
  CASE WHEN first_failed IS NOT NULL THEN concat('No records found: G', CAST(first_failed + 1 AS VARCHAR)) END AS first_error,
  progress_at, CAST(floor(100.0 * processed / total + 0.5) AS DOUBLE) AS percent_done,
  h.job_id IN (SELECT job_id FROM latest) AS is_latest
FROM h JOIN j USING (job_id)"""))
def q_run_progress(spark, d):
    """Q7 with A6-A9 over the persisted run log."""
    path = scratch_path(spark, "runlog")
    sio.write_run_log(_jobs_with_results(spark, d), path)
    return nullable_counts(pl.run_progress(sio.read_run_log(spark, path)), "total", "successful", "failed", "percent_done")


@register("run_log_states", oracle(["jobs"], [], """
SELECT job_id, filename, status, created_at, file_path, start_time, end_time, result_file, error,
  coalesce(end_time, start_time, created_at) AS changed_at
FROM jobs WHERE CAST(job_id AS BIGINT) % 16 <> 3"""))
def q_run_log_states(spark, d):
    """S11 + U3: jobs queued, started, ended and removed by appended changes, read as one row per job."""
    path, to, jobs = scratch_path(spark, "runlog"), scratch_path(spark, "runlog-compact"), fx(spark, d, "jobs")
    null = F.lit(None)
    queued = jobs.withColumns({"status": F.lit("queued"), "start_time": null.cast("timestamp_ntz"), "end_time": null.cast("timestamp_ntz"),
                               "result_file": null.cast("string"), "error": null.cast("string"), "changed_at": F.col("created_at")})
    started = (queued.drop("start_time").join(jobs.select("job_id", "start_time"), "job_id").where(F.col("start_time").isNotNull())
               .withColumns({"status": F.lit("processing"), "changed_at": F.col("start_time")}))
    ended = jobs.where(F.col("end_time").isNotNull()).withColumn("changed_at", F.col("end_time"))
    removed = ended.where(F.col("job_id").cast("long") % 16 == 3).withColumn("status", F.lit("removed"))
    for change in (ended, queued, removed, started):  # in any order
        sio.append_run_changes(change, path)
    sio.compact_run_log(spark, path, to)
    return sio.read_run_states(spark, to).select("job_id", "filename", "status", "created_at", "file_path", "start_time",
                                                 "end_time", "result_file", "error", "changed_at")


# --------------------------------------------------------------------------- U1, J6: row ids of the whole table

@register("append_numbered_upsert", oracle(["gstin_sheet", "lookup_results", "details", "details_hsn", "requested_gstins"], C_CODES + [
    C_DDREQ,
    ("twice", """
SELECT 1 AS run, * FROM lookup_results WHERE length(gstin) = 15 AND seen_at < TIMESTAMP '1998-04-01 00:00:00'
UNION ALL SELECT 2, * FROM lookup_results WHERE length(gstin) = 15"""),
    ("landed", "SELECT * FROM twice UNION ALL SELECT * FROM twice"),
    ("add1", """
SELECT (SELECT max(row_id) FROM gstin_sheet) + row_number() OVER (ORDER BY ord, pan, gstin, gstin_status, state) AS row_id,
  pan AS pan_reference, gstin, gstin_status, state
FROM landed WHERE run = 1 AND gstin NOT IN (SELECT gstin FROM gstin_sheet WHERE gstin IS NOT NULL)"""),
    ("one", "SELECT row_id, pan_reference, gstin, gstin_status, state, false AS fresh FROM gstin_sheet UNION ALL SELECT *, true FROM add1"),
    ("add2", """
SELECT (SELECT max(row_id) FROM one) + row_number() OVER (ORDER BY ord, pan, gstin, gstin_status, state) AS row_id,
  pan AS pan_reference, gstin, gstin_status, state
FROM landed WHERE run = 2 AND gstin NOT IN (SELECT gstin FROM one WHERE gstin IS NOT NULL)"""),
    ("s", "SELECT * FROM one UNION ALL SELECT *, true FROM add2"),
    ("hits", "SELECT f.row_id, u.trade_name, u.registration_date, u.codes FROM (SELECT gstin, min(row_id) AS row_id FROM s GROUP BY gstin) f JOIN ddreq u USING (gstin)")],
    f"""
SELECT s.row_id, s.pan_reference, s.gstin, s.gstin_status, s.state, nullif(h.trade_name, '') AS trade_name,
  nullif(h.registration_date, '') AS registration_date, nullif(h.codes, '') AS hsn_codes,
  CASE WHEN h.row_id IS NOT NULL OR s.fresh THEN {AS_OF_SQL} END AS last_updated
FROM s LEFT JOIN hits h USING (row_id)"""))
def q_append_numbered_upsert(spark, d):
    """Two runs append from landings that hold each response twice; ids stay unique, and J6 updates one row a GSTIN."""
    results, table = fx(spark, d, "lookup_results"), _gstin_sheet(spark, d)
    for landing in (results.where(F.col("seen_at") < F.expr("TIMESTAMP_NTZ '1998-04-01 00:00:00'")), results):
        table = mg.append_numbered(table, mg.new_gstin_rows(landing.unionByName(landing), AS_OF), scratch_path(spark, "appended"))
    return mg.upsert_details_first(table, _found(spark, d), AS_OF)


# --------------------------------------------------------------------------- O1, O4, O5

LOAD_TIMES = [AS_OF + dt.timedelta(days=30 * i) for i in range(3)]


@register("details_history", oracle(["details", "details_hsn"], C_CODES + [
    ("old", "SELECT gstin, trade_name, registration_date, codes, substr(gstin, 11, 1) AS c FROM dd"),
    ("new", "SELECT gstin, concat(trade_name, ' Ltd') AS trade_name, registration_date, codes FROM old WHERE c IN ('1', '3')")], f"""
SELECT gstin, trade_name, registration_date, nullif(codes, '') AS hsn_codes, {AS_OF_SQL} AS valid_from,
  CASE WHEN c IN ('1', '3') THEN {AS_OF_SQL} + INTERVAL 30 DAY END AS valid_to FROM old WHERE c <> '7'
UNION ALL SELECT gstin, trade_name, registration_date, nullif(codes, ''), {AS_OF_SQL} + INTERVAL 30 DAY, NULL FROM new
UNION ALL SELECT gstin, trade_name, registration_date, nullif(codes, ''), {AS_OF_SQL} + INTERVAL 30 DAY, NULL FROM old WHERE c = '7'"""))
def q_details_history(spark, d):
    """O1 over three landed loads: the second changes, adds and lacks firms, the third is the second again."""
    all_details = _details_arrays(spark, d)
    c = F.substring("gstin", 11, 1)
    first = all_details.where(c != "7")
    second = all_details.where(c != "5").withColumn("trade_name", F.when(c.isin("1", "3"), F.concat("trade_name", F.lit(" Ltd"))).otherwise(F.col("trade_name")))
    history = hs.first_load(first, LOAD_TIMES[0])
    for load, at in zip((second, second), LOAD_TIMES[1:], strict=True):
        path = scratch_path(spark, "history")
        history.write.parquet(path)
        history = hs.apply_load(spark.read.schema(history.schema).parquet(path), load, at)
    codes = F.when(F.size("hsn_codes") > 0, F.array_join("hsn_codes", ", "))
    return history.select("gstin", "trade_name", "registration_date", codes.alias("hsn_codes"), "valid_from", "valid_to")


def _hsn_level(n):
    return f"SELECT {n} AS level, substr(hsn_code, 1, {n}) AS hsn_code, count(DISTINCT gstin) AS gstins FROM h WHERE length(hsn_code) >= {n} GROUP BY 2"


@register("hsn_activity", oracle(["details_hsn"], [
    ("h", "SELECT gstin, CASE WHEN pos % 5 = 0 THEN concat(hsn_code, '10') WHEN pos % 7 = 0 THEN concat(hsn_code, '2030') ELSE hsn_code END AS hsn_code FROM details_hsn")],
    "SELECT 0 AS level, '' AS hsn_code, count(DISTINCT gstin) AS gstins FROM h UNION ALL " + " UNION ALL ".join(map(_hsn_level, ac.HSN_LEVELS))))
def q_hsn_activity(spark, d):
    """Firms per HSN chapter, heading, subheading and item, each firm once per subtotal."""
    pos, code = F.col("pos"), F.col("hsn_code")
    longer = F.when(pos % 5 == 0, F.concat(code, F.lit("10"))).when(pos % 7 == 0, F.concat(code, F.lit("2030"))).otherwise(code)
    return ac.hsn_activity(fx(spark, d, "details_hsn").select("gstin", longer.alias("hsn_code")))


@register("own_name_matches", oracle(["details", "pan_sheet"], [
    ("f", "SELECT gstin, regexp_replace(lower(trade_name), '[^a-z0-9]+', '', 'g') AS k FROM details WHERE trade_name <> ''"),
    ("g", "SELECT k, count(DISTINCT gstin) AS n, min(gstin) AS gstin FROM f GROUP BY k"),
    ("o", "SELECT row_id, concat('TRADE - ', substr(trim(pan), 1, 5), ' Pvt. Ltd') AS name FROM pan_sheet WHERE pan IS NOT NULL")], """
SELECT row_id, name, coalesce(n, 0) AS matches, CASE WHEN n = 1 THEN gstin END AS gstin,
  CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS match
FROM o LEFT JOIN g ON k = regexp_replace(regexp_replace(lower(name), ' pvt. ltd$', ''), '[^a-z0-9]+', '', 'g')"""))
def q_own_name_matches(spark, d):
    """O3: names of one's own list, written another way, against the trade names of the firms."""
    own = fx(spark, d, "pan_sheet").where(F.col("pan").isNotNull()).select(
        "row_id", F.concat(F.lit("TRADE - "), F.substring(F.trim("pan"), 1, 5), F.lit(" Pvt. Ltd")).alias("name"))
    return nm.match_names(own, fx(spark, d, "details"))


@register("stale_gstins", oracle(["lookup_results"], [
    ("t", f"SELECT gstin, CASE WHEN ord % 11 <> 0 THEN {AS_OF_SQL} - to_days(CAST(ord % 200 AS INT)) END AS t FROM lookup_results WHERE length(gstin) = 15")], f"""
SELECT gstin, max(t) AS last_updated FROM t GROUP BY gstin
HAVING max(t) IS NULL OR max(t) < {AS_OF_SQL} - to_days(90)"""))
def q_stale_gstins(spark, d):
    """O2: GSTINs due for a refresh, the table's rows being updated over the last 200 days."""
    updated = F.when(F.expr("ord % 11 <> 0"), stamp(AS_OF) - F.expr("make_dt_interval(int(ord % 200))"))
    return mg.stale_gstins(fx(spark, d, "lookup_results").select("gstin", updated.alias("last_updated")), AS_OF)


DATE_TEXT = """CASE substr(gstin, 11, 1)
  WHEN '1' THEN concat(y, '-', m, '-', a) WHEN '3' THEN concat(a, '-', m, '-', y) WHEN '5' THEN 'not given'
  WHEN '7' THEN ' ' WHEN '9' THEN concat(' ', a, '.', m, '.', y) ELSE concat(a, '/', m, '/', y) END"""
DATE_PARTS = """SELECT gstin, substr(registration_date, 1, 2) AS a, substr(registration_date, 4, 2) AS m,
  CAST(2006 + 2 * CAST(substr(gstin, 10, 1) AS INT) AS VARCHAR(9)) AS y FROM {}"""


@register("registration_ages", oracle(["details"], [
    ("t", DATE_PARTS.format("details")),
    ("g", "SELECT CASE WHEN substr(gstin, 11, 1) NOT IN ('5', '7') THEN make_date(y::INT, m::INT, a::INT) END AS dt, substr(gstin, 11, 1) AS c FROM t"),
    ("b", """SELECT CASE WHEN c = '7' THEN 7 WHEN dt IS NULL THEN 6 WHEN dt > DATE '2025-01-01' THEN 5
  WHEN n < 1 THEN 0 WHEN n < 3 THEN 1 WHEN n < 5 THEN 2 WHEN n < 10 THEN 3 ELSE 4 END AS bucket_no
  FROM (SELECT *, date_sub('year', dt, DATE '2025-01-01') AS n FROM g) q""")], """
SELECT bucket_no, ['under 1 year', '1 to 2 years', '3 to 4 years', '5 to 9 years', '10 years and more', 'in the future', 'unreadable',
  'missing'][bucket_no + 1] AS bucket, count(*) AS n FROM b GROUP BY bucket_no"""))
def q_registration_ages(spark, d):
    """Firms by age of their registration, dates given in several formats."""
    fx(spark, d, "details").createOrReplaceTempView("regspark_ages")
    texts = spark.sql(f"SELECT {DATE_TEXT} AS registration_date FROM ({DATE_PARTS.format('regspark_ages')})")
    return ac.registration_ages(texts, AS_OF)


@register("discover_inputs_kinds", """
SELECT 'csv' AS extension, true AS accepted, true AS sized UNION ALL SELECT 'parquet', false, true""")
def q_discover_inputs_kinds(spark, d):
    """Which kinds of file a folder of exports holds, and whether they are taken."""
    return q_discover_inputs(spark, d).groupBy("extension", "accepted").agg((F.sum("length") > 0).alias("sized"))


@register("discover_inputs")
def q_discover_inputs(spark, d):
    """S5 over a folder of exports derived from the tables (rows-only check)."""
    root = scratch_path(spark, "uploads")
    sio.write_csv(fx(spark, d, "pan_sheet"), os.path.join(root, "sheets"))
    fx(spark, d, "gstin_sheet").write.parquet(os.path.join(root, "tables"))
    return sio.discover_inputs(spark, root)

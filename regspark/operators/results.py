"""Lookup results: resume (J1), join (J3), rollup (A1, A2, A4, A5), apply (J4),
nested result explode (P7, P8)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regspark.functions.ids import is_valid_gstin, normalize_id
from regspark.functions.text import stamp
from regspark.operators.ordering import first_by_key

# --- fixed values -----------------------------------------------------------
STATUS_SUCCESS = "Success"
STATUS_NONE_FOUND = "No GSTINs found"
STATUS_UNKNOWN = "Unknown"
NO_RECORDS = "No records found"
ERROR_MARK = "Error"
# ---------------------------------------------------------------------------

RESULT_ITEM_COLS = ("gstin", "gstin_status", "state", "result")


def pending_pans(valid: DataFrame, done: DataFrame, retry_failed: bool = False,
                 failed: DataFrame | None = None) -> DataFrame:
    """Valid PANs not yet processed (anti join; failed ones count as done).

    With ``retry_failed`` the PANs listed in ``failed`` are looked up again.
    """
    done_keys = done.select("pan")
    if retry_failed and failed is not None:
        done_keys = done_keys.join(failed.select("pan"), "pan", "left_anti")
    return valid.join(done_keys.distinct(), "pan", "left_anti")


def _any_contains(text: str) -> Column:
    cols = [F.coalesce(F.col(c), F.lit("")).contains(text) for c in RESULT_ITEM_COLS]
    out = cols[0]
    for c in cols[1:]:
        out = out | c
    return out


def rollup_parts(results: DataFrame) -> DataFrame:
    """Per PAN, what ``merge_parts`` can combine over several inputs: count, flag, first error with its order."""
    err = F.coalesce(F.col("result"), F.lit("")).contains(ERROR_MARK)
    return results.groupBy("pan").agg(
        F.count_if(is_valid_gstin("gstin")).alias("gstin_count"),
        F.bool_or(_any_contains(NO_RECORDS)).alias("no_records"),
        F.min(F.when(err, F.struct(F.col("ord").alias("o"), F.col("result").alias("text")))).alias("error"))


def combine_parts(parts: DataFrame) -> DataFrame:
    """One row a PAN out of its parts."""
    return parts.groupBy("pan").agg(F.sum("gstin_count").alias("gstin_count"),
                                    F.bool_or("no_records").alias("no_records"), F.min("error").alias("error"))


def add_to_state(state: DataFrame, parts: DataFrame, buckets: int) -> DataFrame:
    """``combine_parts`` of a state (one row a PAN) and new parts. An outer join, so a state that lies in
    ``buckets`` buckets by ``pan`` is not shuffled."""
    new = combine_parts(parts.repartition(buckets, "pan")).toDF("pan", "_count", "_none", "_error")
    joined = state.where(F.col("pan").isNotNull()).join(new.where(F.col("pan").isNotNull()), "pan", "full_outer")
    return joined.select(
        "pan", (F.coalesce("gstin_count", F.lit(0)) + F.coalesce("_count", F.lit(0))).cast("long").alias("gstin_count"),
        (F.coalesce("no_records", F.lit(False)) | F.coalesce("_none", F.lit(False))).alias("no_records"),
        F.least("error", "_error").alias("error"))


def merge_parts(parts: DataFrame) -> DataFrame:
    """(pan, gstin_count, status) of PANs whose items came in several parts."""
    return with_status(combine_parts(parts))


def with_status(whole: DataFrame) -> DataFrame:
    """(pan, gstin_count, status) of combined parts (A4)."""
    status = (F.when(F.col("gstin_count") > 0, F.lit(STATUS_SUCCESS))
              .when(F.col("no_records"), F.lit(STATUS_NONE_FOUND))
              .otherwise(F.coalesce(F.col("error.text"), F.lit(STATUS_UNKNOWN))))
    return whole.select("pan", "gstin_count", status.alias("status"))


def rollup_results(results: DataFrame, order=None) -> DataFrame:
    """Per PAN: count of 15-character GSTINs (A1), of any GSTIN (A2), the first
    error text in item order (A5) and the status (A4), in one pass over the items.

    The items of a PAN are first counted per error text (items without an error
    share the text NULL): all figures are then fixed-width partial aggregates
    (hash aggregation, combined map-side, so a PAN with a huge result list ships one
    row per partition and error text, spread over tasks by that text). The second
    aggregate picks the first error out of one row per PAN and text; only there
    does a text go through an aggregate.
    """
    err = F.coalesce(F.col("result"), F.lit("")).contains(ERROR_MARK)
    order = F.col("ord") if order is None else order
    by_text = results.groupBy("pan", F.when(err, F.col("result")).alias("_error")).agg(
        F.count_if(is_valid_gstin("gstin")).alias("_valid"),
        F.count("gstin").alias("_any"),
        F.bool_or(_any_contains(NO_RECORDS)).alias("_none"),
        F.min(order).alias("_first"),
    )
    first = F.when(F.col("_error").isNotNull(), F.struct(F.col("_first").alias("o"), F.col("_error").alias("text")))
    agg = by_text.groupBy("pan").agg(
        F.sum("_valid").alias("gstin_count"),
        F.sum("_any").alias("raw_gstin_count"),
        F.bool_or("_none").alias("_no_records"),
        F.min(first)["text"].alias("first_error"),
    )
    status = (F.when(F.col("gstin_count") > 0, F.lit(STATUS_SUCCESS))
              .when(F.col("_no_records"), F.lit(STATUS_NONE_FOUND))
              .when(F.col("first_error").isNotNull(), F.col("first_error"))
              .otherwise(F.lit(STATUS_UNKNOWN)))
    return agg.withColumn("status", status).drop("_no_records")


def status_by_pan(valid: DataFrame, results: DataFrame) -> DataFrame:
    """J3 + rollup: every valid PAN with its count and status (NULL when never looked up).

    Both sides arrive hash-partitioned on ``pan`` (each is an aggregate on it),
    so the join adds no exchange of its own.
    """
    return valid.join(rollup_results(results), "pan", "left")


PAN_DATA_COLS = ("row_id", "pan", "name", "email", "phone", "address",
                 "gstin_count", "last_updated", "status")


def apply_results(sheet: DataFrame, rollup: DataFrame, as_of: _dt.datetime,
                  match: str = "normalized", firsts: DataFrame | None = None) -> DataFrame:
    """Write count, time and status on the first sheet row of each looked-up PAN.

    ``match='normalized'`` finds the row by its cleaned PAN; ``match='raw'``
    compares the raw cell text with the key, as the original tool did (so a
    lower-case row is looked up but never updated). Other rows are untouched.
    ``firsts`` (pan, row_id) may pass the first rows already found by A3 for the
    normalized match, which saves one aggregation over the sheet.
    """
    if firsts is not None and match != "raw":
        firsts = firsts.select(F.col("pan").alias("_key"), "row_id")
    elif match == "raw":
        keyed = sheet.where(F.col("pan").isNotNull()).select("row_id", F.col("pan").alias("_key"))
        firsts = first_by_key(keyed, "_key", "row_id")
    else:
        keyed = sheet.where(F.col("pan").isNotNull()).select("row_id", normalize_id("pan").alias("_key"))
        firsts = first_by_key(keyed, "_key", "row_id")
    upd = (firsts.join(rollup.select(F.col("pan").alias("_key"), F.col("gstin_count").alias("_count"),
                                     F.col("status").alias("_status")), "_key")
           .select("row_id", "_count", "_status", F.lit(True).alias("_hit")))
    ts = stamp(as_of)
    out = sheet.join(upd, "row_id", "left")
    return out.select(
        *[F.col(c) for c in PAN_DATA_COLS if c not in ("gstin_count", "last_updated", "status")],
        F.coalesce(F.col("_count"), F.col("gstin_count")).cast("long").alias("gstin_count"),
        F.when(F.col("_hit"), ts).otherwise(F.col("last_updated")).alias("last_updated"),
        F.coalesce(F.col("_status"), F.col("status")).alias("status"),
    ).select(*PAN_DATA_COLS)


def explode_nested_results(nested: DataFrame, map_col: str = "results") -> DataFrame:
    """A map PAN -> list of result items, flattened to one row per item.

    ``explode`` of the map gives (pan, items); ``posexplode`` keeps item order.
    """
    per_pan = nested.select(F.explode(map_col).alias("pan", "_items"))
    return per_pan.select("pan", F.posexplode("_items").alias("item_no", "_item")).select(
        "pan", F.col("item_no").cast("long").alias("item_no"), "_item.*")


def explode_pan_gstin_map(nested: DataFrame, map_col: str = "pan_gstin_map",
                          status_label: str = "Active") -> DataFrame:
    """A map PAN -> list of GSTINs as rows, each with the fixed status label."""
    per_pan = nested.select(F.explode(map_col).alias("pan", "_gstins"))
    return per_pan.select("pan", F.explode("_gstins").alias("gstin"),
                          F.lit(status_label).alias("gstin_status"))

"""Table merges: new result rows (P7+F2), append only new GSTINs (J2+U1),
details upserts on every row (J5) or on the first row (J6) with F10."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regspark.functions.ids import is_valid_gstin, non_empty_or
from regspark.functions.text import join_codes, stamp
from regspark.operators.enrich import one_per_gstin
from regspark.operators.ordering import dense_ids, first_by_key
from regspark.operators.schema import GSTIN_DATA_SCHEMA, conform, need_row_ids
from regspark.operators.skew import DEFAULT, SkewConfig, salted_join, skew_join


def new_gstin_rows(results: DataFrame, as_of: _dt.datetime) -> DataFrame:
    """Result items that carry a 15-character GSTIN, as GSTIN-table rows stamped ``as_of``."""
    rows = results.where(is_valid_gstin("gstin")).select(
        F.col("ord").alias("row_id"),
        F.col("pan").alias("pan_reference"), "gstin", "gstin_status", "state",
        stamp(as_of).alias("last_updated"))
    return conform(rows, GSTIN_DATA_SCHEMA)


def stale_gstins(gstin_data: DataFrame, as_of: _dt.datetime, days: int = 90) -> DataFrame:
    """O2: (gstin, last_updated) of the GSTINs whose latest update is more than ``days`` days before ``as_of``,
    or that were never updated: what a regular refresh (Q2) looks up again. Each once, whichever row was updated."""
    latest = gstin_data.where(is_valid_gstin("gstin")).groupBy("gstin").agg(F.max("last_updated").alias("last_updated"))
    return latest.where(F.col("last_updated").isNull() | (F.col("last_updated") < stamp(as_of - _dt.timedelta(days=days))))


def fresh_rows(old: DataFrame, new: DataFrame, skew: SkewConfig = DEFAULT, hot: list | None = None) -> DataFrame:
    """The new rows whose GSTIN is not in the old table."""
    keys = old.where(F.col("gstin").isNotNull()).select("gstin").distinct()
    return (skew_join(new, keys, "gstin", "left_anti", skew) if hot is None
            else salted_join(new, keys, "gstin", "left_anti", hot, skew.salts))


def append_new(old: DataFrame, new: DataFrame, dedup: bool = False, skew: SkewConfig = DEFAULT,
               hot: list | None = None) -> DataFrame:
    """J2 + U1: old rows, then the new rows whose GSTIN is not in the old table.

    A left anti join (NULL keys on the right are harmless, unlike ``NOT IN``).
    The right side is reduced to its distinct keys first, which Spark does
    map-side, so a repeated GSTIN ships once per partition. New rows are not
    deduplicated among themselves unless ``dedup`` (then the first by row_id).
    A GSTIN holding a large share of the new rows is salted (``operators.skew``);
    ``hot`` passes hot GSTINs found upstream (on a cheaper input) instead.
    """
    fresh = fresh_rows(old, new, skew, hot)
    if dedup:
        fresh = first_by_key(fresh, "gstin", "row_id", [c for c in fresh.columns])
    return conform(old, GSTIN_DATA_SCHEMA).unionByName(conform(fresh, GSTIN_DATA_SCHEMA))


def append_numbered(old: DataFrame, new: DataFrame, path: str, skew: SkewConfig = DEFAULT) -> DataFrame:
    """J2 + U1 with row ids of the whole table: the new rows go on from the largest old id, in the order of
    their own (landing) row ids. Responses landed twice thus get rows of their own, and J6 updates one row
    per GSTIN. The numbered rows are written to ``path``."""
    need_row_ids(old)
    fresh = conform(fresh_rows(old, new, skew), GSTIN_DATA_SCHEMA)
    start = old.agg(F.max("row_id")).first()[0] or 0
    ordered = dense_ids(fresh.withColumn("_ord", F.col("row_id")), ["_ord", *[c for c in GSTIN_DATA_SCHEMA if c != "row_id"]],
                        path, start)
    return conform(old, GSTIN_DATA_SCHEMA).unionByName(conform(ordered, GSTIN_DATA_SCHEMA))


def requested_with_details(requested: DataFrame, details: DataFrame) -> DataFrame:
    """Details of the valid requested GSTINs (semi join on the distinct valid ids)."""
    ids = requested.where(is_valid_gstin("gstin")).select("gstin").distinct()
    if "error" in details.columns:  # a failed lookup updates nothing
        details = details.where(F.col("error").isNull()).drop("error")
    return details.join(ids, "gstin", "left_semi")


def _updated(target_prefix: str = "", new_prefix: str = "_new_"):
    """F10 per detail column; codes only when the new list is non-empty."""
    codes = F.col(f"{new_prefix}hsn_codes")
    return {
        "trade_name": non_empty_or(F.col(f"{new_prefix}trade_name"), F.col("trade_name")),
        "registration_date": non_empty_or(F.col(f"{new_prefix}registration_date"), F.col("registration_date")),
        "hsn_codes": F.when(F.size(F.coalesce(codes, F.array().cast("array<string>"))) > 0,
                            join_codes(codes)).otherwise(F.col("hsn_codes")),
    }


def _prefixed(details: DataFrame, key: str) -> DataFrame:
    return one_per_gstin(details).select(
        F.col("gstin").alias(key),
        F.col("trade_name").alias("_new_trade_name"),
        F.col("registration_date").alias("_new_registration_date"),
        F.col("hsn_codes").alias("_new_hsn_codes"))


def upsert_details_all(target: DataFrame, details: DataFrame, skew: SkewConfig = DEFAULT) -> DataFrame:
    """J5 (flat CSV): every row with a GSTIN that has details gets F10 updates; no stamp.

    ``details`` has ``hsn_codes`` as an array (``one_per_gstin`` picks a row). The join is
    a left join on ``gstin``; AQE turns it into a broadcast join when the
    details side is measured small at run time, and a GSTIN holding a large
    share of the table is salted (``operators.skew``).
    """
    target = conform(target, GSTIN_DATA_SCHEMA)
    joined = skew_join(target, _prefixed(details, "gstin"), "gstin", "left", skew)
    return joined.withColumns(_updated()).select(*GSTIN_DATA_SCHEMA)


def upsert_details_first(target: DataFrame, details: DataFrame, as_of: _dt.datetime) -> DataFrame:
    """J6 (workbook): only the first row (by row_id) of each GSTIN is updated, and stamped.

    The first row per GSTIN is a partial ``min`` aggregate; the update then
    joins back on GSTIN and ``row_id``, so equal row ids of two firms never mix.
    """
    need_row_ids(target)
    target = conform(target, GSTIN_DATA_SCHEMA)
    firsts = first_by_key(target.where(F.col("gstin").isNotNull()).select("gstin", "row_id"), "gstin", "row_id")
    hits = firsts.join(_prefixed(details, "gstin"), "gstin").withColumn("_hit", F.lit(True))
    joined = target.join(hits, ["gstin", "row_id"], "left")
    cols = _updated()
    cols["last_updated"] = F.when(F.col("_hit"), stamp(as_of)).otherwise(F.col("last_updated"))
    return joined.withColumns(cols).select(*GSTIN_DATA_SCHEMA)

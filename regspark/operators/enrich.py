"""Details lookup (J7), landed details tables, enrichment join (J8 + C7 + F6 + P10)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regspark.functions.ids import is_valid_gstin, strip_ws
from regspark.functions.text import format_stamp, join_codes, stamp
from regspark.operators.results import NO_RECORDS
from regspark.operators.schema import drop_if_present
from regspark.operators.skew import DEFAULT, SkewConfig, salted_join, skew_join


def distinct_codes(codes: DataFrame, key: str = "gstin") -> DataFrame:
    """Per key, its distinct codes in order of first appearance (blanks dropped).

    ``codes`` is (key, pos, hsn_code) with repeats. The (key, code) pairs are
    reduced map-side to their first position before any per-key list is made,
    so each list is bounded by the size of the code system, not by the number
    of rows a hot key holds.
    """
    firsts = (codes.where(F.coalesce(F.col("hsn_code"), F.lit("")) != "")
              .groupBy(key, "hsn_code").agg(F.min("pos").alias("pos")))
    return firsts.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "hsn_code"))),
                    lambda s: s["hsn_code"]).alias("hsn_codes"))


def details_table(details: DataFrame, codes: DataFrame) -> DataFrame:
    """Landed details, one row per GSTIN: name, date and the ordered distinct code list."""
    return details.join(distinct_codes(codes), "gstin", "left").select(
        "gstin", "trade_name", "registration_date",
        F.coalesce(F.col("hsn_codes"), F.array().cast("array<string>")).alias("hsn_codes"))


def one_per_gstin(details: DataFrame, key: str = "gstin") -> DataFrame:
    """One details row per GSTIN, so that no join multiplies its target: a row without
    error before one with an error, then the least by the other columns."""
    rest = [c for c in details.columns if c != key]
    failed = F.col("error").isNotNull() if "error" in rest else F.lit(False)
    best = details.groupBy(key).agg(F.min(F.struct(failed.alias("_failed"), *[F.col(c) for c in rest])).alias("_best"))
    return best.select(key, *[F.col(f"_best.{c}").alias(c) for c in rest])


def lookup_details(requested: DataFrame, details: DataFrame, skew: SkewConfig = DEFAULT,
                   hot: list | None = None) -> DataFrame:
    """Each valid requested GSTIN (list order and repeats kept) with its details,
    the error landed with them, or ``error = 'No records found'`` when nothing was landed for it."""
    valid = requested.where(is_valid_gstin("gstin"))
    found = one_per_gstin(details).withColumnRenamed("error", "_error").withColumn("_found", F.lit(True))
    out = (skew_join(valid, found, "gstin", "left", skew) if hot is None
           else salted_join(valid, found, "gstin", "left", hot, skew.salts))
    landed = F.col("_error") if "_error" in out.columns else F.lit(None).cast("string")
    return out.withColumn("error", F.coalesce(landed, F.when(F.col("_found").isNull(), F.lit(NO_RECORDS)))) \
        .drop("_found", "_error")


def enrich(sheet: DataFrame, details: DataFrame, as_of: _dt.datetime,
           gstin_col: str = "GSTIN", skew: SkewConfig = DEFAULT) -> DataFrame:
    """The sheet with Trade_Name, Registration_Date, HSN_Codes and Last_Updated.

    The lookup list is the sheet's non-null GSTINs stripped (F6, not upper-cased);
    the merge is on the raw sheet value, so a value with outer blanks finds no
    row (NULL columns). A looked-up id without landed details gets '' in all
    three (the original's failure tuple). The original merged one lookup row per
    sheet row, which multiplies duplicated GSTINs n x n; here each sheet row gets
    exactly one enrichment (no pairs are formed within a group).
    ``details`` holds (gstin, trade_name, registration_date, hsn_codes text).
    """
    base = drop_if_present(sheet).drop("Last_Updated")
    raw = F.col(f"`{gstin_col}`")
    d = one_per_gstin(details).select(F.col("gstin").alias(gstin_col), F.col("trade_name").alias("_d_name"),
                       F.col("registration_date").alias("_d_date"), F.col("hsn_codes").alias("_d_codes"))
    joined = skew_join(base, d, gstin_col, "left", skew)
    looked_up = raw.isNotNull() & (raw == strip_ws(raw))
    def pick(c):
        return F.when(looked_up, F.coalesce(F.col(c), F.lit("")))
    return joined.select(
        *[F.col(f"`{c}`") for c in base.columns],
        pick("_d_name").alias("Trade_Name"),
        pick("_d_date").alias("Registration_Date"),
        pick("_d_codes").alias("HSN_Codes"),
        format_stamp(stamp(as_of)).alias("Last_Updated"))


def codes_text(details: DataFrame) -> DataFrame:
    """Details with the code list as ", "-joined text (the stored form, P5)."""
    return details.withColumn("hsn_codes", join_codes("hsn_codes"))

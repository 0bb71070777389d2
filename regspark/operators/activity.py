"""Reports over the enriched firms: activity by HSN code, age of registrations."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regspark.functions.ids import strip_ws
from regspark.operators.skew import DEFAULT, SkewConfig, hot_keys

# --- fixed values -----------------------------------------------------------
HSN_LEVELS = (2, 4, 6, 8)  # digits of chapter, heading, subheading and tariff item
DATE_FORMATS = ("dd/MM/yyyy", "yyyy-MM-dd", "dd-MM-yyyy", "dd MMM yyyy", "dd.MM.yyyy")
# ---------------------------------------------------------------------------
AGE_BUCKETS = ((1, "under 1 year"), (3, "1 to 2 years"), (5, "3 to 4 years"), (10, "5 to 9 years"), (None, "10 years and more"))


def hsn_activity(codes: DataFrame, key: str = "gstin", code: str = "hsn_code", skew: SkewConfig = DEFAULT) -> DataFrame:
    """(level, hsn_code, gstins): how many GSTINs are active under each code of 2, 4, 6 and 8 digits, and
    in all (level 0). A GSTIN counts once in every subtotal, however many codes it holds below it.

    Each GSTIN's codes are read in order: those that share their first digits stand together, so a code opens a
    subtotal for its GSTIN where the one before it begins otherwise. Tasks hold a sort, which spills, and no set of
    GSTINs; only the repeats of a hot GSTIN are dropped before the shuffle.
    """
    known = codes.where(F.col(key).isNotNull() & (F.coalesce(F.col(code), F.lit("")) != "")).select(key, code)
    hot = hot_keys(known, key, skew)
    if hot:
        known = known.where(~F.col(key).isin(hot)).unionByName(known.where(F.col(key).isin(hot)).distinct())
    read = known.select(F.col(code).alias("_code"), F.lag(code).over(Window.partitionBy(key).orderBy(code)).alias("_before"))

    def opened(n):
        start = F.substring("_code", 1, n)
        return F.when((F.length("_code") >= n) & ~F.coalesce(F.startswith("_before", start), F.lit(False)),
                      F.struct(F.lit(n).alias("level"), start.alias("hsn_code")))

    # level 0 is opened by the first code; codes shorter than a level have no subtotal on it
    opens = F.array(F.when(F.col("_before").isNull(), F.struct(F.lit(0).alias("level"), F.lit("").alias("hsn_code"))),
                    *[opened(n) for n in HSN_LEVELS])
    each = read.select(F.explode_outer(opens).alias("_o")).where(F.col("_o").isNotNull()).select("_o.*")
    return each.groupBy("level", "hsn_code").agg(F.count(F.lit(1)).alias("gstins"))


def tolerant_date(c: str, formats=DATE_FORMATS) -> Column:
    """The date of a text in any of the formats; NULL if none reads it."""
    text = strip_ws(F.col(c))
    return F.coalesce(*[F.try_to_date(text, f) for f in formats])


def registration_ages(details: DataFrame, as_of: _dt.datetime, date: str = "registration_date") -> DataFrame:
    """(bucket_no, bucket, n): firms by whole years since registration, in order; then dates after ``as_of``,
    texts that are no date, and firms without one."""
    rows = details.select(F.when(strip_ws(F.col(date)) != "", F.col(date)).alias("_text"))
    rows = rows.withColumn("_date", tolerant_date("_text"))
    years = F.floor(F.months_between(F.lit(as_of.date()), F.col("_date"), roundOff=False) / 12)
    last = len(AGE_BUCKETS)
    bucket = F.when(F.col("_text").isNull(), last + 2).when(F.col("_date").isNull(), last + 1).when(F.col("_date") > F.lit(as_of.date()), last)
    for i, (below, _) in enumerate(AGE_BUCKETS):
        bucket = bucket.otherwise(i) if below is None else bucket.when(years < below, i)
    names = F.array(*[F.lit(x) for x in (*[b for _, b in AGE_BUCKETS], "in the future", "unreadable", "missing")])
    counted = rows.select(bucket.alias("bucket_no")).groupBy("bucket_no").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("bucket_no", F.get(names, F.col("bucket_no")).alias("bucket"), "n").orderBy("bucket_no")

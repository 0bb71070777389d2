"""Details history: one row per GSTIN and state of its details, with the time it held.

A load is compared with the open rows only (one a GSTIN on either side), by a hash of the details;
an unchanged load adds no row, a changed one closes the open row at the load's time and opens the next.
A GSTIN that a load lacks keeps its open row, as a lookup run covers part of the firms.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regspark.functions.text import stamp
from regspark.operators.enrich import one_per_gstin

DETAIL_COLUMNS = ("trade_name", "registration_date", "hsn_codes")


def details_hash(cols=DETAIL_COLUMNS) -> Column:
    """Hash of the details as one text; NULLs and empty values differ."""
    return F.md5(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}))


def first_load(load: DataFrame, at: _dt.datetime, key: str = "gstin") -> DataFrame:
    """The history after the first load: every GSTIN open since ``at``."""
    return _opened(load, at, key).withColumn("valid_to", F.lit(None).cast("timestamp_ntz"))


def _opened(load: DataFrame, at: _dt.datetime, key: str) -> DataFrame:
    rows = one_per_gstin(load.where(F.col(key).isNotNull()), key).select(key, *DETAIL_COLUMNS)
    return rows.withColumns({"row_hash": details_hash(), "valid_from": stamp(at)})


def apply_load(history: DataFrame, load: DataFrame, at: _dt.datetime, key: str = "gstin") -> DataFrame:
    """The history after a further load at ``at``. Both join sides hold each GSTIN once."""
    columns = history.columns
    before = history.where(F.col("valid_to").isNull()).select(F.col(key).alias("_k"), F.struct(*columns).alias("_old"))
    now = _opened(load, at, key).withColumn("valid_to", F.lit(None).cast("timestamp_ntz")).select(
        F.col(key).alias("_key"), F.struct(*columns).alias("_new"))
    both = before.join(now, F.col("_k") == F.col("_key"), "full_outer")
    changed = F.col("_old.row_hash") != F.col("_new.row_hash")
    rows = (F.when(F.col("_old").isNull(), F.array("_new"))
            .when(F.col("_new").isNull() | ~changed, F.array("_old"))
            .otherwise(F.array(F.col("_old").withField("valid_to", stamp(at)), F.col("_new"))))
    current = both.select(F.explode(rows).alias("_r")).select("_r.*")
    return history.where(F.col("valid_to").isNotNull()).unionByName(current.select(*columns))


def as_of_time(history: DataFrame, at: _dt.datetime) -> DataFrame:
    """The details as they were at a time."""
    held = (F.col("valid_from") <= stamp(at)) & (F.col("valid_to").isNull() | (F.col("valid_to") > stamp(at)))
    return history.where(held).drop("row_hash", "valid_from", "valid_to")

"""Sheet validation: distinct valid keys (A3+F1+F4+F5), invalid report (F7),
missing-column test (F8), split of requested ids (F9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regspark.functions.ids import PAN_PATTERN, is_valid_gstin, is_valid_pan, normalize_id
from regspark.operators.ordering import first_by_key


def normalize_valid_pans(sheet: DataFrame, pan_col: str = "pan", keep=()) -> DataFrame:
    """One row per valid normalized PAN: its first sheet row and columns ``keep``.

    Output: ``pan``, ``row_id`` and the ``keep`` columns of that first row.
    """
    norm = (sheet.where(F.col(pan_col).isNotNull())
            .select("row_id", normalize_id(pan_col).alias("_pan"), *[F.col(c) for c in keep])
            .where(F.col("_pan").rlike(PAN_PATTERN))
            .withColumnRenamed("_pan", "pan"))
    return first_by_key(norm, "pan", "row_id", keep)


def invalid_pan_rows(sheet: DataFrame, pan_col: str = "pan") -> DataFrame:
    """present but invalid PANs with their sheet row number (index + 2)."""
    return (sheet.where(F.col(pan_col).isNotNull())
            .select("row_id", (F.col("row_id") + 2).cast("long").alias("sheet_row"),
                    normalize_id(pan_col).alias("pan"))
            .where(~is_valid_pan("pan", normalized=True)))


def key_presence(sheet: DataFrame, pan_col: str = "pan") -> DataFrame:
    """F8: one row telling whether the key column is entirely missing (also for 0 rows)."""
    return sheet.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(pan_col).alias("n_present"),
    ).withColumn("all_missing", F.col("n_present") == 0)


def split_gstins(requested: DataFrame, col: str = "gstin") -> DataFrame:
    """each requested id flagged valid (15 characters) or rejected; no dedup."""
    return requested.withColumn("is_valid", is_valid_gstin(col))

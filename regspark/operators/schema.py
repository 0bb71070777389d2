"""Schema operators: header search (C1, C2), contact columns (C3), layout
detection (C4), legacy conversion (C5), column repair (C6, C7), export
projection (C8). Header work inspects ``df.columns`` only; no data is read."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StringType, TimestampNTZType

from regspark.functions.ids import legacy_pair_ok, normalize_id
from regspark.functions.text import stamp
from regspark.operators.skew import skew_join

# --- fixed values -----------------------------------------------------------
PAN_ALIASES = ("PAN_NUMBER", "PANNUMBER", "PAN_NO", "PANNO")
GSTIN_ALIASES = ("GST", "GST_NUMBER", "GSTNUMBER", "GST_NO", "GSTNO")
CONTACT_COLUMNS = ("Name", "Email", "Phone", "Address")
# Sheet column names of the two-table workbook.
PAN_SHEET_COLUMNS = ("PAN", "Name", "Email", "Phone", "Address", "GSTIN_Count", "Last_Updated", "Status")
GSTIN_SHEET_COLUMNS = ("PAN_Reference", "GSTIN", "GSTIN Status", "State", "Trade_Name",
                       "Registration_Date", "HSN_Codes", "Last_Updated")
ENRICHMENT_COLUMNS = ("Trade_Name", "Registration_Date", "HSN_Codes")
# ---------------------------------------------------------------------------

# Internal (snake_case) names and types of the two tables.
PAN_DATA_SCHEMA: dict[str, DataType] = {
    "row_id": LongType(), "pan": StringType(), "name": StringType(), "email": StringType(),
    "phone": StringType(), "address": StringType(), "gstin_count": LongType(),
    "last_updated": TimestampNTZType(), "status": StringType(),
}
GSTIN_DATA_SCHEMA: dict[str, DataType] = {
    "row_id": LongType(), "pan_reference": StringType(), "gstin": StringType(),
    "gstin_status": StringType(), "state": StringType(), "trade_name": StringType(),
    "registration_date": StringType(), "hsn_codes": StringType(), "last_updated": TimestampNTZType(),
}
PAN_EXPORT_NAMES = dict(zip(list(PAN_DATA_SCHEMA)[1:], PAN_SHEET_COLUMNS))
GSTIN_EXPORT_NAMES = dict(zip(list(GSTIN_DATA_SCHEMA)[1:], GSTIN_SHEET_COLUMNS))


def need_row_ids(table: DataFrame) -> None:
    """Updates of a key's first row need the sheet order; without it they would change nothing, unseen."""
    if "row_id" not in table.columns:
        raise ValueError("the table has no row_id column (read_sheet adds one)")


def _q(name: str):
    """A column by its exact header, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def _find_column(columns, target: str, aliases, first_match: bool) -> str | None:
    up = [(c, c.upper()) for c in columns]
    exact = lambda u: u == target
    alias = lambda u: u in aliases
    contains = lambda u: target in u
    if first_match:
        return next((c for c, u in up if exact(u) or contains(u) or alias(u)), None)
    for test in (exact, alias, contains):
        hit = next((c for c, u in up if test(u)), None)
        if hit is not None:
            return hit
    return None


def find_pan_column(columns, first_match: bool = False) -> str | None:
    """The PAN column of a sheet, case-insensitive.

    Default order is exact name, then an alias, then any header containing
    "PAN"; ``first_match=True`` takes the first header passing any test (which
    also picks a header such as "Company" standing before "PAN").
    """
    return _find_column(columns, "PAN", PAN_ALIASES, first_match)


def find_gstin_column(columns, first_match: bool = False) -> str | None:
    """The GSTIN column, same rules with the GST aliases."""
    return _find_column(columns, "GSTIN", GSTIN_ALIASES, first_match)


def contact_column(columns, target: str) -> str | None:
    """Exact, lower-case or upper-case spelling of a contact header."""
    for cand in (target, target.lower(), target.upper()):
        if cand in columns:
            return cand
    return None


def ensure_columns(df: DataFrame, schema: dict[str, DataType]) -> DataFrame:
    """Add missing target columns as NULL of the target type; keep extras."""
    missing = {c: F.lit(None).cast(t) for c, t in schema.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def conform(df: DataFrame, schema: dict[str, DataType]) -> DataFrame:
    """C6 then projection to exactly the target columns, in target order and type."""
    return ensure_columns(df, schema).select(*[F.col(c).cast(t).alias(c) for c, t in schema.items()])


def drop_if_present(df: DataFrame, cols=ENRICHMENT_COLUMNS) -> DataFrame:
    """Drop columns, ignoring absent ones."""
    return df.drop(*cols)


def is_legacy_layout(table_names, pan_table: str = "pan_data", gstin_table: str = "gstin_data") -> bool:
    """C4: the old one-table layout, when either target table is missing."""
    names = set(table_names)
    return pan_table not in names or gstin_table not in names


class LayoutError(ValueError):
    pass


def convert_legacy(df: DataFrame, as_of: _dt.datetime, first_match: bool = False):
    """An old one-sheet table -> (pan_data, gstin_data).

    ``df`` carries ``row_id`` and arbitrary headers. PAN rows: valid, distinct
    PANs with the contact columns of their first row (A3). GSTIN rows: every row
    passing the weaker pair test (F3), status and state NULL read as '' (U2).
    Both branches read the same cleaned projection.
    """
    from regspark.operators.validate import normalize_valid_pans

    pan_col = find_pan_column(df.columns, first_match)
    if pan_col is None:
        raise LayoutError("Could not find PAN column in the old format table")
    contacts = {t.lower(): contact_column(df.columns, t) for t in CONTACT_COLUMNS}
    base = df.select(
        "row_id", _q(pan_col).alias("_raw_pan"),
        *[(_q(src) if src else F.lit(None)).cast("string").alias(dst) for dst, src in contacts.items()])
    pans = normalize_valid_pans(base, "_raw_pan", keep=list(contacts))
    pan_data = conform(pans, PAN_DATA_SCHEMA)

    gstin_col = find_gstin_column(df.columns, first_match)
    if gstin_col is None:
        empty = df.sparkSession.createDataFrame([], "row_id long")
        return pan_data, conform(empty, GSTIN_DATA_SCHEMA)
    status = _q("GSTIN Status") if "GSTIN Status" in df.columns else F.lit(None)
    state = _q("State") if "State" in df.columns else F.lit(None)
    rows = (df.where(legacy_pair_ok(_q(pan_col), _q(gstin_col)))
            .select("row_id",
                    normalize_id(_q(pan_col)).alias("pan_reference"),
                    normalize_id(_q(gstin_col)).alias("gstin"),
                    F.coalesce(status.cast("string"), F.lit("")).alias("gstin_status"),
                    F.coalesce(state.cast("string"), F.lit("")).alias("state"),
                    stamp(as_of).alias("last_updated")))
    return pan_data, conform(rows, GSTIN_DATA_SCHEMA)


def legacy_orphans(pan_data: DataFrame, gstin_data: DataFrame) -> DataFrame:
    """Legacy GSTIN rows whose PAN passed the weaker pair test but is not a valid
    PAN row (children without a parent), reported rather than dropped."""
    known = pan_data.select(F.col("pan").alias("pan_reference")).distinct()
    return skew_join(gstin_data, known, "pan_reference", "left_anti")


def simplified_export(df: DataFrame) -> DataFrame:
    """PAN_Reference, GSTIN, GSTIN Status; without status two columns; else all."""
    cols = df.columns
    if "PAN_Reference" in cols and "GSTIN" in cols and "GSTIN Status" in cols:
        return df.select("PAN_Reference", "GSTIN", "GSTIN Status")
    if "PAN_Reference" in cols and "GSTIN" in cols:
        return df.select("PAN_Reference", "GSTIN")
    return df


def to_sheet_names(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Internal snake_case columns -> sheet headers (only at export)."""
    return df.select(*[F.col(c).alias(names.get(c, c)) for c in df.columns if c != "row_id"])


def from_sheet_names(df: DataFrame, names: dict[str, str]) -> DataFrame:
    inverse = {v: k for k, v in names.items()}
    return df.select(*[F.col(f"`{c}`").alias(inverse.get(c, c)) for c in df.columns])

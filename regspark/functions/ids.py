"""Identifier cleaning and validation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Characters Python's str.strip() removes (str.isspace), as one regex class that
# both Java regex (Spark) and RE2 (DuckDB) read the same way.
WHITESPACE_CLASS = (
    r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# PAN: five letters, four digits, one letter (ASCII; see README on H19).
PAN_PATTERN = r"^[A-Z]{5}[0-9]{4}[A-Z]$"
PAN_LENGTH = 10
GSTIN_LENGTH = 15
# Text that the default pandas CSV reader turns into a missing value.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# ---------------------------------------------------------------------------

_STRIP_RE = f"^{WHITESPACE_CLASS}+|{WHITESPACE_CLASS}+$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Whitespace removed at both ends, like Python ``str.strip()``.

    Spark's ``trim`` only removes blanks, so tabs and newlines would survive.
    """
    return F.regexp_replace(_c(c).cast("string"), _STRIP_RE, "")


def normalize_id(c) -> Column:
    """``str(x).strip().upper()`` (F5); NULL stays NULL."""
    return F.upper(strip_ws(c))


def is_valid_pan(c, normalized: bool = False) -> Column:
    """the PAN shape after F5; NULL input is not valid."""
    v = _c(c) if normalized else normalize_id(c)
    return F.coalesce(v.rlike(PAN_PATTERN), F.lit(False))


def is_valid_gstin(c) -> Column:
    """present and exactly 15 characters; no checksum or state test."""
    return F.coalesce(F.length(_c(c)) == GSTIN_LENGTH, F.lit(False))


def legacy_pair_ok(pan, gstin) -> Column:
    """the weaker legacy-row test, on normalized values with NULL read as ''."""
    p = F.coalesce(normalize_id(pan), F.lit(""))
    g = F.coalesce(normalize_id(gstin), F.lit(""))
    return (F.length(p) == PAN_LENGTH) & (F.length(g) == GSTIN_LENGTH)


def null_if_tokens(c, tokens=NA_TOKENS) -> Column:
    """The text spellings of a missing value become NULL."""
    col = _c(c)
    return F.when(col.isin(list(tokens)), F.lit(None).cast("string")).otherwise(col)


def non_empty_or(new, old) -> Column:
    """a new value replaces the old one only when present and non-empty."""
    return F.coalesce(F.nullif(_c(new), F.lit("")), _c(old))

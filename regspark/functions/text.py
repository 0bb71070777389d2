"""Text helpers for reports and exports."""

from __future__ import annotations

from datetime import timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
CODE_SEPARATOR = ", "
NOT_AVAILABLE = "Not available"
SIMPLIFIED_SUFFIX = "_simplified"
BACKUP_SUFFIX = "_backup"
STAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
# Run-label words shown for a job's parameters.
LABEL_HEADLESS, LABEL_UI = "Headless", "UI Mode"
LABEL_TEST, LABEL_FULL = "Test Mode", "Full Mode"
LABEL_LIMIT, LABEL_RESUME = ", Limit: ", ", Resume Enabled"
# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def join_codes(arr) -> Column:
    """P5: a code list stored as ``", "``-joined text."""
    return F.array_join(_c(arr), CODE_SEPARATOR)


def split_codes(c) -> Column:
    """Inverse of ``join_codes``; NULL or '' gives an empty list."""
    col = _c(c)
    return F.when(F.coalesce(col, F.lit("")) == "", F.array().cast("array<string>")) \
        .otherwise(F.split(col, CODE_SEPARATOR))


def short_id(c) -> Column:
    """First eight characters and an ellipsis."""
    return F.concat(F.substring(_c(c), 1, 8), F.lit("..."))


def capitalize_first(c, lower_rest: bool = True) -> Column:
    """First letter upper-cased; the rest lower-cased like the template filter."""
    col = _c(c)
    rest = F.substring(col, 2, 1 << 30)
    return F.concat(F.upper(F.substring(col, 1, 1)), F.lower(rest) if lower_rest else rest)


def run_label(headless, test_mode, limit, resume) -> Column:
    """P11: "Headless, Full Mode, Limit: n, Resume Enabled" (NULL parameters read as false)."""
    lim = _c(limit)
    return F.concat(
        F.when(F.coalesce(_c(headless), F.lit(False)), F.lit(LABEL_HEADLESS)).otherwise(F.lit(LABEL_UI)),
        F.lit(", "),
        F.when(F.coalesce(_c(test_mode), F.lit(False)), F.lit(LABEL_TEST)).otherwise(F.lit(LABEL_FULL)),
        F.when(F.coalesce(lim, F.lit(0)) != 0, F.concat(F.lit(LABEL_LIMIT), lim.cast("string"))).otherwise(F.lit("")),
        F.when(F.coalesce(_c(resume), F.lit(False)), F.lit(LABEL_RESUME)).otherwise(F.lit("")),
    )


def parse_limit(c) -> Column:
    """A form value made only of digits becomes an int; anything else NULL."""
    col = _c(c)
    return F.when(col.rlike(r"^[0-9]+$"), col.try_cast("int"))


def not_available(c) -> Column:
    """Blank or missing shown as 'Not available'."""
    return F.coalesce(F.nullif(_c(c), F.lit("")), F.lit(NOT_AVAILABLE))


def file_extension(path) -> Column:
    """Lower-cased text after the last dot of the file name; '' if none."""
    name = F.substring_index(_c(path), "/", -1)
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))


def file_base(path) -> Column:
    """File name without directory and without its last extension."""
    name = F.substring_index(_c(path), "/", -1)
    return F.regexp_replace(name, r"\.[^.]*$", "")


def export_name(path, ext: str = "csv", as_of=None) -> Column:
    """``<base>_simplified.<ext>``, with ``as_of`` (UTC) ``<base>_simplified_<epoch seconds>.<ext>``."""
    when = "" if as_of is None else f"_{int(as_of.replace(tzinfo=timezone.utc).timestamp())}"
    return F.concat(file_base(path), F.lit(f"{SIMPLIFIED_SUFFIX}{when}.{ext}"))


def backup_name(path) -> Column:
    """``<dir/base>_backup.<ext>`` next to the original."""
    p = _c(path)
    ext = F.regexp_extract(p, r"\.[^./]*$", 0)
    stem = F.regexp_replace(p, r"\.[^./]*$", "")
    return F.concat(stem, F.lit(BACKUP_SUFFIX), ext)


def percent(done, total) -> Column:
    """Round-half-up percentage; NULL when total is missing or 0."""
    return F.round(F.lit(100.0) * _c(done) / F.nullif(_c(total), F.lit(0))).cast("long")


def format_stamp(ts) -> Column:
    """P10: ``YYYY-MM-DD HH:MM:SS`` text of a time stamp."""
    return F.date_format(_c(ts), STAMP_FORMAT)


def stamp(as_of) -> Column:
    """A run time as a zone-free timestamp literal (independent of the driver's zone)."""
    return F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")

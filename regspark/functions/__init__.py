"""Column expressions (pure ``pyspark.sql.functions`` compositions, codegen-friendly)."""

from regspark.functions.ids import (  # noqa: F401
    PAN_PATTERN, WHITESPACE_CLASS, strip_ws, normalize_id, is_valid_pan, is_valid_gstin,
    legacy_pair_ok, null_if_tokens, non_empty_or, NA_TOKENS,
)
from regspark.functions.text import (  # noqa: F401
    join_codes, split_codes, short_id, capitalize_first, run_label, parse_limit,
    not_available, file_extension, file_base, export_name, backup_name, percent,
    format_stamp, stamp,
)

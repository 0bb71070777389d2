"""Own business names against the firms of the GSTIN table (O3): an equi-join on a normal form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regspark.operators.skew import DEFAULT, SkewConfig, skew_join

# --- fixed values -----------------------------------------------------------
# Legal forms, in their long and short spellings, that do not tell firms apart.
LEGAL_WORDS = ("private", "pvt", "limited", "ltd", "llp", "opc", "company", "co", "corporation", "corp", "incorporated", "inc",
               "the", "m", "s", "ms", "messrs", "and")
# ---------------------------------------------------------------------------


def name_key(c) -> Column:
    """Normal form of a business name: lower case, words of letters and digits in their order, without legal
    forms; NULL if nothing is left."""
    words = F.split(F.lower(F.col(c) if isinstance(c, str) else c), r"[^\p{L}\p{N}]+", -1)
    kept = F.filter(words, lambda w: (w != "") & ~w.isin(*LEGAL_WORDS))
    return F.when(F.size(kept) > 0, F.array_join(kept, " "))


def match_names(own: DataFrame, firms: DataFrame, name: str = "name", trade_name: str = "trade_name",
                key: str = "gstin", skew: SkewConfig = DEFAULT) -> DataFrame:
    """``own`` rows with ``matches`` (GSTINs of that name), ``gstin`` (if there is one alone) and ``match``
    ('unique', 'ambiguous' or 'none').

    Firms are reduced to one row per name first, by fixed-width aggregates, so a name that a third of all
    firms bear is one row; own names borne by many rows are salted.
    """
    by_name = (firms.where(F.col(key).isNotNull()).select(name_key(trade_name).alias("_key"), key).where(F.col("_key").isNotNull())
               .groupBy("_key").agg(F.min(key).alias("_first"), F.max(key).alias("_last"), F.count_distinct(key).alias("_n")))
    found = skew_join(own.withColumn("_key", name_key(name)), by_name, "_key", "left", skew)
    n = F.coalesce(F.col("_n"), F.lit(0))
    return found.withColumns({
        "matches": n, "gstin": F.when(F.col("_first") == F.col("_last"), F.col("_first")),
        "match": F.when(n == 0, "none").when(n == 1, "unique").otherwise("ambiguous")}).drop("_key", "_first", "_last", "_n")

"""Hot-key handling for joins whose large side may hold one key in a third of its rows.

AQE splits skewed partitions only when both join inputs are plain shuffle
stages; a side that is already partitioned by the key (an aggregate, an earlier
join) or a distinct on the small side switches that off. So the large joins of
the library salt hot keys explicitly:

1. ``hot_keys``: a seeded sample of the large side's key column is counted per
   key; keys with at least ``share`` of the sampled rows come back, hottest first.
   At most ``1 / share`` keys can have that share, so the list that reaches the
   driver is bounded without a cut. By default ``share`` is four mean partitions.
2. ``salted_join``: large-side rows of a hot key get a salt in ``[0, salts)``
   from a hash of the row (deterministic, so a recomputed task yields the same
   salt); small-side rows of a hot key are copied once per salt; every other
   row has salt 0. The join runs on (key, salt), so a hot key is spread over
   ``salts`` tasks. Each large-side row still meets exactly the small-side rows
   of its key, so the result equals the plain join for any set of hot keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SkewConfig:
    salts: int | None = None        # None: as many as shuffle partitions
    share: float | None = None      # None: four mean partitions, a tenth of the rows at most
    sample_fraction: float = 0.01
    min_hits: int = 20              # sampled rows below which a share is only noise
    seed: int = 17
    enabled: bool = True


DEFAULT = SkewConfig()
_SALT = "_salt"


def _partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def hot_keys(df: DataFrame, key: str, cfg: SkewConfig = DEFAULT) -> list:
    """Keys holding at least ``cfg.share`` of the rows whose key is not NULL, hottest first."""
    if not cfg.enabled:
        return []
    share = cfg.share or min(0.1, 4 / _partitions(df))
    sample = df.select(F.col(key).alias("_k")).where(F.col("_k").isNotNull())
    if cfg.sample_fraction < 1.0:
        sample = sample.sample(fraction=cfg.sample_fraction, seed=cfg.seed)
    # the grand total comes with the counts and sorts first, then at most 1 / share hot keys
    rows = (sample.rollup("_k").agg(F.count(F.lit(1)).alias("_n"), F.grouping("_k").alias("_total"))
            .orderBy(F.desc("_n"), F.desc("_total"), F.asc("_k")).limit(int(1 / share) + 1).collect())
    need = max(cfg.min_hits, share * rows[0]["_n"]) if rows else 0
    return [r["_k"] for r in rows if not r["_total"] and r["_n"] >= need]


def hot_keys_by_column(df: DataFrame, keys, cfg: SkewConfig = DEFAULT) -> dict:
    """``hot_keys`` of several key columns of one input."""
    return {k: hot_keys(df, k, cfg) for k in keys}


def salted_join(large: DataFrame, small: DataFrame, key: str, how: str, hot: list,
                salts: int | None = None) -> DataFrame:
    """``large.join(small, key, how)`` with the ``hot`` keys spread over ``salts`` tasks.

    ``how`` is one of inner, left, left_semi, left_anti (the large side is the left).
    The salt comes from the row's place in its partition, so rows that are equal in
    every column spread too; rows with a NULL key match nothing and are always spread.
    """
    salts = salts or max(32, _partitions(large))
    wide = F.col(key).isNull() | F.col(key).isin(hot) if hot else F.col(key).isNull()
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int")
    l_salted = large.withColumn(_SALT, F.when(wide, salt).otherwise(F.lit(0)))
    copies = F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    s_salted = small.withColumn(_SALT, F.explode(copies) if hot else F.lit(0))
    return l_salted.join(s_salted, [key, _SALT], how).drop(_SALT)


def skew_join(large: DataFrame, small: DataFrame, key: str, how: str, cfg: SkewConfig = DEFAULT) -> DataFrame:
    """Detect hot keys of ``large`` and join with them salted (plain join when none)."""
    return salted_join(large, small, key, how, hot_keys(large, key, cfg), cfg.salts)

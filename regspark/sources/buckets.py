"""Tables bucketed by key, which later runs join without shuffling them.

A run joins its new rows with what earlier runs landed. Bucketed by the join key, the landed
side is read as it lies (no exchange) and only the new rows are shuffled to its buckets. A key
with a large share of the rows would fill one bucket, so its rows (and those with a NULL key)
lie beside the buckets, unbucketed, in ``hot``.

    <path>/cold     bucketed and sorted by the key
    <path>/hot      rows of the keys that were hot in their load, and rows without a key
    <path>/keys     the hot keys of each load (at most 1 / share a load)
    <path>/_spec    key, number of buckets, schema

The table is registered in the session's catalog as an external table, again in each session.
"""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from regspark.operators.skew import DEFAULT, SkewConfig, hot_keys, salted_join
from regspark.session import path_exists

MAX_BROADCAST_KEYS = 10_000  # keys of a counted list beyond which a join is salted instead


@dataclass(frozen=True)
class Bucketed:
    """A bucketed table as read back."""

    key: str
    buckets: int
    cold: DataFrame
    hot: DataFrame
    keys: DataFrame


def _name(path: str) -> str:
    return "bucketed_" + hashlib.sha256(path.encode()).hexdigest()[:24]


def _spec(spark: SparkSession, path: str) -> dict | None:
    if not path_exists(spark, os.path.join(path, "_spec", "_SUCCESS")):
        return None
    return json.loads(spark.read.text(os.path.join(path, "_spec")).first()[0])


def _register(spark: SparkSession, path: str, spec: dict) -> str:
    """The external table over ``cold``, created in this session's catalog if it is not there."""
    name = _name(path)
    if not spark.catalog.tableExists(name):
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(spec["schema"]).fields)
        spark.sql(f"CREATE TABLE {name} ({cols}) USING parquet CLUSTERED BY (`{spec['key']}`) SORTED BY (`{spec['key']}`) "
                  f"INTO {spec['buckets']} BUCKETS LOCATION '{os.path.join(path, 'cold')}'")
    return name


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int, skew: SkewConfig = DEFAULT, placed: bool = False) -> None:
    """Append a load to the bucketed table at ``path`` (made if it is not there; key and buckets then stay).

    One file a bucket is written, unless the rows are ``placed``: they lie partitioned by the key already,
    and are written where they are.
    """
    spark, hot = df.sparkSession, hot_keys(df, key, skew)
    spec = _spec(spark, path)
    if spec is None:
        spec = {"key": key, "buckets": buckets, "schema": df.schema.jsonValue()}
        spark.createDataFrame([(json.dumps(spec),)], "value string").coalesce(1).write.text(os.path.join(path, "_spec"))
    elif spec["key"] != key:
        raise ValueError(f"the table at {path} is bucketed by {spec['key']}, not {key}")
    cols = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in StructType.fromJson(spec["schema"]).fields]
    rows = df.select(*cols)
    beside = F.col(key).isNull() | F.col(key).isin(hot) if hot else F.col(key).isNull()
    rows.where(beside).write.mode("append").parquet(os.path.join(path, "hot"))
    spark.createDataFrame([(k,) for k in hot], StructType([rows.schema[key]])).write.mode("append").parquet(os.path.join(path, "keys"))
    inside = rows.where(~beside) if placed else rows.where(~beside).repartition(spec["buckets"], key)
    (inside.write.format("parquet").mode("append")
     .bucketBy(spec["buckets"], key).sortBy(key).saveAsTable(_register(spark, path, spec)))


def read_bucketed(spark: SparkSession, path: str) -> Bucketed:
    spec = _spec(spark, path)
    if spec is None:
        raise FileNotFoundError(f"no bucketed table at {path}")
    name, schema = _register(spark, path, spec), StructType.fromJson(spec["schema"])
    spark.catalog.refreshTable(name)
    return Bucketed(spec["key"], spec["buckets"], spark.table(name), spark.read.schema(schema).parquet(os.path.join(path, "hot")),
                    spark.read.schema(StructType([schema[spec["key"]]])).parquet(os.path.join(path, "keys")).distinct())


def rows_of(table: Bucketed, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cold, hot) rows of the table whose key is in ``wanted`` (a distinct column of the key's name).

    The cold rows meet the wanted keys in their buckets: the keys are spread over as many partitions as there
    are buckets, or Spark would rather shuffle the side with fewer of them. The hot rows stay where they are and meet
    the few wanted keys that are hot, broadcast if counted as few, else salted.
    """
    cold = table.cold.join(wanted.repartition(table.buckets, table.key), table.key, "left_semi")
    n = table.keys.count()
    if n > MAX_BROADCAST_KEYS:
        return cold, salted_join(table.hot, wanted, table.key, "left_semi", [r[0] for r in table.keys.collect()])
    few = wanted.join(F.broadcast(table.keys), table.key, "left_semi")
    return cold, table.hot.join(F.broadcast(few), table.key, "left_semi")


# -- an index of the keys a growing table holds ------------------------------------------------

def add_keys(rows: DataFrame, path: str, key: str, run: int, buckets: int) -> None:
    """Add the distinct keys of ``rows`` as those of ``run``. Distinct keys have no hot one; a key that is
    added twice does no harm, so a run may be repeated."""
    keys = rows.where(F.col(key).isNotNull()).select(key).distinct().withColumn("run", F.lit(run))
    write_bucketed(keys, path, key, buckets, SkewConfig(enabled=False))


def unknown_rows(rows: DataFrame, index: Bucketed, run: int, hot: list) -> DataFrame:
    """J2 against the index: the rows whose key no run before ``run`` has added.

    ``run``'s own keys do not count, so a run that is repeated after a failure finds the same rows again.
    Rows of the ``hot`` keys (at most 1 / share of them, see ``hot_keys``) meet a broadcast of those keys
    of the index, rows without a key meet nothing; neither is shuffled.
    """
    key, known = index.key, index.cold.where(F.col("run") < run)
    if not hot:
        beside = rows.where(F.col(key).isNull())
    else:
        few = F.broadcast(known.where(F.col(key).isin(hot)).select(key))
        beside = rows.where(F.col(key).isNull() | F.col(key).isin(hot)).join(few, key, "left_anti")
    rest = rows.where(F.col(key).isNotNull() & ~F.col(key).isin(hot) if hot else F.col(key).isNotNull())
    return rest.repartition(index.buckets, key).join(known.select(key), key, "left_anti").unionByName(beside)

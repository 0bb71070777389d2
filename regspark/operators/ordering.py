"""Order-dependent operators: first-by-key (A3), top-n (L1, L2), positions and batches (L4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_by_key(df: DataFrame, key, order_col: str = "row_id", cols=()) -> DataFrame:
    """Per key, the smallest ``order_col`` and the other columns of that row (A3).

    ``min_by`` is a declarative aggregate, so Spark combines it map-side before
    the shuffle: a key holding a third of all rows still ships one partial row
    per input partition. ``dropDuplicates`` would keep an arbitrary row instead.
    """
    keys = [key] if isinstance(key, str) else list(key)
    cols = [c for c in cols if c not in keys and c != order_col]
    aggs = [F.min(order_col).alias(order_col)]
    if cols:
        aggs.append(F.min_by(F.struct(*cols), F.col(order_col)).alias("_first"))
    out = df.groupBy(*keys).agg(*aggs)
    return out.select(*keys, order_col, *[F.col(f"_first.{c}").alias(c) for c in cols])


def first_n(df: DataFrame, n: int | None, order_col: str = "row_id") -> DataFrame:
    """The first ``n`` rows in sheet order (L1, L2); ``None`` keeps all.

    ``orderBy().limit()`` plans as TakeOrderedAndProject: every partition keeps
    its own top n and only those meet in the final task.
    """
    if n is None:
        return df
    return df.orderBy(order_col).limit(int(n))


def global_position(df: DataFrame, order_col: str = "row_id", out: str = "position",
                    bucket_rows: int = 1 << 16) -> DataFrame:
    """1-based position of every row in ``order_col`` order, without a one-partition sort.

    ``order_col`` is a unique integer (the sheet row index). Rows fall into
    buckets of ``bucket_rows`` consecutive values; a window numbers the rows
    inside each bucket (each bucket holds at most ``bucket_rows`` rows), and the
    running total of bucket sizes, again in two levels, gives the offset.
    """
    bucket = F.floor(F.col(order_col) / F.lit(bucket_rows)).cast("long")
    tagged = df.withColumn("_bucket", bucket)
    sizes = tagged.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # running totals in two levels: buckets inside a shelf of as many buckets, then whole shelves
    shelf = F.floor(F.col("_bucket") / F.lit(bucket_rows)).cast("long")
    sizes = sizes.withColumn("_shelf", shelf)
    shelves = sizes.groupBy("_shelf").agg(F.sum("_n").alias("_n"))
    above = Window.orderBy("_shelf").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket_rows ** 2 ids
    shelves = shelves.select("_shelf", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_above"))
    before = Window.partitionBy("_shelf").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
               .join(shelves, "_shelf").select("_bucket", (F.col("_before") + F.col("_above")).alias("_offset")))
    local = F.row_number().over(Window.partitionBy("_bucket").orderBy(order_col))
    return (tagged.withColumn("_local", local)
            .join(offsets, "_bucket")
            .withColumn(out, (F.col("_offset") + F.col("_local")).cast("long"))
            .drop("_bucket", "_local", "_offset"))


def dense_ids(df: DataFrame, order, path: str, start: int = 0, out: str = "row_id") -> DataFrame:
    """The rows with ids ``start + 1, start + 2, ...`` in the order of the columns ``order``, written to ``path``.

    Rows are sorted over ranges and written once with their place in their partition; one count per
    partition gives the offsets. No task holds more than a range, and rows equal in all of ``order`` get ids of their own.
    """
    spark = df.sparkSession
    rest = df.drop(out)
    rest.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()).write.mode("errorifexists").parquet(path)
    kept = spark.read.schema(rest.withColumn("_at", F.lit(0).cast("long")).schema).parquet(path)
    part = F.shiftright("_at", 33)
    sizes = kept.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    offsets, upto = [], start
    for r in sizes:  # one row a partition
        offsets.append((r["part"], upto))
        upto += r["n"]
    table = spark.createDataFrame(offsets, "_part long, _offset long")
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (kept.withColumn("_part", part).join(F.broadcast(table), "_part")
            .withColumn(out, F.col("_offset") + place + 1).select(*df.columns))


def cut_batches(df: DataFrame, size: int = 10, order_col: str = "row_id") -> DataFrame:
    """L4: groups of ``size`` rows in order; the last group may be short."""
    pos = global_position(df, order_col)
    return pos.withColumn("batch_no", F.floor((F.col("position") - 1) / F.lit(size)).cast("long"))

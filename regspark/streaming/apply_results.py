"""Incremental, resumable append of new GSTIN rows.

The original tool processed PANs in batches of ten, saved a checkpoint after
each batch and resumed from it. Here the landed result files are a file
stream: each micro-batch keeps result items with a 15-character GSTIN, drops
those whose GSTIN is already in the existing table (anti join, hot GSTINs
salted), and writes into a folder named by its epoch with overwrite. A batch
replayed after a failure replaces its own output instead of doubling it; the
query checkpoint records which files each epoch consumed.
"""

from __future__ import annotations

import datetime as _dt
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regspark.operators.merge import new_gstin_rows
from regspark.operators.results import add_to_state, apply_results, combine_parts, rollup_parts, with_status
from regspark.operators.schema import GSTIN_DATA_SCHEMA, PAN_DATA_SCHEMA, conform
from regspark.operators.skew import SkewConfig, skew_join
from regspark.session import path_exists, scratch_path
from regspark.sources.buckets import Bucketed, read_bucketed, write_bucketed
from regspark.sources.io import COMPLETE_MARKER, table_names

PARTS = "pan string, gstin_count bigint, no_records boolean, error struct<o: bigint, text: string>"


def land_results(results: DataFrame, landing_dir: str, files: int | None = None) -> None:
    """Write result items as Parquet files, the way responses would arrive: as many
    files as the input has partitions, or ``files``. A PAN's items may be in any of them."""
    out = results if files is None else results.repartition(files)
    out.write.mode("append").parquet(landing_dir)


def _known_gstins(old: DataFrame) -> DataFrame:
    """The old table's keys, written once to shared storage: every micro-batch reads them."""
    spark, path = old.sparkSession, scratch_path(old.sparkSession, "known-gstins")
    keys = old.where(F.col("gstin").isNotNull()).select("gstin").distinct()
    keys.write.parquet(path)
    return spark.read.schema(keys.schema).parquet(path)


def _run(spark: SparkSession, landing_dir: str, checkpoint_dir: str, bytes_per_trigger: int, per_batch) -> None:
    """Every landed file not yet consumed, in micro-batches; returns when all are done."""
    schema = spark.read.parquet(landing_dir).schema
    stream = (spark.readStream.schema(schema).option("maxBytesPerTrigger", str(bytes_per_trigger))
              .parquet(landing_dir))
    q = (stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def _write_epoch(df: DataFrame, folder: str, epoch: int) -> None:
    df.write.mode("overwrite").parquet(os.path.join(folder, f"epoch={epoch}"))


def stream_apply_results(spark: SparkSession, landing_dir: str, old: DataFrame, sink_dir: str,
                         checkpoint_dir: str, as_of: _dt.datetime, bytes_per_trigger: int = 1 << 30) -> DataFrame:
    """Run the stream until every landed file is processed; return old rows + appended rows."""
    keys = _known_gstins(old)

    def per_batch(batch: DataFrame, epoch: int) -> None:
        _write_epoch(skew_join(new_gstin_rows(batch, as_of), keys, "gstin", "left_anti"), sink_dir, epoch)

    _run(spark, landing_dir, checkpoint_dir, bytes_per_trigger, per_batch)
    appended = spark.read.parquet(sink_dir).drop("epoch")
    return conform(old, GSTIN_DATA_SCHEMA).unionByName(conform(appended, GSTIN_DATA_SCHEMA))


def _last_state(spark: SparkSession, state_dir: str) -> tuple[int, Bucketed | None]:
    """(last epoch in it, table) of the newest complete state; (-1, None) before the first."""
    for name in sorted(table_names(spark, state_dir), reverse=True):
        path = os.path.join(state_dir, name)
        if path_exists(spark, os.path.join(path, COMPLETE_MARKER, "_SUCCESS")):
            return int(name.split("-")[1]), read_bucketed(spark, path)
    return -1, None


def _advance_state(spark: SparkSession, upd_dir: str, state_dir: str) -> DataFrame:
    """The state with every epoch's parts in it: the newest one plus the epochs after it, written as a new one.

    The state holds one row a PAN, bucketed by ``pan``. Earlier epochs are not read again, and the state is
    not shuffled. A state without its marker (a run that died) is passed over.
    """
    upto, state = _last_state(spark, state_dir)
    epochs = {int(n.split("=")[1]): n for n in table_names(spark, upd_dir)}
    later = [os.path.join(upd_dir, n) for e, n in epochs.items() if e > upto]
    if not later:
        return state.cold
    parts = spark.read.schema(PARTS).parquet(*later)
    buckets = state.buckets if state else int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = (add_to_state(state.cold, parts, buckets) if state
             else combine_parts(parts.repartition(buckets, "pan")))
    path = os.path.join(state_dir, f"upto-{max(epochs):010d}-{uuid.uuid4().hex}")
    write_bucketed(whole.where(F.col("pan").isNotNull()), path, "pan", buckets, SkewConfig(enabled=False), placed=True)
    spark.range(1).coalesce(1).write.parquet(os.path.join(path, COMPLETE_MARKER))
    return read_bucketed(spark, path).cold


def stream_map_pans(spark: SparkSession, landing_dir: str, sheet: DataFrame, old: DataFrame, out_dir: str,
                    checkpoint_dir: str, as_of: _dt.datetime, bytes_per_trigger: int = 1 << 30):
    """T1 with the PAN table: every micro-batch rolls up its PANs (A1, A4) and
    appends new GSTIN rows (J2, U1); at the end of a run its parts are added to a state kept
    per PAN, and the PAN table takes each PAN's state (J4), so a PAN's items may come in any
    files of any run. Returns (pan_data, gstin_data).
    """
    keys = _known_gstins(old)
    upd_dir, new_dir = os.path.join(out_dir, "pan_updates"), os.path.join(out_dir, "new_gstins")

    def per_batch(batch: DataFrame, epoch: int) -> None:
        _write_epoch(rollup_parts(batch), upd_dir, epoch)
        _write_epoch(skew_join(new_gstin_rows(batch, as_of), keys, "gstin", "left_anti"), new_dir, epoch)

    _run(spark, landing_dir, checkpoint_dir, bytes_per_trigger, per_batch)
    state = _advance_state(spark, upd_dir, os.path.join(out_dir, "pan_state"))
    pan_data = apply_results(conform(sheet, PAN_DATA_SCHEMA), with_status(state), as_of)
    appended = spark.read.parquet(new_dir).drop("epoch")
    gstin_data = conform(old, GSTIN_DATA_SCHEMA).unionByName(conform(appended, GSTIN_DATA_SCHEMA))
    return pan_data, gstin_data

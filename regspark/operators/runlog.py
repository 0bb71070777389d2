"""Run log reports: history (L3, P11, P12), progress (A6, A7, A8), latest result
(A9), run summary (A10), removal of runs (U3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regspark.functions.text import capitalize_first, percent, run_label, short_id
from regspark.operators.skew import salted_join, skew_join

# --- fixed values -----------------------------------------------------------
STATUS_COMPLETED = "completed"
STATUS_ORDER = ("queued", "processing", "completed", "failed", "removed")
ERR_NOT_IN_TABLE = "Failed to update Excel file"
# ---------------------------------------------------------------------------


def run_history(jobs: DataFrame) -> DataFrame:
    """L3 + P11 + P12: every run, newest first, with its display fields."""
    return jobs.select(
        "job_id", short_id("job_id").alias("short_id"), "filename", "created_at",
        capitalize_first("status").alias("status_label"),
        run_label("headless", "test_mode", "max_pans", "resume").alias("params_label"),
    ).orderBy(F.desc("created_at"), F.desc("job_id"))


def batch_outcomes(looked_up: DataFrame, target: DataFrame, hot: list | None = None,
                   salts: int | None = None) -> DataFrame:
    """Per requested GSTIN of a details run: success, or the error that stopped it.

    ``looked_up`` is the output of ``lookup_details`` (J7); an id with details
    that is not in the target table fails with the table-update error.
    """
    present = target.where(F.col("gstin").isNotNull()).select("gstin").distinct().withColumn("_in", F.lit(True))
    j = (skew_join(looked_up, present, "gstin", "left") if hot is None
         else salted_join(looked_up, present, "gstin", "left", hot, salts))
    error = F.when(F.col("error").isNotNull(), F.col("error")) \
        .when(F.col("_in").isNull(), F.lit(ERR_NOT_IN_TABLE))
    return j.select("gstin", error.isNull().alias("success"), error.alias("error"))


def batch_progress(outcomes: DataFrame) -> DataFrame:
    """A6 + A8: total, processed, successful, failed and the rounded percentage."""
    agg = outcomes.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.lit(1)).alias("processed"),
        F.count_if(F.col("success")).alias("successful"),
        F.count_if(~F.col("success")).alias("failed"))
    return agg.withColumn("percent_done", percent("processed", "total"))


def processed_count(done: DataFrame) -> DataFrame:
    """Number of checkpointed PANs and the latest checkpoint time (``done`` has pan, timestamp)."""
    return done.agg(F.count(F.lit(1)).alias("processed_count"), F.max("timestamp").alias("timestamp"))


def latest_completed(jobs: DataFrame) -> DataFrame:
    """The completed run with the newest result (ties: larger job id); runs without
    a result file do not count, and with none at all there is no row."""
    done = jobs.where((F.col("status") == STATUS_COMPLETED) & F.col("result_file").isNotNull())
    last = done.agg(F.max(F.struct("end_time", "job_id", "result_file")).alias("_last"))
    return last.where(F.col("_last").isNotNull()).select("_last.job_id", "_last.result_file", "_last.end_time")


def latest_states(changes: DataFrame) -> DataFrame:
    """One row per job, its state after its last change (of equal times the later status); removed jobs (U3) drop out.

    ``changes`` is (job_id, job struct with ``changed_at`` and ``status``). ``max_by`` combines map-side, so
    a job with very many changes ships one row per partition.
    """
    rank = F.array_position(F.array(*[F.lit(x) for x in STATUS_ORDER]), F.col("job.status"))
    last = changes.groupBy("job_id").agg(F.max_by("job", F.struct(F.col("job.changed_at").alias("at"), rank.alias("rank"))).alias("job"))
    return last.where(F.coalesce(F.col("job.status"), F.lit("")) != "removed").select("job_id", "job.*")


def progress_report(log: DataFrame) -> DataFrame:
    """Q7 with A6-A9: per run its display fields, how far it came, and whether its result is the latest.

    ``log`` is the run log with its nested records: counts come from aggregates inside a run's ``results``
    array, else from its ``progress`` (a details run's totals, a mapping run's checkpoint count and time).
    The latest result is one job id, a scalar subquery over three columns.
    """
    has = F.col("results").isNotNull()
    ok = F.size(F.filter("results", lambda r: F.coalesce(r["success"], F.lit(False))))
    total = F.coalesce(F.col("progress.total"), F.when(F.col("gstins").isNotNull(), F.size("gstins")))
    processed = F.when(has, F.size("results")).otherwise(F.coalesce("progress.processed", "progress.processed_count"))
    counted = log.select(
        "job_id", short_id("job_id").alias("short_id"), "filename", "created_at",
        capitalize_first("status").alias("status_label"),
        run_label("parameters.headless", "parameters.test_mode", "parameters.limit", "parameters.resume").alias("params_label"),
        total.cast("long").alias("total"), processed.cast("long").alias("processed"),
        F.when(has, ok).otherwise(F.col("progress.successful")).cast("long").alias("successful"),
        F.when(has, F.size("results") - ok).otherwise(F.col("progress.failed")).cast("long").alias("failed"),
        F.get(F.filter("results", lambda r: r["error"].isNotNull()), 0)["error"].alias("first_error"),
        F.col("progress.timestamp").alias("progress_at"))
    last = latest_completed(log).select("job_id").scalar()
    return counted.withColumns({"percent_done": percent("processed", "total"),
                                "is_latest": F.coalesce(F.col("job_id") == last, F.lit(False))})


def drop_runs(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Remove the listed runs from the log."""
    return jobs.join(ids.select("job_id").distinct(), "job_id", "left_anti")


def run_summary(*counts: DataFrame) -> DataFrame:
    """A10: one-row frames of named counts as (metric, value) rows (a union, no cross join)."""
    parts = [c.unpivot([], [F.col(n).cast("long").alias(n) for n in c.columns], "metric", "value") for c in counts]
    return reduce(DataFrame.unionByName, parts)

"""User-facing pipelines (Q1-Q7), each one lazy plan from inputs to outputs."""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from regspark.functions.ids import is_valid_pan, normalize_id
from regspark.operators.enrich import enrich, lookup_details
from regspark.operators.merge import (fresh_rows, new_gstin_rows, requested_with_details,
                                      upsert_details_all, upsert_details_first)
from regspark.operators.ordering import first_n
from regspark.operators.pages import extract_details, item_order, landed_items, page_results
from regspark.operators.results import apply_results, pending_pans, rollup_results
from regspark.operators.runlog import batch_outcomes, batch_progress, latest_completed
from regspark.operators.skew import DEFAULT as SKEW, SkewConfig, hot_keys, hot_keys_by_column, salted_join
from regspark.operators.schema import (GSTIN_DATA_SCHEMA, GSTIN_EXPORT_NAMES, PAN_DATA_SCHEMA, conform, need_row_ids,
                                       simplified_export, to_sheet_names)
from regspark.session import scratch_path
from regspark.sources import io as sio
from regspark.sources.buckets import Bucketed, add_keys, read_bucketed, rows_of, unknown_rows
from regspark.sources.io import RESULT_ITEM
from regspark.operators.validate import normalize_valid_pans, split_gstins


class ValidationError(ValueError):
    pass


def check_key_column(pan_data: DataFrame) -> None:
    """F8 before any repair (H10): the PAN column must exist and hold a value."""
    if "pan" not in pan_data.columns:
        raise ValidationError("PAN column is missing in the PAN sheet")
    if pan_data.where(F.col("pan").isNotNull()).isEmpty():  # stops at the first value
        raise ValidationError("PAN column is empty in the PAN sheet")


def check_requested(requested: DataFrame) -> None:
    """a details run needs at least one valid id."""
    if split_gstins(requested).where("is_valid").isEmpty():
        raise ValidationError("No valid GSTINs provided")


def map_pans(pan_data: DataFrame, gstin_data: DataFrame, responses: DataFrame, as_of: _dt.datetime,
             done: DataFrame | None = None, resume: bool = False, limit: int | None = None,
             test_mode: bool = False, match: str = "normalized", validate: bool = True,
             skew: SkewConfig = SKEW, checkpointed: DataFrame | None = None):
    """Q1: (updated pan_data, updated gstin_data).

    Distinct valid PANs (A3) minus the checkpointed ones (J1, when ``resume``),
    the first PAN only in ``test_mode`` (L2), the first ``limit`` (L1); the
    landed responses of those PANs plus the responses of the checkpointed PANs
    (from ``checkpointed``, the results of ``read_checkpoint``, else the landed ones) are rolled
    up (A1, A4) and written to the first sheet row of each PAN (J4); their
    15-character GSTINs not yet in the table are appended (J2, U1).
    """
    chosen = select_responses(pan_data, responses, done, resume, limit, test_mode, validate, skew, checkpointed)
    new_pan, fresh = mapped(chosen, gstin_data, as_of, match, skew)
    return new_pan, conform(gstin_data, GSTIN_DATA_SCHEMA).unionByName(fresh)


@dataclass(frozen=True)
class Selection:
    """What a mapping run works on: the sheet, its valid PANs, the responses that take part, the hot GSTINs."""

    pan_data: DataFrame
    valid: DataFrame
    results: DataFrame
    hot_gstins: list


def select_responses(pan_data: DataFrame, responses: DataFrame | Bucketed, done: DataFrame | None = None, resume: bool = False,
                     limit: int | None = None, test_mode: bool = False, validate: bool = True,
                     skew: SkewConfig = SKEW, checkpointed: DataFrame | None = None) -> Selection:
    """The first half of Q1: A3, J1, L1, L2 and the responses of the chosen PANs.

    ``responses`` may be a table bucketed by ``pan`` (``sources.buckets``), which is then not shuffled.
    """
    if validate:
        check_key_column(pan_data)
    need_row_ids(pan_data)
    pan_data = conform(pan_data, PAN_DATA_SCHEMA)
    valid = normalize_valid_pans(pan_data).select("pan", "row_id")
    todo = valid
    keys = None
    if resume and done is not None:
        todo = pending_pans(valid, done)
        keys = done.select("pan") if checkpointed is None else None
    if test_mode:
        todo = first_n(todo, 1)
    todo = first_n(todo, limit)
    # only the responses of the PANs this run processes (and of the checkpointed
    # ones) take part; the landed table may hold responses for other sheets
    chosen = todo.select("pan") if keys is None else todo.select("pan").unionByName(keys)
    # hot PANs and GSTINs are found once, on the landed responses (a plain scan),
    # and used by both salted joins below
    if isinstance(responses, Bucketed):
        hot = hot_keys_by_column(responses.cold.unionByName(responses.hot), ["pan", "gstin"], skew)
        cold, beside = rows_of(responses, chosen.distinct())
        results = cold.unionByName(beside)
    else:
        hot = hot_keys_by_column(responses, ["pan", "gstin"], skew)
        results = salted_join(responses, chosen.distinct(), "pan", "left_semi", hot["pan"], skew.salts)
    if resume and done is not None and checkpointed is not None:
        cols = ["pan", *RESULT_ITEM.names]
        kept = salted_join(checkpointed, done.select("pan").distinct(), "pan", "left_semi", hot["pan"], skew.salts)
        results = results.select(cols).unionByName(kept.select(cols))
    return Selection(pan_data, valid, results, hot["gstin"])


def mapped(chosen: Selection, gstin_data: DataFrame, as_of: _dt.datetime, match: str = "normalized",
           skew: SkewConfig = SKEW) -> tuple[DataFrame, DataFrame]:
    """The second half of Q1: (updated pan_data (A1, A4, J4), rows to append to gstin_data (J2, U1))."""
    new_pan = apply_results(chosen.pan_data, rollup_results(chosen.results), as_of, match=match,
                            firsts=chosen.valid if match != "raw" else None)
    fresh = fresh_rows(gstin_data, new_gstin_rows(chosen.results, as_of), skew, chosen.hot_gstins)
    return new_pan, conform(fresh, GSTIN_DATA_SCHEMA)


def run_mapping(pan_data: DataFrame, gstin_data: DataFrame, responses: DataFrame, as_of: _dt.datetime, root: str,
                match: str = "normalized", skew: SkewConfig = SKEW, **options) -> tuple[str, dict]:
    """Q1 as a job: both tables written as a new version of ``root``; (version, counts of the run (A10)).

    The valid PANs and the chosen responses, which both tables need, are written once. The counts are
    observed on the writes themselves, so no table is read again for them; distinct counts are counts
    of frames that hold one row a key.
    """
    spark = pan_data.sparkSession
    seen = {n: Observation() for n in ("valid", "known", "pan", "gstin", "fresh")}

    def written(df: DataFrame, name: str, **counts) -> DataFrame:
        path = scratch_path(spark, f"run-{name}")
        (df.observe(seen[name], *[c.alias(n) for n, c in counts.items()]) if counts else df).write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    n = F.count(F.lit(1))
    chosen = select_responses(pan_data, responses, skew=skew, **options)
    chosen = replace(chosen, valid=written(chosen.valid, "valid", unique_pans=n), results=written(chosen.results, "results"))
    old = conform(gstin_data, GSTIN_DATA_SCHEMA)
    known = written(old.where(F.col("gstin").isNotNull()).select("gstin").distinct(), "known", known_gstins=n)
    new_pan, fresh = mapped(chosen, known, as_of, match, skew)
    fresh = written(fresh, "rows")
    written(fresh.select("gstin").distinct(), "fresh", new_gstins=n)
    pan = normalize_id("pan")
    new_pan = new_pan.observe(seen["pan"], F.count_if(pan.isNotNull() & ~is_valid_pan(pan, normalized=True)).alias("invalid_pan_rows"))
    both = old.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    both = both.observe(seen["gstin"], n.alias("gstin_rows"), F.coalesce(F.sum("_new"), F.lit(0)).alias("added_gstin_rows")).drop("_new")
    version = sio.write_two_tables(new_pan, both, root)
    counts = {k: v for o in seen.values() for k, v in o.get.items()}
    counts["unique_gstins"] = counts.pop("known_gstins") + counts.pop("new_gstins")
    return version, counts


def append_run(spark, responses: DataFrame, rows_dir: str, index_dir: str, run: int, as_of: _dt.datetime,
               skew: SkewConfig = SKEW) -> DataFrame:
    """J2 + U1 of one run of many, against an index of the table's GSTINs bucketed by ``gstin``.

    The rows go to ``rows_dir/run=<run>`` first, their keys to the index then. A run that is repeated
    after a failure finds and overwrites its own rows. Run 0 is the table the index was made from.
    """
    index, new = read_bucketed(spark, index_dir), new_gstin_rows(responses, as_of)
    fresh = unknown_rows(new, index, run, hot_keys(responses, "gstin", skew))
    path = f"{rows_dir.rstrip('/')}/run={run}"
    fresh.write.mode("overwrite").parquet(path)
    fresh = spark.read.schema(fresh.schema).parquet(path)
    add_keys(fresh, index_dir, "gstin", run, index.buckets)
    return fresh


def update_details(target: DataFrame, requested: DataFrame, details: DataFrame, as_of: _dt.datetime,
                   first_only: bool = True, skew: SkewConfig = SKEW) -> DataFrame:
    """Q2: the table after a details run.

    Valid requested ids (F9) are looked up in the landed details (J7) and the
    table is upserted in one join (J6 on the first row, stamped; J5 on every
    row for a flat CSV), instead of one file rewrite per id.
    """
    check_requested(requested)
    found = requested_with_details(requested, details)
    return (upsert_details_first(target, found, as_of) if first_only
            else upsert_details_all(target, found, skew=skew))


def details_run_outcomes(target: DataFrame, requested: DataFrame, details: DataFrame, skew: SkewConfig = SKEW):
    """Q2's job record: (per-id outcomes, progress) (J7, A6, A8). Hot ids are found
    once on the request list and salted in both joins."""
    check_requested(requested)
    hot = hot_keys(requested, "gstin", skew)
    outcomes = batch_outcomes(lookup_details(requested, details, skew=skew, hot=hot), target, hot=hot,
                              salts=skew.salts)
    return outcomes, batch_progress(outcomes)


def enrich_sheet(sheet: DataFrame, details_text: DataFrame, as_of: _dt.datetime,
                 skew: SkewConfig = SKEW) -> DataFrame:
    """Q3: the sheet's GSTINs looked up and merged back."""
    return enrich(sheet, details_text, as_of, skew=skew)


def export_simplified(gstin_data: DataFrame) -> DataFrame:
    """Q4: GSTIN table in sheet names, projected for download."""
    return simplified_export(to_sheet_names(conform(gstin_data, GSTIN_DATA_SCHEMA), GSTIN_EXPORT_NAMES))


def ingest_pages(lookup_pages: DataFrame, detail_pages: DataFrame, items_dir: str | None = None):
    """Q5: landed pages -> (result items, per-PAN status, details).

    With ``items_dir`` the extracted items are written there once (the landed
    ``lookup_results`` of this run) and the rollup reads that table, so the
    pages are parsed a single time for both outputs.
    """
    items = page_results(lookup_pages)
    if items_dir is not None:
        items.write.mode("errorifexists").parquet(items_dir)
        items = lookup_pages.sparkSession.read.schema(items.schema).parquet(items_dir)
    return items, rollup_results(items, order=item_order()), extract_details(detail_pages)


def single_details(target: DataFrame, gstin: DataFrame, details: DataFrame, as_of: _dt.datetime) -> DataFrame:
    """Q6: one id (a one-row frame) looked up and written to its first row in ``target``."""
    return update_details(target, gstin, details, as_of)


def update_latest(spark, log: DataFrame, requested: DataFrame, details: DataFrame, as_of: _dt.datetime) -> str:
    """Q2/Q6 on the result of the latest completed run of the log (A9): its tables are
    read, updated and written as a new version. Returns the folder updated."""
    last = latest_completed(log).first()
    if last is None:
        raise ValidationError("No completed run with a result to update")
    root = last["result_file"]
    base = sio.current_version(spark, root)
    pan_data, gstin_data = sio.read_two_tables(spark, root)
    sio.write_two_tables(pan_data, update_details(gstin_data, requested, details, as_of), root, based_on=base)
    return root


def map_from_pages(spark, pan_data: DataFrame, gstin_data: DataFrame, lookup_pages: DataFrame, landing: str,
                   as_of: _dt.datetime, **options):
    """Q5 -> Q1: pages parsed once into the landed lookup results at ``landing`` (S12), which the mapping reads."""
    sio.write_landed(landed_items(page_results(lookup_pages), as_of), landing, "lookup_results")
    return map_pans(pan_data, gstin_data, sio.read_landed(spark, landing, "lookup_results"), as_of, **options)


def run_report(log: DataFrame) -> DataFrame:
    """Q7: the history report over a run log read with ``sources.io.read_run_log``."""
    from regspark.operators.runlog import run_history

    flat = log.select(
        "job_id", "filename", "status", "created_at", F.col("parameters.headless").alias("headless"),
        F.col("parameters.test_mode").alias("test_mode"), F.col("parameters.limit").alias("max_pans"),
        F.col("parameters.resume").alias("resume"))
    return run_history(flat)


def run_progress(log: DataFrame) -> DataFrame:
    """Q7 with progress: every run with its counts, percentage and whether its result is the latest."""
    from regspark.operators.runlog import progress_report

    return progress_report(log)


def load_tables(spark, root: str, as_of: _dt.datetime, legacy_csv: str | None = None):
    """Q1's front (S1, C4, C5, S8): the current two-table version under ``root``; when
    it lacks a table (old layout), the one-sheet CSV ``legacy_csv`` is converted
    and written as a new version first, then read back."""
    from regspark.operators.schema import LayoutError, convert_legacy, is_legacy_layout
    if not is_legacy_layout(sio.table_names(spark, sio.current_version(spark, root))):
        return sio.read_two_tables(spark, root)
    if legacy_csv is None:
        raise LayoutError(f"no two-table version under {root} and no legacy sheet given")
    pan_data, gstin_data = convert_legacy(sio.read_sheet(spark, legacy_csv), as_of)
    sio.write_two_tables(pan_data, gstin_data, root)
    return sio.read_two_tables(spark, root)

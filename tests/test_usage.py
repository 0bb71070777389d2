"""The README's usage flow, end to end through the public API (S1, S12, S6, Q1, S8),
compared with the registered Q1 query on the same inputs."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

import __spark_entry__ as E
from regspark.fixtures import fixture
from regspark.operators.schema import GSTIN_DATA_SCHEMA, PAN_DATA_SCHEMA, conform
from regspark.plans import pipelines as pl
from regspark.session import AS_OF, scratch_path
from regspark.sources import io


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_readme_flow(spark, sf_dir):
    root = scratch_path(spark, "usage")
    wb, landed, ckpt = (os.path.join(root, n) for n in ("workbook", "landed", "checkpoint"))
    # what a deployment has before the run: the two tables, landed responses, a checkpoint
    io.write_two_tables(conform(fixture(spark, sf_dir, "pan_sheet"), PAN_DATA_SCHEMA),
                        conform(fixture(spark, sf_dir, "gstin_sheet"), GSTIN_DATA_SCHEMA), wb)
    io.write_landed(fixture(spark, sf_dir, "lookup_results"), landed, "lookup_results")
    done_keys = fixture(spark, sf_dir, "done_keys")
    io.write_checkpoint(done_keys, spark.createDataFrame([], io.LANDED_SCHEMAS["lookup_results"]),
                        ckpt, batch=0, as_of=AS_OF)

    # the README's run
    pan_data, gstin_data = io.read_two_tables(spark, wb)
    responses = io.read_landed(spark, landed, "lookup_results")
    done, _ = io.read_checkpoint(spark, ckpt)
    new_pan, new_gstin = pl.map_pans(pan_data, gstin_data, responses, AS_OF, done=done, resume=True)
    io.write_two_tables(new_pan, new_gstin, wb)

    p2, g2 = io.read_two_tables(spark, wb)
    q_pan = E.queries()["map_pans_pan_data"](spark, sf_dir)
    q_gstin = E.queries()["map_pans_gstin_data"](spark, sf_dir)
    assert _same(p2.withColumn("gstin_count", F.col("gstin_count").cast("double")), q_pan)
    assert _same(g2, q_gstin)


def test_load_tables_converts_legacy_once(spark, sf_dir):
    root = scratch_path(spark, "legacy-wb")
    csv = os.path.join(root, "old_sheet")
    legacy = fixture(spark, sf_dir, "legacy_sheet").orderBy("row_id").select(
        F.col("pan_no").alias("PAN NO."), F.col("name").alias("NAME"), "gstin",
        F.col("gstin_status").alias("GSTIN Status"), F.col("state").alias("State"))
    io.write_csv(legacy, csv, single_file=True)
    pan_data, gstin_data = pl.load_tables(spark, os.path.join(root, "workbook"), AS_OF, legacy_csv=csv)
    # same PANs and GSTIN rows as the conversion of the fixture itself
    want_pan = E.queries()["legacy_pan_rows"](spark, sf_dir)
    want_g = E.queries()["legacy_gstin_rows"](spark, sf_dir)
    assert _same(pan_data.select("pan"), want_pan.select("pan"))
    cols = ["pan_reference", "gstin", "gstin_status", "state"]
    assert _same(gstin_data.select(cols), want_g.select(cols))
    # second open: the converted version is read, the legacy sheet is not needed
    again, _ = pl.load_tables(spark, os.path.join(root, "workbook"), AS_OF)
    assert _same(again, pan_data)

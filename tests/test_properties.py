"""
old keys, A4 total, resume after a cut equals the uncut run."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from regspark.fixtures import fixture
from regspark.operators.merge import new_gstin_rows
from regspark.operators.results import rollup_results
from regspark.operators.schema import GSTIN_DATA_SCHEMA, conform
from regspark.plans.pipelines import map_pans

AS_OF = dt.datetime(2025, 1, 1)


def _inputs(spark, sf_dir):
    return (fixture(spark, sf_dir, "pan_sheet"), conform(fixture(spark, sf_dir, "gstin_sheet"), GSTIN_DATA_SCHEMA),
            fixture(spark, sf_dir, "lookup_results"))


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_q1_twice_equals_once(spark, sf_dir):
    sheet, old, res = _inputs(spark, sf_dir)
    pan1, g1 = map_pans(sheet, old, res, AS_OF)
    pan2, g2 = map_pans(pan1, g1, res, AS_OF)
    assert _same(g1, g2)
    assert _same(pan1, pan2)


def test_new_rows_disjoint_from_old_keys(spark, sf_dir):
    _, old, res = _inputs(spark, sf_dir)
    _, g = map_pans(fixture(spark, sf_dir, "pan_sheet"), old, res, AS_OF)
    added = g.exceptAll(old)
    assert added.join(old.select("gstin").distinct(), "gstin").count() == 0
    from regspark.operators.validate import normalize_valid_pans
    run = res.join(normalize_valid_pans(fixture(spark, sf_dir, "pan_sheet")).select("pan"), "pan", "left_semi")
    assert added.count() == new_gstin_rows(run, AS_OF).join(old.select("gstin"), "gstin", "left_anti").count()


def test_status_is_total(spark, sf_dir):
    _, _, res = _inputs(spark, sf_dir)
    roll = rollup_results(res)
    assert roll.count() == res.select("pan").distinct().count()
    assert roll.where(F.col("status").isNull() | F.col("gstin_count").isNull()).count() == 0


def test_resume_after_cut_equals_uncut(spark, sf_dir):
    sheet, old, res = _inputs(spark, sf_dir)
    full_pan, full_g = map_pans(sheet, old, res, AS_OF)
    # a run that stopped after the PANs of even hash: they are checkpointed as done
    from regspark.operators.validate import normalize_valid_pans
    done = normalize_valid_pans(sheet).select("pan").where(F.pmod(F.hash("pan"), F.lit(2)) == 0)
    cut_pan, cut_g = map_pans(sheet, old, res, AS_OF, done=done, resume=True)
    assert _same(full_pan, cut_pan)
    assert _same(full_g, cut_g)

"""Plan assertions: no nested-loop or cartesian joins anywhere, anti joins for J1/J2,
pruned and pushed-down scans, hash aggregation for the rollup."""

from __future__ import annotations

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
# queries that write files while being built are checked by test_oracles instead
WRITERS = {"enrich_sheet", "processed_count", "stream_apply_results", "two_table_roundtrip",
           "export_from_two_tables", "csv_roundtrip", "run_log_roundtrip", "run_report",
           "checkpoint_roundtrip", "discover_inputs", "ingest_pages_status", "ingest_pages",
           "stream_map_pans_pan_data", "single_details_latest", "map_pans_resumed_pan_data",
           "map_pans_resumed_gstin_data", "map_from_pages_pan_data", "map_from_pages_gstin_data", "two_table_roundtrip_pan",
           "discover_inputs_kinds", "stream_map_pans_gstin_data", "stream_resumed_pan_data",
           "append_indexed_runs", "run_summary_observed"}
NAMES = [n for n in E.queries() if n not in WRITERS]


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001


@pytest.mark.parametrize("name", NAMES)
def test_no_nested_loop_or_cartesian(spark, name):
    plan = physical(E.queries()[name](spark, SF))
    assert "BroadcastNestedLoopJoin" not in plan
    assert "CartesianProduct" not in plan


def test_resume_and_append_are_anti_joins(spark):
    for name in ("pending_pans", "append_new_gstins"):
        plan = physical(E.queries()[name](spark, SF))
        assert "LeftAnti" in plan, name


def test_rollup_counts_use_hash_aggregation(spark):
    plan = physical(E.queries()["status_by_pan"](spark, SF))
    assert "HashAggregate" in plan
    # the only sort-based aggregate is that of the first error, over the counts per error text
    assert plan.count("SortAggregate") <= 2


def test_rollup_reads_its_items_once(spark):
    from regspark.operators.results import rollup_results
    from regspark.plans.catalog import fx

    plan = physical(rollup_results(fx(spark, SF, "lookup_results")))
    assert plan.count("FileScan") == 1 and "Join" not in plan
    scan, counts = plan.index("FileScan"), plan.rindex("HashAggregate")
    assert plan.rindex("SortAggregate") < counts < scan  # (plans read upwards) items are counted by hash first


def test_scans_are_pruned(spark):
    plan = physical(E.queries()["status_by_pan"](spark, SF))
    for line in plan.splitlines():
        if "customer.parquet" in line or "orders.parquet" in line:
            assert "c_acctbal" not in line and "c_mktsegment" not in line
            assert "o_totalprice" not in line and "o_orderpriority" not in line
    assert "PushedFilters" in plan

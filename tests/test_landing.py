"""Landed fixtures: many files, written where the rows were made."""

from __future__ import annotations

from pyspark.sql import functions as F

from regspark import fixtures


def test_landing_writes_files_of_bounded_size_without_dealing_rows_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fixtures, "LANDED_ROWS", 1000)
    built = spark.range(0, 8000, numPartitions=2).withColumn("t", F.concat(F.lit("x"), "id"))
    back = fixtures.landed(spark, str(tmp_path), "t-landing", lambda: built)
    assert back.columns == ["id", "t"] and sorted(r.id for r in back.collect()) == list(range(8000))
    files = back.groupBy(F.input_file_name().alias("f")).agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("id").alias("n")).collect()
    assert len(files) == 8 and all(r.n == 1000 and r.b - r.a == 999 for r in files)  # rows side by side stay so
    again = fixtures.landed(spark, str(tmp_path), "t-landing", lambda: None)
    assert sorted(again.inputFiles()) == sorted(back.inputFiles())

"""The corpus pipeline, stage by stage, and SQL parity of the registered queries."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from regspark.llm import queries

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.store(stage(spark, docs, DIR), f"test-{name}")
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts[1] < counts[0] and counts[2] <= counts[1] and counts[3] == counts[2]
    assert docs.filter("text rlike '[a-z0-9.]+@mail[0-9]'").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    want = packed.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).count()
    assert want == docs.select("doc_id").distinct().count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash_neardup", "pii", "mixing", "packing"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    want = con.execute(queries.ORACLES[name]).fetchdf()
    got = queries.QUERIES[name](spark, DIR).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    rows = [sorted(str([None if pd.isna(v) else float(v) if isinstance(v, (int, float, np.number)) else v for v in r])
                   for r in f[sorted(want.columns)].astype(object).values.tolist()) for f in (got, want)]
    assert rows[0] == rows[1]

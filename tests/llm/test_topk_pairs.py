"""Top-k search over vectors of unequal length: groups that cannot share a result never meet."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from regspark.llm import topk


def vectors(spark, n, spread):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 12))
    x = centres[rng.integers(0, 8, n)] + rng.normal(size=(n, 12)) * 0.2
    x *= (np.exp(rng.normal(size=n) * spread) / np.linalg.norm(x, axis=1))[:, None]
    x[::97] = 0.0
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>"), np.floor(x * 64).astype(np.int64)


def brute(x, k):
    out = []
    for q in range(0, len(x), 20):
        s = x @ x[q]
        best = sorted((-int(s[i]), i) for i in range(len(x)) if i != q)[:k]
        out += [(q, r + 1, i, -m) for r, (m, i) in enumerate(best)]
    return out


def test_pruned_pairs_lose_nothing(spark, monkeypatch):
    df, x = vectors(spark, 3000, 1.5)
    cfg = topk.TopKConfig(bucket=64, buckets_a_group=2, query_block=8, blocks_a_group=2)
    seen = {}
    plain = topk.group_pairs

    def watched(buckets, blocks):
        found = plain(buckets, blocks)
        seen.update(found=found.count(), distinct=found.distinct().count(),
                    all=buckets.select("g").distinct().count() * blocks.select("h").distinct().count())
        return found

    monkeypatch.setattr(topk, "group_pairs", watched)
    assert sorted(map(tuple, topk.top_k(df, F.col("id") % 20 == 0, cfg).collect())) == brute(x, 20)
    assert seen["found"] == seen["distinct"] < 0.6 * seen["all"], seen


def test_pairs_of_lengths_and_needs(spark):
    """Against plain comparison, with needs of 0, lengths of 0 and needs equal to a length."""
    tops = [0.0, 1.0, 1.5, 64.0, 100.25, 1e9]
    needs = [0.0, 0.5, 1.0, 1.5, 64.0, 64.1, 1e9, 2e9]
    buckets = spark.createDataFrame([*enumerate(tops), (2, 0.25)], "g int, top double")
    blocks = spark.createDataFrame([*enumerate(needs), (5, 1e12)], "h int, need double")
    got = sorted(map(tuple, topk.group_pairs(buckets, blocks).collect()))
    assert got == sorted((g, h) for g, t in enumerate(tops) for h, n in enumerate(needs) if t >= n)
    assert topk.group_pairs(buckets.filter("g < 0"), blocks).count() == 0

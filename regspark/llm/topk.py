"""Exact top-k inner-product search over norm-ordered buckets.

Vectors are quantised, range-partitioned by length (then id) and packed into buckets of at
most ``bucket`` vectors of similar length. Each query has a threshold: the k-th score within
the bucket of the greatest lengths, which is a valid lower bound. A vector shorter than
``threshold / |q|`` (the query's need) cannot enter its result, so queries are ordered by need
and travel in blocks, and a group of blocks meets only the groups of buckets whose greatest
length reaches its least need; the groups are matched by length levels before any vector moves.
For a bucket of greatest length L and a query q, only vectors of cosine at least
``t = threshold / (|q| L)`` can enter the result, so per query and bucket

* the bucket is skipped if t > 1;
* coordinate pruning if t >= ``coordinate_from``: candidates must lie within the feasible
  range of the query's two largest coordinates;
* else length pruning: only the bucket's leading vectors with |x| >= threshold / |q|;

and the remaining products are computed and verified as integers. Thresholds rise while a task
goes through its buckets. A task holds one group of buckets and one group of query blocks.

Defined cases: vectors that are null or hold null or non-finite components, and rows with a
null id, take no part; repeated rows count once, and of different vectors with one id the
smallest (by components) counts; missing trailing components count as zero, an empty
vector scores 0; ties go to the smaller id; an empty table gives an empty result;
further columns are not read. Scores must fit in a 64-bit integer.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regspark.llm.common import store


@dataclass(frozen=True)
class TopKConfig:
    k: int = 20
    scale: int = 64
    bucket: int = 2048
    buckets_a_group: int = 8
    query_block: int = 512
    blocks_a_group: int = 8
    coordinate_from: float = 0.6


def quantised(vectors: DataFrame, cfg: TopKConfig, key: str, vector: str) -> DataFrame:
    """(id, v array<long>, norm): one row per id."""
    v = F.col("v")
    rows = (vectors.select(vectors[key].cast("long").alias("id"), F.transform(vectors[vector], lambda x: x.cast("double")).alias("v"))
            .filter(F.col("id").isNotNull() & v.isNotNull()
                    & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))))
    whole = rows.select("id", F.transform(v, lambda x: F.floor(x * cfg.scale).cast("long")).alias("v"))
    one = whole.groupBy("id").agg(F.min("v").alias("v"))
    return one.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))


def _matrix(vectors, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Integer products of rows; by float BLAS where every partial sum is exact."""
    if x.size and y.size and float(np.abs(x).max()) * float(np.abs(y).max()) * x.shape[1] < 2 ** 52:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return x @ y.T


def _packed(rows: DataFrame, size: int, group: str) -> DataFrame:
    """Buckets of up to ``size`` consecutive rows of (id, v, norm, floor, need): columns as bytes, the greatest
    length, the least need and, as ``group``, the partition."""
    def pack(frames):
        for p in frames:
            for i in range(0, len(p), size):
                part = p.iloc[i:i + size]
                dims = max((len(v) for v in part.v), default=0)
                yield pd.DataFrame({"ids": [part.id.to_numpy(np.int64).tobytes()], "dims": [dims],
                                    "vs": [_matrix(part.v, dims).tobytes()], "n": [len(part)],
                                    "norms": [part.norm.to_numpy(np.float64).tobytes()], "top": [float(part.norm.max())],
                                    "floors": [part.floor.to_numpy(np.float64).tobytes()], "need": [float(part.need.min())]})

    packed = rows.mapInPandas(pack, "ids binary, dims int, vs binary, n int, norms binary, top double, floors binary, need double")
    return packed.withColumn(group, F.spark_partition_id())


def _level(length: Column) -> Column:
    """Lengths in steps of an eighth of an octave; -1 below 1 (whole components: only the zero vector)."""
    return F.when(length >= 1, F.floor(F.log2(length) * 8)).otherwise(-1).cast("int")


def group_pairs(buckets: DataFrame, blocks: DataFrame) -> DataFrame:
    """(g, h): the groups of buckets whose greatest length reaches the least need of a group of blocks.

    An equi-join on length levels (at most 8 for each binary digit of a length), so only pairs that
    can hold a result, and those of the need's own level, are formed.
    """
    tops = buckets.groupBy("g").agg(F.max("top").alias("top")).withColumn("level", _level(F.col("top")))
    last = tops.agg(F.coalesce(F.max("level"), F.lit(-1))).first()[0]
    needs = blocks.groupBy("h").agg(F.min("need").alias("need")).filter(_level(F.col("need")) <= last)
    needs = needs.withColumn("level", F.explode(F.sequence(_level(F.col("need")), F.lit(last))))
    return tops.join(needs, "level").filter("top >= need").select("g", "h")


def _unpack(r):
    return (np.frombuffer(r.ids, np.int64), np.frombuffer(r.vs, np.int64).reshape(r.n, r.dims),
            np.frombuffer(r.norms, np.float64))


def _pad(m: np.ndarray, dims: int) -> np.ndarray:
    return m if m.shape[1] == dims else np.pad(m, ((0, 0), (0, dims - m.shape[1])))


class Best:
    """The k best (score, smaller id) of each query so far."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.score, self.id = k, [np.empty(0, np.int64)] * n, [np.empty(0, np.int64)] * n
        self.floor = floor.copy()

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.score[q], score]), np.concatenate([self.id[q], ids])
        keep = np.lexsort((i, -s))[:self.k]
        self.score[q], self.id[q] = s[keep], i[keep]
        if len(keep) == self.k:
            self.floor[q] = max(self.floor[q], float(s[keep[-1]]))


def search(best: Best, qid: np.ndarray, q: np.ndarray, qnorm: np.ndarray, bucket, cfg: TopKConfig) -> None:
    """Bring one bucket into the results of a block of queries."""
    ids, x, norms = bucket
    dims = max(q.shape[1], x.shape[1])
    q, x = _pad(q, dims), _pad(x, dims)
    order = np.argsort(-norms, kind="stable")
    ids, x, norms = ids[order], x[order], norms[order]
    slack = 1 - 1e-9
    reach = qnorm * norms[0]
    t = np.where(reach > 0, best.floor * slack / np.maximum(reach, 1e-300), np.where(best.floor > 0, 2.0, -1.0))
    by_coordinate = (t >= cfg.coordinate_from) & (t <= 1)
    if by_coordinate.any():
        unit = x / np.maximum(norms, 1e-300)[:, None]
        for i in np.flatnonzero(by_coordinate):
            angle, ok = np.arccos(min(1.0, t[i])), np.ones(len(ids), bool)
            for c in np.argsort(-np.abs(q[i]))[:2]:
                to_axis = np.arccos(np.clip(q[i, c] / qnorm[i], -1, 1))
                ok &= unit[:, c] <= np.cos(max(0.0, to_axis - angle)) + 1e-9
                ok &= unit[:, c] >= np.cos(min(np.pi, to_axis + angle)) - 1e-9
            at = np.flatnonzero(ok & (ids != qid[i]))
            s = _products(q[i:i + 1], x[at])[0]
            good = s >= best.floor[i]
            best.add(i, s[good], ids[at[good]])
    rest = np.flatnonzero((t <= 1) & ~by_coordinate)
    if len(rest):
        lead = np.where(best.floor[rest] > 0, best.floor[rest] * slack / np.maximum(qnorm[rest], 1e-300), -1.0)
        upto = np.searchsorted(-norms, -lead, "right")
        s = _products(q[rest], x[:int(upto.max())])
        for row, i in enumerate(rest):
            at = np.flatnonzero((s[row] >= best.floor[i]) & (ids[:s.shape[1]] != qid[i]))
            if len(at) > cfg.k:
                cut = np.partition(s[row, at], len(at) - cfg.k)[len(at) - cfg.k]
                at = at[s[row, at] >= cut]
            best.add(i, s[row, at], ids[at])


def top_k(vectors: DataFrame, is_query, cfg: TopKConfig = TopKConfig(), key: str = "vec_id",
          vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose ``id`` meets ``is_query`` (a column expression)."""
    spark = vectors.sparkSession
    rows = store(quantised(vectors, cfg, key, vector), "vectors")
    queries = rows.filter(is_query)

    def ordered(frame, block, blocks_a_group, *by):
        groups = max(1, -(-frame.count() // (block * blocks_a_group)))
        return frame.repartitionByRange(groups, *by).sortWithinPartitions(*by)

    plain = rows.withColumns({"floor": F.lit(0.0), "need": F.lit(0.0)})
    buckets = store(_packed(ordered(plain, cfg.bucket, cfg.buckets_a_group, F.desc("norm"), F.col("id")), cfg.bucket, "g"),
                    "vector-buckets")
    lead = spark.sparkContext.broadcast(buckets.orderBy(F.desc("top"), "g", "ids").limit(1).collect())  # one bucket at most

    def seed(frames):
        for p in frames:
            for i in range(0, len(p), cfg.query_block):
                part = p.iloc[i:i + cfg.query_block]
                qid, qn = part.id.to_numpy(np.int64), part.norm.to_numpy(np.float64)
                q = _matrix(part.v, max((len(v) for v in part.v), default=0))
                best = Best(len(qid), cfg.k, np.full(len(qid), -np.inf))
                for bucket in lead.value:
                    search(best, qid, q, qn, _unpack(bucket), cfg)
                need = np.where((best.floor > 0) & (qn > 0), best.floor * (1 - 2e-9) / np.maximum(qn, 1e-300), 0.0)
                yield part.assign(floor=best.floor, need=need)

    spread = queries.repartition(max(1, -(-queries.count() // cfg.query_block)), "id")
    seeded = store(spread.mapInPandas(seed, "id long, v array<long>, norm double, floor double, need double"), "queries")
    blocks = store(_packed(ordered(seeded, cfg.query_block, cfg.blocks_a_group, F.col("need"), F.col("id")), cfg.query_block, "h"),
                   "query-blocks")
    pairs = store(group_pairs(buckets, blocks), "group-pairs")
    left, right = buckets.join(pairs, "g"), blocks.join(pairs, "h")

    def compare(b: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(r) for r in b.sort_values("top", ascending=False).itertuples()]
        out = []
        for r in qs.itertuples():
            qid, q, qn = _unpack(r)
            best = Best(len(qid), cfg.k, np.frombuffer(r.floors, np.float64))
            for part in parts:
                search(best, qid, q, qn, part, cfg)
            sizes = [len(x) for x in best.id]
            out.append(pd.DataFrame({"query_id": np.repeat(qid, sizes), "vec_id": np.concatenate(best.id),
                                     "score": np.concatenate(best.score)}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)

    found = (left.groupBy("g", "h").cogroup(right.groupBy("g", "h"))
             .applyInPandas(compare, "query_id long, vec_id long, score long"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cfg.k)
            .select("query_id", "rank", "vec_id", "score"))

"""MinHash near-dedup with min-max signatures, exact confirmation and connected components.

A document's set holds its distinct five-word shingles (64-bit hashes, A-Z folded).
Under each permutation both the smallest and the largest value are kept: two signature
entries for one hash evaluation, each agreeing with probability equal to the Jaccard
similarity. ``bands`` bands of ``rows`` entries give candidates; at similarity 0.75 the
default 40 bands of 4 miss a pair with probability 3e-7.

Documents with one and the same set form a class (its key: 128 bits of the set's
hash), so exact copies are never compared. Classes are linked in two steps, which
find every component that all candidate pairs would give:

1. every class is compared with the best connected class of its buckets;
2. in buckets whose classes are then still in different components, the classes outside the
   largest component are compared with all classes of the bucket, in cells of at most
   ``block`` classes a side, so no task gets a whole bucket; equal buckets of several
   bands are compared once, and a cell returns links between components, not pairs.

Candidates are confirmed on full sets. Defined cases: null or wordless text has an empty
set, no links and itself as component; fewer than five words make one shingle;
rows that share a doc_id each get their own set; a null doc_id gets the smallest
non-null id of its component, else null; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql import types as T

from regspark.llm.common import FOLDED_VALUES, Words, as_batch, chunks, discard, mix, store, window_hashes
from regspark.llm.graph import components


@dataclass(frozen=True)
class NearDupConfig:
    width: int = 5
    percent: int = 75
    bands: int = 40
    rows: int = 4
    block: int = 512

    @property
    def permutations(self) -> int:
        return self.bands * self.rows // 2


def shingle_sets(texts: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, concatenated (ascending within a text), and their bounds."""
    w = Words(texts, FOLDED_VALUES)
    at = w.whole_windows(width)
    keys, of = window_hashes(w.h, width)[at], w.text_of[at]
    short = np.flatnonzero((w.n > 0) & (w.n < width))
    if len(short):
        lone = np.array([mix(window_hashes(w.h[w.bounds[i]:w.bounds[i + 1]], int(w.n[i])))[0] for i in short])
        keys, of = np.concatenate([keys, lone]), np.concatenate([of, short])
    order = np.lexsort((keys, of))
    keys, of = keys[order], of[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
    keys, of = keys[new], of[new]
    return keys, np.searchsorted(of, np.arange(len(texts) + 1))


def class_keys(keys: np.ndarray, bounds: np.ndarray) -> list:
    """16 bytes for each set: two sums of mixed members (independent of order)."""
    sums = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(keys ^ np.uint64(salt)))])
        sums.append(mix(c[bounds[1:]] - c[bounds[:-1]] + np.diff(bounds).astype(np.uint64)))
    return [x.tobytes() for x in np.stack(sums, 1).astype(">u8")]


def signatures(keys: np.ndarray, bounds: np.ndarray, permutations: int) -> np.ndarray:
    """(texts with a set, 2 * permutations) uint32: minima and maxima side by side."""
    rng = np.random.default_rng(9)
    a = rng.integers(1, 1 << 32, permutations, dtype=np.uint32) | np.uint32(1)
    b = rng.integers(0, 1 << 32, permutations, dtype=np.uint32)
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(starts), 2 * permutations), np.uint32)
    x = (keys >> np.uint64(32)).astype(np.uint32)
    for k in range(permutations):
        y = x * a[k] + b[k]
        y ^= y >> np.uint32(16)
        y *= np.uint32(0x7FEB352D)
        out[:, 2 * k] = np.minimum.reduceat(y, starts)
        out[:, 2 * k + 1] = np.maximum.reduceat(y, starts)
    return out


def band_keys(sig: np.ndarray, cfg: NearDupConfig) -> np.ndarray:
    h = mix(sig.astype(np.uint64) + np.uint64(0x9E37))
    h = h.reshape(len(sig), cfg.bands, cfg.rows)
    out = np.zeros(h.shape[:2], np.uint64)
    for r in range(cfg.rows):
        out = mix(out * np.uint64(31) + h[:, :, r])
    return mix(out ^ np.arange(cfg.bands, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _sketches(docs: DataFrame, cfg: NearDupConfig, key: str, text: str) -> DataFrame:
    """(id, th, n, cls, bands) of every row; the last two are null for an empty set."""
    inner = docs.select(docs[key].alias("id"), F.xxhash64(docs[text]).alias("th"), docs[text].alias("text"))
    out_type = T.StructType([T.StructField("id", docs.schema[key].dataType), T.StructField("th", T.LongType()),
                             T.StructField("n", T.LongType()), T.StructField("cls", T.BinaryType()),
                             T.StructField("bands", T.ArrayType(T.LongType()))])

    def sketch(batches):
        schema = to_arrow_schema(out_type)
        for rows, texts in chunks(batches):
            keys, bounds = shingle_sets(texts, cfg.width)
            n = np.diff(bounds)
            cls, bands = class_keys(keys, bounds), [None] * len(n)
            if len(keys):
                found = band_keys(signatures(keys, bounds, cfg.permutations), cfg)
                for i, b in zip(np.flatnonzero(n), found, strict=True):
                    bands[i] = b
            cls = [c if m else None for c, m in zip(cls, n, strict=True)]
            yield as_batch(schema, rows.column(0), rows.column(1), n, cls, bands)

    return inner.mapInArrow(sketch, out_type)


def _sets(docs: DataFrame, wanted: DataFrame, cfg: NearDupConfig, key: str, text: str) -> DataFrame:
    """(cls, shingles): full sets of the wanted (cls, id, th) rows, as bytes of ascending 64-bit values."""
    texts = docs.select(docs[key].alias("id"), F.xxhash64(docs[text]).alias("th"), docs[text].alias("text"))
    rows = (texts.join(wanted, [texts["th"] == wanted["th"], texts["id"].eqNullSafe(wanted["id"])])
            .select("cls", "text"))

    def full(batches):
        schema = pa.schema([("cls", pa.binary()), ("shingles", pa.binary())])
        for r, values in chunks(batches):
            keys, bounds = shingle_sets(values, cfg.width)
            yield as_batch(schema, r.column(0), [keys[i:j].tobytes() for i, j in
                                                 zip(bounds[:-1], bounds[1:], strict=True)])

    return rows.mapInArrow(full, "cls binary, shingles binary").dropDuplicates(["cls"])


def _confirm(pairs: DataFrame, sets: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """The (a, b) pairs whose full sets are similar enough."""
    both = (pairs.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa")), "a")
            .join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb")), "b").select("a", "b", "sa", "sb"))

    def compare(batches):
        schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                m = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((m[1:] == m[:-1]).sum())
                keep.append(100 * common >= cfg.percent * (len(x) + len(y) - common))
            yield as_batch(schema, *[batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)])

    return both.mapInArrow(compare, "a binary, b binary")


def _pivots(members: DataFrame) -> DataFrame:
    """(a, b): each class of (band, cls, m) and the best connected class of its buckets.

    A class's connections are the sizes of its buckets, so the text that others were copied from
    leads its buckets, and one comparison links most copies.
    """
    weight = members.groupBy("cls").agg(F.sum("m").alias("weight"))
    ranked = members.join(weight, "cls").withColumn("rank", F.struct("weight", "cls"))
    lead = ranked.groupBy("band").agg(F.max("rank").alias("lead"))
    best = members.join(lead, "band").groupBy("cls").agg(F.max("lead").alias("lead"))
    return best.select(F.col("cls").alias("a"), F.col("lead.cls").alias("b")).filter("a <> b")


def _links_across(placed: DataFrame, sets: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """(a, b): links that join the components met in one bucket of (band, cls, root).

    In each bucket the classes outside its largest component are compared with all its
    classes, in cells of at most ``block`` classes a side. Cells hold full sets and count all
    intersections at once; a cell returns at most one link per component it holds.
    """
    shares = placed.groupBy("band", "root").agg(F.count("*").alias("n"), F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("h"))
    mixed = (shares.groupBy("band").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("m"),
                                        F.count("*").alias("roots"), F.sum("h").alias("same")).filter("roots > 1")
             .groupBy("same", "m").agg(F.min(F.struct("band", "most")).alias("x"))
             .select("x.band", "x.most", "m"))
    rows = placed.join(mixed, "band").withColumn("outside", F.col("root") != F.col("most.root"))
    i_parts = F.ceil((F.col("m") - F.col("most.n")) / cfg.block).cast("int")
    j_parts = F.ceil(F.col("m") / cfg.block).cast("int")
    rows = rows.select("band", "cls", "root", "outside", i_parts.alias("ni"), j_parts.alias("nj"), F.xxhash64("cls").alias("z"))
    left = (rows.filter("outside").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nj") - 1)))
            .select("band", F.pmod("z", "ni").cast("int").alias("i"), "j", F.lit(True).alias("left"), "cls", "root"))
    right = (rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ni") - 1)))
             .select("band", "i", F.pmod("z", "nj").cast("int").alias("j"), F.lit(False).alias("left"), "cls", "root"))
    cells = left.unionByName(right).join(sets, "cls")

    def compare(p: pd.DataFrame) -> pd.DataFrame:
        x, y = p[p.left], p[~p.left]
        out: list = []
        if len(x) and len(y):
            a, b = ([np.frombuffer(v, np.uint64) for v in q.shingles] for q in (x, y))
            codes = pd.factorize(pd.concat([x.root, y.root]))[0]
            rx, ry = codes[:len(x)], codes[len(x):]
            nx, ny = np.array([len(v) for v in a]), np.array([len(v) for v in b])
            fit = rx[:, None] != ry[None, :]
            fit &= 100 * np.minimum(nx[:, None], ny[None, :]) >= cfg.percent * np.maximum(nx[:, None], ny[None, :])
            common = intersections(a, b, fit)
            linked = fit & (100 * common >= cfg.percent * (nx[:, None] + ny[None, :] - common))
            parent = list(range(codes.max() + 1))
            cx, cy = x.cls.to_numpy(), y.cls.to_numpy()
            for k, i in zip(*np.nonzero(linked), strict=True):
                r, t = _root(parent, rx[k]), _root(parent, ry[i])
                if r != t:
                    parent[r] = t
                    out.append((max(cx[k], cy[i]), min(cx[k], cy[i])))
        return pd.DataFrame(out, columns=["a", "b"])

    return cells.groupBy("band", "i", "j").applyInPandas(compare, "a binary, b binary").distinct()


def _root(parent: list, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def intersections(a: list, b: list, fit: np.ndarray, columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all fitting pairs of ascending distinct sets."""
    out = np.zeros((len(a), len(b)), np.int64)
    pairs = np.argwhere(fit)
    if len(pairs) <= 4 * (len(a) + len(b)):
        for i, j in pairs:
            m = np.sort(np.concatenate([a[i], b[j]]), kind="stable")
            out[i, j] = int((m[1:] == m[:-1]).sum())
        return out
    rows, cols = np.flatnonzero(fit.any(1)), np.flatnonzero(fit.any(0))
    keys = np.concatenate([a[i] for i in rows] + [b[j] for j in cols])
    sizes = [len(a[i]) for i in rows] + [len(b[j]) for j in cols]
    of = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(keys, kind="stable")
    keys, of = keys[order], of[order]
    word = np.concatenate([[0], np.cumsum(keys[1:] != keys[:-1])])
    total = np.zeros((len(rows), len(cols)), np.float64)
    for first in range(0, int(word[-1]) + 1, columns):  # shingles as 0/1 columns, so many at a time
        lo, hi = np.searchsorted(word, [first, first + columns])
        m = np.zeros((len(sizes), min(columns, int(word[-1]) + 1 - first)), np.float32)
        m[of[lo:hi], word[lo:hi] - first] = 1
        both = m[:, m[:len(rows)].any(0) & m[len(rows):].any(0)]
        if both.shape[1]:
            total += both[:len(rows)] @ both[len(rows):].T
    out[np.ix_(rows, cols)] = total.astype(np.int64)
    return out


def near_duplicates(docs: DataFrame, cfg: NearDupConfig = NearDupConfig(), key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """One row per document: (id, th, n, component); th is the text's hash, component the smallest id."""
    sketches = store(_sketches(docs, cfg, key, text), "sketches")
    classes = store(sketches.filter("cls is not null").groupBy("cls")
                    .agg(F.min("id").alias("id"), F.min(F.struct("id", "th")).alias("rep"),
                         F.min("bands").alias("bands")), "classes")
    rows = classes.select("cls", F.explode("bands").alias("band"))
    sizes = rows.groupBy("band").agg(F.count("*").alias("m")).filter("m > 1")
    members = store(rows.join(sizes, "band"), "buckets")
    wanted = members.select("cls").distinct().join(classes.select("cls", "rep.id", "rep.th"), "cls")
    sets = store(_sets(docs, wanted, cfg, key, text), "sets")

    links = store(_confirm(_pivots(members), sets, cfg), "links-first")
    roots = components(links)
    placed = store(members.join(roots, members["cls"] == roots["vertex"], "left")
                   .select("band", "cls", F.coalesce("root", "cls").alias("root")), "placed")
    second = store(_links_across(placed, sets, cfg), "links-second")
    final = components(links.unionByName(second))

    named = classes.select("cls", "id").join(final, classes["cls"] == final["vertex"], "left")
    named = named.select("cls", F.coalesce("root", "cls").alias("root"), "id")
    of_root = named.groupBy("root").agg(F.min("id").alias("component"))
    of_class = store(named.join(of_root, "root").select("cls", "component"), "components")
    for step in (members, sets, placed, links, second, classes):
        discard(step)
    return (sketches.select("id", "th", "n", "cls").join(of_class, "cls", "left")
            .select("id", "th", "n", F.when(F.col("cls").isNull(), F.col("id"))
                    .otherwise(F.col("component")).alias("component")))


def drop_near_duplicates(docs: DataFrame, cfg: NearDupConfig = NearDupConfig(), key: str = "doc_id",
                         text: str = "text") -> DataFrame:
    """One document of each component stays (that of the smallest id), all columns as they were.

    Rows repeated under that id are all of one document: one of them stays.
    """
    found = near_duplicates(docs, cfg, key, text)
    keep = found.filter(F.col("id").eqNullSafe(F.col("component"))).select("id", "th").distinct()
    def named(c):
        return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))

    texts = docs.withColumn("_nd_th", F.xxhash64(docs[text])).withColumn("_nd_id", named(docs[key]))
    out = texts.join(keep.select(named(F.col("id")).alias("_nd_id"), F.col("th").alias("_nd_th")),
                     ["_nd_id", "_nd_th"], "left_semi")
    return out.dropDuplicates(["_nd_id", "_nd_th"]).select(*docs.columns)

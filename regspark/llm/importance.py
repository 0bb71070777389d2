"""Importance resampling of documents towards the n-gram distribution of a target table.

1. Features are all runs of 1 to ``runs`` consecutive words, hashed by crc32 into ``buckets`` buckets. A
   run's checksum is put together from its words' checksum registers: registers are linear in the bytes, so
   a register is advanced over a later word by table lookups and combined with that word's own, in numpy
   over all words of a chunk. Every task adds its counts up before the one small shuffle.
2. A bucket's gain compares its count in the target with that in all documents. A document's weight is the sum
   of the gains of its features; its score adds a Gumbel number made from a hash of its id, so
   the highest scores are a draw without replacement in proportion to exp(weight / 1000).
3. The k-th score is found by a distributed quickselect on the composite key (score falling, id, row): random
   pivot keys, exact counts of the rows before, at and after each, and on within the part that holds the
   k-th key. Only rows up to that key are sorted, over ranges, and numbered.

The driver holds the bucket counts, the pivots and one count per range of winners.

Defined cases: a null text has no words; a null id hashes as the empty string and comes last among equal scores;
rows repeat as given, each with its own place (rows of equal score and id are taken in the order they were
stored); empty tables of documents or targets give an empty result or gains from the other table alone; texts of any
length count whole, in blocks of ``BLOCK`` words; only the named columns are read, so further ones do not matter.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from regspark.llm.common import as_batch, chunks, store

BLOCK = 1 << 18  # words whose runs are in memory at a time
SHORT = 48  # bytes of a word whose checksum is taken in numpy


@dataclass(frozen=True)
class DrawConfig:
    buckets: int = 10_000
    runs: int = 3
    least_words: int = 20
    percent: int = 5  # of the documents with enough words
    seed: int = 42
    pivots: int = 31
    rows_a_range: int = 100_000  # winners sorted in one task


# -- checksums of runs of words ---------------------------------------------------------------

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


_BYTE = _byte_table()


def _tables_of(images: np.ndarray) -> np.ndarray:
    """Lookup tables by byte, (..., 4, 256), of the linear maps with the given images of the 32 bits."""
    out = np.zeros((*images.shape[:-1], 4, 256), np.uint32)
    for bit in range(32):
        out[..., bit // 8, (np.arange(256) >> bit % 8 & 1) == 1] ^= images[..., bit][..., None]
    return out


def _look_up(tables: np.ndarray, base, r: np.ndarray) -> np.ndarray:
    out = tables.take(base + (r & np.uint32(255)))
    for k in (1, 2, 3):
        out = out ^ tables.take(base + 256 * k + (r >> np.uint32(8 * k) & np.uint32(255)))
    return out


def _advance_tables() -> list[np.ndarray]:
    """For each of the four bytes of a length, the maps that advance a register over 0 to 255 times 256^k zero bytes."""
    one, out = _tables_of(np.where(np.arange(32) < 8, _BYTE[(1 << np.arange(32)) & 255], 0).astype(np.uint32)
                          ^ (np.uint32(1) << np.arange(32, dtype=np.uint32)) >> np.uint32(8)), []
    for _ in range(4):
        images = np.empty((257, 32), np.uint32)
        images[0] = np.uint32(1) << np.arange(32, dtype=np.uint32)
        for m in range(256):
            images[m + 1] = _look_up(one.reshape(-1), 0, images[m])
        out.append(_tables_of(images[:256]).reshape(-1))
        one = _tables_of(images[256])
    return out


_ADVANCE = _advance_tables()


def advance(r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Registers after n further zero bytes."""
    n = n.astype(np.int64)
    out = _look_up(_ADVANCE[0], (n & 255) * 1024, r)
    for k in (1, 2, 3):
        part = n >> 8 * k & 255
        if part.any():
            out = np.where(part > 0, _look_up(_ADVANCE[k], part * 1024, out), out)
    return out


def registers(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Checksum register (started at zero) of each word."""
    order = np.argsort(-sizes, kind="stable")
    s, n = starts[order], sizes[order]
    reg, long = np.zeros(len(s), np.uint32), int(np.searchsorted(-n, -SHORT, "left"))
    for i in range(long):
        reg[i] = zlib.crc32(buf[s[i]:s[i] + n[i]].tobytes(), 0xFFFFFFFF) ^ 0xFFFFFFFF
    for j in range(SHORT):
        k = int(np.searchsorted(-n, -j, "left"))  # words with more than j bytes
        if k <= long:
            break
        r = reg[long:k]
        reg[long:k] = _BYTE[(r ^ buf[s[long:k] + j]) & np.uint32(255)] ^ (r >> np.uint32(8))
    out = np.empty_like(reg)
    out[order] = reg
    return out


class Chunk:
    """The words of a chunk of texts, lower-cased in A-Z: byte ranges and their text's index."""

    def __init__(self, texts: list):
        sizes = np.array([len(t) if t else 0 for t in texts], np.int64)
        self.buf = _FOLD[np.frombuffer(b"\n".join([t or b"" for t in texts]) + b"\n", np.uint8)]
        inside = _IN_WORD[self.buf]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edges = np.concatenate([[0], edges])
        self.starts = edges[0::2]
        self.sizes = edges[1::2] - self.starts
        ends = np.cumsum(sizes + 1)
        self.bounds = np.searchsorted(self.starts, np.concatenate([[0], ends]))
        self.n_words = np.diff(self.bounds)

    def features(self, cfg: DrawConfig) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text, bucket) of all runs of words, in blocks of the words they start at."""
        text_of = np.repeat(np.arange(len(self.n_words)), self.n_words)
        for first in range(0, len(self.starts), BLOCK):
            own = slice(first, first + BLOCK + cfg.runs - 1)
            size, text = self.sizes[own], text_of[own]
            reg = registers(self.buf, self.starts[own], size)
            spaced = reg ^ advance(np.full(len(reg), _BYTE[32]), size)  # of a blank and the word
            n = min(BLOCK, len(size))
            run, length, alive = reg[:n], size[:n], np.arange(n)
            of, found = [], []
            for k in range(cfg.runs):
                if k:
                    alive = alive[alive + k < len(text)]
                    same = text[alive] == text[alive + k]
                    run, length, alive = run[:len(alive)][same], length[:len(alive)][same], alive[same]
                    run = advance(run, size[alive + k] + 1) ^ spaced[alive + k]
                    length = length + size[alive + k] + 1
                full = np.full(len(run), 0xFFFFFFFF, np.uint32)
                crc = run ^ advance(full, length) ^ full
                of.append(text[alive])
                found.append((crc % np.uint32(cfg.buckets)).astype(np.int64))
            yield np.concatenate(of), np.concatenate(found)


# -- weights ------------------------------------------------------------------------------------

def bucket_counts(rows: DataFrame, cfg: DrawConfig = DrawConfig(), text: str = "text") -> np.ndarray:
    """Features of all texts by bucket; every task adds up its own first."""
    def count(batches):
        n = np.zeros(cfg.buckets, np.int64)
        for _, texts in chunks(batches, "_text"):
            for _, bucket in Chunk(texts).features(cfg):
                n += np.bincount(bucket, minlength=cfg.buckets)
        at = np.flatnonzero(n)
        yield as_batch(pa.schema([("bucket", pa.int64()), ("n", pa.int64())]), at, n[at])

    per_task = rows.select(rows[text].alias("_text")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(cfg.buckets, np.int64)
    for r in per_task.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most cfg.buckets rows
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of a bucket's smoothed shares in target and source, rounded down."""
    k = float(len(source))
    s_all, t_all = float(source.sum()) + k, float(target.sum()) + k
    return np.array([math.floor(1000 * math.log((float(t) + 1) * s_all / ((float(s) + 1) * t_all)))
                     for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(key: str, seed: int) -> int:
    """Gumbel number (times 1000, rounded down) of an id, from 32 bits of a hash."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, cfg: DrawConfig = DrawConfig(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_features, weight, score."""
    names = ("n_words", "n_features", "weight", "score")
    out_type = T.StructType([T.StructField(key, docs.schema[key].dataType), *[T.StructField(n, T.LongType()) for n in names]])
    if len(gain) != cfg.buckets:
        raise ValueError(f"{len(gain)} gains for {cfg.buckets} buckets")

    def run(batches):
        schema = to_arrow_schema(out_type)
        for rows, texts in chunks(batches, "_text"):
            chunk = Chunk(texts)
            n, weight = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for of, bucket in chunk.features(cfg):
                n += np.bincount(of, minlength=len(texts))
                order = np.argsort(of, kind="stable")
                of = of[order]
                first = np.flatnonzero(np.diff(of, prepend=-1))
                if len(first):
                    weight[of[first]] += np.add.reduceat(gain[bucket[order]], first)
            noise = np.array([gumbel(k or "", cfg.seed) for k in rows.column(1).to_pylist()], np.int64)
            yield as_batch(schema, rows.column(0), chunk.n_words, n, weight, weight + noise)

    return docs.select(docs[key].alias("_key"), docs[key].cast("string").alias("_id"),
                       docs[text].alias("_text")).mapInArrow(run, out_type)


# -- the draw -----------------------------------------------------------------------------------

def _place(key: str) -> Column:
    """The composite key of a row; smaller comes first in the draw."""
    return F.struct((-F.col("score")).alias("a"), F.col(key).isNull().alias("b"), F.col(key).alias("c"), F.col("_row").alias("d"))


def _literal(place, kind: T.StructType) -> Column:
    return F.struct(*[F.lit(place[n]).alias(n) for n in "abcd"]).cast(kind)


def kth_place(rows: DataFrame, k: int, key: str, cfg: DrawConfig) -> dict:
    """The k-th smallest composite key (from 1) of the rows, by quickselect; keys are distinct as ``_row`` is."""
    typed = rows.withColumn("_place", _place(key))
    kind = typed.schema["_place"].dataType
    low, high, skipped, turn = None, None, 0, 0
    while True:
        part = typed
        if low is not None:  # the scores alone reach the scan as a pushed filter
            part = part.filter((F.col("score") <= -low["a"]) & (F.col("_place") > _literal(low, kind)))
        if high is not None:
            part = part.filter((F.col("score") >= -high["a"]) & (F.col("_place") < _literal(high, kind)))
        turn += 1
        picked = (part.orderBy(F.xxhash64(F.lit(cfg.seed + turn), "_row"), "_row").limit(cfg.pivots)
                  .select("_place").collect())
        pivots = sorted((r["_place"] for r in picked), key=lambda p: (p["a"], p["b"], 0 if p["c"] is None else p["c"], p["d"]))
        before = part.agg(*[F.count_if(F.col("_place") < _literal(p, kind)) for p in pivots]).first()
        passed = 0
        for n, p in zip(before, pivots, strict=True):  # n before the pivot, one at it, the others after it
            if skipped + n + 1 == k:
                return p
            if skipped + n >= k:
                high = p
                break
            low, passed = p, n + 1
        skipped += passed


def numbered(rows: DataFrame, n: int, key: str, cfg: DrawConfig) -> DataFrame:
    """The rows with their rank in the order of the composite key: sorted over ranges, each range numbered from its offset."""
    order = [F.desc("score"), F.col(key).isNull(), F.col(key), F.col("_row")]
    ranges = rows.repartitionByRange(max(1, -(-n // cfg.rows_a_range)), *order).sortWithinPartitions(*order)
    kept = store(ranges.withColumn("_at", F.monotonically_increasing_id()), "drawn")
    part = F.shiftright("_at", 33)
    sizes = kept.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # one row a range
    offsets, upto = [], 0
    for r in sizes:
        offsets.append((r["part"], upto))
        upto += r["n"]
    table = rows.sparkSession.createDataFrame(offsets, "_part long, _offset long")
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (kept.withColumn("_part", part.cast("long")).join(F.broadcast(table), "_part")
            .withColumn("rank", F.col("_offset") + place + 1).drop("_part", "_offset", "_at"))


def draw_report(docs: DataFrame, target: DataFrame, cfg: DrawConfig = DrawConfig(), key: str = "doc_id",
                text: str = "text", target_text: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_features, weight, score, rank (null if not drawn)."""
    gain = gains(bucket_counts(docs, cfg, text), bucket_counts(target, cfg, target_text))
    scored = store(weigh(docs, gain, cfg, key, text).withColumn("_row", F.monotonically_increasing_id()), "draw-scores")
    enough = scored.filter(F.col("n_words") >= cfg.least_words)
    k = enough.count() * cfg.percent // 100
    columns = [F.col(f"`{key}`"), "n_words", "n_features", "weight", "score"]
    if not k:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    last = kth_place(enough, k, key, cfg)
    kind = scored.select(_place(key).alias("p")).schema["p"].dataType
    wins = (F.col("n_words") >= cfg.least_words) & (_place(key) <= _literal(last, kind))
    winners = numbered(scored.filter((F.col("score") >= -last["a"]) & wins), k, key, cfg)
    return (winners.select(*columns, F.col("rank").cast("long").alias("rank"))
            .unionByName(scored.filter(~wins).select(*columns, F.lit(None).cast("long").alias("rank"))))


def draw(docs: DataFrame, target: DataFrame, cfg: DrawConfig = DrawConfig(), key: str = "doc_id",
         text: str = "text", target_text: str = "text") -> DataFrame:
    """The drawn documents, columns as they were; of rows that share a drawn id all come."""
    ids = draw_report(docs, target, cfg, key, text, target_text).filter("rank is not null").select(F.col(f"`{key}`").alias("_drawn")).distinct()
    return docs.join(ids, docs[key].eqNullSafe(ids["_drawn"]), "left_semi")

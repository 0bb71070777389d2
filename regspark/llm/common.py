"""Shared helpers of the training-data operators: stored steps, Arrow chunks, word hashes.

Texts are read as Arrow batches and handled in chunks of a few MB, so a task's
memory does not grow with its partition. Words are byte ranges found with a
separator table; each gets a 64-bit hash from prefix sums of a polynomial over
its bytes (mod 2^64, odd base, so a range's value is shifted back by an inverse
power), then mixed. UTF-8 keeps ASCII separators apart from other characters,
so byte ranges and character ranges hold the same words.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regspark.session import hadoop_fs, scratch_path

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
CHUNK_BYTES = 4 << 20
_SEGMENT = 1 << 20
NULL_ID = -(1 << 63)


# -- stored steps ---------------------------------------------------------------------------

def store(df: DataFrame, name: str) -> DataFrame:
    """Write a step as Parquet below ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage with files that every executor can read, so a lost executor
    costs no earlier step; the step's own shuffle files are dropped once written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a step written by ``store`` that nothing reads any more."""
    hit = hadoop_fs(df.sparkSession, df._stored_at)
    if hit is not None:
        hit[0].delete(hit[1], True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ascii_lower(c):
    """Lower-case A-Z only, as the contracts of the text operators ask."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bounded_sample(rows: DataFrame, group: str, order: str, n: int, groups: int) -> DataFrame:
    """The ``n`` rows of smallest ``order`` (a hash) of each group, for the ``groups`` largest groups.

    Only about 2 n rows a group, those below a cut in the hash, reach the window, however large
    the group is; ties in the hash go by all columns.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("_size")).orderBy(F.desc("_size"), group).limit(groups)
    share = F.least(F.lit(1.0), F.lit(2.0 * n) / F.col("_size"))
    near = (rows.join(F.broadcast(sizes), group)
            .filter(F.pmod(order, F.lit(1 << 31)) <= share * float(1 << 31)).drop("_size"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.pmod(order, F.lit(1 << 31)), *near.columns))
    return near.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


# -- Arrow chunks ---------------------------------------------------------------------------

def chunks(batches: Iterator[pa.RecordBatch], text: str = "text",
           limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """(rows, texts as bytes or None) in runs of about ``limit`` bytes; one row at least."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
        first, size = 0, 0
        for i, v in enumerate(values):
            n = len(v) if v else 0
            if i > first and size + n > limit:
                yield batch.slice(first, i - first), values[first:i]
                first, size = i, 0
            size += n
        if first < len(values):
            yield batch.slice(first), values[first:]


def as_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type)
              for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


# -- hashes ---------------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
BYTE_VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
FOLDED_VALUES = BYTE_VALUES.copy()
FOLDED_VALUES[65:91] = BYTE_VALUES[97:123]

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_powers: list = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int):
    if len(_powers[0]) < n:
        size = max(n, _SEGMENT + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[k] = np.cumprod(a)
    return _powers


def range_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                 values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """Hash of each byte range; ranges are ascending and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + _SEGMENT, "right")))
        hi = int(ends[j - 1])
        up, down = _power_tables(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(values[buf[lo:hi]] * up[:hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def window_hashes(h: np.ndarray, m: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hash of every m consecutive entries (length ``len(h) - m + 1``), by doubling widths."""
    n = len(h)
    if n < m:
        return np.empty(0, np.uint64)
    out, size, block, width = None, 0, h, 1
    while True:
        if m & width:
            if out is None:
                out, size = block, width
            else:
                k = n - size - width + 1
                out = out[:k] * np.uint64(pow(base, width, 1 << 64)) + block[size:size + k]
                size += width
        if width * 2 > m:
            return mix(out)
        k = n - 2 * width + 1
        block = block[:k] * np.uint64(pow(base, width, 1 << 64)) + block[width:width + k]
        width *= 2


class Words:
    """The words of a chunk of texts: byte ranges, hashes and their text's index."""

    def __init__(self, texts: list, values: np.ndarray = BYTE_VALUES, separator: np.ndarray = SPACE):
        sizes = np.array([len(t) if t else 0 for t in texts], np.int64)
        self.buf = buf = np.frombuffer(b"\n".join([t or b"" for t in texts]) + b"\n", np.uint8)
        self.text_ends = np.cumsum(sizes + 1) - 1
        self.text_starts = self.text_ends - sizes
        sep = separator[buf]
        edges = np.flatnonzero(sep[1:] != sep[:-1]) + 1
        if not sep[0]:
            edges = np.concatenate([[0], edges])
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.bounds = np.searchsorted(self.starts, np.append(self.text_starts, len(buf)))
        self.n = np.diff(self.bounds)
        self.h = range_hashes(buf, self.starts, self.ends, values)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n)), self.n)

    @property
    def position(self) -> np.ndarray:
        return np.arange(len(self.h)) - np.repeat(self.bounds[:-1], self.n)

    def whole_windows(self, m: int) -> np.ndarray:
        """Indexes of the words at which m consecutive words of one text start."""
        i = np.arange(max(0, len(self.h) - m + 1))
        return i[np.repeat(self.bounds[1:], self.n)[:len(i)] - i >= m]

    def per_text(self, byte_flag: np.ndarray) -> np.ndarray:
        """Sum of a 256-entry table over the bytes of each text (separator newline left out)."""
        flags = byte_flag[self.buf]
        flags[self.text_ends] = 0
        return np.add.reduceat(flags, self.text_starts, dtype=np.int64) if len(self.n) else np.zeros(0, np.int64)

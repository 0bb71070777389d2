"""Substring dedup: difference-cover anchors find repeated passages, windows are then judged exactly.

A passage is ``window`` (20) consecutive words. Anchors of 8 words are hashed only at
positions whose remainder modulo 13 is in the cover {0, 1, 3, 9}: for any two positions
some shift below 13 brings both onto the cover, so two equal windows (8 + 12 words)
always share an aligned anchor. Repeated anchors are extended to the windows that hold
them; a window is repeated if an earlier start (by document id, then a hash of the
text, then position) has the same 96-bit hash of its 20 words.

Before each shuffle a task keeps one row per hash and chunk; further occurrences
within the chunk are then known to be repeats and need no group, so an anchor or window that
a third of all rows share sends at most one row per chunk to its group.

Defined cases: null text has no words; a null id sorts before all others; rows with
the same id and text are one document and get equal results, rows with the same id
and different texts are ordered by a hash of the text; an empty table gives an empty
result; further columns do not matter.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from regspark.llm.common import Words, as_batch, chunks, discard, mix, store, window_hashes


@dataclass(frozen=True)
class SubstringConfig:
    window: int = 20
    period: int = 13
    cover: tuple = (0, 1, 3, 9)

    @property
    def anchor(self) -> int:
        return self.window - self.period + 1


def check_cover(cfg: SubstringConfig) -> None:
    """Every difference modulo the period must occur between two members of the cover."""
    found = {(a - b) % cfg.period for a in cfg.cover for b in cfg.cover}
    if len(found) != cfg.period or cfg.anchor < 1:
        raise ValueError(f"{cfg.cover} is no difference cover modulo {cfg.period}")


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(docs[key].alias("id"), F.xxhash64(docs[text]).alias("th"), docs[text].alias("text"))


def _anchors(keyed: DataFrame, cfg: SubstringConfig) -> DataFrame:
    """(g, id, th, pos, known): covered positions; ``g`` groups equal anchors, known rows stand alone."""
    out_type = T.StructType([T.StructField("g", T.LongType()), *keyed.schema.fields[:2],
                             T.StructField("pos", T.IntegerType()), T.StructField("known", T.BooleanType())])
    on_cover = np.isin(np.arange(cfg.period), cfg.cover)

    def cut(batches):
        schema = to_arrow_schema(out_type)
        for rows, texts in chunks(batches):
            w = Words(texts)
            at = w.whole_windows(cfg.anchor)
            at = at[on_cover[w.position[at] % cfg.period] & (np.repeat(w.n, w.n)[at] >= cfg.window)]
            h = window_hashes(w.h, cfg.anchor)[at]
            order = np.argsort(h, kind="stable")
            h, at = h[order], at[order]
            again = np.zeros(len(h), bool)
            again[1:] = h[1:] == h[:-1]
            followed = np.append(again[1:], False)
            g = np.where(again, mix(h + at.astype(np.uint64) + np.uint64(1)), h).view(np.int64)
            of = w.text_of[at]
            for i in range(0, len(h), 200_000):
                s = slice(i, i + 200_000)
                pick = pa.array(of[s])
                yield as_batch(schema, g[s], rows.column(0).take(pick), rows.column(1).take(pick),
                               w.position[at[s]].astype(np.int32), (again | followed)[s])

    return keyed.mapInArrow(cut, out_type)


def _candidates(anchors: DataFrame) -> DataFrame:
    """(id, th, anchors): the positions of the anchors that occur twice or more, per document."""
    times = F.count("*").over(Window.partitionBy("g"))
    return (anchors.withColumn("times", times).filter("known or times > 1")
            .groupBy("id", "th").agg(F.collect_list("pos").alias("anchors")))


def _with_text(keyed: DataFrame, found: DataFrame, how: str) -> DataFrame:
    other = found.withColumnsRenamed({"id": "_id", "th": "_th"})
    return keyed.join(other, [keyed["th"] == other["_th"], keyed["id"].eqNullSafe(other["_id"])], how).drop("_id", "_th")


def _windows(with_anchors: DataFrame, cfg: SubstringConfig) -> DataFrame:
    """(w1, w2, id, th, pos, more): one leading row per window hash and chunk; rows with ``more`` hold sure
    repeats of a document and stand alone."""
    id_type = with_anchors.schema["id"].dataType
    out_type = T.StructType([T.StructField("w1", T.LongType()), T.StructField("w2", T.IntegerType()),
                             T.StructField("id", id_type), T.StructField("th", T.LongType()),
                             T.StructField("pos", T.IntegerType()), T.StructField("more", T.ArrayType(T.IntegerType()))])

    def extend(batches):
        schema = to_arrow_schema(out_type)
        for rows, texts in chunks(batches):
            w = Words(texts)
            spots = rows.column(3)
            sizes = np.diff(spots.offsets.to_numpy())
            a = np.repeat(w.bounds[:-1], sizes) + spots.flatten().to_numpy(zero_copy_only=False)
            opened = np.zeros(len(w.h) + 1, np.int32)
            np.add.at(opened, np.maximum(a - cfg.period + 1, np.repeat(w.bounds[:-1], sizes)), 1)
            np.add.at(opened, a + 1, -1)
            at = w.whole_windows(cfg.window)
            at = at[np.cumsum(opened)[at] > 0]
            w1 = window_hashes(w.h, cfg.window)[at]
            w2 = window_hashes(mix(w.h + np.uint64(0x632BE59BD9B4E019)), cfg.window, 0xA0761D6478BD642F)[at]
            w2 = (w2 >> np.uint64(32)).astype(np.uint32)
            of = w.text_of[at]
            ids, ths = rows.column(0), rows.column(1)
            # rows of one (id, th) are one document: they share a rank, and so are no repeats of each other
            rank = _ranks(ids, ths)[of]
            order = np.lexsort((w.position[at], rank, w2, w1))
            w1, w2, at, of, rank = w1[order], w2[order], at[order], of[order], rank[order]
            pos = w.position[at].astype(np.int32)
            same = np.zeros(len(w1), bool)
            same[1:] = (w1[1:] == w1[:-1]) & (w2[1:] == w2[:-1])
            lead = ~same
            first = np.maximum.accumulate(np.where(lead, np.arange(len(w1)), 0))
            twin = same & (rank == rank[first]) & (pos == pos[first])  # the leading window itself, in a repeated row
            yield as_batch(schema, w1[lead].view(np.int64), w2[lead].view(np.int32),
                           ids.take(pa.array(of[lead])), ths.take(pa.array(of[lead])), pos[lead],
                           pa.nulls(int(lead.sum()), pa.list_(pa.int32())))
            sure = same & ~twin
            by = np.argsort(of[sure], kind="stable")
            of_s, pos_s = of[sure][by], pos[sure][by]
            docs, start = np.unique(of_s, return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(pos_s)), pa.int32()), pa.array(pos_s))
            alone = mix((start + rows.num_rows).astype(np.uint64) ^ w1[sure][by][start]).view(np.int64)  # no group needed
            yield as_batch(schema, alone, np.zeros(len(docs), np.int32), ids.take(pa.array(docs)), ths.take(pa.array(docs)),
                           pa.nulls(len(docs), pa.int32()), lists)

    return with_anchors.select("id", "th", "text", "anchors").mapInArrow(extend, out_type)


def _ranks(ids: pa.Array, ths: pa.Array) -> np.ndarray:
    """Order of each row by (id, th), nulls first, equal for equal rows."""
    keys = pa.table({"id": ids, "th": ths})
    order = pc.sort_indices(keys, sort_keys=[("id", "ascending"), ("th", "ascending")],
                            null_placement="at_start").to_numpy()
    pairs = list(zip(ids.to_pylist(), ths.to_pylist(), strict=True))
    out, rank = np.empty(len(pairs), np.int64), -1
    for k, i in enumerate(order):
        rank += k == 0 or pairs[i] != pairs[order[k - 1]]
        out[i] = rank
    return out


def _repeated(windows: DataFrame) -> DataFrame:
    """(id, th, starts): the starts of the windows that occur earlier, per document."""
    place = F.rank().over(Window.partitionBy("w1", "w2").orderBy("id", "th", "pos"))
    found = windows.withColumn("place", place).filter("more is not null or place > 1")
    return (found.select("id", "th", F.coalesce("more", F.array("pos")).alias("starts"))
            .groupBy("id", "th").agg(F.flatten(F.collect_list("starts")).alias("starts")))


def dedup_substrings(docs: DataFrame, cfg: SubstringConfig = SubstringConfig(), key: str = "doc_id",
                     text: str = "text") -> DataFrame:
    """One row per document: its id, n_words, n_removed and ``kept``, the other words joined by one blank."""
    check_cover(cfg)
    keyed = _keyed(docs, key, text)
    found = store(_candidates(_anchors(keyed, cfg)), "anchors")
    repeated = store(_repeated(_windows(_with_text(keyed, found, "inner"), cfg)), "repeats")
    discard(found)
    out_type = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n_words", T.LongType()),
                             T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def strip(batches):
        schema = to_arrow_schema(out_type)
        for rows, texts in chunks(batches):
            w = Words(texts)
            marks = rows.column(3)
            sizes = pc.fill_null(pc.list_value_length(marks), 0).to_numpy()
            starts = np.repeat(w.bounds[:-1], sizes) + marks.flatten().to_numpy(zero_copy_only=False)
            edge = np.zeros(len(w.h) + 1, np.int32)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + cfg.window, -1)
            gone = np.cumsum(edge)[:-1] > 0
            sums = np.concatenate([[0], np.cumsum(gone)])
            removed = sums[w.bounds[1:]] - sums[w.bounds[:-1]]
            kept = []
            for i, t in enumerate(texts):
                words = (t or b"").split()
                if removed[i]:
                    g = gone[w.bounds[i]:w.bounds[i + 1]]
                    words = [x for x, y in zip(words, g, strict=True) if not y]
                kept.append(b" ".join(words))
            yield as_batch(schema, rows.column(0), w.n, removed, pa.array(kept, pa.binary()).cast(pa.string()))

    texts = _with_text(keyed, repeated, "left").select("id", "th", "text", "starts")
    return texts.mapInArrow(strip, out_type)

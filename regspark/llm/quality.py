"""Quality rules: rule counts of a text plus an n-gram perplexity band per language.

The language model is a modified Kneser-Ney model of order 4 over 64 symbol
classes (letters folded, digits, white space, punctuation, UTF-8 lead and
continuation bytes). Spark counts its 4-grams over whole texts in two rounds: a first
model is counted over all documents and scores all of them; a second one over every
document whose score lies in the core of its language (``median`` plus or minus
``core * spread``). The verdict is that of their mixture: the model of all documents has the
share ``background``, the core the rest, so every document counts, while junk that is common
in the corpus does not teach the model that it is usual. The counts grow with the corpus;
their keys are at most 64^4 (16.8 million), which bounds what the driver gathers and
broadcasts. A model is kept as sorted arrays of packed n-grams with their log-probabilities;
a task spreads the highest order over a direct table.

A document's verdict is true if its mean log-probability per byte lies within its
language's band: ``median - low * spread - slack`` to ``median + high * spread + slack``,
where spread is the larger of half the distance between the quartiles and
``least_spread``, exact on a histogram of all texts that pass the base rules (each
distinct text once, so a group of copies does not narrow a band), and slack is
``noise / sqrt(bytes)``: the mean over a short text varies more.

Defined cases: null text has no words and scores 0 with no verdict of its own (the base
rules reject it); null language is a group of its own; rows repeat as given;
an empty table gives an empty result; further columns are kept by ``keep_good`` as
they are (its own working columns carry the prefix ``_q_``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from regspark.llm.common import Words, as_batch, chunks, discard, mix, range_hashes, store, window_hashes
from regspark.operators.skew import skew_join

ORDER = 4
BITS = 6
SYMBOLS = 1 << BITS
PAD = 27  # newline
MAX_BROADCAST = 10_000


@dataclass(frozen=True)
class QualityConfig:
    """Limits of the base rules and widths of the perplexity bands."""

    least_words: int = 50
    repeat_percent: int = 50
    core: float = 1.0
    background: float = 0.05
    low: float = 6.0
    high: float = 6.0
    least_spread: float = 0.012
    noise: float = 4.0
    bin_width: float = 0.005


def symbol_table() -> np.ndarray:
    """Class of each byte: 0-25 letters, 26 blank, 27 newline, 28 digit, 29-43 punctuation,
    44-47 UTF-8 lead bytes, 48-63 continuation bytes by their low four bits."""
    t = np.full(256, 43, np.int64)
    t[0:32] = 26
    for i in range(26):
        t[65 + i] = t[97 + i] = i
    t[32], t[10] = 26, PAD
    t[48:58] = 28
    for i, c in enumerate(b".,;:!?'\"()-/@_"):
        t[c] = 29 + i
    b = np.arange(128, 256)
    t[128:192] = 48 + (b[:64] & 15)
    t[192:256] = 44 + np.minimum(3, np.maximum(0, (b[64:] - 192) // 16))
    return t


SYMBOL_OF = symbol_table()
JUNK = np.zeros(256, np.int64)
JUNK[list(b"#*$%&|<>")] = 1
CODE_POINT = np.ones(256, np.int64)
CODE_POINT[128:192] = 0
CODE_POINT[[32, 9, 10, 11, 12, 13]] = 0


def ngrams(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Packed 4-grams ending at each byte of the texts (padded with newlines), and their text's index."""
    pad = b"\n" * (ORDER - 1)
    sizes = np.array([len(t) if t else 0 for t in texts], np.int64)
    s = SYMBOL_OF[np.frombuffer(pad + pad.join([t or b"" for t in texts]), np.uint8)].astype(np.uint32)
    keys = s[ORDER - 1:].copy()
    for k in range(1, ORDER):
        keys |= s[ORDER - 1 - k:len(s) - k] << np.uint32(BITS * k)
    inside = np.ones(len(keys), bool)
    stops = np.cumsum(sizes + ORDER - 1) - (ORDER - 1)
    for k in range(ORDER - 1):
        inside[stops[:-1] + k] = False
    return keys[inside], np.repeat(np.arange(len(texts)), sizes)


def count_ngrams(docs: DataFrame, text: str = "text", chosen=None) -> DataFrame:
    """(key, n): 4-gram counts over whole texts, summed per task before the shuffle.

    ``chosen(rows, keys, text_of)`` may pick the documents to count, as a mask over the rows of a chunk.
    """
    def count(batches):
        keys, counts = np.empty(0, np.uint32), np.empty(0, np.int64)
        for rows, texts in chunks(batches, text):
            k, of = ngrams(texts)
            if chosen:
                k = k[chosen(rows, k, of)[of]]
            k, n = np.unique(k, return_counts=True)
            both = np.concatenate([keys, k])
            keys, at = np.unique(both, return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n]), len(keys)).astype(np.int64)
        schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])
        for i in range(0, len(keys), 100_000):
            yield as_batch(schema, keys[i:i + 100_000].astype(np.int64), counts[i:i + 100_000])

    return docs.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


class KneserNey:
    """Modified Kneser-Ney model as sorted key arrays with log-probabilities and backoff weights."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        grams = {ORDER: (keys[order].astype(np.int64), counts[order].astype(np.int64))}
        for k in range(ORDER - 1, 0, -1):  # a lower order counts distinct preceding symbols
            grams[k] = np.unique(grams[k + 1][0] & ((1 << BITS * k) - 1), return_counts=True)
        self.keys, self.logp, self.contexts, self.backoff = {}, {}, {}, {}
        lower = np.full(SYMBOLS, 1 / SYMBOLS)
        for k in range(1, ORDER + 1):
            g, c = grams[k]
            ones, twos, threes, fours = (float((c == i).sum()) for i in (1, 2, 3, 4))
            y = ones / (ones + 2 * twos) if ones else 0.0
            steps = [0.0, 1 - 2 * y * twos / ones if ones else 0.5, 2 - 3 * y * threes / twos if twos else 1.0,
                     3 - 4 * y * fours / threes if threes else 1.5]
            steps = np.clip(steps, [0, 0.05, 0.1, 0.15], [0, 0.95, 1.9, 2.85])
            cut = steps[np.minimum(c, 3)]
            ctx, at = np.unique(g >> BITS, return_inverse=True)
            total = np.bincount(at, c, len(ctx))
            gamma = np.bincount(at, cut, len(ctx)) / np.maximum(total, 1)
            suffix = g & ((1 << BITS * (k - 1)) - 1)
            below = lower[np.searchsorted(self.keys[k - 1], suffix)] if k > 1 else np.full(len(g), 1 / SYMBOLS)
            lower = (c - cut) / np.maximum(total[at], 1) + gamma[at] * below
            self.keys[k], self.logp[k] = g, np.log(lower).astype(np.float32)
            self.contexts[k], self.backoff[k] = ctx, np.log(np.maximum(gamma, 1e-12)).astype(np.float32)

    def log_probability(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Any 4-grams, also unseen ones: back off to the longest suffix that was seen."""
        if order == 0:
            return np.full(len(keys), -np.log(SYMBOLS), np.float32)
        keys = keys.astype(np.int64) & ((1 << BITS * order) - 1)
        out = np.empty(len(keys), np.float32)
        at = np.minimum(np.searchsorted(self.keys[order], keys), max(0, len(self.keys[order]) - 1))
        seen = self.keys[order][at] == keys if len(self.keys[order]) else np.zeros(len(keys), bool)
        out[seen] = self.logp[order][at[seen]]
        rest = keys[~seen]
        if len(rest):
            ctx = self.contexts[order]
            at = np.minimum(np.searchsorted(ctx, rest >> BITS), max(0, len(ctx) - 1))
            known = ctx[at] == rest >> BITS if len(ctx) else np.zeros(len(rest), bool)
            weight = np.where(known, self.backoff[order][at] if len(ctx) else 0, 0)
            out[~seen] = weight + self.log_probability(rest, order - 1)
        return out

    def direct(self) -> np.ndarray:
        """Log-probabilities of the highest order by packed key (NaN: not seen); 64^4 floats."""
        t = np.full(SYMBOLS ** ORDER, np.nan, np.float32)
        t[self.keys[ORDER]] = self.logp[ORDER]
        return t

    def score(self, keys: np.ndarray, direct: np.ndarray) -> np.ndarray:
        out = direct[keys]
        miss = np.isnan(out)
        if miss.any():
            out[miss] = self.log_probability(keys[miss])
        return out


class Blend(KneserNey):
    """Mixture of the model of all documents (with the share ``share``) and that of the core.

    The core's n-grams are among those of all documents, so the latter are the sorted keys.
    """

    def __init__(self, whole: KneserNey, core: KneserNey, share: float):
        self.whole, self.core, self.share = whole, core, share
        keys = whole.keys[ORDER]
        self.keys, self.logp = {ORDER: keys}, {ORDER: self.log_probability(keys)}

    def log_probability(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        with np.errstate(divide="ignore"):
            whole, core = np.log(self.share), np.log1p(-self.share)
        return np.logaddexp(whole + self.whole.log_probability(keys, order),
                            core + self.core.log_probability(keys, order)).astype(np.float32)


def gathered(counts: DataFrame) -> KneserNey:
    """Model of (key, n) rows; at most 64^4 of them reach the driver."""
    t = counts.toArrow()
    return KneserNey(t.column("key").to_numpy(), t.column("n").to_numpy())


def train(docs: DataFrame, cfg: QualityConfig = QualityConfig(), text: str = "text", lang: str = "lang") -> KneserNey:
    """Model of all documents, mixed with one of those in the core of their language by the first's judgement."""
    rows = docs.select(docs[lang].alias("_q_l"), docs[text].alias("_q_text"))
    first = gathered(count_ngrams(rows.select("_q_text"), "_q_text"))
    scored = store(score_rows(rows, first, ["_q_l"], "_q_text", rules=False), "quality-first")
    limits = store(bands(scored, "_q_k0", cfg.core, cfg.core, cfg), "quality-core")
    discard(scored)
    shared = docs.sparkSession.sparkContext.broadcast(first)

    def in_core(batch, keys, of):
        n = batch.num_rows
        lo, hi = (pc.fill_null(batch.column(i), np.nan).to_numpy(zero_copy_only=False) for i in (1, 2))
        log_p = mean_log_p(shared.value, keys, of, n)[0]
        return (log_p >= lo) & (log_p <= hi)

    inside = with_limits(rows, limits, "_q_l").select("_q_text", "_q_lo", "_q_hi")
    model = gathered(count_ngrams(inside, "_q_text", in_core))
    discard(limits)
    return Blend(first, model, cfg.background) if len(model.keys[ORDER]) else first


def rule_counts(texts: list) -> dict[str, np.ndarray]:
    """Base counts of each text of a chunk."""
    w = Words(texts)
    m, zero = len(texts), np.zeros(len(texts), np.int64)
    breaks = np.flatnonzero(w.buf == 10)
    starts = np.concatenate([[0], breaks[:-1] + 1])
    has_word = np.searchsorted(w.starts, breaks) > np.searchsorted(w.starts, starts)
    starts, ends = starts[has_word], breaks[has_word]
    of = np.searchsorted(w.text_ends, starts)
    salt = mix(of.astype(np.uint64) + np.uint64(1))
    first = np.unique(range_hashes(w.buf, starts, ends) ^ salt, return_index=True)[1]
    dup = np.bincount(of, minlength=m) - np.bincount(of[first], minlength=m)

    at = w.whole_windows(3)
    repeated = zero
    if len(at):
        keys = window_hashes(w.h, 3)[at] ^ mix(w.text_of[at].astype(np.uint64) + np.uint64(1))
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(len(w.h), np.int64)
        for k in range(3):
            covered[at[twice] + k] = 1
        sums = np.concatenate([[0], np.cumsum(covered)])
        repeated = sums[w.bounds[1:]] - sums[w.bounds[:-1]]
    return {"n_words": w.n, "word_chars": w.per_text(CODE_POINT), "n_symbols": w.per_text(JUNK),
            "n_dup_lines": dup, "n_repeat_words": repeated}


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_table: dict = {}


def mean_log_p(model: KneserNey, keys: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean log-probability per byte of each of n texts (0 if empty) and their numbers of bytes."""
    if _table.get("of") is not model:
        _table.update({"of": model, "direct": model.direct()})
    size = np.bincount(of, minlength=n)
    return np.bincount(of, model.score(keys, _table["direct"]), n) / np.maximum(size, 1), size


def score_rows(docs: DataFrame, model: KneserNey, keep: list[str], text: str = "text", rules: bool = True) -> DataFrame:
    """``keep`` columns, the text's hash, the base counts (with ``rules``), ``log_p`` (mean log-probability
    per byte) and 1/sqrt(bytes)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    inner = docs.select(*[docs[c].alias(f"_q_k{i}") for i, c in enumerate(keep)], F.xxhash64(docs[text]).alias("_q_th"),
                        docs[text].alias("_q_text"))
    names = COUNTS if rules else []
    fields = [T.StructField(f"_q_k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
    fields += [T.StructField(f"_q_{c}", T.LongType()) for c in ["th", *names]]
    out_type = T.StructType(fields + [T.StructField(f"_q_{c}", T.DoubleType()) for c in ("log_p", "slack")])

    def score(batches):
        schema = to_arrow_schema(out_type)
        for rows, texts in chunks(batches, "_q_text"):
            counts = rule_counts(texts) if rules else {}
            log_p, size = mean_log_p(shared.value, *ngrams(texts), len(texts))
            yield as_batch(schema, *rows.columns[:-1], *[counts[c] for c in names], log_p, 1 / np.sqrt(np.maximum(size, 1)))

    return inner.mapInArrow(score, out_type)


def base_failed(cfg: QualityConfig):
    return ((F.col("_q_n_words") < cfg.least_words)
            | (100 * F.col("_q_n_repeat_words") > cfg.repeat_percent * F.col("_q_n_words")))


def bands(scored: DataFrame, lang: str, low: float, high: float, cfg: QualityConfig) -> DataFrame:
    """(_q_lang, _q_lo, _q_hi): median - low * spread and median + high * spread, from a histogram of distinct texts."""
    texts = (scored.select(F.col(lang).alias("_q_lang"), "_q_th", F.floor(F.col("_q_log_p") / cfg.bin_width).alias("bin"))
             .filter("_q_th is not null").distinct())
    hist = texts.groupBy("_q_lang", "bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy("_q_lang")
    run = (hist.withColumn("upto", F.sum("n").over(w.orderBy("bin")))
           .withColumn("share", F.col("upto") / F.sum("n").over(w)))

    def quantile(q):
        return F.min(F.when(F.col("share") >= q, F.col("bin"))) * cfg.bin_width

    q = run.groupBy("_q_lang").agg(quantile(0.25).alias("a"), quantile(0.5).alias("m"), quantile(0.75).alias("b"))
    spread = F.greatest((F.col("b") - F.col("a")) / 2, F.lit(cfg.least_spread))
    return q.select("_q_lang", (F.col("m") - low * spread).alias("_q_lo"), (F.col("m") + high * spread).alias("_q_hi"))


def with_limits(rows: DataFrame, limits: DataFrame, lang: str) -> DataFrame:
    """Adds _q_lo and _q_hi of a row's language. The stored limits hold one row a language: up to
    ``MAX_BROADCAST`` of them (counted) are broadcast, more are joined with hot languages salted."""
    if limits.count() <= MAX_BROADCAST:
        return rows.join(F.broadcast(limits), rows[lang].eqNullSafe(limits["_q_lang"]), "left").drop("_q_lang")

    def named(c):
        return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))

    keyed = limits.withColumn("_q_key", named(limits["_q_lang"])).drop("_q_lang")
    return skew_join(rows.withColumn("_q_key", named(rows[lang])), keyed, "_q_key", "left").drop("_q_key")


def judge(scored: DataFrame, limits: DataFrame, cfg: QualityConfig, lang: str) -> DataFrame:
    """Adds ``_q_failed`` and ``_q_kept``; one row of limits per language."""
    slack = cfg.noise * F.col("_q_slack")
    fine = F.coalesce(F.col("_q_log_p").between(F.col("_q_lo") - slack, F.col("_q_hi") + slack), F.lit(False))
    return (with_limits(scored, limits, lang).withColumn("_q_failed", base_failed(cfg))
            .withColumn("_q_kept", ~F.col("_q_failed") & fine).drop("_q_lo", "_q_hi"))


def _final_bands(scored: DataFrame, cfg: QualityConfig, lang: str) -> DataFrame:
    return store(bands(scored.filter(~base_failed(cfg)), lang, cfg.low, cfg.high, cfg), "quality-limits")


def quality_report(docs: DataFrame, cfg: QualityConfig = QualityConfig(), key: str = "doc_id",
                   text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: key, counts, base_failed, kept and perplexity per byte."""
    model = train(docs, cfg, text, lang)
    scored = store(score_rows(docs, model, [key, lang], text), "quality-scores")
    judged = judge(scored, _final_bands(scored, cfg, "_q_k1"), cfg, "_q_k1")
    return judged.select(F.col("_q_k0").alias(key), *[F.col(f"_q_{c}").alias(c) for c in COUNTS],
                         F.col("_q_failed").alias("base_failed"), F.col("_q_kept").alias("kept"),
                         F.exp(-F.col("_q_log_p")).alias("perplexity"))


def keep_good(docs: DataFrame, cfg: QualityConfig = QualityConfig(), text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that pass, all columns as they were."""
    model = train(docs, cfg, text, lang)
    scored = store(score_rows(docs, model, [lang], text), "quality-bands")
    limits = _final_bands(scored, cfg, "_q_k0")
    discard(scored)
    again = score_rows(docs, model, docs.columns, text)
    at = f"_q_k{docs.columns.index(lang)}"
    kept = judge(again, limits, cfg, at).filter("_q_kept")
    return kept.select(*[F.col(f"_q_k{i}").alias(c) for i, c in enumerate(docs.columns)])

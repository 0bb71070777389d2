"""Language identification with a byte convolutional network trained here in numpy.

A window of ``window`` bytes (zero padded) passes filters of widths 2, 3 and 4 over its
bytes, a maximum over all positions per filter, a ReLU and a softmax over the learned
languages. It is trained with Adam on a bounded sample of labelled windows, each of another
text (``per_language`` windows a language, ``windows`` in all, shared equally by all languages there
are). A document's prediction takes all windows of its whole text: the mean
log-probabilities, weighted by bytes.

For prediction, filters of up to four bytes are two lookups in tables indexed by byte
pairs, in batches of ``batch`` windows, so memory does not depend on the text.

Defined cases: null text or text without a letter is ``und`` with score 0; so is every
text if there is no labelled row; rows repeat as given, and copies of a text count once in the
sample; ties go to the first language by name; texts of any length are predicted from all their
windows; an empty table gives an empty result; of ``docs`` only the named columns are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from regspark.llm.common import as_batch, chunks

WIDTHS = (2, 3, 4)
LETTER = re.compile(rb"[A-Za-z]")


@dataclass(frozen=True)
class LangConfig:
    window: int = 256
    filters: int = 16  # of each width
    per_language: int = 1000
    windows: int = 40_000
    epochs: int = 4
    rate: float = 0.02
    batch: int = 64
    seed: int = 6


class ByteCNN:
    """Filters as one table per width and offset: ``w[width][offset][byte]`` is a row of filter weights."""

    def __init__(self, languages: list, cfg: LangConfig):
        rng = np.random.default_rng(cfg.seed)
        self.languages, self.cfg, f = languages, cfg, cfg.filters
        self.w = [rng.normal(0, 0.3, (width, 256, f)).astype(np.float32) for width in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * f, np.float32)
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * f, len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)
        self.tables = None

    def windows(self, value: bytes) -> np.ndarray:
        n = self.cfg.window
        a = np.zeros(max(1, -(-len(value) // n)) * n, np.uint8)
        a[:len(value)] = np.frombuffer(value, np.uint8)
        return a.reshape(-1, n)

    def pair_tables(self):
        """The first two bytes of every filter, and its third and fourth, by byte pair."""
        f = self.cfg.filters
        first = np.concatenate([(w[0][:, None] + w[1][None, :]).reshape(65536, f) for w in self.w], 1)
        then = np.concatenate([np.repeat(self.w[1][2], 256, 0),
                               (self.w[2][2][:, None] + self.w[2][3][None, :]).reshape(65536, f)], 1)
        return np.ascontiguousarray(first), np.ascontiguousarray(then)

    def activations(self, x: np.ndarray) -> np.ndarray:
        """(windows, positions, filters): every filter at every position."""
        if self.tables is None:
            self.tables = self.pair_tables()
        f, n = self.cfg.filters, x.shape[1] - 3
        pairs = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        a = self.tables[0].take(pairs[:, :n], 0)
        a[:, :, f:] += self.tables[1].take(pairs[:, 2:2 + n], 0)
        return a

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(self.activations(x).max(1) + self.bias, 0)
        z = h @ self.out + self.out_bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def train(self, x: np.ndarray, y: np.ndarray) -> None:
        cfg, rng = self.cfg, np.random.default_rng(self.cfg.seed)
        params = [*self.w, self.bias, self.out, self.out_bias]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        f = cfg.filters
        for _ in range(cfg.epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), cfg.batch):
                b, t = x[order[i:i + cfg.batch]], y[order[i:i + cfg.batch]]
                self.tables = None
                a = self.activations(b)
                top = a.argmax(1)
                raw = np.take_along_axis(a, top[:, None, :], 1)[:, 0, :] + self.bias
                h = np.maximum(raw, 0)
                z = h @ self.out + self.out_bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(t)), t] -= 1
                p /= len(t)
                back = (p @ self.out.T) * (raw > 0)
                grads = []
                rows = np.arange(len(b))[:, None]
                for k, width in enumerate(WIDTHS):  # only the position of the maximum has a gradient
                    g = np.zeros_like(self.w[k])
                    own = slice(k * f, (k + 1) * f)
                    for o in range(width):
                        np.add.at(g[o], (b[rows, top[:, own] + o], np.arange(f)[None, :]), back[:, own])
                    grads.append(g)
                grads += [back.sum(0), h.T @ p, p.sum(0)]
                step += 1
                rate = cfg.rate * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
                for q, g, mi, vi in zip(params, grads, m, v, strict=True):
                    mi *= 0.9
                    mi += 0.1 * g
                    vi *= 0.999
                    vi += 0.001 * g * g
                    q -= (rate * mi / (np.sqrt(vi) + 1e-8)).astype(np.float32)
        self.tables = None

    def predict_many(self, values: list) -> list:
        """(language index, probability) of each text; windows of all texts in common batches."""
        blocks = [self.windows(v) for v in values]
        counts = np.array([len(b) for b in blocks])
        x, of = np.concatenate(blocks), np.repeat(np.arange(len(values)), counts)
        place = np.arange(len(x)) - np.repeat(np.cumsum(counts) - counts, counts)
        size = np.clip(np.array([len(v) for v in values])[of] - place * self.cfg.window, 0, self.cfg.window)
        total = np.zeros((len(values), len(self.languages)))
        for i in range(0, len(x), self.cfg.batch):
            s = slice(i, i + self.cfg.batch)
            np.add.at(total, of[s], self.log_probabilities(x[s]) * size[s, None])
        mean = total / np.maximum(1, np.bincount(of, size))[:, None]
        p = np.exp(mean - mean.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return list(zip(best.tolist(), p[np.arange(len(p)), best].tolist(), strict=True))


def has_letter(value: bytes | None) -> bool:
    return bool(value) and (bool(LETTER.search(value)) or any(map(str.isalpha, value.decode())))


def sample(labelled: DataFrame, cfg: LangConfig, text: str, lang: str) -> list:
    """At most ``per_language`` windows of each language: one of each distinct text, at a place and in an order set by
    its hash. Only about twice as many texts as are taken, those below a cut in the hash, leave their partition."""
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0))
    at = F.pmod(F.xxhash64(F.lit("place"), F.col(text)), F.greatest(F.length(text) - cfg.window, F.lit(1)))
    cut = rows.select(F.col(lang).alias("lang"), F.xxhash64(text).alias("order"),
                      F.substring(F.col(text), (at + 1).cast("int"), F.lit(cfg.window)).alias("text"))
    sizes = cut.groupBy("lang").agg(F.count_distinct("order").alias("n")).collect()  # a row a language, as the network has
    if not sizes:
        return []
    per = max(1, min(cfg.per_language, cfg.windows // len(sizes)))
    known = labelled.sparkSession.createDataFrame([(r["lang"], r["n"]) for r in sizes], "lang string, n long")
    place = F.pmod("order", F.lit(1 << 31))
    near = (cut.join(F.broadcast(known), "lang")
            .filter(place <= F.least(F.lit(1.0), (2.0 * per + 50) / F.col("n")) * float(1 << 31))
            .groupBy("lang", "order").agg(F.min("text").alias("text")))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(place, "order"))
    picked = near.withColumn("_place", first).filter(F.col("_place") <= per)
    return picked.orderBy("lang", "order", "text").select("lang", "text").collect()


def train(labelled: DataFrame, cfg: LangConfig = LangConfig(), text: str = "text", lang: str = "lang") -> ByteCNN:
    """Network of a bounded sample; a part of the windows is shortened, as short texts occur too."""
    rows = sample(labelled, cfg, text, lang)
    languages = sorted({r[0] for r in rows})
    index = {name: k for k, name in enumerate(languages)}
    net = ByteCNN(languages, cfg)
    if len(languages) > 1:
        rng = np.random.default_rng(cfg.seed)
        x, y = np.zeros((2 * len(rows), cfg.window), np.uint8), np.zeros(2 * len(rows), np.int64)
        for i, r in enumerate(rows):
            b = r[1].encode()[:cfg.window]
            for k, part in enumerate((b, b[:int(rng.integers(6, 97))])):
                x[2 * i + k, :len(part)] = np.frombuffer(part, np.uint8)
                y[2 * i + k] = index[r[0]]
        net.train(x, y)
    return net


def identify(docs: DataFrame, net: ByteCNN, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns of every row with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    out_type = T.StructType([*[T.StructField(c, docs.schema[c].dataType) for c in keep],
                             T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        schema, model = to_arrow_schema(out_type), shared.value
        for rows, texts in chunks(batches, "_text"):
            known = [i for i, t in enumerate(texts) if model.languages and has_letter(t)]
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            found = model.predict_many([texts[i] for i in known]) if known else []
            for i, (k, p) in zip(known, found, strict=True):
                lang[i], score[i] = model.languages[k], p
            yield as_batch(schema, *rows.columns[:-1], lang, score)

    return docs.select(*[docs[c].alias(f"_k{i}") for i, c in enumerate(keep)], docs[text].alias("_text")).mapInArrow(run, out_type)

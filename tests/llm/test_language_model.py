"""The language model of the quality rules against a plain modified Kneser-Ney model of dictionaries."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from regspark.llm import quality

DIR = "/root/testdata/sf0.001"
CFG = quality.QualityConfig()


def grams_of(text: str):
    s = [quality.PAD] * 3 + [int(quality.SYMBOL_OF[b]) for b in text.encode()]
    return [tuple(s[i:i + 4]) for i in range(len(s) - 3)]


class Plain:
    """p(symbol | three before it), interpolated, with three discounts an order."""

    def __init__(self, texts):
        count = Counter(g for t in texts for g in grams_of(t))
        self.orders = {}
        for k in (4, 3, 2, 1):
            n = Counter(min(c, 5) for c in count.values())
            y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
            d = [1 - 2 * y * n[2] / n[1] if n[1] else 0.5, 2 - 3 * y * n[3] / n[2] if n[2] else 1.0,
                 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
            d = [min(max(x, lo), hi) for x, lo, hi in zip(d, (0.05, 0.1, 0.15), (0.95, 1.9, 2.85))]
            total, left = Counter(), defaultdict(float)
            for g, c in count.items():
                total[g[:-1]] += c
                left[g[:-1]] += d[min(c, 3) - 1]
            self.orders[k] = (dict(count), d, total, left)
            before = defaultdict(set)
            for g in count:
                before[g[1:]].add(g[0])
            count = Counter({g: len(v) for g, v in before.items()})

    def p(self, g) -> float:
        if not g:
            return 1 / 64
        count, d, total, left = self.orders[len(g)]
        shorter = self.p(g[1:])
        if g[:-1] not in total:
            return shorter
        c = count.get(g, 0)
        return (c - (d[min(c, 3) - 1] if c else 0) + left[g[:-1]] * shorter) / total[g[:-1]]


def packed(g) -> int:
    return sum(x << 6 * i for i, x in enumerate(reversed(g)))


def gathered(texts):
    keys, counts = np.unique(np.concatenate([quality.ngrams([t.encode()])[0] for t in texts]), return_counts=True)
    return quality.KneserNey(keys, counts)


TEXTS = ["the river runs to the sea, the sea is wide.", "a stone by the river\nand 42 trees", "", "élan vital", "zzzzzzzz"]


def test_probabilities_equal_a_plain_model():
    plain, model = Plain(TEXTS), gathered(TEXTS)
    rng = np.random.default_rng(0)
    seen = sorted({g for t in TEXTS for g in grams_of(t)})
    new = [tuple(int(x) for x in rng.integers(0, 64, 4)) for _ in range(500)]
    new += [(*g[:3], int(rng.integers(0, 64))) for g in seen]  # known contexts, other symbols
    got = np.exp(model.log_probability(np.array([packed(g) for g in seen + new])).astype(float))
    np.testing.assert_allclose(got, [plain.p(g) for g in seen + new], rtol=1e-4)


@pytest.mark.parametrize("share", [0.05, 0.5, 1.0])
def test_mixture_of_all_and_core(share):
    whole, core = Plain(TEXTS), Plain(TEXTS[:2])
    model = quality.Blend(gathered(TEXTS), gathered(TEXTS[:2]), share)
    rng = np.random.default_rng(1)
    grams = sorted({g for t in TEXTS for g in grams_of(t)}) + [tuple(int(x) for x in rng.integers(0, 64, 4)) for _ in range(300)]
    keys = np.array([packed(g) for g in grams])
    want = [share * whole.p(g) + (1 - share) * core.p(g) for g in grams]
    np.testing.assert_allclose(np.exp(model.score(keys, model.direct()).astype(float)), want, rtol=1e-4)
    total = np.exp(model.log_probability((np.int64(777) << 6) + np.arange(64)).astype(float)).sum()
    assert abs(total - 1) < 1e-3


def mean_log(model, text):
    g = grams_of(text)
    return sum(math.log(model(x)) for x in g) / max(1, len(g))


def limits(scores, texts, langs, low, high):
    """{language: (least, most)}, from the scores of distinct texts in bins."""
    out = {}
    for lang in set(langs):
        one = {t: math.floor(s / CFG.bin_width) for s, t, x in zip(scores, texts, langs) if x == lang and t is not None}
        bins = sorted({(t, b) for t, b in one.items()}, key=lambda x: x[1])
        if bins:
            a, m, b = (bins[math.ceil(q * len(bins)) - 1][1] * CFG.bin_width for q in (0.25, 0.5, 0.75))
            spread = max((b - a) / 2, CFG.least_spread)
            out[lang] = (m - low * spread, m + high * spread)
    return out


def test_verdicts_equal_a_plain_model(spark):
    """Every verdict of the small table, by dictionaries and lists (scores near a limit aside)."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.collect()
    texts, langs = [r.text for r in rows], [r.lang for r in rows]
    whole = Plain([t or "" for t in texts])
    first = [mean_log(whole.p, t or "") for t in texts]
    near = limits(first, texts, langs, CFG.core, CFG.core)
    core = Plain([t for t, s, x in zip(texts, first, langs) if t is not None and near[x][0] <= s <= near[x][1]])
    both = [mean_log(lambda g: CFG.background * whole.p(g) + (1 - CFG.background) * core.p(g), t or "") for t in texts]
    got = {r.doc_id: r for r in quality.quality_report(docs).collect()}
    fine = [not got[r.doc_id].base_failed for r in rows]
    band = limits([s for s, f in zip(both, fine) if f], [t for t, f in zip(texts, fine) if f],
                  [x for x, f in zip(langs, fine) if f], CFG.low, CFG.high)
    judged = 0
    for r, s, f in zip(rows, both, fine):
        assert abs(math.log(got[r.doc_id].perplexity) + s) < 1e-3
        if not f:
            assert not got[r.doc_id].kept
            continue
        slack = CFG.noise / math.sqrt(max(1, len((r.text or "").encode())))
        lo, hi = band[r.lang][0] - slack, band[r.lang][1] + slack
        if min(abs(s - lo), abs(s - hi)) > 2 * CFG.bin_width:
            assert got[r.doc_id].kept == (lo <= s <= hi)
            judged += 1
    assert judged > 0.8 * sum(fine)

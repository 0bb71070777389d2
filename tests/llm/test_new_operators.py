"""Brute-force comparisons and defined cases of encoding, hard negatives and the importance draw."""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from regspark.llm import bpe, importance, langid, negatives, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# -- 11 byte-pair encoding --------------------------------------------------------------------

def ids_of(packed):
    return np.frombuffer(packed, "<u4").tolist()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_encoding_equals_the_library(library):
    known, rnd = bpe.vocabulary(PATH), random.Random(1)
    parts = ["a", "b", "th", "e", " ", "  ", "\n", "é", "漢", "\U00032400", "Ᲊ", "՘", "'s", "'ll", "'S", "1", "23", "!", "ß",
             "<|endoftext|>", "<|endoftext|", "\x1c", "\x85", " ", "🙂", "�", "-", "\t", "token", "ization"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(40))) for _ in range(3000)]
    texts += ["a" * 5000, "ab" * 3000, "aaab" * 777, "漢" * 900, "1" * 4001, "=-" * 999, " " * 3000,
              "".join(rnd.choice("abcdefgh") for _ in range(5000)), "word " * 70_000]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert ids_of(known.encode(text)) == ids
        assert known.decode(known.encode(text)) == library.decode(ids, skip_special_tokens=False)
    for _ in range(300):  # ids of no text, whose bytes may be no UTF-8
        ids = [rnd.randrange(50_257) for _ in range(20)]
        assert known.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)
    assert known.decode(np.array([60_000, 64], "<u4").tobytes()) == library.decode([60_000, 64], skip_special_tokens=False)


def test_long_words_merge_alike():
    known, rnd = bpe.vocabulary(PATH), random.Random(2)
    assert known.in_order
    for n in (1, 2, 3, 50, 700):
        for letters in ("a", "ab", "the quick", "".join(map(chr, range(33, 127)))):
            word = "".join(rnd.choice(letters) for _ in range(n)).encode()
            assert known.merge(word) == known.merge_long(word).tolist()


def test_word_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 10)
    known = bpe.Vocabulary(PATH)
    text = " ".join(f"w{i}" for i in range(100))
    assert ids_of(known.encode(text)) == ids_of(bpe.vocabulary(PATH).encode(text))
    assert len(known.cache) <= 10


def test_other_kinds_of_vocabulary_are_refused(tmp_path):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"model": {**spec["model"], "byte_fallback": True}},
                   {"pre_tokenizer": {"type": "Whitespace"}}):
        p = tmp_path / "v.json"
        p.write_text(json.dumps({**spec, **change}))
        with pytest.raises(ValueError, match="byte-level"):
            bpe.Vocabulary(str(p))


def test_merges_out_of_order_use_the_lists(tmp_path, library):
    """A merge that uses a later one's result: places of one rank may not be merged all at once."""
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    merges = [["ab", "c"], ["a", "b"]]
    vocab = {c: i for i, c in enumerate(bpe.byte_characters())} | {"ab": 256, "abc": 257}
    p = tmp_path / "v.json"
    p.write_text(json.dumps({**spec, "added_tokens": [], "model": {**spec["model"], "vocab": vocab, "merges": merges}}))
    known, other = bpe.Vocabulary(str(p)), Tokenizer.from_file(str(p))
    assert not known.in_order
    text = "abcab" * 300
    assert ids_of(known.encode(text)) == other.encode(text, add_special_tokens=False).ids


def test_encode_and_decode_documents(spark, library):
    texts = [None, "", "Hello  world <|endoftext|>", "Hello  world <|endoftext|>", "é😀\n" * 400_000]
    rows = [(i if i != 1 else None, t, "x", b"y") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, _text binary")
    got = bpe.decode_documents(bpe.encode_documents(docs, PATH), PATH).collect()
    assert [r.doc_id for r in got] == [0, None, 2, 3, 4]
    for r, t in zip(got, texts, strict=True):
        assert r.decoded == (t or "") and r.n_tokens == len(r.ids) // 4
        assert ids_of(r.ids) == library.encode(t or "", add_special_tokens=False).ids
    assert bpe.encode_documents(docs.filter("1 = 0"), PATH).collect() == []
    nulls = spark.createDataFrame([(1, None, "old")], "doc_id long, ids binary, decoded string")
    assert [tuple(r) for r in bpe.decode_documents(nulls, PATH).collect()] == [(1, None, None)]


def test_encoding_query(spark, sf_dir, library):
    docs = {r.doc_id: r.text or "" for r in queries.table(spark, sf_dir, "documents").collect()}
    got = queries.op11_bpe(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# -- 12 hard negatives ------------------------------------------------------------------------

def brute_negatives(rows, anchors, cfg):
    ids = sorted(rows)
    x = {i: np.floor(np.array(rows[i][0], float) * cfg.scale).astype(np.int64) for i in ids}

    def score(a, b):
        n = min(len(x[a]), len(x[b]))
        return int(x[a][:n] @ x[b][:n])

    out = []
    for a in (i for i in ids if anchors(i)):
        ranked = sorted(((score(a, b), b) for b in ids if b != a), key=lambda t: (-t[0], t[1]))
        for ps, p in [t for t in ranked if rows[t[1]][1] == rows[a][1]][:cfg.positives]:
            fit = [t for t in ranked if rows[t[1]][1] != rows[a][1] and cfg.low * ps <= 100 * t[0] <= cfg.high * ps]
            out += [(a, p, k + 1, n, ps, ns) for k, (ns, n) in enumerate(fit[:cfg.negatives])]
    return sorted(out)


@pytest.mark.parametrize("shape", ["clusters", "copies", "lengths", "few"])
def test_hard_negatives(spark, shape):
    rng = np.random.default_rng(len(shape))
    n, d = 400, 12
    centres = rng.normal(size=(8, d))
    x = centres[rng.integers(0, 8, n)] + 0.3 * rng.normal(size=(n, d))
    if shape == "copies":  # a third of all rows are one vector, so one cell is hot and scores tie
        x[::3] = x[0]
    if shape == "lengths":
        x *= rng.lognormal(0, 2, (n, 1))
    label = [0 if shape == "few" and i > 3 else int(v) for i, v in enumerate(rng.integers(0, 3, n))]
    rows = {i: (x[i].tolist(), label[i]) for i in range(n)}
    df = spark.createDataFrame([(i, v, k, "x") for i, (v, k) in rows.items()], "vec_id long, embedding array<double>, label int, id string")
    cfg = negatives.MiningConfig(rows_a_cell=20, block=16, blocks_a_task=2, questions_a_task=8, first_rows=40, growth=3)
    got = sorted(tuple(r) for r in negatives.mine(df, F.col("id") % 10 == 0, cfg).collect())
    assert got == brute_negatives(rows, lambda i: i % 10 == 0, cfg)


def test_hard_negatives_defined_cases(spark):
    rows = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (1, [0.9, 0.5], 1), (2, [0.9, 0.4], 2), (3, None, 1), (4, [None, 1.0], 1),
            (5, [float("nan"), 1.0], 2), (6, [float("inf"), 1.0], 2), (None, [1.0, 1.0], 2), (7, [1.0, 1.0], None),
            (8, [0.9], 2), (9, [], 2), (11, [0.9, 0.4], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(r) for r in negatives.mine(df, F.col("id") == 0).collect())
    kept = {0: ([1.0, 0.5], 1), 1: ([0.9, 0.5], 1), 2: ([0.9, 0.4], 2), 8: ([0.9], 2), 9: ([], 2), 11: ([0.9, 0.4], 2)}
    assert got == brute_negatives(kept, lambda i: i == 0, negatives.MiningConfig())
    assert [r[3] for r in got] == [2, 11]  # equal scores: the smaller id first
    none = negatives.mine(df.filter("1 = 0"), F.col("id") == 0)
    assert none.collect() == [] and none.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert negatives.mine(df, F.col("id") == 77).collect() == []


def test_heap_visits_all_cells_by_falling_bound():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=7), np.round(rng.normal(size=5), 1)
    seen = list(negatives.visits(a, b))
    assert sorted((i, j) for _, i, j in seen) == [(i, j) for i in range(7) for j in range(5)]
    assert [s[0] for s in seen] == sorted((a[i] + b[j] for i in range(7) for j in range(5)), reverse=True)


def test_bounds_hold_and_prune(spark):
    """No row scores above its cell's bound, and far clusters are not sent to a question."""
    rng = np.random.default_rng(4)
    centres = 5 * np.eye(16)[:8]
    x = centres[rng.integers(0, 8, 600)] + 0.05 * rng.normal(size=(600, 16))
    df = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    cfg = negatives.MiningConfig(rows_a_cell=10, first_rows=100)
    rows = negatives.quantised(df, cfg.scale, "vec_id", "embedding", "label")
    index = negatives.build(rows, cfg)
    whole = np.floor(x * cfg.scale)
    first, second = index.bounds(whole[:20])
    wide = index.counts.shape[1]
    for b in index.blocks.collect():
        ids = np.frombuffer(b.ids, "<i8")
        i, j = divmod(b.cell, wide)
        assert (whole[:20] @ whole[ids].T <= (first[:, i] + second[:, j])[:, None]).all()
    state = (rows.filter("id < 20").withColumn("slots", F.array(F.struct(F.lit(0).alias("slot"), F.lit(0).alias("low"), F.lit(1 << 62).alias("high"))))
             .withColumn("upto", F.lit(0)).withColumn("reach", F.array(F.lit(int(4.5 * 4.5 * cfg.scale ** 2)).cast("long"))))
    asked = negatives._ask(state.select("id", "label", "v", "slots", "upto", "reach"), index, 1 << 40).groupBy("id").count().collect()
    assert len(asked) == 20 and max(r["count"] for r in asked) < (index.counts > 0).sum() / 2


def test_a_question_goes_once_to_each_shelf(spark):
    """Requests hold a question's vector per shelf of cells, not per cell, and exactly the cells its bounds leave."""
    x = np.random.default_rng(6).normal(size=(900, 16))
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    cfg = negatives.MiningConfig(rows_a_cell=4, block=32, blocks_a_task=4)
    rows = negatives.quantised(df, cfg.scale, "vec_id", "embedding", "label")
    index = negatives.build(rows, cfg)
    assert len(index.cells) > 100 and 5 <= len(index.shelves) <= 9
    assert sum(len(b.labels) for b in index.blocks.collect()) == 900
    first, second = index.bounds(np.floor(x[:40] * cfg.scale))
    least = int(np.median(first[:, :, None] + second[:, None, :]))
    state = (rows.filter("id < 40").withColumn("slots", F.array(F.struct(F.lit(0).alias("slot"), F.lit(least).cast("long").alias("low"), F.lit(1 << 62).alias("high"))))
             .withColumn("upto", F.lit(0)).withColumn("reach", F.array(F.lit(least).cast("long"))))
    asked = negatives._ask(state.select("id", "label", "v", "slots", "upto", "reach"), index, 1 << 40).collect()
    assert len({(r.id, r.shelf) for r in asked}) == len(asked) <= 40 * len(index.shelves)
    got = {i: set() for i in range(40)}
    for r in asked:
        lo, hi = next(s[1:] for s in index.shelves if s[0] == r.shelf)
        got[r.id] |= set(index.cells[lo:hi][np.unpackbits(np.frombuffer(r.cells, np.uint8))[:hi - lo] > 0].tolist())
        assert np.frombuffer(r.v, index.kind).tolist() == np.floor(x[r.id] * cfg.scale).astype(int).tolist()
    for i in range(40):
        bound = (first[i][:, None] + second[i]).ravel()
        assert got[i] == {c for c in index.cells.tolist() if bound[c] >= least}


@pytest.mark.parametrize("heap", [0, 1 << 30])
def test_waves_visit_each_cell_once_by_falling_bound(monkeypatch, heap):
    rng = np.random.default_rng(7)
    counts = rng.integers(0, 3, (12, 9)) * rng.integers(1, 40, (12, 9))
    index = negatives.Index(2, (None, None), (None, None), counts, 200, "<i8", None)
    monkeypatch.setattr(negatives, "HEAP_CELLS", heap)
    for _ in range(20):
        first, second = np.round(rng.normal(size=12), 1), np.round(rng.normal(size=9), 1)  # many ties
        bound = (first[:, None] + second).ravel()
        done, seen, lowest = 0, [], np.inf
        for budget in (30, 90, 270, 1 << 40):
            own, upto = index.next_cells(first, second, done, -1, budget)
            b = bound[index.cells[own]]
            assert (b < lowest).all() and (b >= -1).all() and upto >= done
            assert upto == (bound >= (b.min() if budget < 1 << 40 else -1)).sum()
            assert (index.sizes[own].sum() >= budget) == (budget < 1 << 40)
            done, lowest, seen = upto, b.min(initial=lowest), seen + own.tolist()
        assert sorted(seen) == np.flatnonzero(bound[index.cells] >= -1).tolist()
        assert len(index.next_cells(first, second, done, -1, 1 << 40)[0]) == 0


@pytest.mark.parametrize("same", [True, False])
@pytest.mark.parametrize("shape", ["sparse", "dense", "ties", "large"])
def test_tiles_keep_the_best_of_each_window(monkeypatch, shape, same):
    """All windows of all questions against plain products, with tiles smaller than the group."""
    monkeypatch.setattr(negatives, "TILE_QUESTIONS", 7)
    monkeypatch.setattr(negatives, "TILE_ROWS", 50)
    rng = np.random.default_rng(8)
    n, g, dims, limit = 400, 30, 6, 3
    counts = rng.integers(0, 30, (6, 5))
    counts[2, 3] += n - counts.sum() if n > counts.sum() else 0
    n = int(counts.sum())
    index = negatives.Index(dims, (None, None), (None, None), counts, 10 ** 6, "<i8", None)
    size = {"large": 1 << 28}.get(shape, 100)
    x, q = rng.integers(-size, size, (n, dims)), rng.integers(-size, size, (g, dims))
    if shape == "ties":
        x[::2] = x[0]
    cell = np.repeat(index.cells, index.sizes)
    ids = np.concatenate([np.sort(part) for part in np.split(rng.permutation(n), np.cumsum(index.sizes)[:-1])])
    labels, qlabels = rng.integers(0, 4, n).astype(str), rng.integers(0, 4, g).astype(str)
    wanted = rng.random((g, len(index.cells))) < 0.7
    score = q @ x.T
    low = np.quantile(score, {"sparse": 0.97}.get(shape, 0.1)).astype(int)
    slots = [[{"slot": k + 1, "low": int(low), "high": int(np.quantile(score, 1 - 0.2 * k))} for k in range(1 + i % 3)] for i in range(g)]
    reach = [[int(low) + 5 * k for k in range(len(s))] for s in slots]
    edges = [0, *np.cumsum(index.sizes)]
    runs = [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]
    blocks = pa.table({"shelf": [0] * len(runs), "cell": index.cells, "ids": [ids[r].astype("<i8").tobytes() for r in runs],
                       "labels": [labels[r].tolist() for r in runs], "vs": [x[r].tobytes() for r in runs]})
    asked = pa.table({"shelf": [0] * g, "id": np.arange(g), "label": qlabels.tolist(), "v": [v.tobytes() for v in q], "slots": slots,
                      "reach": reach, "cells": [r.tobytes() for r in np.packbits(wanted, axis=1)]})
    got = negatives._score(blocks, asked, index, same, limit)
    want = []
    for i in range(g):
        fit = ((labels == qlabels[i]) == same) & (ids != i) & wanted[i][np.searchsorted(index.cells, cell)]
        for s, r in zip(slots[i], reach[i], strict=True):
            at = np.flatnonzero(fit & (score[i] >= r) & (score[i] <= s["high"]))
            want += [(i, s["slot"], int(ids[k]), int(score[i, k])) for k in at[np.lexsort((ids[at], -score[i, at]))][:limit]]
    assert sorted(zip(*(got.column(c).to_pylist() for c in ("id", "slot", "found", "score")), strict=True)) == sorted(want)
    assert negatives._score(blocks.slice(0, 0), asked, index, same, limit).num_rows == 0


# -- 13 importance resampling -----------------------------------------------------------------

def features(text, buckets=10_000):
    w = WORDS.findall((text or "").translate(LOW))
    return [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in (1, 2, 3) for i in range(len(w) - n + 1)], len(w)


def brute_draw(docs, target):
    s, t = np.zeros(10_000, int), np.zeros(10_000, int)
    found = [features(x) for _, x in docs]
    for f, _ in found:
        np.add.at(s, f, 1)
    for x in target:
        np.add.at(t, features(x)[0], 1)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + 10_000) / ((s[b] + 1) * (t.sum() + 10_000)))) for b in range(10_000)]
    rows = []
    for (i, _), (f, n) in zip(docs, found, strict=True):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    ranked = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return rows, ranked[:5 * len(ranked) // 100]


def random_text(rnd):
    parts = ["a", "B", "é", "漢字", " ", " ", "!", "\n", "7", "[", "@ ", "z" * rnd.choice([5, 47, 48, 49, 300])]
    return "".join(rnd.choice(parts) for _ in range(rnd.randrange(200)))


def test_checksums_of_runs(monkeypatch):
    rnd = random.Random(3)
    for block in (1, 2, 7, 1 << 18):
        monkeypatch.setattr(importance, "BLOCK", block)
        texts = [random_text(rnd) if rnd.random() < 0.9 else None for _ in range(30)] + ["y" * 70_000 + " b"]
        chunk = importance.Chunk([t.encode() if t is not None else None for t in texts])
        found = [[] for _ in texts]
        for of, bucket in chunk.features(importance.DrawConfig()):
            for o, b in zip(of.tolist(), bucket.tolist(), strict=True):
                found[o].append(b)
        for t, f, n in zip(texts, found, chunk.n_words, strict=True):
            assert (sorted(f), n) == (sorted(features(t)[0]), features(t)[1])


@pytest.mark.parametrize("pivots", [1, 5, 31])
def test_draw(spark, pivots):
    rnd = random.Random(7)
    docs = [(i, random_text(rnd)) for i in range(400)]
    docs += [(7, docs[7][1])] * 60 + [(None, "w " * 30), (None, "w " * 30), (401, None), (402, ""), (403, "long " * 300_000)]
    target = ["é 漢字 a b", None, "", "a b a b 7"]
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, rank string, _row int").repartition(5)
    t = spark.createDataFrame([(x,) for x in target], "text string")
    cfg = importance.DrawConfig(pivots=pivots, rows_a_range=4)
    got = importance.draw_report(d, t, cfg).collect()
    rows, drawn = brute_draw(docs, target)

    def key(r):
        return (r[0] is None, r[0] or 0, *r[1:])

    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(rows, key=key)
    ranked = sorted((r for r in got if r.rank is not None), key=lambda r: r.rank)
    assert [r.rank for r in ranked] == list(range(1, len(drawn) + 1))
    assert [tuple(r)[:5] for r in ranked] == drawn
    if pivots == 31:
        ids = {r[0] for r in drawn}
        taken = importance.draw(d, t, cfg)
        assert taken.columns == d.columns
        assert sorted(map(str, (r.doc_id for r in taken.collect()))) == sorted(str(i) for i, _ in docs if i in ids)


def test_draw_of_empty_tables(spark):
    docs = spark.createDataFrame([(i, "a b c d e f g h i j k l m n o p q r s t u " * 2) for i in range(40)], "doc_id long, text string")
    empty = docs.filter("1 = 0")
    assert importance.draw_report(empty, docs).collect() == []
    got = importance.draw_report(docs, empty).collect()
    assert sorted(r.rank for r in got if r.rank) == [1, 2]
    assert importance.draw_report(docs.limit(3), docs).filter("rank is not null").count() == 0
    keyed = docs.withColumn("doc_id", F.col("doc_id").cast("string"))  # other types of ids
    assert importance.draw_report(keyed, docs).filter("rank is not null").count() == 2


def test_kth_place_of_ties(spark):
    rows = spark.createDataFrame([(i % 3, 5 - i % 2, i) for i in range(50)], "k long, score long, _row long")
    order = sorted(range(50), key=lambda i: (-(5 - i % 2), i % 3, i))
    for k in (1, 2, 25, 26, 50):
        assert importance.kth_place(rows, k, "k", importance.DrawConfig(pivots=3))["d"] == order[k - 1]


# -- 6 language identification: the sample and the network ----------------------------------------

def made_up(rnd, language, n):
    """Words of a made-up language: its own syllables."""
    own = random.Random(language)
    syllables = ["".join(own.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(6)]
    return " ".join("".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 4))) for _ in range(n))


def test_copies_do_not_fill_the_sample(spark):
    rnd = random.Random(8)
    rows = [("de", made_up(rnd, "de", 60)) for _ in range(100)] + [("fr", made_up(rnd, "fr", 60)) for _ in range(100)]
    rows += [rows[0]] * 400 + [("fr", None), ("fr", ""), (None, "x")]
    df = spark.createDataFrame(rows, "lang string, text string")
    cfg = langid.LangConfig(per_language=40)
    got = langid.sample(df, cfg, "text", "lang")
    assert sorted(r.lang for r in got) == ["de"] * 40 + ["fr"] * 40
    assert len({r.text for r in got}) == 80
    net = langid.train(df, langid.LangConfig(per_language=80))
    held = [(lang, made_up(rnd, lang, 30).encode()) for lang in ("de", "fr") for _ in range(50)]
    found = net.predict_many([t for _, t in held])
    assert sum(net.languages[k] == lang for (k, _), (lang, _) in zip(found, held, strict=True)) >= 95


def test_three_hundred_languages_are_learned(spark):
    rnd = random.Random(9)
    names = [f"l{i:03d}" for i in range(300)]
    df = spark.createDataFrame([(n, made_up(rnd, n, 50)) for n in names for _ in range(8)], "lang string, text string")
    net = langid.train(df, langid.LangConfig(windows=300 * 6, filters=32, epochs=12))
    assert net.languages == names
    found = net.predict_many([made_up(rnd, n, 50).encode() for n in names])
    assert sum(net.languages[k] == n for (k, _), n in zip(found, names, strict=True)) > 200


def test_forward_pass(spark):
    """The lookup tables give what the filters say, position by position."""
    rng = np.random.default_rng(2)
    net = langid.ByteCNN(["a", "b", "c"], langid.LangConfig(window=20, filters=3))
    net.bias, net.out_bias = rng.normal(size=9).astype(np.float32), rng.normal(size=3).astype(np.float32)
    x = rng.integers(0, 256, (5, 20)).astype(np.uint8)
    for row, got in zip(x, net.log_probabilities(x), strict=True):
        h = []
        for w in net.w:
            at = [sum(w[o][row[p + o]] for o in range(len(w))) for p in range(20 - 3)]
            h.append(np.max(at, 0))
        z = np.maximum(np.concatenate(h) + net.bias, 0) @ net.out + net.out_bias
        assert np.allclose(got, z - np.log(np.exp(z).sum()), atol=1e-4)

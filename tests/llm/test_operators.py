"""Brute-force comparisons and defined cases of the training-data operators."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from regspark.llm import chat, graph, langid, licenses, mixing, neardup, packing, pii, quality, queries, substring, topk

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RNG = random.Random(5)
VOCAB = ["la", "mer", "über", "sun", "río", "x1", "tree", "stone", "blue", "of"]
LONG = " ".join(RNG.choice(VOCAB) + str(RNG.randrange(400)) for _ in range(6000))
PASSAGE = " ".join(f"p{i}" for i in range(40))

TEXTS = [None, "", "   \n\t ", "one", "a b c d", LONG, LONG, LONG.replace("la1", "la2"), PASSAGE + " tail one",
         "head two " + PASSAGE, PASSAGE + "\n" + PASSAGE, "x " * 60, "MIT License", "mit\nlicense. MIT license",
         "Licensed under CC BY-NC 4.0.\nGNU General Public License", "mail a.b@c-d.org, +1 (988) 555-2485 and 10.0.0.256",
         "card 4111 1111 1111 1111 ip 1.2.3.4 password=ab12cd34ef56ab78 é@x.fr 😀 <|endoftext|>", "café über straße 漢字",
         "12345 --- 678", "9" * 20000, "no end " * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, "src", i) for i, t in enumerate(TEXTS)]
    rows += [(5, LONG, "en", "src", 0), (None, PASSAGE + " tail one", None, None, None), (40, PASSAGE, "de", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({"id": F.lit("x"), "th": F.lit(1), "word": F.lit("w"), "blocks": F.lit(0)})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("1 = 0")


def shingles(t):
    w = WORDS.findall((t or "").translate(LOW))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


# -- 1 license scans ------------------------------------------------------------------------

def test_licenses(spark, docs, empty):
    got = sorted(((r.doc_id if r.doc_id is not None else -9, r) for r in licenses.scan_licenses(docs).collect()), key=lambda x: x[0])
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    texts = {**dict(enumerate(TEXTS)), -9: PASSAGE + " tail one", 40: PASSAGE}
    for i, r in got:
        low = (texts[i] or "").translate(LOW)
        words = split.findall(low)
        assert r.n_words == len(words)
        places = sorted((k, lab) for p, lab in licenses.PHRASES for k in range(len(words)) if words[k:k + len(p.split())] == p.split())
        assert sorted((p["start"], p["label"]) for p in r.places or []) == places
        want = set()
        for lab, t in licenses.TEMPLATES:
            tw = set(licenses.template_words(t))
            size = licenses.reach(t)
            for k in range(0, len(words), size):
                if len(tw & set(words[k:k + 2 * size])) >= licenses.needed(len(tw), 0.8):
                    want.add(lab)
        assert set(r.labels or []) == want, i
    assert licenses.scan_licenses(empty).count() == 0


WRAPPED = {  # the usual layout of notices in files: wrapped lines, comment marks, text before and behind
    "mit": """// Copyright (c) the authors
// Permission is hereby granted, free of charge, to any person obtaining a copy
// of this software and associated documentation files (the "Software"), to deal
// in the Software without restriction""",
    "bsd": """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:""",
    "mpl": """# This Source Code Form is subject to the terms of the Mozilla Public

# License, v. 2.0. If a copy of the MPL was not distributed with this""",
    "cc0": """To the extent possible under law, the author(s) have dedicated
all copyright and related and neighboring
rights to this work to the public domain. To the extent possible under law,
the author has waived all copyright and related or neighboring
rights to this work.""",
    "gpl": """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License"""}


def test_wrapped_notices(spark):
    filler = " ".join(f"w{i}" for i in range(1000))
    rows = [(f"{lab}-{n}", f"{filler[:n]}\n{text}\n{filler}") for lab, text in WRAPPED.items() for n in (0, 31, 97, 3900)]
    rows += [("none", "Free software is software; the work is under way, and the source of this copy is the author's own. " + filler),
             ("apart", "licensed " + filler + " mozilla " + filler + " public license source code form subject terms")]
    got = {r.doc_id: (r.labels, r.containment) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    for name, (labels, share) in got.items():
        if name in ("none", "apart"):
            assert labels is None, name
        else:
            assert labels == [name.split("-")[0]] and share >= 0.8, name


# -- 2 exact top-k --------------------------------------------------------------------------

def test_topk(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in rng.normal(0, 1 + i % 5, 8)]) for i in range(400)]
    vectors += [(i, [0.5] * 8) for i in range(400, 600)] + [(600, None), (601, [1.0, None]), (602, [float("nan")] * 8),
                                                            (603, [float("inf")] * 8), (None, [1.0] * 8), (604, []), (605, [2.0, 3.0]), (5, vectors[5][1])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("norm", F.lit("n"))
    cfg = topk.TopKConfig(bucket=64, buckets_a_group=2, query_block=4, blocks_a_group=2)
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("id") % 20 == 0, cfg).collect())
    good = {i: [int(np.floor(64 * x)) for x in v] for i, v in vectors
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in (i for i in good if i % 20 == 0):
        scored = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q)
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored[:20])]
    assert got == sorted(want)
    assert topk.top_k(df.filter("1 = 0"), F.col("id") % 20 == 0, cfg).count() == 0


# -- 3 substring dedup ----------------------------------------------------------------------

def brute_substrings(rows):
    seen, out = {}, []
    for d, t in rows:
        w = WORDS.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            g = tuple(w[k:k + 20])
            if g in seen:
                gone[k:k + 20] = [True] * 20
            else:
                seen[g] = d
        out.append((d, len(w), sum(gone), " ".join(x for x, y in zip(w, gone) if not y)))
    return out


def test_substrings(spark, docs, empty):
    once = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    got = sorted(tuple(r) for r in substring.dedup_substrings(once).collect())
    assert got == sorted(brute_substrings(sorted([*enumerate(TEXTS), (40, PASSAGE)])))
    every = substring.dedup_substrings(docs).collect()
    assert len(every) == docs.count()
    assert len({tuple(r) for r in every if r.doc_id == 5}) == 1  # a repeated row is the same document
    assert next(r for r in every if r.doc_id is None).n_removed == 0  # a null id sorts first
    assert substring.dedup_substrings(empty).count() == 0


def test_cover():
    substring.check_cover(substring.SubstringConfig())
    with pytest.raises(ValueError):
        substring.check_cover(substring.SubstringConfig(cover=(0, 1, 3)))


def test_substrings_random(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(90)))) for i in range(60)]
    rows += [(i, " ".join(["z"] * rng.randrange(60))) for i in range(60, 70)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(tuple(r) for r in substring.dedup_substrings(df).collect()) == sorted(brute_substrings(rows))


# -- 4 PII ----------------------------------------------------------------------------------

def test_pii_patterns():
    plain = {"email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
             "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
             "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}
    rng = random.Random(4)
    for _ in range(3000):
        t = "".join(rng.choice("ab@@..--1123 +(4é😀") for _ in range(rng.randrange(60)))
        want = []
        for kind, p in plain.items():
            for m in p.finditer(t):
                digits = re.sub("[^0-9]", "", m.group())
                if (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))
                        or kind == "card" and 13 <= len(digits) <= 19 and pii.luhn(digits)
                        or kind == "phone" and 9 <= len(digits) <= 15):
                    want.append((kind, *m.span()))
        assert pii.base_spans(t) == want, t


def test_pii(docs, empty):
    got = pii.find_pii(docs).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: [(s["kind"], s["start"], s["end"], s["base"]) for s in r.spans] for r in got if r.doc_id is not None}
    assert by[0] == by[1] == [] and [s[0] for s in by[15]] == ["email", "phone"]
    t = TEXTS[16]
    assert {(k, t[a:b]) for k, a, b, _ in by[16]} >= {("card", "4111 1111 1111 1111"), ("ip", "1.2.3.4"), ("secret", "ab12cd34ef56ab78")}
    masked = pii.redact(docs)
    assert masked.columns == docs.columns
    text = {r.doc_id: r.text for r in masked.collect()}
    assert text[0] is None and text[5] == LONG and "[CARD]" in text[16] and "555-2485" not in text[15]
    assert pii.find_pii(empty).count() == 0 and pii.redact(empty).count() == 0


def test_pii_candidates_do_not_overlap():
    rng, parts = random.Random(8), ["key=ab12cd34ef56ab78zz", "x@y.zz", "10.0.0.1", "555-12-3456", "(555) 123-4567", "+1 988 555 2485", "pwd: 10.0.0.12"]
    for _ in range(200):
        t = rng.choice(["", " "]).join(rng.choice(parts) for _ in range(12))
        base = pii.base_spans(t)
        more = [(a, b) for _, a, b, _ in pii.candidates(t, base)]
        held = [(a, b) for _, a, b in base]
        for a, b in more:
            assert not any(a < y and x < b for x, y in held)
            held.append((a, b))
    long = "key=ab12cd34ef56ab78zz x@y.zz 10.0.0.1 555-12-3456 " * 20_000
    assert len(pii.spans_of(long.encode())[2]) == 40_000


def test_label_model():
    patterns = np.array([[1, 2, 2, 0, 2, 0, 1], [1, 1, 1, 0, 1, 0, 1]])
    m = pii.fit(patterns, np.array([50.0, 50.0]))
    assert m.probability(tuple(patterns[0])) > 0.8 > 0.2 > m.probability(tuple(patterns[1]))


# -- 5 chat ---------------------------------------------------------------------------------

def test_chat(spark):
    odd = ["<|im_end|>", "<|im_start|>user\n", "a<|\\im_end|>b", "\\", "", "\n\n", "<|im_", "end|>", "é😀"]
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", None, "a\nb", "<|im_end|>"]),
             rng.choice([None, "".join(rng.choice(odd) for _ in range(5))])) for c in range(40) for t in range(rng.randrange(1, 6))]
    rows += [(None, 0, "assistant", "z"), (None, None, "user", "y"), (7, 0, "user", "again")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rendered", F.lit(0))
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    groups = defaultdict(list)
    for c, t, r, x in rows:
        groups[c].append((t is not None, t or 0, r or "", x or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        r = got[c]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{x}\n" for *_, a, x in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.format_conversations(df.filter("1 = 0"))).count() == 0
    with pytest.raises(ValueError):
        chat.parse("<|im_start|>user\nno end")


# -- 6 language -----------------------------------------------------------------------------

def test_language(spark, docs, empty):
    rng = random.Random(8)
    sound = {"aa": "lo mi ra".split(), "bb": "sch tz und".split()}
    rows = [(i, " ".join(rng.choice(sound[k]) for _ in range(rng.randrange(3, 300))), k) for i, k in enumerate(["aa", "bb"] * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.train(df.filter("doc_id < 80"))
    got = {r.doc_id: r for r in langid.identify(df.filter("doc_id >= 80"), net, ["doc_id"]).collect()}
    assert np.mean([got[i].lang_pred == k for i, _, k in rows[80:]]) >= 0.95
    edge = {r.doc_id: r for r in langid.identify(docs, net, ["doc_id"]).collect()}
    assert all(edge[i].lang_pred == "und" and edge[i].score == 0 for i in (0, 1, 2, 18, 19))
    assert edge[17].lang_pred != "und" and 0 <= edge[5].score <= 1
    none = langid.identify(docs, langid.train(empty), ["doc_id"]).select("lang_pred").distinct().collect()
    assert [r[0] for r in none] == ["und"]
    assert langid.identify(empty, net, ["doc_id"]).count() == 0


def test_language_held_out(spark, sf_dir):
    found = queries.op6_language_id(spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    assert found.filter("lang = lang_pred").count() >= 0.95 * found.count()


# -- 7 quality ------------------------------------------------------------------------------

def brute_counts(t):
    t = t or ""
    w = WORDS.findall(t)
    lines, seen, dup = t.split("\n"), set(), 0
    for x in lines:
        if WORDS.search(x):
            dup += x in seen
            seen.add(x)
    tri = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if tri[tuple(w[i:i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit)


def test_quality_counts(docs, empty):
    texts = [*TEXTS, "a\nb\na\n\n\na b\na", "é#\né#\n \n ", "x y z x y z", "x y\nz x y z"]
    got = quality.rule_counts([None if t is None else t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert tuple(int(got[c][i]) for c in quality.COUNTS) == brute_counts(t), t
    report = quality.quality_report(docs).collect()
    assert len(report) == docs.count()
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in report)
    assert all(not r.kept for r in report if r.base_failed)
    assert quality.quality_report(empty).count() == 0 and quality.keep_good(docs).columns == docs.columns


def test_kneser_ney(spark):
    texts = [b"abcabd", b"abe\nxy", b"", b"zzzz"]
    keys, counts = np.unique(np.concatenate([quality.ngrams([t])[0] for t in texts]), return_counts=True)
    m = quality.KneserNey(keys, counts)
    df = spark.createDataFrame([(t.decode(),) for t in texts], "text string").repartition(3)
    assert sorted(map(tuple, quality.count_ngrams(df).collect())) == sorted(zip(keys.tolist(), counts.tolist()))
    for context in (keys[0] >> 6, keys[3] >> 6, 12345):  # probabilities after any context sum to one
        p = np.exp(m.log_probability((np.int64(context) << 6) + np.arange(64)).astype(float)).sum()
        assert abs(p - 1) < 1e-3


def test_quality_keeps_clean(spark):
    d = "/root/testdata/sf0.01"
    r = queries.op7_quality_rules(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("not base_failed")
    assert r.filter("quality = 1 and not kept").count() == 0
    junk = r.filter("quality = 0 and toxic = 0")
    assert 4 * junk.filter("not kept").count() >= 3 * junk.count()


def test_quality_hot_copies(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    hot = docs.limit(1).withColumns({"text": F.lit(LONG), "lang": F.lit("en")})
    copies = spark.range(docs.count() // 2).crossJoin(hot.drop("doc_id")).withColumnRenamed("id", "doc_id")
    good = spark.read.parquet(f"{d}/labels.parquet").filter("quality = 1").select("doc_id").distinct()
    both = docs.join(good, "doc_id").withColumn("doc_id", F.col("doc_id") + 10_000_000).select("doc_id", "text", "lang").unionByName(
        copies.select("doc_id", "text", "lang"))
    r = quality.quality_report(both).filter("doc_id >= 10000000 and not base_failed")
    assert r.filter("not kept").count() == 0


def test_quality_many_languages(spark, monkeypatch):
    rows = [(i, f"word{i % 7} " * 3 + " ".join(f"w{i}x{k}" for k in range(60)), None if i % 5 == 0 else f"l{i % 3}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    few = sorted(map(tuple, quality.quality_report(df).collect()))
    monkeypatch.setattr(quality, "MAX_BROADCAST", 0)
    assert sorted(map(tuple, quality.quality_report(df).collect())) == few


# -- 8 packing ------------------------------------------------------------------------------

def test_packing(spark, docs, empty):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    args = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    one = docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).repartition(2, "doc_id")
    tok, pieces = Tokenizer.from_file(args[0]), defaultdict(list)
    bins = defaultdict(list)
    for r in packing.pack_documents(one, *args).collect():
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    for i, t in [*enumerate(TEXTS), (40, PASSAGE)]:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            part = np.array(ids[r.start:r.start + r.length], "<u4").tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(part))
            at += r.length
        assert at == len(ids)
    for rows in bins.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == list(np.cumsum([0, *[r.length for r in rows]])[:-1]) and sum(r.length for r in rows) <= 1024
    assert packing.pack_documents(docs, *args).agg(F.sum("length")).first()[0] > 0 and packing.pack_documents(empty, *args).count() == 0


def test_place_limits():
    rng = np.random.default_rng(1)
    cfg = packing.PackingConfig(tokens=100, segments=5, loss=60)
    tokens = rng.integers(1, 60, 300)
    loss = (tokens * rng.random(300)).astype(int)
    bins = packing.place(tokens, loss, cfg)
    assert sorted(i for b in bins for i in b) == list(range(300))
    assert all(tokens[b].sum() <= 100 and loss[b].sum() <= 60 and len(b) <= 5 for b in bins)


# -- 9 near-dedup ---------------------------------------------------------------------------

def brute_components(rows):
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j < i and sets[i] and sets[j]:
                c = len(sets[i] & sets[j])
                if 100 * c >= 75 * (len(sets[i]) + len(sets[j]) - c):
                    a, b = sorted((find(i), find(j)))
                    parent[b] = a
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_neardup(spark, docs, empty):
    rng = random.Random(9)
    rows = [*enumerate(TEXTS)]
    for g in range(6):  # chains and stars of near copies
        base = [f"g{g}w{i}" for i in range(120)]
        for k in range(14):
            w = list(base)
            for _ in range(rng.randrange(6)):
                w[rng.randrange(120)] = f"e{rng.randrange(9999)}"
            rows.append((100 + 20 * g + k, " ".join(w)))
            base = w if g % 2 else base
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.id: (r.n, r.component) for r in neardup.near_duplicates(df, neardup.NearDupConfig(block=4)).collect()}
    assert got == brute_components(rows)
    every = neardup.near_duplicates(docs).collect()
    assert len(every) == docs.count() and {r.component for r in every if r.id is None} == {8}
    kept = neardup.drop_near_duplicates(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and len(ids) == len(set(ids)) and 5 in ids and 6 not in ids and {0, 1, 2} <= set(ids)
    assert neardup.near_duplicates(empty).count() == 0 and neardup.drop_near_duplicates(empty).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 150), (120, 150), (7, 7)]
    got = {r.vertex: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 120, 150), 100)}


def test_intersections():
    rng = np.random.default_rng(3)
    a, b = ([np.unique(rng.integers(0, 90, rng.integers(1, 40)).astype(np.uint64)) for _ in range(n)] for n in (30, 25))
    want = [[len(set(x.tolist()) & set(y.tolist())) for y in b] for x in a]
    assert neardup.intersections(a, b, np.ones((30, 25), bool), 7).tolist() == want


# -- 10 mixing ------------------------------------------------------------------------------

def test_mixing(spark, docs, empty):
    rng = random.Random(10)
    kinds = {"clean": ("river stone tree", 1, 0), "poor": ("#### junk ||||", 0, 0), "toxic": ("stupid trash fool", 0, 1)}
    rows, marks, of = [], [], {}
    for i in range(300):
        k = rng.choice(["clean", "clean", "poor", "toxic"])
        of[i] = k
        rows.append((i, " ".join(rng.choice(kinds[k][0].split()) for _ in range(60))))
        if i < 200:
            marks.append((i, *kinds[k][1:]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (None, 1, 0), (9999, 1, 1), (0, None, None), marks[1]], "doc_id long, quality int, toxic int")
    cfg = mixing.MixConfig(shares={"clean": 0.7, "poor": 0.2, "toxic": 0.1}, budget=1.0)
    got = mixing.mix_report(df, labels, cfg).collect()
    assert all(r.domain == of[r.doc_id] for r in got)
    total = sum(r.n_tokens for r in got)
    for d, share in cfg.shares.items():
        assert abs(sum(r.rate * r.n_tokens for r in got if r.domain == d) - share * total) < 0.03 * total
    assert all(r.rate >= 0 and abs(r.copies - r.rate) < 1 for r in got)
    out = mixing.resample(df.withColumn("copies", F.lit("c")), labels, cfg)
    assert Counter(r.doc_id for r in out.collect()) == Counter({r.doc_id: r.copies for r in got if r.copies})
    assert mixing.mix_report(docs, labels).count() == docs.count()
    assert mixing.mix_report(docs, labels.filter("1 = 0")).select("domain").distinct().collect()[0][0] == "all"
    assert mixing.mix_report(empty, labels).count() == 0 and mixing.resample(empty, labels).count() == 0

"""Tests of cases where an operator once did less than the whole job."""

from __future__ import annotations

import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest

from regspark.llm import chat, mixing, packing, pii


@pytest.mark.parametrize("share", [0.005, 0.01, 0.11])
def test_mixing_rare_domain_reaches_its_target(spark, share):
    """The production configuration drops a domain of target 0, however rare it is."""
    n = 2000
    kinds = {"toxic": ("stupid trash fool", 0, 1), "poor": ("#### junk ||||", 0, 0), "clean": ("river stone tree", 1, 0)}
    rng, rows, marks = random.Random(3), [], []
    for i in range(n):
        k = "toxic" if i < share * n else "poor" if i < 0.3 * n else "clean"
        rows.append((i, " ".join(rng.choice(kinds[k][0].split()) for _ in range(60))))
        marks.append((i, *kinds[k][1:]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    totals = {r.domain: r for r in mixing.mix_totals(df, labels).collect()}
    assert totals["toxic"].target == 0 and totals["toxic"].reached < 0.025 * totals["toxic"].tokens
    for d in ("clean", "poor"):
        assert abs(totals[d].reached - totals[d].target) < 0.02 * totals[d].target


def test_mixing_rates_are_the_optimum(spark):
    """The rates equal those of exact coordinate descent, also where they are cut at 0."""
    rng = random.Random(4)
    cfg = mixing.MixConfig(shares={"a": 0.6, "b": 0.4, "c": 0.0}, tolerance=1e-8)
    cells = []
    for i in range(40):
        p = [rng.random() ** 3 + 1e-3 for _ in range(3)]
        cells.append((i, rng.randrange(1, 1000), *[x / sum(p) for x in p]))
    df = spark.createDataFrame(cells, "cell int, tokens long, p_0 double, p_1 double, p_2 double")
    rate = {r.cell: r.rate for r in mixing.fit_rates(df, ["a", "b", "c"], cfg).collect()}
    total = sum(c[1] for c in cells)
    t, p = np.array([c[1] for c in cells]) / total, np.array([c[2:] for c in cells])
    aim = cfg.budget * np.array(list(cfg.shares.values()))
    weight = np.array([min(1 / a, cfg.most_weight) if a else 1.0 for a in aim])
    anchor = p @ (aim / (t @ p))
    r = anchor.copy()
    for _ in range(3000):
        for c in range(len(r)):
            rest = (t * r) @ p - t[c] * r[c] * p[c] - aim
            r[c] = max(0.0, (cfg.pull * anchor[c] - weight @ (rest * p[c])) / (cfg.pull + t[c] * weight @ p[c] ** 2))
    assert any(x == 0 for x in r)
    assert max(abs(rate[c] - x) for c, x in enumerate(r)) < 1e-5


def _overlapping(n, seed):
    """Domains with common words: a tenth of a toxic document's words are toxic, of a poor one's half are junk."""
    rng, rows, marks = random.Random(seed), [], []
    common = [f"w{i}" for i in range(200)]
    for i in range(n):
        kind = "toxic" if i % 10 == 0 else "poor" if i % 10 == 1 else "clean"
        share, own = {"toxic": (0.1, ["stupid", "trash", "fool"]), "poor": (0.5, ["####", "zz", "qq"]), "clean": (0, ["-"])}[kind]
        rows.append((i, " ".join(rng.choice(own) if rng.random() < share else rng.choice(common) for _ in range(rng.randrange(20, 200)))))
        if i % 3:
            marks.append((i, int(kind != "poor"), int(kind == "toxic")))
    return rows, marks


def test_mixing_keeps_good_documents_of_common_words(spark):
    rows, marks = _overlapping(2000, 6)
    marks = [(i, q, 1 - t if i % 97 == 0 else t) for i, q, t in marks]  # and a few wrong labels
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    report = mixing.mix_report(df, labels).collect()
    kind = {i: "toxic" if i % 10 == 0 else "poor" if i % 10 == 1 else "clean" for i, _ in rows}
    good = [r for r in report if kind[r.doc_id] == "clean"]
    bad = [r for r in report if kind[r.doc_id] == "toxic"]
    assert sum(r.copies > 0 for r in good) >= 0.95 * len(good)
    assert sum(r.copies == 0 for r in bad) >= 0.85 * len(bad)
    totals = {r.domain: r for r in mixing.mix_totals(df, labels).collect()}
    for d in ("clean", "poor"):
        assert abs(totals[d].reached - totals[d].target) < 0.02 * totals[d].target
    assert totals["toxic"].reached < 0.2 * totals["toxic"].tokens
    shares = {(r.domain, r.calibrating): r for r in mixing.kept_share(mixing.mix_report(df, labels), labels).collect()}
    assert shares["clean", True].dropped < 0.05 * shares["clean", True].documents


def test_mixing_many_cells_join(spark, monkeypatch):
    rows, marks = _overlapping(300, 7)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    want = sorted(map(tuple, mixing.mix_report(df, labels).collect()))
    monkeypatch.setattr(mixing, "MAX_BROADCAST", 0)
    assert sorted(map(tuple, mixing.mix_report(df, labels).collect())) == want


def test_pii_gate_skips_nothing():
    """Texts without digits, @ or = may hold secrets too; the gate gives what the patterns give."""
    for t, secret in (("password: CorrectHorseBatteryStaple", "CorrectHorseBatteryStaple"),
                      ("token:'abcdefgh'", "abcdefgh"), ("id ABCDEFGHIJKLMNOPQRST end", "ABCDEFGHIJKLMNOPQRST")):
        assert [t[a:b] for _, a, b, _ in pii.spans_of(t.encode())[2]] == [secret]
    rng = random.Random(5)
    parts = ["key", ":", "=", " ", "'", "abcdefgh", "ABCDEFGHIJ", "KLMNOPQRST", "é", "\n", "a@b.cc", "7", "x", "-", "pass: "]
    for _ in range(20_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 9)))
        base = pii.base_spans(t)
        assert pii.spans_of(t.encode())[1:] == (base, pii.candidates(t, base)), t


def test_pii_pairs_of_any_length():
    """Long values and names are found whole, short ones as by the bounded pattern, all in linear time."""
    for name, value in (("token", "eyJ" + "aB3-" * 1249 + "z"), ("a" * 40, "ab12cd34ef56ab78"), ("k" * 400, "Q9" * 400)):
        t = f"see {name}={value}, end"
        assert [t[a:b] for k, a, b, _ in pii.spans_of(t.encode())[2] if k == "secret"] == [value]
    bounded = re.compile(r"(?<![A-Za-z0-9_])([A-Za-z][A-Za-z0-9_-]{1,30})[ ]?[=:][ ]?([\"']?)"
                         r"([A-Za-z0-9+/_.-]{8,512})(?![A-Za-z0-9+/_.-])")
    rng = random.Random(6)
    for _ in range(50_000):
        t = "".join(rng.choice("ab1_--==: '.\"+é" + "A" * 6) for _ in range(rng.randrange(1, 32)))
        assert [m.span(k) for m in pii.PAIR.finditer(t) for k in (1, 3)] == [m.span(k) for m in bounded.finditer(t) for k in (1, 3)], t
    start = time.process_time()
    for t in ("a-" * 500_000, "1-" * 500_000, "-" * 1_000_000, "aa=aaaaaaa " * 100_000, "a" * 1_000_000, "aa=" + "b" * 1_000_000):
        sum(1 for _ in pii.PAIR.finditer(t))
    assert time.process_time() - start < 5


def test_packing_limits_loss_of_conversations(spark):
    """Prompt tokens bear no loss, and the limit on loss-bearing tokens binds before that on tokens."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    rng, turns = random.Random(8), []
    for c in range(120):
        for n in range(rng.randrange(1, 6)):
            words = " ".join(rng.choice(["sun", "río", "tree"]) + str(rng.randrange(99)) for _ in range(rng.choice([3, 30, 400])))
            turns.append((c, n, "assistant" if c % 3 == 0 or n % 2 else "user", words))
    formatted = chat.format_conversations(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string"))
    made = chat.examples(formatted)
    args = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    tok, want = Tokenizer.from_file(args[0]), {}
    for r in made.collect():
        said = [t for c, _, role, t in sorted(turns) if c == r.conv_id and role == "assistant"]
        assert [r.text[x.start:x.end] for x in r.loss] == said
        found = tok.encode(r.text, add_special_tokens=False)
        want[r.conv_id] = (len(found.ids) + 1, sum(any(a < x.end and b > x.start for x in r.loss) for a, b in found.offsets))
    bins, of = defaultdict(list), defaultdict(list)
    for r in packing.pack_documents(made, *args, key="conv_id", loss="loss").collect():
        bins[r.sequence_id].append(r)
        of[r.conv_id].append(r)
    assert {c: (sum(r.length for r in x), sum(r.loss_tokens for r in x)) for c, x in of.items()} == want
    sizes = [(sum(r.length for r in x), sum(r.loss_tokens for r in x)) for x in bins.values()]
    limit = packing.EXAMPLES
    assert limit.loss < limit.tokens and all(n <= limit.tokens and m <= limit.loss for n, m in sizes)
    assert any(m == limit.loss and n < limit.tokens for n, m in sizes) and any(n > limit.loss for n, _ in sizes)
    assert all(sorted(r.start for r in x)[0] == 0 for x in of.values())

"""Personal data: base patterns, and further spans by weak supervision.

Base spans (email, ip, card, phone) follow their patterns and checks exactly and always stay.
Further candidates (``secret``: the value of a key=value pair, or an access key id; ``phone``: numbers without
a country code; ``ssn``; ``iban``) are voted on by labelers: the shape of the value, a
gazetteer of key names, context words before it, the mix of its characters, a checksum.
Expectation-maximisation over the counts of vote patterns of all documents gives each
labeler's reliability and a posterior per pattern; a logistic classifier trained on these
posteriors decides each span. There are at most ``len(EXTRA) * 3^5 * 4`` patterns, whatever
the size of the corpus, so only that many counts reach the driver.

All patterns are matched in time linear in the text, also over very long runs of digits or
letters. Defined cases: null text is empty and has no spans (its redacted form stays
null); rows repeat as given; an empty table gives an empty result and needs no model;
further columns are kept by ``redact``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from regspark.llm.common import as_batch, chunks

BASE = ("email", "ip", "card", "phone")
EXTRA = ("phone", "secret", "ssn", "iban")
KINDS = ("email", "ip", "card", "phone", "secret", "ssn", "iban")
LABELERS = ("shape", "gazetteer", "context", "mixture", "checksum")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# A name is the rest of its run of name characters from the first part between dashes that starts with a letter.
PAIR = re.compile(r"(?<![A-Za-z0-9_-])(?:(?:[0-9_][A-Za-z0-9_]*+)?-)*+([A-Za-z][A-Za-z0-9_-]++)[ ]?[=:][ ]?"
                  r"([\"']?)([A-Za-z0-9+/_.-]{8,}+)")
NATIONAL = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")

# Gazetteer of names and words that announce personal data (fixed values).
NAMES = {
    "secret": {"password", "passwd", "pwd", "pass", "token", "secret", "api_key", "apikey", "access_key",
               "auth_token", "private_key", "client_secret", "key", "passwort", "kennwort", "clave"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "cell", "fax", "telefon", "telefono"},
    "ssn": {"ssn", "social", "security"},
    "iban": {"iban", "account", "konto", "compte", "cuenta"},
}
ABSTAIN, NO, YES = 0, 1, 2
ACCESS_KEY = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Z]{4}[A-Z0-9]{16}(?![A-Za-z0-9+/_-])")
WORD = re.compile(r"[A-Za-z_]+")
ANY_DIGIT = re.compile(rb"[0-9]")
COLON_VALUE = re.compile(rb":[ ]?[\"']?[A-Za-z0-9+/_.-]{8}")
CAPITALS = re.compile(rb"[A-Z]{20}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(t: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain: each @ takes the run of local characters before it."""
    out, free, at = [], 0, t.find("@")
    while at >= 0:
        start = at
        while start > free and t[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(t, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = t.find("@", max(at + 1, free))
    return out


def base_spans(t: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(t)]
    for m in IP.finditer(t):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(t):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(t):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


def _iban_ok(v: str) -> bool:
    s = v.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def votes(t: str, kind: str, start: int, end: int, name: str) -> tuple[int, ...]:
    """One vote of each labeler on a candidate span."""
    v = t[start:end]
    before = {w.lower() for w in WORD.findall(t[max(0, start - 48):start])}
    kinds_of = [any(f(c) for c in v) for f in (str.isdigit, str.islower, str.isupper)]
    if kind == "secret":
        shape = YES if re.fullmatch(r"[0-9a-fA-F]{16,}|[A-Za-z0-9+/_-]{20,}", v) else NO
        gazetteer = ABSTAIN if not name else YES if name.lower() in NAMES[kind] else NO
        mixture = YES if sum(kinds_of) >= 2 and len(set(v)) >= 6 else NO
        checksum = ABSTAIN
    else:
        shape = YES
        gazetteer = YES if before & NAMES[kind] else ABSTAIN
        mixture = YES if len(set(v) - set(" .-()")) >= 4 else NO
        checksum = (YES if _iban_ok(v) else NO) if kind == "iban" else (
            NO if kind == "ssn" and (v[:3] in ("000", "666") or v[0] == "9" or v[4:6] == "00" or v[7:] == "0000")
            else ABSTAIN)
    context = YES if before & set().union(*NAMES.values()) else ABSTAIN
    return shape, gazetteer, context, mixture, checksum


def candidates(t: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int, tuple]]:
    """Further spans that overlap no base span and no earlier candidate, with their pattern."""
    found = [("secret", *m.span(3), m.group(1)) for m in PAIR.finditer(t)] if "=" in t or ":" in t else []
    for kind, pattern in (("iban", IBAN), ("secret", ACCESS_KEY), ("ssn", SSN), ("phone", NATIONAL)):
        found += [(kind, *m.span(), "") for m in pattern.finditer(t)]
    out, starts, ends = [], [], []
    for a, b in sorted((a, b) for _, a, b in taken):  # merged, so a search finds what overlaps a candidate
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    for kind, a, b, name in found:
        i = bisect_left(starts, b)
        if i == 0 or ends[i - 1] <= a:
            starts.insert(i, a)
            ends.insert(i, b)
            out.append((kind, a, b, (EXTRA.index(kind), *votes(t, kind, a, b, name), min(3, (b - a) // 12))))
    return out


def spans_of(value: bytes | None) -> tuple[str, list, list]:
    """Text, base spans and candidates; none without @, =, a digit, a value after a colon or 20 capital letters."""
    if not value or not (b"@" in value or b"=" in value or ANY_DIGIT.search(value)
                         or (b":" in value and COLON_VALUE.search(value)) or CAPITALS.search(value)):
        return "", [], []
    t = value.decode()
    base = base_spans(t)
    return t, base, candidates(t, base)


# -- label model and classifier -------------------------------------------------------------

@dataclass(frozen=True)
class SpanModel:
    """Reliabilities found by EM and the weights of the span classifier."""

    prior: float
    true_yes: tuple
    false_yes: tuple
    weights: tuple
    threshold: float = 0.5

    def probability(self, pattern: tuple) -> float:
        return float(1 / (1 + np.exp(-features(np.array([pattern])) @ np.array(self.weights)))[0])


def features(patterns: np.ndarray) -> np.ndarray:
    """One column per kind, per labeler and vote, per length class, and a constant."""
    p = np.asarray(patterns, np.int64).reshape(-1, len(LABELERS) + 2)
    cols = [p[:, :1] == np.arange(len(EXTRA))]
    cols += [p[:, 1 + i:2 + i] == np.array([NO, YES]) for i in range(len(LABELERS))]
    cols += [p[:, -1:] == np.arange(4), np.ones((len(p), 1), bool)]
    return np.concatenate(cols, 1).astype(float)


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> SpanModel:
    """EM over vote patterns, then logistic regression on the posteriors; weights are counts."""
    n = len(LABELERS)
    if not len(counts):
        return SpanModel(0.5, (0.8,) * n, (0.2,) * n, tuple(np.zeros(features(np.zeros((1, n + 2))).shape[1])))
    v = patterns[:, 1:1 + n]
    yes, no = v == YES, v == NO
    post = np.clip((yes.sum(1) + 0.5) / (yes.sum(1) + no.sum(1) + 1), 0.05, 0.95)
    for _ in range(rounds):
        a = ((counts * post)[:, None] * yes).sum(0) + 4
        a = a / (((counts * post)[:, None] * (yes | no)).sum(0) + 5)  # smoothed towards 0.8
        b = ((counts * (1 - post))[:, None] * yes).sum(0) + 1
        b = b / (((counts * (1 - post))[:, None] * (yes | no)).sum(0) + 5)  # towards 0.2
        prior = np.clip((counts * post).sum() / counts.sum(), 0.02, 0.98)
        odds = np.log(prior / (1 - prior)) + (yes * np.log(a / b) + no * np.log((1 - a) / (1 - b))).sum(1)
        post = 1 / (1 + np.exp(-odds))
    x, w = features(patterns), np.zeros(features(patterns).shape[1])
    share = counts / counts.sum()
    for _ in range(25):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (share * (p - post)) + 1e-3 * w
        hess = (x * (share * p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-3 * np.eye(len(w))
        w = w - np.linalg.solve(hess, grad)
    return SpanModel(float(prior), tuple(a), tuple(b), tuple(w))


def train(docs: DataFrame, text: str = "text") -> SpanModel:
    """Count the vote patterns of all documents in Spark, then fit."""
    def count(batches):
        total: dict = {}
        for _, texts in chunks(batches, text):
            for value in texts:
                for *_, pattern in spans_of(value)[2]:
                    total[pattern] = total.get(pattern, 0) + 1
        yield as_batch(pa.schema([("pattern", pa.list_(pa.int32())), ("n", pa.int64())]),
                       [list(k) for k in total], list(total.values()))

    rows = (docs.select(text).mapInArrow(count, "pattern array<int>, n long")
            .groupBy("pattern").agg(F.sum("n").alias("n")).collect())
    rows.sort()
    return fit(np.array([r[0] for r in rows], np.int64).reshape(-1, len(LABELERS) + 2),
               np.array([r[1] for r in rows], float))


def decide(model: SpanModel, value: bytes | None, known: dict) -> tuple[str, list, list]:
    """(text, base spans, all spans), each (kind, start, end), by kind as listed and start."""
    t, base, more = spans_of(value)
    extra = []
    for kind, a, b, pattern in more:
        if pattern not in known:
            known[pattern] = model.probability(pattern) >= model.threshold
        if known[pattern]:
            extra.append((kind, a, b))
    place = {k: i for i, k in enumerate(KINDS)}
    order = lambda s: (place[s[0]], s[1])
    return t, sorted(base, key=order), sorted(base + extra, key=order)


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                     T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())])


def find_pii(docs: DataFrame, model: SpanModel | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: (id, spans), spans in order of kind and start."""
    model = model or train(docs, text)
    out_type = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("spans", T.ArrayType(SPAN))])

    def scan(batches):
        schema, known = to_arrow_schema(out_type), {}
        for rows, texts in chunks(batches, "_pii_text"):
            found = []
            for value in texts:
                _, base, every = decide(model, value, known)
                kept = set(base)
                found.append([{"kind": k, "start": a, "end": b, "base": (k, a, b) in kept} for k, a, b in every])
            yield as_batch(schema, rows.column(0), found)

    return docs.select(docs[key].alias("_pii_key"), docs[text].alias("_pii_text")).mapInArrow(scan, out_type)


def mask(t: str, spans: list[tuple[str, int, int]]) -> str:
    """Each run of overlapping spans becomes the upper-case kind of its first span in brackets."""
    out, free = [], 0
    merged: list = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [t[free:a], f"[{kind.upper()}]"]
        free = b
    return "".join([*out, t[free:]])


def redact(docs: DataFrame, model: SpanModel | None = None, text: str = "text") -> DataFrame:
    """The documents with every span masked; other columns as they were."""
    model = model or train(docs, text)
    names = docs.columns
    at = names.index(text)

    def rewrite(batches):
        known: dict = {}
        for rows, texts in chunks(batches, text):
            out = []
            for value in texts:
                t, _, every = decide(model, value, known)
                out.append(mask(t, every) if every else value.decode() if value is not None else None)
            cols = list(rows.columns)
            cols[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(rewrite, docs.schema)

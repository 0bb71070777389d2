"""License scans: an exact set-similarity join of text blocks with license templates.

Blocks are overlapping windows of words, across lines and paragraphs, as notices are wrapped in files.
A template has a reach, the power of two that holds ``SLACK`` times its words; its blocks are the windows of
twice the reach that start at multiples of the reach, so every passage of up to reach words lies whole in one.
A block holds the set of its words; it matches a template of its reach if it contains at
least ``threshold`` of the template's distinct words. Words are ordered by their number
of documents, rarest first. Filters, all exact:

* prefix: a match shares one of the template's ``m - a + 1`` rarest words (m words, of
  which a are needed) and one of the block's ``s - a + 1`` rarest;
* length: a block needs at least ``a`` words of the templates;
* position: at the first shared word, what is left on either side must reach ``a``.

Template words are a bounded parameter (``MAX_TEMPLATE_WORDS``, checked), so they and their counts
are literals; only windows around prefix words leave their row. All steps are
DataFrame functions.

Beside it, phrases are found at every place where their words stand consecutively.

Defined cases: null text is empty; rows repeat as given (rows of one id and text get
equal results); a null id is kept; ties of words in the order go by the word; texts of any length are
scanned whole; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regspark.llm.common import ascii_lower, store

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MAX_TEMPLATE_WORDS = 20_000
SLACK = 1.25

# The phrases and labels of the base scan.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Opening sentences of public licenses and usual notices.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
            "and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the "
            "GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or "
            "neighboring rights to this work"),
)


def template_words(text: str) -> list[str]:
    """Distinct words of a template, in order of first occurrence."""
    low = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower())
    return list(dict.fromkeys(low.split()))


def needed(m: int, threshold: float) -> int:
    """How many of m template words a match must contain."""
    return max(1, math.ceil(round(threshold * m, 9)))


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def reach(text: str) -> int:
    """Words of a passage in which a template is looked for: a power of two."""
    n = len("".join(c if c.isalnum() or ord(c) > 127 else " " for c in text).split())
    return 1 << max(0, math.ceil(math.log2(max(1, SLACK * n))))


def _words(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, th, words): the words of every text."""
    low = ascii_lower(F.coalesce(docs[text], F.lit("")))
    return docs.select(docs[key].alias("id"), F.xxhash64(docs[text]).alias("th"),
                       F.filter(F.split(low, SEPARATOR, -1), lambda w: w != "").alias("words"))


def word_counts(rows: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Number of documents that hold each word of the templates."""
    held = rows.select(F.explode(F.array_intersect("words", strings(vocabulary))).alias("word"))
    return {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}


def _windows(words: Column, size: int, prefixes: list[str], order: list[str]) -> Column:
    """Array of (reach, block, words in global order) of the windows of a reach that hold a prefix word."""
    own = strings(prefixes)
    spots = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array_contains(own, F.get(words, i)))
    near = F.flatten(F.transform(spots, lambda i: F.array(F.floor(i / size), F.floor(i / size) - 1)))
    blocks = F.filter(F.array_distinct(near), lambda k: k >= 0)
    found = F.transform(blocks, lambda k: F.struct(
        F.lit(size).alias("reach"), k.cast("long").alias("block"),
        F.array_intersect(strings(order), F.slice(words, (k * size + 1).cast("int"), 2 * size)).alias("words")))
    return F.when(F.arrays_overlap(words, own), found).otherwise(
        F.array().cast("array<struct<reach:int,block:bigint,words:array<string>>>"))


def _phrase_places(words: Column, phrase: str, label: str) -> Column:
    parts = phrase.split()

    def here(i):
        out = F.get(words, i) == F.lit(parts[0])
        for k, p in enumerate(parts[1:], 1):
            out = out & (F.get(words, i + k) == F.lit(p))
        return F.coalesce(out, F.lit(False))

    spots = F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)
    present = F.array_contains(words, parts[0]) & F.array_contains(words, parts[-1])
    return (F.when(present, F.transform(spots, lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label"))))
            .otherwise(F.array().cast("array<struct<start:bigint,label:string>>")))


def _places(words: Column, phrases) -> Column:
    """Array of (start, label) of every place of every phrase."""
    return F.concat(*[_phrase_places(words, phrase, label) for phrase, label in phrases])


def match_templates(candidates: DataFrame, spark, templates, order: list[str], threshold: float) -> DataFrame:
    """(id, th, reach, block, template, label, containment) of all matches among (id, th, reach, block, words in global order)."""
    place = {w: i for i, w in enumerate(order)}
    index, full = [], []
    for t, (label, text) in enumerate(templates):
        words = sorted(template_words(text), key=place.__getitem__)
        m, a = len(words), needed(len(words), threshold)
        index += [(w, reach(text), t, i + 1, m, a) for i, w in enumerate(words[:m - a + 1])]
        full.append((t, label, words))
    inverted = spark.createDataFrame(index, "word string, reach int, template int, i int, m int, a int")
    whole = spark.createDataFrame(full, "template int, label string, t_words array<string>")
    least = min(a for *_, a in index)
    s = F.size("words")
    rows = (candidates.filter(s >= least)
            .select("id", "th", "reach", "block", "words", s.alias("s"),
                    F.posexplode(F.slice("words", F.lit(1), F.greatest(s - least + 1, F.lit(1)))).alias("j", "word")))
    pairs = (rows.join(F.broadcast(inverted), ["word", "reach"]).withColumn("j", F.col("j") + 1)
             .filter((F.col("s") >= F.col("a")) & (F.col("j") <= F.col("s") - F.col("a") + 1)))
    first = (pairs.groupBy("id", "th", "reach", "block", "words", "s", "template", "m", "a")
             .agg(F.min("i").alias("i"), F.min("j").alias("j"))
             .filter(F.least(F.col("m") - F.col("i"), F.col("s") - F.col("j")) + 1 >= F.col("a")))
    shared = F.size(F.array_intersect("words", "t_words"))
    return (first.join(F.broadcast(whole), "template").withColumn("shared", shared).filter(F.col("shared") >= F.col("a"))
            .select("id", "th", "reach", "block", "template", "label", (F.col("shared") / F.col("m")).alias("containment")))


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = 0.8,
                  key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_words, places (start, label) of phrases, labels and containment of matches."""
    spark = docs.sparkSession
    vocabulary = sorted({w for _, t in templates for w in template_words(t)})
    if len(vocabulary) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates have {len(vocabulary)} words; the bound is {MAX_TEMPLATE_WORDS}")
    rows = _words(docs, key, text)
    counts = word_counts(rows, vocabulary)
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    place = {w: i for i, w in enumerate(order)}
    prefixes: dict[int, set] = {}
    for _, t in templates:
        words = sorted(template_words(t), key=place.__getitem__)
        prefixes.setdefault(reach(t), set()).update(words[:len(words) - needed(len(words), threshold) + 1])

    windows = F.concat(*[_windows(F.col("words"), size, sorted(own), order) for size, own in sorted(prefixes.items())])
    marked = rows.select("id", "th", F.size("words").cast("long").alias("n_words"),
                         F.when(F.size("words") > 0, _places(F.col("words"), phrases)).alias("places"),
                         F.when(F.size("words") > 0, windows).alias("windows"))
    kept = store(marked, "licenses")

    candidates = (kept.filter(F.size("windows") > 0).select("id", "th", "windows").dropDuplicates(["id", "th"])
                  .select("id", "th", F.inline("windows")))
    matches = match_templates(candidates, spark, templates, order, threshold)
    found = (matches.groupBy(F.col("id").alias("m_id"), F.col("th").alias("m_th"))
             .agg(F.collect_set("label").alias("labels"), F.max("containment").alias("containment")))
    return (kept.join(found, [kept["th"] == found["m_th"], kept["id"].eqNullSafe(found["m_id"])], "left")
            .select(F.col("id").alias(key), "n_words", "places", "labels", "containment"))

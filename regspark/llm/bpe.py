"""Byte-pair encoding and decoding of whole texts with a public byte-level vocabulary.

A text is split at the vocabulary's added tokens, then into words by its splitting pattern; each
word's bytes are merged. A short word holds its part boundaries and the ranks of its adjacent
parts in contiguous lists: the least rank is scanned for, its boundary deleted and the two
neighbouring ranks looked up again, until no adjacent parts have a rank. Words above ``LONG``
bytes do the same in numpy with all places of the least rank at once, left to right; that gives equal
ids where every merge uses only results of earlier merges (checked when the vocabulary is read; else
the lists serve all lengths). Words repeat, so a task keeps at most ``CACHE`` merged words.

Rows are encoded and decoded where they are read; nothing is shuffled. Ids are packed as little-endian
unsigned 32-bit integers (``numpy.frombuffer(ids, "<u4")``).

Defined cases: a null text is empty and has no ids; null ids decode to null, ids outside the vocabulary
to nothing, bytes that are no UTF-8 to U+FFFD; rows repeat as given; a null id of a row is
kept; an empty table gives an empty result; texts of any length are encoded whole, in runs of
``RUN`` words; only the named columns are read, so further ones and their names do not matter.
"""

from __future__ import annotations

import json
import unicodedata
from itertools import islice

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from regspark.llm.common import as_batch, chunks

LONG = 256  # bytes of a word
CACHE = 200_000  # words
CACHED_CHARS = 64  # longer words are not kept
RUN = 1 << 16  # words of a text merged at a time
NONE = 1 << 40  # rank of parts that do not merge

# The splitting pattern of byte-level vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 ones for
    themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """A ``tokenizers`` JSON file of a byte-level BPE model without normalizer, prefix space, dropout or word marks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split, added = spec["model"], spec["pre_tokenizer"] or {}, spec["added_tokens"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback",
                           "ignore_merges") if model.get(k)]
        odd += [k for k in ("normalizer", "truncation", "padding") if spec.get(k)]
        odd += [k for a in added for k in ("single_word", "lstrip", "rstrip", "normalized") if a[k]]
        if (odd or model["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space")
                or not split.get("use_regex", True) or (spec["decoder"] or {}).get("type") != "ByteLevel"):
            raise ValueError(f"{path} is no plain byte-level BPE model: {odd or split}")
        self.path, self._library = path, None
        byte_of = {c: b for b, c in enumerate(byte_characters())}

        def raw(token):
            return bytes(byte_of[c] for c in token)

        id_of = {raw(t): i for t, i in model["vocab"].items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pairs = [(raw(a), raw(b)) for a, b in pairs]
        self.added = {a["content"]: a["id"] for a in added}
        self.bytes_of = [b""] * (1 + max([*id_of.values(), *self.added.values()]))
        for t, i in [*id_of.items(), *((c.encode(), i) for c, i in self.added.items())]:
            self.bytes_of[i] = t
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        self.split = regex.compile(SPLIT)

        self.byte_ids = np.array([id_of[bytes([b])] for b in range(256)], np.int64)
        ids = np.array([(id_of[a], id_of[b], id_of[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)
        keys = ids[:, 0] << 32 | ids[:, 1]
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks, self.made = keys[order], order, ids[:, 2]
        self.rank = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.byte_list, self.made_list = self.byte_ids.tolist(), self.made.tolist()
        born = np.full(len(self.bytes_of), -1, np.int64)
        born[ids[:, 2]] = np.arange(len(ids))
        once = len(np.unique(ids[:, 2])) == len(ids)
        self.in_order = once and bool((born[ids[:, :2]].max(1, initial=-1) < np.arange(len(ids))).all())
        self.cache = _Cache(self)

    def merge(self, word: bytes) -> list[int]:
        """Ids of a word: its parts in order, one between each two boundaries, and the ranks of adjacent parts."""
        rank, made = self.rank.get, self.made_list
        parts = [self.byte_list[b] for b in word]
        ranks = [rank(a << 32 | b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            low = min(ranks)
            if low == NONE:
                break
            i = ranks.index(low)
            parts[i] = made[low]
            del parts[i + 1], ranks[i]  # the boundary between the two is gone
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 32 | parts[i], NONE)
            if i < len(ranks):
                ranks[i] = rank(parts[i] << 32 | parts[i + 1], NONE)
        return parts

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE)

    def merge_long(self, word: bytes) -> np.ndarray:
        """``merge`` with all places of the least rank at once."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)]
        if not len(self.pair_keys):
            return ids
        ranks = self._ranks(ids[:-1], ids[1:])
        while len(ranks):
            low = int(ranks.min())
            if low == NONE:
                break
            at = np.flatnonzero(ranks == low)
            place = np.arange(len(at))
            run = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, place, 0))
            at = at[(place - run) % 2 == 0]  # of overlapping places every second one
            ids[at] = self.made[low]
            ids, ranks = np.delete(ids, at + 1), np.delete(ranks, at)
            now = at - np.arange(len(at))
            near = np.concatenate([now - 1, now])
            near = near[(near >= 0) & (near < len(ranks))]
            ranks[near] = self._ranks(ids[near], ids[near + 1])
        return ids

    def packed_word(self, word: str) -> bytes:
        data = word.encode()
        long = len(data) > LONG and self.in_order
        return np.asarray(self.merge_long(data) if long else self.merge(data), "<u4").tobytes()

    def words(self, text: str):
        """The words of a text; by the ``tokenizers`` library where a code point is newer than this Python's tables."""
        if not text.isascii() and any(unicodedata.category(c) == "Cn" for c in set(text)):
            if self._library is None:
                from tokenizers import Tokenizer

                self._library = Tokenizer.from_file(self.path).pre_tokenizer
            return (text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text))
        return self.split.findall(text) if len(text) < RUN else (m.group() for m in self.split.finditer(text))

    def encode(self, text: str) -> bytes:
        """The packed ids of a text."""
        pieces = self.special.split(text) if self.special else [text]
        out = []
        for i, piece in enumerate(pieces):
            if i % 2:
                out.append(np.array([self.added[piece]], "<u4").tobytes())
                continue
            words = iter(self.words(piece))
            while run := b"".join(map(self.cache.__getitem__, islice(words, RUN))):
                out.append(run)
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        table, n = self.bytes_of, len(self.bytes_of)
        ids = np.frombuffer(packed, "<u4")
        if len(ids) and int(ids.max()) >= n:
            ids = ids[ids < n]
        out = [b"".join(map(table.__getitem__, ids[i:i + RUN].tolist())) for i in range(0, len(ids), RUN)]
        return b"".join(out).decode("utf-8", "replace")


class _Cache(dict):
    """Packed ids by word; emptied when full."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> bytes:
        ids = self.vocabulary.packed_word(word)
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHE:
                self.clear()
            self[word] = ids
        return ids


_vocabularies: dict = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once a process."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, ids (packed)."""
    out_type = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n_tokens", T.LongType()),
                             T.StructField("ids", T.BinaryType())])

    def run(batches):
        schema, known = to_arrow_schema(out_type), vocabulary(path)
        for rows, texts in chunks(batches, "_text"):
            ids = [known.encode(t.decode()) if t else b"" for t in texts]
            yield as_batch(schema, rows.column(0), [len(i) // 4 for i in ids], ids)

    return docs.select(docs[key].alias("_key"), docs[text].alias("_text")).mapInArrow(run, out_type)


def decode_documents(encoded: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """The rows with a further column, the text of their packed ids; it takes the place of one of that name."""
    kept = [c for c in encoded.columns if c != to]
    at = kept.index(ids)
    out_type = T.StructType([*[encoded.schema[c] for c in kept], T.StructField(to, T.StringType())])

    def run(batches):
        schema, known = to_arrow_schema(out_type), vocabulary(path)
        for rows, packed in chunks(batches, kept[at]):
            texts = [None if p is None else known.decode(p) for p in packed]
            yield as_batch(schema, *rows.columns, texts)

    return encoded.select(*[encoded[c] for c in kept]).mapInArrow(run, out_type)

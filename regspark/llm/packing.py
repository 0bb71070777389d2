"""Vector bin packing of tokenized examples under limits on tokens, segments and loss-bearing tokens.

Each document is tokenized whole and cut into full sequences; what remains of it is an item
with three sizes: tokens, one segment, loss-bearing tokens. In plain documents these are all but the
end mark, so the limit on tokens binds first; with a column of loss ranges (``chat.examples``) they are
the tokens that touch a range, and ``EXAMPLES`` limits them below the tokens. A
bin takes, again and again, the item that fits and whose sizes have the largest
weighted dot product with the bin's remaining room, until none fits.

Packing happens where the rows are read, over ``buffer`` remainders at a time, so nothing is
shuffled and memory is bounded. Sequence ids hold the task's partition and a counter;
a task run again on the same partition gives the same ids.

Defined cases: null text is empty and has the end mark alone; rows repeat as given (each is
packed); a null id is kept; an empty table gives an empty result; null loss ranges are none.
"""

from __future__ import annotations

import base64
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from regspark.llm.common import as_batch, chunks


@dataclass(frozen=True)
class PackingConfig:
    tokens: int = 1024
    segments: int = 128
    loss: int = 1024
    end_id: int = 0
    buffer: int = 8192


EXAMPLES = PackingConfig(loss=768)  # general default where the loss-bearing tokens are given


class Encoder:
    """Ids as ``tokenizers`` gives them for the JSON file without special tokens added.

    With ``ranks`` (the same vocabulary as tiktoken ranks) that library encodes, which is several
    times faster and gives the same ids; texts that contain a special token's string,
    which the JSON file maps to its id, go to ``tokenizers``.
    """

    def __init__(self, json_path: str, ranks: str | None, pattern: str | None):
        self.json_path, self._slow, self._fast = json_path, None, None
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._fast = tiktoken.Encoding("fast", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    @property
    def slow(self):
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.json_path)
        return self._slow

    def ids(self, text: str) -> np.ndarray:
        if self._fast is None or any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self._fast.encode_ordinary(text), np.uint32)

    def ids_under(self, text: str, ranges: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and for each token whether it touches one of the ranges [start, end) of characters."""
        found = self.slow.encode(text, add_special_tokens=False)
        marked = np.zeros(len(text) + 1, np.int64)
        for r in ranges:
            marked[r["start"]:r["end"]] = 1
        upto = np.concatenate([[0], np.cumsum(marked)])
        at = np.array(found.offsets, np.int64).reshape(-1, 2)
        return np.array(found.ids, np.uint32), upto[at[:, 1]] > upto[at[:, 0]]


_encoders: dict = {}


def encoder(json_path: str, ranks: str | None = None, pattern: str | None = None) -> Encoder:
    if json_path not in _encoders:
        _encoders[json_path] = Encoder(json_path, ranks, pattern)
    return _encoders[json_path]


def place(tokens: np.ndarray, loss: np.ndarray, cfg: PackingConfig) -> list[list[int]]:
    """Bins of item indexes. Items of equal sizes are one class, so a step costs one pass over the classes."""
    if not len(tokens):
        return []
    sizes, of = np.unique(np.stack([tokens, loss], 1), axis=0, return_inverse=True)
    of = of.ravel()
    order = np.argsort(of, kind="stable")
    stacks = [list(x) for x in np.split(order, np.cumsum(np.bincount(of))[:-1])]
    limit = np.array([cfg.tokens, cfg.loss, cfg.segments], float)
    vec = np.column_stack([sizes, np.ones(len(sizes), np.int64)]) / limit
    left = np.array([len(s) for s in stacks])
    weight = (vec * left[:, None]).sum(0) / left.sum()  # scarcer limits count for more
    whole = np.column_stack([sizes, np.ones(len(sizes), np.int64)])
    bins = []
    while left.any():
        room, now = limit.copy(), []
        while True:
            fits = (left > 0) & (whole <= room).all(1)
            if not fits.any():
                break
            gain = np.where(fits, vec @ (weight * room / limit), -1)
            k = int(np.argmax(gain))
            now.append(stacks[k].pop())
            left[k] -= 1
            room = room - whole[k]
        bins.append(now)
    return bins


PIECE = T.StructType([T.StructField(n, T.LongType()) for n in (
    "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens")])


def pack_documents(docs: DataFrame, json_path: str, ranks: str | None = None, pattern: str | None = None,
                   cfg: PackingConfig | None = None, key: str = "doc_id", text: str = "text", loss: str | None = None) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    ``loss`` names a column of arrays of (start, end): the ranges of a text's characters under the loss. Without
    it all tokens but the end mark are. ``cfg`` is ``PackingConfig()``, with ``loss`` ``EXAMPLES``.
    """
    cfg = cfg or (EXAMPLES if loss else PackingConfig())
    out_type = T.StructType([T.StructField(key, docs.schema[key].dataType), *PIECE.fields])

    def pack(batches):
        schema, enc = to_arrow_schema(out_type), encoder(json_path, ranks, pattern)
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 32
        held: list = []

        def rows(pieces):
            return as_batch(schema, pa.array([p[0] for p in pieces], schema.field(0).type),
                            *(list(c) for c in list(zip(*pieces, strict=True))[1:]))

        def flush():
            nonlocal sequence
            out = []
            bins = place(np.array([h[2] for h in held]), np.array([h[5] for h in held]), cfg)
            for items in bins:
                at = 0
                for i in items:
                    doc, start, length, crc, total, n_loss = held[i]
                    out.append((doc, start, length, crc, total, sequence, at, n_loss))
                    at += length
                sequence += 1
            held.clear()
            return out

        for batch, texts in chunks(batches, "_text"):
            out = []
            under = batch.column(2).to_pylist() if loss else [None] * len(texts)
            for doc, value, ranges in zip(batch.column(0).to_pylist(), texts, under, strict=True):
                if loss:
                    ids, bears = enc.ids_under(value.decode() if value else "", ranges or [])
                else:
                    ids = enc.ids(value.decode()) if value else np.empty(0, np.uint32)
                    bears = np.ones(len(ids), bool)
                ids = np.append(ids, np.uint32(cfg.end_id)).astype("<u4")
                upto = np.concatenate([[0], np.cumsum(np.append(bears, False))])
                start = 0
                while start < len(ids):  # as many tokens as both limits allow
                    most = int(np.searchsorted(upto, upto[start] + cfg.loss, "right")) - 1
                    part = ids[start:min(start + cfg.tokens, most)]
                    n_loss = int(upto[start + len(part)] - upto[start])
                    piece = (doc, start, len(part), zlib.crc32(part.tobytes()), len(ids))
                    start += len(part)
                    if len(part) == cfg.tokens:
                        out.append((*piece, sequence, 0, n_loss))
                        sequence += 1
                    else:
                        held.append((*piece, n_loss))
                        if len(held) >= cfg.buffer:
                            out += flush()
            if out:
                yield rows(out)
        if held:
            yield rows(flush())

    given = [docs[loss].alias("_loss")] if loss else []
    return docs.select(docs[key].alias("_key"), docs[text].alias("_text"), *given).mapInArrow(pack, out_type)

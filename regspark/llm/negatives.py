"""Hard-negative mining over an inverted multi-index.

Vectors are quantised to integers and cut into two halves. A codebook per half is fitted on a
bounded sample (``sample`` rows of smallest hash); every row is put into the cell (code of its first half, code of
its second half), and each code knows the radius that holds all its rows. For an asking vector a
code's bound is its product with the code's centre plus the half's length times the radius, so no row of a cell scores
above the sum of the cell's two bounds. The multi-sequence heap visits cells in falling order of that sum.

A question is a set of score windows; each wants its ``limit`` best rows. Visits go in waves of growing
numbers of rows: a wave asks for the next cells of the heap, joins them with the index on the cells' shelf, and keeps each
window's best rows. A window is certified once no cell left can reach its last kept row or its lower edge, and a question stops
with its last window. So only cells that may hold a result are compared with a question, and results are exact.

Mining asks twice: for each anchor's best rows of the same label (its positives), then, with a window
per positive, for the best rows of other labels.

Cells are kept in blocks of at most ``block`` rows, and neighbouring cells lie on one shelf of bounded rows. A question
goes once to each shelf it asks, with one bit per cell of the shelf, not once per cell. The join key holds the shelf and two
salts: a shelf's blocks and its questions are split evenly, so a cell with a third of all rows or questions is spread over
many tasks. Vectors travel as the narrowest integers that hold them; scores are computed in tiles, by floats where these are exact,
and only what reaches a window's last kept row leaves a tile, so a task's memory is bounded by its rows and questions, however
many cells a question visits. The driver holds the codebooks, radii and one count per cell (at most ``max_codes`` squared).

Defined cases: rows with a null id or label, vectors that are null or hold null or non-finite components take no
part; repeated rows count once, and of different rows with one id the smallest (by components, then label)
counts; missing trailing components count as zero; ties go to the smaller id; fewer than ``limit`` rows come if there are
no more, windows without a score (those of negative positives) give none; empty tables give an empty result;
only the named columns are read. Scores must fit in 62 bits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from regspark.llm.common import as_batch, discard, store

EDGE = 1 << 62
BOUNDS_OFF = 1e-9  # relative error allowed for in sums of floats
HEAP_CELLS = 512  # the heap serves shorter visits, one sort of all bounds longer ones
ASK_AT_ONCE, ASK_A_TASK = 64, 512  # questions
TILE_QUESTIONS, TILE_ROWS = 512, 2048  # of one product
DENSE = 16  # a tile with more than one in so many scores to keep is cut by selection, others by sorting what is kept


@dataclass(frozen=True)
class MiningConfig:
    scale: int = 256
    positives: int = 5
    negatives: int = 5
    low: int = 80  # a negative's score lies between these percentages of its positive's
    high: int = 100
    sample: int = 16_384
    steps: int = 8  # of the clustering
    rows_a_cell: int = 512
    max_codes: int = 256
    block: int = 2048
    blocks_a_task: int = 8  # at least; from 64 shelves on they grow to shelf_values
    shelf_values: int = 1 << 23  # components of vectors
    questions_a_task: int = 2048  # at least; from 4 tasks a shelf on they grow to question_values
    question_values: int = 1 << 21
    first_rows: int = 2048  # of a question's first wave
    growth: int = 8
    seed: int = 12


def quantised(vectors: DataFrame, scale: int, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, v array<long>): one row per id."""
    v = F.col("v")
    rows = (vectors.select(vectors[key].cast("long").alias("id"), vectors[label].cast("string").alias("label"),
                           F.transform(vectors[vector], lambda x: x.cast("double")).alias("v"))
            .filter(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull()
                    & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))))
    whole = rows.select("id", F.struct(F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("v"), "label").alias("r"))
    return whole.groupBy("id").agg(F.min("r").alias("r")).select("id", "r.label", "r.v")


def matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    """Rows of integers, padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _longest(x: np.ndarray) -> float:
    """The largest length of a row."""
    return max((float(np.sqrt(np.square(x[k:k + 8192].astype(np.float64)).sum(1)).max()) for k in range(0, len(x), 8192)), default=0.0)


def product_type(x: np.ndarray, y: np.ndarray) -> type:
    """The narrowest type in which all sums of products of rows are exact: none passes the product of the rows' lengths."""
    most = _longest(x) * _longest(y)
    return np.float32 if most < 2 ** 23 else np.float64 if most < 2 ** 52 else np.int64


def narrowest(least: int, most: int) -> str:
    """The narrowest integers that hold both."""
    return next(f"<i{n}" for n in (1, 2, 4, 8) if -(1 << 8 * n - 1) <= least and most < 1 << 8 * n - 1)


def packed(x: np.ndarray, kind: str) -> list[bytes]:
    """Each row's bytes."""
    whole, size = x.astype(kind).tobytes(), x.shape[1] * np.dtype(kind).itemsize
    return [whole[k:k + size] for k in range(0, len(whole), size)]


def unpacked(rows: pa.ChunkedArray, kind: str, dims: int) -> np.ndarray:
    """Rows of integers from binary cells, one or more rows in each."""
    return np.frombuffer(b"".join(rows.to_pylist()), kind).reshape(-1, dims)


# -- the index ------------------------------------------------------------------------------------

def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(1), 0)


def codebook(x: np.ndarray, codes: int, cfg: MiningConfig) -> np.ndarray:
    """Centres of at most ``codes`` clusters by Lloyd's steps, started from distinct rows far from each other."""
    rng = np.random.default_rng(cfg.seed)
    centres = x[rng.integers(len(x))][None]
    near = _distances(x, centres)[:, 0]
    while len(centres) < codes and near.max() > 0:
        centres = np.vstack([centres, x[rng.choice(len(x), p=near / near.sum())]])
        near = np.minimum(near, _distances(x, centres[-1:])[:, 0])
    for _ in range(cfg.steps):
        of = _distances(x, centres).argmin(1)
        n = np.bincount(of, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


@dataclass
class Index:
    """Codebooks and radii of both halves, rows per cell, and the blocks (shelf, cell, block, ids, labels, vs).

    ``shelf_rows`` are the rows after which a shelf ends at the next cell, ``kind`` is the type of the integers.
    """

    dims: int
    centres: tuple
    radii: tuple
    counts: np.ndarray
    shelf_rows: int
    kind: str
    blocks: DataFrame | None

    def __post_init__(self):
        self.cells = np.flatnonzero(self.counts)  # those that hold rows
        self.sizes = self.counts.ravel()[self.cells]
        self.shelf = (np.cumsum(self.sizes) - self.sizes) // self.shelf_rows
        starts = np.flatnonzero(np.diff(self.shelf, prepend=-1))
        self.shelves = list(zip(self.shelf[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(self.cells)], strict=True))

    def bare(self) -> Index:
        """Without the blocks, for tasks."""
        return replace(self, blocks=None)

    def halves(self, x: np.ndarray) -> tuple:
        cut = self.dims // 2
        return x[:, :cut], x[:, cut:]

    def bounds(self, x: np.ndarray) -> tuple:
        """Per half: what a row of each code can add to a score, at most."""
        out = []
        for part, centres, radii in zip(self.halves(x.astype(np.float64)), self.centres, self.radii, strict=True):
            length = np.sqrt((part * part).sum(1))[:, None]
            slack = BOUNDS_OFF * (length * (np.sqrt((centres * centres).sum(1)) + radii) + 1)
            out.append(part @ centres.T + length * radii + slack)
        return tuple(out)

    def next_cells(self, first: np.ndarray, second: np.ndarray, done: int, least: int, budget: int) -> tuple[np.ndarray, int]:
        """(places in ``cells``, places of the heap's order done with): the next cells of one question, after the ``done``
        first ones, until ``budget`` rows or until the bound is below ``least``. Cells of one bound go together."""
        if done + budget * self.counts.size / self.sizes.sum() <= HEAP_CELLS:
            rows, own, last = 0, [], None
            for place, (bound, i, j) in enumerate(visits(first, second)):
                if bound < least or (rows >= budget and bound != last):
                    return np.searchsorted(self.cells, own), max(done, place)
                if place > 2 * HEAP_CELLS:  # many empty cells
                    break
                if place >= done:
                    last = bound
                    if self.counts[i, j]:
                        own.append(i * self.counts.shape[1] + j)
                        rows += int(self.counts[i, j])
            else:
                return np.searchsorted(self.cells, own), self.counts.size
        every = (first[:, None] + second).ravel()
        if done >= len(every):
            return np.zeros(0, np.int64), done
        bound = every[self.cells]
        wanted = bound >= least
        if done:
            wanted &= bound < np.partition(every, len(every) - done)[len(every) - done]
        at = np.flatnonzero(wanted)
        if self.sizes[at].sum() > budget:
            order = at[np.argsort(-bound[at])]
            last = bound[order[np.searchsorted(np.cumsum(self.sizes[order]), budget)]]
            return at[bound[at] >= last], int((every >= last).sum())
        return at, max(done, int((every >= least).sum()))


def visits(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(bound, code, code) of all cells in falling order of the bound: the multi-sequence heap."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    heap = [(-(first[a[0]] + second[b[0]]), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, int(a[i]), int(b[j])
        if j + 1 < len(b):
            heapq.heappush(heap, (-(first[a[i]] + second[b[j + 1]]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(first[a[i + 1]] + second[b[0]]), i + 1, 0))


BLOCK = "shelf int, cell int, block long, ids binary, labels array<string>, vs binary"
PLACED = "cell int, id long, label string, v binary, r_0 double, r_1 double"


def build(rows: DataFrame, cfg: MiningConfig) -> Index | None:
    """The index of all (id, label, v); None without rows. Rows are sent once, sorted by cell and id."""
    n, dims, least, most = rows.agg(F.count("*"), F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    if not n:
        return None
    dims, kind = max(2, dims), narrowest(least or 0, most or 0)
    order = F.xxhash64(F.lit(cfg.seed), "id")
    near = int(-(1 << 63) + min(1.0, 2 * cfg.sample / n) * (1 << 64))  # about twice the sample is sorted, not a sample of each task
    some = rows if n <= 2 * cfg.sample else rows.filter(order <= F.lit(near))
    x = matrix(some.orderBy(order, "id").limit(cfg.sample).select("v").toArrow().column("v"), dims).astype(np.float64)
    codes = int(np.clip(np.ceil(np.sqrt(n / cfg.rows_a_cell)), 1, cfg.max_codes))
    cut = dims // 2
    centres = (codebook(x[:, :cut], codes, cfg), codebook(x[:, cut:], codes, cfg))
    wide = len(centres[1])
    placed_type = T._parse_datatype_string(PLACED)

    def assign(batches):
        schema = to_arrow_schema(placed_type)
        step = max(1, (1 << 19) // dims)
        for b in (b.slice(k, step) for b in batches for k in range(0, b.num_rows, step)):
            whole = matrix(b.column(2), dims)
            of, far = [], []
            for part, centre in zip((whole[:, :cut].astype(np.float64), whole[:, cut:].astype(np.float64)), centres, strict=True):
                code = _distances(part, centre).argmin(1)
                of.append(code)
                far.append(np.sqrt(((part - centre[code]) ** 2).sum(1)))
            yield as_batch(schema, (of[0] * wide + of[1]).astype(np.int32), b.column(0), b.column(1), packed(whole, kind), *far)

    placed = store(rows.select("id", "label", "v").mapInArrow(assign, placed_type), "mining-rows")
    per_cell = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("r_0").alias("a"), F.max("r_1").alias("b")).collect()
    counts, radii = np.zeros((len(centres[0]), wide), np.int64), (np.zeros(len(centres[0])), np.zeros(wide))
    for r in per_cell:  # at most max_codes squared
        i, j = divmod(r["cell"], wide)
        counts[i, j] = r["n"]
        radii[0][i], radii[1][j] = max(radii[0][i], r["a"]), max(radii[1][j], r["b"])
    few = cfg.block * cfg.blocks_a_task
    index = Index(dims, centres, radii, counts, max(few, min(cfg.shelf_values // dims, n // 64)), kind, None)
    block_type = T._parse_datatype_string(BLOCK)

    def pack(batches):
        schema = to_arrow_schema(block_type)
        for b in batches:
            cell = b.column(0).to_numpy()
            edges = np.concatenate([np.flatnonzero(np.diff(cell, prepend=-1)), [len(cell)]])
            spans = [(k, min(cfg.block, hi - k)) for lo, hi in zip(edges, edges[1:], strict=False) for k in range(lo, hi, cfg.block)]
            ids, vs = b.column(1).to_numpy().astype("<i8"), b.column(3).to_pylist()
            at = [k for k, _ in spans]
            lists = pa.ListArray.from_arrays(pa.array([*at, len(cell)], pa.int32()), b.column(2))
            yield as_batch(schema, index.shelf[np.searchsorted(index.cells, cell[at])].astype(np.int32), cell[at], ids[at],
                           [ids[k:k + m].tobytes() for k, m in spans], lists, [b"".join(vs[k:k + m]) for k, m in spans])

    ordered = (placed.select("cell", "id", "label", "v").repartitionByRange(max(1, -(-n // few)), "cell", "id")
               .sortWithinPartitions("cell", "id"))
    index.blocks = store(ordered.mapInArrow(pack, block_type), "mining-blocks")
    discard(placed)
    return index


# -- questions --------------------------------------------------------------------------------------

REQUEST = ("shelf int, id long, label string, v binary, slots array<struct<slot:int,low:long,high:long>>, upto int, "
           "reach array<long>, cells binary")
HIT = T.StructType([T.StructField("id", T.LongType()), T.StructField("slot", T.IntegerType()),
                    T.StructField("found", T.LongType()), T.StructField("score", T.LongType())])


def _ask(state: DataFrame, index: Index, budget: int) -> DataFrame:
    """The next cells of each question, a row per shelf with a bit per cell: from its place in the heap's order until
    ``budget`` rows or until the bound is below all of its windows."""
    bare, out_type = index.bare(), T._parse_datatype_string(REQUEST)

    def run(batches):
        schema = to_arrow_schema(out_type)
        for whole in batches:
            for k in range(0, whole.num_rows, ASK_AT_ONCE):
                b = whole.slice(k, ASK_AT_ONCE)
                x = matrix(b.column(2), bare.dims)
                first, second = bare.bounds(x)
                wanted, upto = np.zeros((len(x), len(bare.cells)), bool), np.zeros(len(x), np.int32)
                for q, (done, reach) in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)):
                    own, upto[q] = bare.next_cells(first[q], second[q], done, min(reach), budget)
                    wanted[q, own] = True
                vs, shelves, took, bits = packed(x, bare.kind), [], [], []
                for shelf, lo, hi in bare.shelves:
                    at = np.flatnonzero(wanted[:, lo:hi].any(1))
                    shelves += [shelf] * len(at)
                    took += at.tolist()
                    bits += [r.tobytes() for r in np.packbits(wanted[at, lo:hi], axis=1)]
                if took:
                    c = b.select([0, 1, 3, 5]).take(pa.array(took, pa.int64())).columns
                    yield as_batch(schema, shelves, c[0], c[1], [vs[q] for q in took], c[2], upto[took], c[3], bits)

    return state.mapInArrow(run, out_type)


def _best(score: np.ndarray, ok: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``limit`` best allowed scores of each row, ties to the smaller column."""
    n = score.shape[1]
    if np.abs(score).max(initial=0) < EDGE // max(n, 1):
        order = score * n + (n - 1 - np.arange(n))
        order = np.where(ok, order, -EDGE)
        if n > limit:
            at = np.argpartition(-order, limit - 1, axis=1)[:, :limit]
        else:
            at = np.broadcast_to(np.arange(n), score.shape)
        row = np.repeat(np.arange(len(score)), at.shape[1])
        at = at.ravel()
        good = ok[row, at]
        return row[good], at[good]
    rows, columns = [], []
    for r in range(len(score)):
        at = np.flatnonzero(ok[r])
        at = at[np.lexsort((at, -score[r, at]))][:limit]
        rows.append(np.full(len(at), r))
        columns.append(at)
    return np.concatenate(rows), np.concatenate(columns)


class _Kept:
    """The best rows so far of each window of a few questions."""

    def __init__(self, low: np.ndarray, high: np.ndarray, limit: int):
        self.low, self.high, self.limit = low.copy(), high, limit
        self.width, self.parts, self.waiting, self.open = low.shape[1], [], 0, True
        self.enough = 2 * limit * low.size

    def add(self, at: np.ndarray, slot: int, found: np.ndarray, score: np.ndarray) -> None:
        self.parts.append((at * self.width + slot, found, score))
        self.waiting += len(at)

    def settle(self) -> None:
        """Drop what is not among a window's best, and raise the least scores that still count."""
        key, found, score = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.lexsort((found, -score, key))
        key, found, score = key[order], found[order], score[order]
        place = np.arange(len(key)) - np.searchsorted(key, key)
        last = place == self.limit - 1
        self.low.ravel()[key[last]] = np.maximum(self.low.ravel()[key[last]], score[last])
        best = place < self.limit
        self.parts, self.waiting = [(key[best], found[best], score[best])], 0


def _tiles(at: np.ndarray, vectors: np.ndarray, ids: np.ndarray, codes: np.ndarray, cell: np.ndarray) -> list[tuple]:
    """The rows ``at``, neighbours by cell, in runs sorted by id, each with its cells."""
    out = []
    for k in range(0, len(at), TILE_ROWS):
        part = at[k:k + TILE_ROWS]
        part = part[np.argsort(ids[part])]
        out.append((vectors[part], ids[part], codes[part], cell[part], np.unique(cell[part])))
    return out


def _compare(q, qid, qcode, wanted, tile, kept: _Kept, same: bool) -> None:
    """Scores of a few questions and the rows of a tile: what reaches a window goes to ``kept``."""
    vectors, ids, codes, cell, cells = tile
    asks = np.flatnonzero(wanted[:, cells].any(1))
    if not len(asks):
        return
    score = (q if len(asks) == len(q) else q[asks]) @ vectors.T
    mask = score >= kept.low.min(1)[asks, None].astype(score.dtype)  # rounded only beyond all scores
    n = np.count_nonzero(mask)
    if n * DENSE > mask.size:
        for k in range(0, len(asks), 128):
            at = asks[k:k + 128]
            s = score[k:k + 128].astype(np.int64)
            fit = ((qcode[at, None] == codes) == same) & (qid[at, None] != ids) & wanted[at[:, None], cell]
            for slot in range(kept.width):
                row, column = _best(s, fit & (s >= kept.low[at, slot, None]) & (s <= kept.high[at, slot, None]), kept.limit)
                kept.add(at[row], slot, ids[column], s[row, column])
    elif n:
        row, column = np.divmod(np.flatnonzero(mask), mask.shape[1])
        at = asks[row]
        good = ((qcode[at] == codes[column]) == same) & (qid[at] != ids[column]) & wanted[at, cell[column]]
        at, found, s = at[good], ids[column[good]], score[row[good], column[good]].astype(np.int64)
        for slot in range(kept.width):
            ok = (s >= kept.low[at, slot]) & (s <= kept.high[at, slot])
            kept.add(at[ok], slot, found[ok], s[ok])
    if kept.waiting > (0 if kept.open else kept.enough):
        kept.settle()
        kept.open = False


def _windows(asked: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, low, high) of each question's windows, one row a question; windows that it lacks hold nothing."""
    slots, reach = asked.column("slots").combine_chunks(), asked.column("reach").combine_chunks()
    n = slots.value_lengths().to_numpy()
    has = np.arange(n.max()) < n[:, None]
    slot, low, high = (np.zeros(has.shape, np.int64) for _ in range(3))
    low[:], high[:] = EDGE, -EDGE
    whole = slots.flatten()
    slot[has], high[has] = whole.field("slot").to_numpy(), whole.field("high").to_numpy()
    low[has] = np.maximum(whole.field("low").to_numpy(), reach.flatten().to_numpy())
    return slot, low, high


def _score(blocks: pa.Table, asked: pa.Table, index: Index, same: bool, limit: int) -> pa.Table:
    """The best rows of a shelf's blocks for each window of the questions that asked for their cells."""
    schema = to_arrow_schema(HIT)
    if not blocks.num_rows or not asked.num_rows:
        return schema.empty_table()
    lo, hi = next((lo, hi) for shelf, lo, hi in index.shelves if shelf == asked.column("shelf")[0].as_py())
    ids, x = unpacked(blocks.column("ids"), "<i8", 1)[:, 0], unpacked(blocks.column("vs"), index.kind, index.dims)
    labels = blocks.column("labels").combine_chunks()
    cell = np.repeat(np.searchsorted(index.cells[lo:hi], blocks.column("cell").to_numpy()), labels.value_lengths().to_numpy())
    qid, q = asked.column("id").to_numpy(), unpacked(asked.column("v"), index.kind, index.dims)
    code = pa.chunked_array([labels.flatten(), *asked.column("label").chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
    code, qcode = code[:len(ids)], code[len(ids):]
    slot, low, high = _windows(asked)
    bits = np.frombuffer(b"".join(asked.column("cells").to_pylist()), np.uint8).reshape(len(q), -1)
    exact = product_type(q, x)
    q, x = q.astype(exact), x.astype(exact)
    near = np.argsort(cell, kind="stable")
    if same:  # each label for itself
        by, qby = near[np.argsort(code[near], kind="stable")], np.argsort(qcode, kind="stable")
        both = np.intersect1d(code, qcode)
        spans = zip(*(np.searchsorted(c, both, side) for c in (qcode[qby], code[by]) for side in ("left", "right")), strict=True)
        parts = ((qby[a:b], by[c:d]) for a, b, c, d in spans)
    else:
        parts = [(np.arange(len(q)), near)]
    out = []
    for questions, rows in parts:
        tiles = _tiles(rows, x, ids, code, cell)
        for k in range(0, len(questions), TILE_QUESTIONS):
            at = questions[k:k + TILE_QUESTIONS]
            kept, wanted = _Kept(low[at], high[at], limit), np.unpackbits(bits[at], axis=1).astype(bool)
            for tile in tiles:
                _compare(q[at], qid[at], qcode[at], wanted, tile, kept, same)
            if kept.parts:
                kept.settle()
                key, found, score = kept.parts[0]
                row, column = np.divmod(key, kept.width)
                out.append(as_batch(schema, qid[at][row], slot[at][row, column], found, score))
    return pa.Table.from_batches(out, schema)


def _top(hits: DataFrame, limit: int) -> DataFrame:
    order = Window.partitionBy("id", "slot").orderBy(F.desc("score"), "found")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def _salted(blocks: DataFrame, requests: DataFrame, index: Index, cfg: MiningConfig) -> tuple[DataFrame, DataFrame, int]:
    """Both sides with the key (shelf, s, t), and the number of keys: blocks dealt over s and copied over t, requests the
    other way round."""
    spark = blocks.sparkSession
    asked = {r["shelf"]: r["n"] for r in requests.groupBy("shelf").agg(F.count("*").alias("n")).collect()}
    most = max(cfg.questions_a_task, min(cfg.question_values // index.dims, max(asked.values()) // 4))
    rows = [(shelf, max(1, round(int(index.sizes[lo:hi].sum()) / index.shelf_rows)), max(1, -(-asked[shelf] // most)))
            for shelf, lo, hi in index.shelves if shelf in asked]
    table = F.broadcast(spark.createDataFrame(rows, "shelf int, n_s int, n_t int"))  # at most the number of shelves

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = (blocks.join(table, "shelf").withColumn("s", F.pmod(F.xxhash64("cell", "block"), F.col("n_s")).cast("int"))
            .withColumn("t", every("n_t")).drop("n_s", "n_t"))
    right = (requests.join(table, "shelf").withColumn("t", F.pmod(F.xxhash64("id"), F.col("n_t")).cast("int"))
             .withColumn("s", every("n_s")).drop("n_s", "n_t"))
    return left, right, sum(n_s * n_t for _, n_s, n_t in rows)


def search(index: Index, asked: DataFrame, same: bool, limit: int, cfg: MiningConfig) -> DataFrame:
    """(id, slot, rank, found, score): for each window (slot, low, high) of the asked (id, label, v, slots) the ``limit``
    best other rows, of the same label or of another one."""
    spark = asked.sparkSession
    state = asked.withColumn("upto", F.lit(0)).withColumn("reach", F.transform("slots", lambda s: s["low"]))
    found, requests, budget, bare, total = None, None, cfg.first_rows, index.bare(), int(index.sizes.sum())
    parts = min(4096, asked.count() // ASK_A_TASK + 1)

    def compare(b: pa.Table, q: pa.Table) -> pa.Table:
        return _score(b, q, bare, same, limit)

    key = ["shelf", "s", "t"]
    while True:
        open_ones = state.select("id", "label", "v", "slots", "upto", "reach").repartition(parts, "id")
        last, requests = requests, store(_ask(open_ones, index, budget), "mining-requests")
        if last is not None:
            discard(last)
        if requests.isEmpty():
            break
        left, right, keys = _salted(index.blocks, requests, index, cfg)
        tasks = min(keys, 4096)
        hits = (left.repartition(tasks, *key).groupBy(*key).cogroup(right.repartition(tasks, *key).groupBy(*key))
                .applyInArrow(compare, HIT))
        before, found = found, store(_top(hits if found is None else hits.unionByName(found.drop("rank")), limit), "mining-found")
        if before is not None:
            discard(before)
        full = (found.filter(F.col("rank") == limit).groupBy("id")
                .agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("least")))
        now = requests.groupBy(F.col("id").alias("at")).agg(F.max("upto").alias("upto"))
        rise = F.transform("slots", lambda s: F.greatest(s["low"], F.coalesce(F.get(F.map_values(F.map_filter(
            "least", lambda k, _: k == s["slot"])), F.lit(0)), s["low"])))
        state = (asked.join(now, asked["id"] == now["at"]).drop("at").join(full, "id", "left")
                 .withColumn("reach", rise))
        budget *= cfg.growth
        if budget * 4 > total:  # a further wave would send most blocks once more
            budget = max(budget, total)
    discard(requests)
    return found if found is not None else spark.createDataFrame([], "id long, slot int, found long, score long, rank int")


def _hundredth(x: Column) -> Column:
    """x / 100 rounded down, in whole numbers."""
    return F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))


def mine(vectors: DataFrame, is_anchor, cfg: MiningConfig = MiningConfig(), key: str = "vec_id",
         vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows whose ``id`` meets
    ``is_anchor`` (a column expression)."""
    spark = vectors.sparkSession
    rows = store(quantised(vectors, cfg.scale, key, vector, label), "mining-vectors")
    index = build(rows, cfg)
    if index is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, "
                                         "positive_score long, negative_score long")
    anchors = store(rows.filter(is_anchor).select("id", "label", "v"), "mining-anchors")
    discard(rows)
    any_score = F.array(F.struct(F.lit(0).alias("slot"), F.lit(-EDGE).alias("low"), F.lit(EDGE).alias("high")))
    positive = search(index, anchors.withColumn("slots", any_score), True, cfg.positives, cfg)
    window = positive.select("id", F.col("rank").alias("slot"), (-_hundredth(-F.col("score") * cfg.low)).alias("low"),
                             _hundredth(F.col("score") * cfg.high).alias("high")).filter("low <= high")
    windows = window.groupBy(F.col("id").alias("at")).agg(F.collect_list(F.struct("slot", "low", "high")).alias("slots"))
    asked = store(anchors.join(windows, anchors["id"] == windows["at"]).drop("at"), "mining-windows")
    negative = search(index, asked, False, cfg.negatives, cfg)
    for step in (index.blocks, anchors, asked):
        discard(step)
    own = positive.select(F.col("id").alias("p_id"), F.col("rank").alias("p_rank"), F.col("found").alias("positive_id"),
                          F.col("score").alias("positive_score"))
    return (negative.join(own, [negative["id"] == own["p_id"], negative["slot"] == own["p_rank"]])
            .select(F.col("id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"),
                    F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))

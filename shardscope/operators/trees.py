"""Decision trees as a table of node arrays: grown one per task row, scored and attributed inside tasks.

A forest's fitting rows travel to the tasks, as rows or, where they are many, as counted cells in blocks that a task reads one after the other; each task
grows its own trees from them, so trees, not rows, are dealt to the cluster, and a lost task grows its trees again from their seeds. The fitted forest is a table with one row per tree, written once; what scores with it reads
that table. Tables to be scored or attributed are never unfolded: a batch of rows walks all trees level by level.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardscope.functions.scalars import quoted
from shardscope.operators.scoring import Scorer, feature_array, python_scorer
from shardscope.session import materialise

# Most cut points of a numeric column; a column with fewer distinct values is cut between all of them.
CUTS = 127
# Most nodes of a forest that travels to the tasks (about 40 bytes each and 8 per class).
MAX_NODES = 4_000_000
# Path columns for which the weights of all patterns are one product of matrices.
DENSE = 8
# Rows that walk a tree together, and levels after which those that reached a leaf drop out.
WALK, STEPS = 1 << 13, 5
# Cells of a forest's bins that a task evaluates at a time.
CELLS = 1 << 12
# Most numbers in the grids of an attributed forest over few columns (8 bytes each, in every worker).
GRID = 1 << 24
# Drawn cells that a growing tree keeps between its levels (8 bytes each and the bins); of more, each block is drawn and walked again.
HELD = 1 << 23
# Counts of a level's cuts that a tree holds at a time (8 bytes each); more nodes take further passes.
CUT_COUNTS = 1 << 22
NODE_FIELDS = "column array<int>, threshold array<double>, category array<int>, left array<int>, right array<int>, shares array<double>, gain array<double>"


@dataclass(frozen=True)
class Sample:
    """Fitting rows: numbers as bins between ``cuts``, texts as codes, classes as codes from 0."""

    bins: np.ndarray
    cuts: list[np.ndarray]
    categories: list[int]
    classes: np.ndarray
    n_classes: int

    @classmethod
    def build(cls, numbers: np.ndarray, codes: np.ndarray, categories: Sequence[int], classes: np.ndarray, n_classes: int) -> Sample:
        cuts = [_cut_points(numbers[:, j]) for j in range(numbers.shape[1])]
        binned = [np.searchsorted(c, numbers[:, j], "left") for j, c in enumerate(cuts)]
        bins = np.stack([*binned, *codes.T], axis=1) if len(cuts) or codes.shape[1] else np.zeros((len(classes), 0))
        return cls(bins.astype(np.int32), cuts, list(categories), classes.astype(np.int64), n_classes)

    @property
    def slots(self) -> tuple[np.ndarray, np.ndarray]:
        return _slots(self.cuts, self.categories)


@dataclass(frozen=True)
class Counted:
    """All fitting rows as cells: rows of equal bins and class are one cell with their number.

    ``blocks`` are sent one by one, each with the bins [cell, column], classes and numbers of its cells; ``sizes`` are the blocks' rows.
    """

    blocks: list[Broadcast]
    sizes: np.ndarray
    cells: int
    cuts: list[np.ndarray]
    categories: list[int]
    n_classes: int

    @property
    def slots(self) -> tuple[np.ndarray, np.ndarray]:
        return _slots(self.cuts, self.categories)


def _slots(cuts: Sequence[np.ndarray], categories: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Column and category of each input of the forest: numeric columns as they are, one input per category of a text."""
    n = len(cuts)
    column = [*range(n), *[n + j for j, k in enumerate(categories) for _ in range(k)]]
    category = [-1] * n + [c for k in categories for c in range(k)]
    return np.array(column, np.int64), np.array(category, np.int64)


def _cut_points(values: np.ndarray) -> np.ndarray:
    distinct = np.unique(values)
    if len(distinct) > CUTS + 1:
        distinct = np.unique(np.quantile(values, np.linspace(0, 1, CUTS + 1), method="nearest"))
    return (distinct[1:] + distinct[:-1]) / 2


@dataclass
class _Level:
    """Nodes of one depth: their rows' node numbers and class totals."""

    node: np.ndarray
    totals: np.ndarray


def grow(sample: Sample, seed: Sequence[int], depth: int | None) -> dict[str, list]:
    """One tree: a bootstrap of the rows, classes weighted to balance in it, the square root of the inputs tried at a node (more only
    while none of them cuts it), Gini impurity, level by level."""
    draw = np.random.default_rng(list(seed))
    n, k = len(sample.classes), sample.n_classes
    times = np.bincount(draw.integers(0, n, n), minlength=n).astype(float)
    per_class = np.bincount(sample.classes, times, k)
    times *= (n / (max((per_class > 0).sum(), 1) * np.maximum(per_class, 1)))[sample.classes]
    rows = np.flatnonzero(times)
    bins, y, weight = sample.bins[rows], sample.classes[rows], times[rows]
    slot_column, slot_category = sample.slots
    tried = max(1, int(math.sqrt(len(slot_column))))
    out: dict[str, list] = {f.split()[0]: [] for f in NODE_FIELDS.split(", ")}
    node, level, count = np.zeros(len(rows), np.int64), 0, 1
    while count:
        totals = np.bincount(node * k + y, weight, count * k).reshape(count, k)
        slot, cut, gain = _best_cuts(sample, bins, y, weight, node, totals, tried, draw) if depth is None or level < depth else _no_cuts(count)
        split = slot >= 0
        first = len(out["column"])
        ahead = first + count + 2 * (np.cumsum(split) - split)
        column, category = slot_column[slot], slot_category[slot]
        numeric = split & (category < 0)
        out["column"] += np.where(split, column, -1).tolist()
        out["category"] += np.where(split, category, -1).tolist()
        out["threshold"] += [float(sample.cuts[c][b]) if x else 0.0 for c, b, x in zip(column.tolist(), cut.tolist(), numeric.tolist())]
        out["left"] += np.where(split, ahead, -1).tolist()
        out["right"] += np.where(split, ahead + 1, -1).tolist()
        out["shares"] += (totals / totals.sum(axis=1, keepdims=True)).ravel().tolist()
        out["gain"] += np.where(split, gain, 0.0).tolist()
        on = split[node]
        bins, y, weight, node = bins[on], y[on], weight[on], node[on]
        value = bins[np.arange(len(node)), column[node]]
        goes_right = np.where(category[node] < 0, value > cut[node], value == category[node])
        node = 2 * (np.cumsum(split) - split)[node] + goes_right
        count, level = 2 * int(split.sum()), level + 1
    return out


def _no_cuts(count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.full(count, -1), np.zeros(count, np.int64), np.zeros(count)


def _best_cuts(
    sample: Sample, bins: np.ndarray, y: np.ndarray, weight: np.ndarray, node: np.ndarray, totals: np.ndarray, tried: int, draw: np.random.Generator
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Input (-1: none), cut and fall of impurity of the best cut of each node."""
    slot_column, slot_category = sample.slots
    count, k = totals.shape
    best, cut, gain = _no_cuts(count)
    whole = (totals**2).sum(axis=1) / totals.sum(axis=1)
    open_ = (totals > 0).sum(axis=1) > 1
    order = draw.random((count, len(slot_column))).argsort(axis=1)
    width = max([len(c) + 1 for c in sample.cuts] + [2])
    for start in range(0, len(slot_column), tried):
        if not open_.any():
            break
        place = np.cumsum(open_) - 1
        rows = np.flatnonzero(open_[node])
        at, own_y, own_weight = place[node[rows]], y[rows], weight[rows]
        n_open, parent = int(open_.sum()), totals[open_]
        for j in range(start, min(start + tried, len(slot_column))):
            slot = order[open_, j]
            value = bins[rows, slot_column[slot][at]]
            category = slot_category[slot][at]
            value = np.where(category < 0, value, value == category)
            left = np.bincount((at * width + value) * k + own_y, own_weight, n_open * width * k).reshape(n_open, width, k).cumsum(axis=1)[:, :-1]
            right = parent[:, None, :] - left
            n_left, n_right = left.sum(axis=2), right.sum(axis=2)
            with np.errstate(divide="ignore", invalid="ignore"):
                fall = (left**2).sum(axis=2) / n_left + (right**2).sum(axis=2) / n_right - whole[open_][:, None]
            fall[(n_left < 1e-9) | (n_right < 1e-9)] = -1.0
            top = fall.argmax(axis=1)
            fall = fall[np.arange(n_open), top]
            better = np.flatnonzero(fall > np.maximum(gain[open_], 1e-9))
            target = np.flatnonzero(open_)[better]
            best[target], cut[target], gain[target] = slot[better], top[better], fall[better]
        open_ &= best < 0
    return best, cut, gain


class _Drawn:
    """A bootstrap of all counted rows, and the node of the current level that each drawn cell is at; cells in a leaf drop out.

    Rows fall to the blocks, and in a block to its cells, by their numbers, which is a draw of as many rows as there are, with replacement.
    """

    def __init__(self, sample: Counted, seed: Sequence[int], draw: np.random.Generator) -> None:
        self.sample, self.seed, self.levels, self.held = sample, list(seed), [], {}
        n = int(sample.sizes.sum())
        self.rows = draw.multinomial(n, sample.sizes / n)

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Bins, class, times drawn and node of the cells of each block."""
        keep = self.sample.cells <= HELD
        for b, sent in enumerate(self.sample.blocks):
            bins, classes, counts = sent.value
            if b in self.held:
                level, cells, times, node = self.held[b]
            else:
                times = np.random.default_rng([*self.seed, b]).multinomial(self.rows[b], counts / counts.sum())
                level, cells = 0, np.flatnonzero(times).astype(np.int32)
                times, node = times[cells].astype(np.int64 if times.max() >> 31 else np.int32), np.zeros(len(cells), np.int32)
            for split, column, category, cut in self.levels[level:]:
                on = split[node]
                cells, times, node = cells[on], times[on], node[on]
                value = bins[cells, column[node]]
                right = np.where(category[node] < 0, value > cut[node], value == category[node])
                node = (2 * (np.cumsum(split) - split)[node] + right).astype(np.int32)
            if keep:
                self.held[b] = len(self.levels), cells, times, node
            else:
                vars(sent).pop("_value", None)
            if len(cells):
                yield bins[cells], classes[cells], times, node


def grow_counted(sample: Counted, seed: Sequence[int], depth: int | None) -> dict[str, list]:
    """One tree as by ``grow``, from cells: what is drawn is counted per node, input, bin and class in passes over the blocks, and weighted after."""
    draw = np.random.default_rng(list(seed))
    drawn = _Drawn(sample, seed, draw)
    k = sample.n_classes
    counts = sum((np.bincount(y, times, k) for _, y, times, _ in drawn), np.zeros(k))[None, :]
    weight = counts.sum() / (max((counts > 0).sum(), 1) * np.maximum(counts[0], 1))
    slot_column, slot_category = sample.slots
    tried = max(1, int(math.sqrt(len(slot_column))))
    out: dict[str, list] = {f.split()[0]: [] for f in NODE_FIELDS.split(", ")}
    while len(counts):
        count, level, totals = len(counts), len(drawn.levels), counts * weight
        if depth is None or level < depth:
            slot, cut, gain, left = _best_counted_cuts(sample, drawn, totals, weight, tried, draw)
        else:
            (slot, cut, gain), left = _no_cuts(count), np.zeros((count, k))
        split = slot >= 0
        ahead = len(out["column"]) + count + 2 * (np.cumsum(split) - split)
        column, category = (slot_column[slot], slot_category[slot]) if len(slot_column) else (slot, slot)
        numeric = split & (category < 0)
        out["column"] += np.where(split, column, -1).tolist()
        out["category"] += np.where(split, category, -1).tolist()
        out["threshold"] += [float(sample.cuts[c][b]) if x else 0.0 for c, b, x in zip(column.tolist(), cut.tolist(), numeric.tolist())]
        out["left"] += np.where(split, ahead, -1).tolist()
        out["right"] += np.where(split, ahead + 1, -1).tolist()
        out["shares"] += (totals / totals.sum(axis=1, keepdims=True)).ravel().tolist()
        out["gain"] += np.where(split, gain, 0.0).tolist()
        counts = np.stack([left[split], (counts - left)[split]], axis=1).reshape(-1, k)
        drawn.levels.append((split, column, category, cut))
    return out


def _best_counted_cuts(
    sample: Counted, drawn: _Drawn, totals: np.ndarray, weight: np.ndarray, tried: int, draw: np.random.Generator
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Input (-1: none), cut and fall of impurity of the best cut of each node, and the drawn rows per class that go left."""
    slot_column, slot_category = sample.slots
    count, k = totals.shape
    (best, cut, gain), lefts = _no_cuts(count), np.zeros((count, k))
    whole = (totals**2).sum(axis=1) / totals.sum(axis=1)
    open_ = (totals > 0).sum(axis=1) > 1
    order = draw.random((count, len(slot_column))).argsort(axis=1)
    width = max([len(c) + 1 for c in sample.cuts] + [2])
    for start in range(0, len(slot_column), tried):
        places = range(start, min(start + tried, len(slot_column)))
        nodes, step = np.flatnonzero(open_), max(1, CUT_COUNTS // (len(places) * width * k))
        for some in (nodes[i : i + step] for i in range(0, len(nodes), step)):
            place = np.full(count, -1)
            place[some] = np.arange(len(some))
            counted = np.zeros((len(places), len(some) * width * k))
            for bins, y, times, node in drawn:
                at = place[node]
                rows = np.flatnonzero(at >= 0)
                at, own_node, own_y, own_times = at[rows], node[rows], y[rows], times[rows]
                for i, j in enumerate(places):
                    slot = order[own_node, j]
                    value, category = bins[rows, slot_column[slot]].astype(np.int64), slot_category[slot]
                    value = np.where(category < 0, value, value == category)
                    counted[i] += np.bincount((at * width + value) * k + own_y, own_times, counted.shape[1])
            for i, j in enumerate(places):
                upto = counted[i].reshape(len(some), width, k).cumsum(axis=1)[:, :-1]
                left = upto * weight
                right = totals[some][:, None, :] - left
                n_left, n_right = left.sum(axis=2), right.sum(axis=2)
                with np.errstate(divide="ignore", invalid="ignore"):
                    fall = (left**2).sum(axis=2) / n_left + (right**2).sum(axis=2) / n_right - whole[some][:, None]
                fall[(n_left < 1e-9) | (n_right < 1e-9)] = -1.0
                top = fall.argmax(axis=1)
                fall = fall[np.arange(len(some)), top]
                better = np.flatnonzero(fall > np.maximum(gain[some], 1e-9))
                target = some[better]
                best[target], cut[target], gain[target], lefts[target] = order[target, j], top[better], fall[better], upto[better, top[better]]
        open_ &= best < 0
    return best, cut, gain, lefts


def fit(spark: SparkSession, sample: Sample | Counted, trees: int, depth: int | None, seed: int) -> DataFrame:
    """``tree`` and its node arrays, one row per tree; children and rows count from the tree's first node, a leaf's column is -1."""
    # blocks of cells are sent already
    sent = None if isinstance(sample, Counted) else spark.sparkContext.broadcast(sample)
    cells = sample if sent is None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree in batch.column(0).to_pylist():
                grown = grow_counted(cells, [seed, tree], depth) if sent is None else grow(sent.value, [seed, tree], depth)
                columns = [pa.array([tree], pa.int64())]
                for field in NODE_FIELDS.split(", "):
                    name, kind = field.split()
                    columns.append(pa.array([grown[name]], pa.list_(pa.int32() if "int" in kind else pa.float64())))
                yield pa.RecordBatch.from_arrays(columns, ["tree", *grown])

    parts = min(trees, 4 * spark.sparkContext.defaultParallelism)
    return materialise(spark.range(0, trees, 1, parts).mapInArrow(run, f"tree long, {NODE_FIELDS}"))


@dataclass(frozen=True)
class Trees:
    """The node arrays of all trees one after another, with children as places in them."""

    roots: np.ndarray
    column: np.ndarray
    threshold: np.ndarray
    category: np.ndarray
    left: np.ndarray
    right: np.ndarray
    shares: np.ndarray
    gain: np.ndarray

    @classmethod
    def load(cls, table: DataFrame) -> Trees:
        """Bring a fitted forest to the driver, from where it travels to the tasks; more than ``MAX_NODES`` nodes are an error."""
        nodes = table.agg(F.sum(F.size("column"))).first()[0] or 0
        if nodes > MAX_NODES:
            raise ValueError(f"the forest has {nodes} nodes, more than {MAX_NODES}; bound its depth")
        rows = table.orderBy("tree").toArrow()
        column, threshold, category, left, right, shares, gain = (
            [x.values.to_numpy(zero_copy_only=False) for x in rows.column(f.split()[0])] for f in NODE_FIELDS.split(", ")
        )
        sizes = np.array([len(c) for c in column])
        roots = np.cumsum(sizes) - sizes
        moved = [[np.where(x >= 0, x + r, -1) for x, r in zip(side, roots)] for side in (left, right)]
        n_classes = len(shares[0]) // len(column[0]) if len(sizes) else 0
        flat = [np.concatenate(x) for x in (column, threshold, category, *moved, shares, gain)]
        return cls(roots, flat[0], flat[1], flat[2], flat[3], flat[4], flat[5].reshape(-1, n_classes), flat[6])

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(np.append(self.roots, len(self.column)))

    @cached_property
    def walks(self) -> list[tuple[np.ndarray, ...]]:
        """Per tree, by node: column, lowest bin and number of further bins that go to the second child, the two children; a leaf is its own child."""
        cells = Cells.of(self)
        low, more = np.zeros(len(self.column), np.uint32), np.zeros(len(self.column), np.uint32)
        for c, (marks, text) in enumerate(zip(cells.marks, cells.texts)):
            at = np.flatnonzero(self.column == c)
            place = np.searchsorted(marks, self.category[at] if text else self.threshold[at])
            if text:
                low[at] = place
            else:
                more[at] = place
        out = []
        for root, size in zip(self.roots.tolist(), self.sizes.tolist()):
            own, itself = slice(root, root + size), np.arange(size)
            inner, text = self.column[own] >= 0, self.category[own] >= 0
            sides = [np.where(inner, side[own] - root, itself) for side in (self.left, self.right)]
            children = np.stack([np.where(text, sides[0], sides[1]), np.where(text, sides[1], sides[0])], axis=1).ravel()
            column = np.where(inner, self.column[own], 0)
            out.append((column, low[own] if text.any() else None, more[own], children, inner))
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Mean class shares of the leaves that each row (numbers, then text codes) reaches."""
        total = np.zeros((len(x), self.shares.shape[1]))
        cells = Cells.of(self)
        for first in range(0, len(x), WALK):
            # few rows, which stay in the processor's cache with the nodes of a tree
            binned = cells.binned(x[first : first + WALK])
            values, width = binned.ravel(), binned.shape[1]
            start = np.arange(len(binned)) * width
            for root, (column, low, more, children, inner) in zip(self.roots.tolist(), self.walks):
                leaf, rows, begins = np.zeros(len(binned), np.int64), None, start
                here = np.zeros(len(binned), np.int64)
                while True:
                    for _ in range(STEPS):
                        value = values.take(begins + column.take(here))
                        if low is not None:
                            value -= low.take(here)
                        here = children.take(2 * here + (value <= more.take(here)))
                    if rows is None:
                        leaf = here.copy()
                    else:
                        leaf[rows] = here
                    open_ = np.flatnonzero(inner.take(here))
                    if not len(open_):
                        break
                    rows, here, begins = open_ if rows is None else rows[open_], here[open_], begins[open_]
                total[first : first + WALK] += self.shares[root + leaf]
        return total / max(len(self.roots), 1)

    def importances(self, columns: np.ndarray, categories: np.ndarray) -> np.ndarray:
        """Share of each input in the falls of impurity: per tree, then their mean, together 1 (all 0 where no tree has a cut)."""
        places = {(c, g): i for i, (c, g) in enumerate(zip(columns.tolist(), categories.tolist()))}
        out = np.zeros(len(columns))
        for root, size in zip(self.roots, self.sizes):
            inner = root + np.flatnonzero(self.column[root : root + size] >= 0)
            own = np.bincount([places[p] for p in zip(self.column[inner].tolist(), self.category[inner].tolist())], self.gain[inner], len(out))
            out += own / (own.sum() or 1.0)
        return out / (out.sum() or 1.0)


@dataclass(frozen=True)
class Cells:
    """A forest's bins: numbers between the cut points of all its trees, text codes by the categories that some tree asks for.

    All rows of a cell go the same way in every tree. ``outputs`` has the shares of each cell, once they are known.
    """

    marks: list[np.ndarray]
    texts: list[bool]
    outputs: np.ndarray | None = None

    @classmethod
    def of(cls, trees: Trees) -> Cells:
        texts = [bool((trees.category[trees.column == c] >= 0).any()) for c in range(max(int(trees.column.max(initial=0)) + 1, 1))]
        marks = [np.unique((trees.category if t else trees.threshold)[trees.column == c]).astype(float) for c, t in enumerate(texts)]
        return cls(marks, texts)

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(len(m) + 1 for m in self.marks)

    @property
    def count(self) -> int:
        return math.prod(self.shape)

    def points(self, cells: np.ndarray) -> np.ndarray:
        """A row of each cell: the upper end of its bins, or a category; the last bin holds all that lies above, or no category of the forest."""
        ends = [np.append(m, -1.0 if t else np.inf) for m, t in zip(self.marks, self.texts)]
        return np.stack([e[b] for e, b in zip(ends, np.unravel_index(cells, self.shape))], axis=1)

    def binned(self, x: np.ndarray) -> np.ndarray:
        """[row, column]: the bin of each value; columns that no tree asks for are left out."""
        out = np.zeros((len(x), len(self.marks)), np.uint32)
        for j, (marks, text) in enumerate(zip(self.marks, self.texts)):
            place = np.searchsorted(marks, x[:, j], "left")
            out[:, j] = np.where(np.append(marks, np.nan)[place] == x[:, j], place, len(marks)) if text else place
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self.outputs[np.ravel_multi_index(tuple(self.binned(x).T), self.shape)]


def scorer(spark: SparkSession, trees: Trees, rows: int = 0) -> Scorer:
    """Scorer that sends the trees to the tasks once.

    When ``rows`` rows are to be scored, and the forest has fewer cells than that (``GRID`` numbers at most), tasks evaluate every
    cell by the same walk first; a row is then one look at its cell, with the same outputs.
    """
    sent = spark.sparkContext.broadcast(trees)
    cells = Cells.of(trees)
    if cells.count > rows or cells.count * trees.shares.shape[1] > GRID:
        return python_scorer(lambda x: sent.value.probabilities(x))
    bins = spark.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0).to_pylist():
                ids = np.arange(block * CELLS, min((block + 1) * CELLS, bins.value.count))
                found = sent.value.probabilities(bins.value.points(ids)).ravel()
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([found], pa.list_(pa.float64()))], ["block", "shares"])

    blocks = -(-cells.count // CELLS)
    parts = min(blocks, 4 * spark.sparkContext.defaultParallelism)
    evaluated = spark.range(0, blocks, 1, parts).mapInArrow(run, "block long, shares array<double>")
    # in the order of the blocks, at most GRID numbers
    shares = [np.asarray(x.values) for x in evaluated.toArrow().sort_by("block").column("shares")]
    known = spark.sparkContext.broadcast(Cells(cells.marks, cells.texts, np.concatenate(shares).reshape(cells.count, -1)))
    return python_scorer(lambda x: known.value.probabilities(x))


# Attribution ---------------------------------------------------------------------------------------


@lru_cache(maxsize=DENSE + 1)
def pattern_weights(width: int) -> np.ndarray:
    """[own, base, column]: what a leaf gives a column when the row meets the path columns of bit set ``own`` and the background row those of ``base``.

    The leaf is reached by a mixture that takes from the row what only the row meets (a columns) and from the background what only that meets (b). Over all
    orders, each of the former gains (a - 1)! b! / (a + b)! and each of the latter loses a! (b - 1)! / (a + b)!; where neither meets a column the leaf is out of
    reach.
    """
    n = 1 << width
    own, base = np.arange(n)[:, None, None], np.arange(n)[None, :, None]
    bit = 1 << np.arange(width)[None, None, :]
    return _weights(own, base, bit, n - 1)


def _weights(own: np.ndarray, base: np.ndarray, bit: np.ndarray, full: np.ndarray | int) -> np.ndarray:
    only_own, only_base = own & ~base, base & ~own
    a, b = np.bitwise_count(only_own).astype(int), np.bitwise_count(only_base).astype(int)
    top = int(max(a.max(initial=0), b.max(initial=0))) * 2 + 1
    log_factorial = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, top + 1)))])
    gains = np.exp(log_factorial[np.maximum(a - 1, 0)] + log_factorial[b] - log_factorial[a + b])
    losses = np.exp(log_factorial[a] + log_factorial[np.maximum(b - 1, 0)] - log_factorial[a + b])
    return ((own | base) == full) * (((only_own & bit) > 0) * gains - ((only_base & bit) > 0) * losses)


@dataclass(frozen=True)
class Leaves:
    """The leaves of one tree: value per class, and per path column the bins (over ``low``, up to ``high``) that lead there.

    A path has ``sizes`` columns; it is filled up to the longest with column 0 and all bins, which every row meets.
    """

    sizes: np.ndarray
    columns: np.ndarray
    low: np.ndarray
    high: np.ndarray
    shares: np.ndarray


class Attributor:
    """Exact interventional Shapley values of a forest over numbers against background rows."""

    def __init__(self, trees: Trees, base: np.ndarray) -> None:
        if (trees.category >= 0).any():
            raise ValueError("attribution is for forests over numeric columns")
        self.n_trees, self.n_classes, self.width = len(trees.roots), trees.shares.shape[1], base.shape[1]
        self.cuts = [np.unique(trees.threshold[trees.column == c]) for c in range(self.width)]
        self.leaves = [_leaves(trees, int(r), self.cuts) for r in trees.roots]
        self.base = self._binned(base)
        self.counts = [self._patterns(x, self.base) for x in self.leaves]
        self.grids = self._grids()

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], axis=1).astype(np.int16)

    def _patterns(self, leaves: Leaves, binned: np.ndarray) -> np.ndarray:
        """[leaf, row]: bit set of the path columns that each row meets."""
        width = leaves.columns.shape[1]
        out = np.zeros((len(leaves.columns), len(binned)), np.int64 if width > 30 else np.int32)
        by_column = np.ascontiguousarray(binned.T)
        for k in range(width):
            value = by_column[leaves.columns[:, k]]
            out |= ((value > leaves.low[:, k, None]) & (value <= leaves.high[:, k, None])).astype(out.dtype) << k
        return out

    def values(self, x: np.ndarray) -> np.ndarray:
        """[row, class, column]; per row and class they sum to f(row) - mean f(background).

        Without grids the leaves are gone through one by one, and rows of equal bins are computed once.
        """
        if self.grids is not None:
            return self._looked_up(self._binned(x))
        binned, place = np.unique(self._binned(x), axis=0, return_inverse=True)
        sums: dict[tuple[int, ...], np.ndarray] = {}
        for leaves, base in zip(self.leaves, self.counts):
            width = leaves.columns.shape[1]
            own = self._patterns(leaves, binned)
            weights = self._tables(leaves, base) if width <= DENSE else None
            for leaf, size in enumerate(leaves.sizes.tolist()):
                if size == 0:
                    continue
                table, row = (weights[leaf], own[leaf]) if width <= DENSE else _sparse(own[leaf], base[leaf], width)
                gain = (table[:, :size, None] * leaves.shares[leaf]).reshape(len(table), -1)
                columns = tuple(leaves.columns[leaf, :size].tolist())
                total = sums.get(columns)
                if total is None:
                    total = sums[columns] = np.zeros((len(binned), gain.shape[1]))
                total += np.take(gain, row, axis=0, mode="clip")
        out = np.zeros((len(binned), self.width, self.n_classes))
        for columns, total in sums.items():
            out[:, list(columns)] += total.reshape(len(binned), len(columns), -1)
        return out.transpose(0, 2, 1)[place.ravel()] / max(self.n_trees, 1)


    def _tables(self, leaves: Leaves, base: np.ndarray) -> np.ndarray:
        """[leaf, pattern, path column]: weights of all patterns of a row, summed over the background."""
        width = leaves.columns.shape[1]
        seen = np.zeros((len(leaves.columns), 1 << width))
        np.add.at(seen, (np.arange(len(leaves.columns))[:, None], base), 1.0 / len(self.base))
        return np.tensordot(seen, pattern_weights(width), axes=(1, 1))

    def _grids(self) -> dict[tuple[int, ...], np.ndarray] | None:
        """The values as sums of tables over the bins of few columns, or None where these would be too large.

        A leaf's table over the patterns of its path is a sum over sets of columns of a number times "the row meets all of the set", and a row meets
        a set inside one box of bins. So every leaf of every tree adds boxes to the tables of its column sets; a box is added at its corners, and
        running sums along every axis then fill it. A row costs one look into each table, however many trees there are.
        """
        sets = {tuple(c[:n].tolist()) for x in self.leaves for c, n in zip(x.columns, x.sizes)}
        if max(map(len, sets), default=0) > DENSE:
            return None
        parts = {tuple(c for k, c in enumerate(s) if a >> k & 1) for s in sets for a in range(1 << len(s))}
        bins = [len(c) + 2 for c in self.cuts]
        numbers = self.width * self.n_classes
        if sum(int(np.prod([bins[c] for c in a], dtype=float)) for a in parts) * numbers > GRID:
            return None
        grids = {a: np.zeros((int(np.prod([bins[c] for c in a], dtype=int)), self.width, self.n_classes)) for a in parts}
        held: dict[tuple[int, ...], list[tuple[np.ndarray, ...]]] = {}
        for leaves, base in zip(self.leaves, self.counts):
            width, tables = leaves.columns.shape[1], self._tables(leaves, base)
            for leaf, size in enumerate(leaves.sizes.tolist()):
                # columns that only fill the path up are met by every row
                filled = np.arange(1 << size) | ((1 << width) - (1 << size))
                columns = tuple(leaves.columns[leaf, :size].tolist())
                held.setdefault(columns, []).append((tables[leaf, filled, :size], leaves.low[leaf, :size], leaves.high[leaf, :size], leaves.shares[leaf]))
        for columns, rows in held.items():
            table, low, high, shares = (np.array(x) for x in zip(*rows))
            size = len(columns)
            by_set = table.copy()
            for k in range(size):
                with_k = np.flatnonzero(np.arange(1 << size) >> k & 1)
                by_set[:, with_k] -= by_set[:, with_k ^ (1 << k)]
            last = np.array([len(self.cuts[c]) for c in columns], np.int64)
            edges = np.stack([low.astype(np.int64) + 1, np.minimum(high, last) + 1]) if size else np.zeros((2, len(rows), 0), np.int64)
            for a in range(1 << size):
                axes = [k for k in range(size) if a >> k & 1]
                grid = grids[tuple(columns[k] for k in axes)]
                corner, sign = np.zeros((1, len(rows)), np.int64), np.ones((1, 1))
                for k in axes:
                    corner = np.concatenate([corner * bins[columns[k]] + edges[side, :, k] for side in (0, 1)])
                    sign = np.concatenate([sign, -sign])
                at = corner.ravel()
                for k, c in enumerate(columns):
                    for output in range(self.n_classes):
                        amount = sign * (by_set[:, a, k] * shares[:, output])[None, :]
                        grid[:, c, output] += np.bincount(at, amount.ravel(), len(grid))
        for a, grid in grids.items():
            shaped = grid.reshape(*[bins[c] for c in a], self.width, self.n_classes)
            for axis in range(len(a)):
                np.cumsum(shaped, axis=axis, out=shaped)
            grid /= max(self.n_trees, 1)
        return grids

    def _looked_up(self, binned: np.ndarray) -> np.ndarray:
        bins = [len(c) + 2 for c in self.cuts]
        out = np.zeros((len(binned), self.width, self.n_classes))
        for columns, grid in self.grids.items():
            at = np.zeros(len(binned), np.int64)
            for c in columns:
                at = at * bins[c] + binned[:, c]
            out += grid[at]
        return out.transpose(0, 2, 1)


def _sparse(own: np.ndarray, base: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the patterns that occur, for paths of many columns."""
    mine, row = np.unique(own, return_inverse=True)
    theirs, times = np.unique(base, return_counts=True)
    bit = 1 << np.arange(width, dtype=np.int64)
    table = np.zeros((len(mine), width))
    for pattern, n in zip(theirs.tolist(), times.tolist()):
        table += n / len(base) * _weights(mine[:, None], np.int64(pattern), bit[None, :], (1 << width) - 1)
    return table, row


def _leaves(trees: Trees, root: int, cuts: list[np.ndarray]) -> Leaves:
    found: list[tuple[dict[int, tuple[int, int]], int]] = []
    open_: list[tuple[int, dict[int, tuple[int, int]]]] = [(root, {})]
    while open_:
        node, path = open_.pop()
        c = int(trees.column[node])
        if c < 0:
            found.append((path, node))
            continue
        at = int(np.searchsorted(cuts[c], trees.threshold[node]))
        low, high = path.get(c, (-1, len(cuts[c])))
        open_.append((int(trees.left[node]), path | {c: (low, min(high, at))}))
        open_.append((int(trees.right[node]), path | {c: (max(low, at), high)}))
    width = max((len(p) for p, _ in found), default=0)
    shape = (len(found), width)
    columns, low, high = np.zeros(shape, np.int64), np.full(shape, -1, np.int16), np.full(shape, np.iinfo(np.int16).max, np.int16)
    for i, (path, _) in enumerate(found):
        for k, (c, (a, b)) in enumerate(sorted(path.items())):
            columns[i, k], low[i, k], high[i, k] = c, a, b
    return Leaves(np.array([len(p) for p, _ in found]), columns, low, high, trees.shares[[n for _, n in found]])


def attribute(df: DataFrame, trees: Trees, features: Sequence[str], key: Sequence[str], background: DataFrame, limit: int = 1_000) -> DataFrame:
    """``key..., output, feature, value`` of all rows: exact interventional Shapley values of a forest over ``features``.

    See ``attribute_rows``, whose rows are unfolded here.
    """
    rows = attribute_rows(df, trees, features, key, background, limit)
    names, width = F.array(*[F.lit(c) for c in features]), len(features)
    unfolded = rows.select(*[quoted(k) for k in key], F.posexplode("attribution").alias("place", "value"))
    return unfolded.select(
        *[quoted(k) for k in key], F.floor(F.col("place") / width).cast("int").alias("output"), F.get(names, F.col("place") % width).alias("feature"), "value"
    )


def attribute_rows(df: DataFrame, trees: Trees, features: Sequence[str], key: Sequence[str], background: DataFrame, limit: int = 1_000) -> DataFrame:
    """All rows of ``df`` with ``key...`` and the array ``attribution``: the values of all features for the first output, then for the next.

    Exact interventional Shapley values of a forest over ``features``. ``background`` is a bounded sample and travels with the trees; more than ``limit`` rows are an error, none
    give values of NULL. For each row and output the values sum to f(row) - mean f(background).
    """
    taken = background.select(*[quoted(c).cast("double") for c in features]).limit(limit + 1).collect()
    if len(taken) > limit:
        raise ValueError(f"the background has more than {limit} rows")
    base, width = np.array([list(r) for r in taken], float).reshape(-1, len(features)), len(features)
    # made once, whatever the number of tasks; without it the values are missing
    sent = df.sparkSession.sparkContext.broadcast((Attributor(trees, base) if len(base) else None, trees.shares.shape[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attributor, outputs = sent.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = np.array(batch.column(len(key)).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width)
            values = attributor.values(x) if attributor else np.full((len(x), outputs, width), np.nan)
            flat = pa.array(np.ascontiguousarray(values).reshape(-1), pa.float64(), from_pandas=True)
            ends = pa.array(np.arange(len(x) + 1) * (outputs * width), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(key)], pa.ListArray.from_arrays(ends, flat)], [*key, "attribution"])

    rows = df.select(*[quoted(k) for k in key], feature_array(df, features).alias("inputs"))
    return rows.mapInArrow(run, T.StructType([*[rows.schema[k] for k in key], T.StructField("attribution", T.ArrayType(T.DoubleType()))]))

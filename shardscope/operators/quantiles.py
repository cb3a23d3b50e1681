"""Exact percentiles and median deviations in two scans, without bringing a whole group into one task.

Spark's ``percentile`` keeps every distinct value of a group in one buffer. Here one scan gives a sketch of every column (and
its moments, when they are wanted). The sketch brackets each order statistic; folded around the middle it also brackets the median
deviation from a median that is not yet known exactly. The second scan counts what lies below each bracket and keeps the values inside,
in the same pass over a batch. The brackets hold a small fixed share of the rows, hot values collapse into one counted value,
and the answer is exact: a bracket that missed its rank is widened and the second scan repeated. Tables of every size, empty ones included, go the same
way; what is kept is ranked by a window where it is known to be short, else by running totals over range partitions.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardscope.functions.scalars import finite, quoted
from shardscope.operators.totals import running_totals
from shardscope.session import written

ACCURACY = 10_000
# Groups of at most this share of ``accuracy`` rows have brackets of a few ranks at most and are
# taken whole; the answer is the same.
SHORT = 0.1
# More kept values than this are ranked by running totals instead of a window.
MAX_SURVIVORS = 5_000_000
WIDER = 16
# Cells (groups x columns x brackets) whose brackets travel with the second scan; tables of more groups are joined with theirs.
MAX_CELLS = 2_000_000
# Steps of the sketch that is folded around the median.
FOLD = 1_000
MOMENTS = ("mean", "var", "std", "skew", "kurtosis")
# Distinct kept values a task holds before it hands them on.
HELD = 1 << 20

# The functions travel with the task, so workers need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class Brackets:
    """[group, column, slot] edges on the values, or on their distance from ``middle`` for the slot of the median deviation."""

    low: np.ndarray
    high: np.ndarray
    middle: np.ndarray
    folded: bool


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    accuracy: int = ACCURACY,
    max_survivors: int = MAX_SURVIVORS,
    margin: float | None = None,
) -> DataFrame:
    """Linear-interpolation percentiles: ``by..., feature, prob, n, value``; NULL for no values.

    Missing and non-finite values are skipped. ``n`` is the number of values used. ``margin`` is the
    share of the rows on either side of a rank that its bracket aims at. A table without rows gives n = 0 and
    NULL for every feature, or no rows with ``by``.
    """
    found = order_statistics(df, columns, probs, by, False, False, accuracy, max_survivors, margin)
    listed = F.array(*[F.struct(F.lit(float(p)).alias("prob"), F.get("values", F.lit(i)).alias("value")) for i, p in enumerate(probs)])
    return found.select(*[quoted(b) for b in by], "feature", "n", F.inline(listed)).select(*[quoted(b) for b in by], "feature", "prob", "n", "value")


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Global medians on the driver: one number per column, however long the table is."""
    rows = exact_quantiles(df, columns, [0.5]).select("feature", "value").collect() if columns else []
    return {r.feature: r.value for r in rows}


def order_statistics(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    deviation: bool = False,
    moments: bool = False,
    accuracy: int = ACCURACY,
    max_survivors: int = MAX_SURVIVORS,
    margin: float | None = None,
) -> DataFrame:
    """``by..., feature, n, values`` (one per probability), then ``mad`` and the moments when asked for; ``mad`` needs 0.5 among ``probs``."""
    columns, probs = list(columns), [float(p) for p in probs]
    # One struct as group key: structs with missing fields still equal each other in joins.
    group = F.struct(*[quoted(b).alias(b) for b in by]) if by else F.lit(0)
    rows = df.select(group.alias("group_key"), *[finite(quoted(c)).alias(f"v{i}") for i, c in enumerate(columns)])
    margin = 2.0 / accuracy if margin is None else margin
    sketch = _sketch(rows, len(columns), probs, margin, deviation, moments, accuracy)
    sketch = written(sketch) if by else sketch
    groups = sketch.count() if by else 1
    if groups * len(columns) * (len(probs) + deviation) > MAX_CELLS:
        return _by_join(rows, sketch, columns, probs, by, deviation, moments, accuracy)
    table = sketch.toArrow()
    if table.num_rows == 0 and by:
        return _answers(rows, table, columns, probs, by, [], deviation, moments)
    found = table.select(["counts", "cuts", "grid"] if deviation else ["counts", "cuts"]).to_pylist()
    if not found:
        empty = {"counts": [0] * len(columns), "cuts": [[None] * 2 * len(probs)] * len(columns), "grid": [[None] * (FOLD + 1)] * len(columns)}
        found = [empty]
    counts = np.array([r["counts"] for r in found], np.int64).reshape(len(found), len(columns))
    if not counts.any():
        return _answers(rows, table, columns, probs, by, np.full((*counts.shape, len(probs) + deviation), np.nan), deviation, moments, counts)
    rows = rows.join(_numbered(rows, table), "group_key") if by else rows.withColumn("g", F.lit(0))
    while True:
        brackets = _brackets(found, counts, probs, margin, deviation, accuracy)
        kept = written(_kept(rows, brackets, len(columns)))
        values, missed = _located(kept, counts, probs, deviation, max_survivors)
        if not missed or margin >= 0.5:
            return _answers(rows, table, columns, probs, by, values, deviation, moments, counts)
        margin = margin * WIDER
        if margin >= 0.5:
            found = [r | {"cuts": [None] * len(columns), "grid": [None] * len(columns)} for r in found]
        else:
            wider = _sketch(rows, len(columns), probs, margin, deviation, False, accuracy).toArrow().to_pylist()
            order = {str(r["group_key"]): r for r in wider}
            found = [order[str(k)] for k in table.column("group_key").to_pylist()]


def _sketch(rows: DataFrame, width: int, probs: Sequence[float], margin: float, deviation: bool, moments: bool, accuracy: int) -> DataFrame:
    """One row per group: ``counts``, ``cuts`` around each probability, ``grid`` for the fold, ``moments``; arrays over columns."""
    values = [F.col(f"v{i}") for i in range(width)]
    around = F.array(*[F.lit(min(1.0, max(0.0, p + side))) for p in probs for side in (-margin, margin)])
    parts = [
        F.array(*[F.count(v) for v in values]).alias("counts"),
        F.array(*[F.percentile_approx(v, around, F.lit(accuracy)) for v in values]).alias("cuts"),
    ]
    if deviation:
        grid = F.array(*[F.lit(i / FOLD) for i in range(FOLD + 1)])
        parts.append(F.array(*[F.percentile_approx(v, grid, F.lit(accuracy)) for v in values]).alias("grid"))
    if moments:
        functions = (F.avg, F.var_pop, F.stddev_pop, F.skewness, F.kurtosis)
        parts.append(F.array(*[F.struct(*[f(v).alias(n) for n, f in zip(MOMENTS, functions)]) for v in values]).alias("moments"))
    return rows.groupBy("group_key").agg(*parts)


def _numbered(rows: DataFrame, table: pa.Table) -> DataFrame:
    """The groups with their places in the sketch, as a local relation."""
    numbered = table.select(["group_key"]).append_column("g", pa.array(np.arange(table.num_rows), pa.int32()))
    schema = rows.select("group_key", F.lit(0).alias("g")).schema
    return rows.sparkSession.createDataFrame(numbered, schema=schema)


def _brackets(found: list[dict], counts: np.ndarray, probs: Sequence[float], margin: float, deviation: bool, accuracy: int) -> Brackets:
    """Edges from the sketch; short groups are taken whole."""
    shape = (*counts.shape, len(probs) + deviation)
    low, high, middle = np.full(shape, -np.inf), np.full(shape, np.inf), np.zeros(counts.shape)
    for g, row in enumerate(found):
        for c in range(counts.shape[1]):
            cuts = row["cuts"][c]
            if counts[g, c] <= SHORT * accuracy or cuts is None or margin >= 0.5:
                continue
            low[g, c, : len(probs)], high[g, c, : len(probs)] = cuts[0::2], cuts[1::2]
            if deviation:
                at = probs.index(0.5)
                middle[g, c], low[g, c, -1], high[g, c, -1] = _fold(np.array(row["grid"][c], float), cuts[2 * at], cuts[2 * at + 1], margin, accuracy)
    return Brackets(low, high, middle, deviation)


def _fold(grid: np.ndarray, left: float, right: float, margin: float, accuracy: int) -> tuple[float, float, float]:
    """A middle, and distances from it between which the median deviation lies, from a grid of quantiles.

    The median lies between ``left`` and ``right``, so distances from it differ from those from ``middle`` by at most half that width. A distance
    is surely too short when even the steps it touches hold less than half of the values, and surely too long when the steps it covers hold more.
    """
    middle = left + (right - left) / 2
    slack = max(abs(left - middle), abs(right - middle))
    away = np.unique(np.abs(grid - middle))
    error = margin + 2.0 / accuracy
    inside_least = (np.searchsorted(grid, middle + away, "left") - np.searchsorted(grid, middle - away, "right") - 1) / FOLD - error
    inside_most = (np.searchsorted(grid, middle + away, "right") - np.searchsorted(grid, middle - away, "left") + 1) / FOLD + error
    short, long = away[inside_most < 0.5], away[inside_least > 0.5]
    low = float(short[-1]) if len(short) else 0.0
    high = float(long[0]) if len(long) else np.inf
    return middle, max(low - 2 * slack, 0.0), high + 2 * slack


def _kept(rows: DataFrame, brackets: Brackets, width: int) -> DataFrame:
    """``g, slot, value, n``: kept values with their numbers, and with a NULL value how many lie below the bracket. One scan."""
    slots = brackets.low.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = np.zeros(brackets.low.shape, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            g = batch.column(width).to_numpy()
            for c in range(width):
                value = batch.column(c).to_numpy(zero_copy_only=False).astype(float)
                for s in range(slots):
                    place = value if not brackets.folded or s < slots - 1 else np.abs(value - brackets.middle[g, c])
                    under = place < brackets.low[g, c, s]
                    below[:, c, s] += np.bincount(g[under], minlength=len(below))
                    inside = np.flatnonzero(~under & (place <= brackets.high[g, c, s]))
                    held.append((g[inside].astype(np.int64) * (width * slots) + (c * slots + s), value[inside]))
                    waiting += len(inside)
            if waiting > HELD:
                held = [_counted(held)]
                yield _rows(*held.pop(), width * slots)
                waiting = 0
        if held:
            yield _rows(*_counted(held), width * slots)
        at = np.flatnonzero(below.ravel())
        yield _rows((at, np.full(len(at), np.nan)), below.ravel()[at], width * slots)

    listed = rows.select(*[f"v{i}" for i in range(width)], "g")
    counted = listed.mapInArrow(run, "g int, slot int, value double, n long")
    return counted.groupBy("g", "slot", "value").agg(F.sum("n").alias("n"))


def _counted(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    cell, value = (np.concatenate([h[i] for h in held]) for i in (0, 1))
    order = np.lexsort((value, cell))
    cell, value = cell[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (value[1:] != value[:-1])])) if len(cell) else order
    return (cell[first], value[first]), np.diff(np.append(first, len(cell)))


def _rows(cells: tuple[np.ndarray, np.ndarray], n: np.ndarray, per_group: int) -> pa.RecordBatch:
    cell, value = cells
    columns = [
        pa.array((cell // per_group).astype(np.int32)),
        pa.array((cell % per_group).astype(np.int32)),
        pa.array(value, pa.float64(), mask=np.isnan(value)),
        pa.array(n.astype(np.int64)),
    ]
    return pa.RecordBatch.from_arrays(columns, ["g", "slot", "value", "n"])


def _located(kept: DataFrame, counts: np.ndarray, probs: Sequence[float], deviation: bool, max_survivors: int) -> tuple[np.ndarray, bool]:
    """[group, column, slot] values (NaN for none), and whether some rank lies outside its bracket."""
    slots, n_probs = len(probs) + deviation, len(probs)
    values = np.full((*counts.shape, slots), np.nan)
    exact = np.maximum(counts - 1, 0)[:, :, None] * np.array([*probs, *[0.5] * deviation])
    long = kept.count() > max_survivors
    filled = [(int(g), int(c)) for g, c in zip(*np.nonzero(counts))]
    if not filled:
        return values, False
    of_slot = F.col("slot") % slots
    below = kept.where("value IS NULL").select("g", "slot", F.col("n").alias("below"))
    inside = kept.where("value IS NOT NULL")
    missed = _ranked(inside.where(of_slot < n_probs), below, values, exact, [(g, c, s) for g, c in filled for s in range(n_probs)], long)
    if deviation and not missed:
        at = list(probs).index(0.5)
        middles = [(g, c * slots + n_probs, float(values[g, c, at])) for g, c in filled]
        middle = kept.sparkSession.createDataFrame(middles, "g int, slot int, middle double")
        away = inside.join(middle, ["g", "slot"]).groupBy("g", "slot", F.abs(F.col("value") - F.col("middle")).alias("value")).agg(F.sum("n").alias("n"))
        missed = _ranked(away, below, values, exact, [(g, c, n_probs) for g, c in filled], long)
    return values, missed


def _ranked(inside: DataFrame, below: DataFrame, values: np.ndarray, exact: np.ndarray, cells: list[tuple[int, int, int]], long: bool) -> bool:
    """Fill ``values`` of the cells from their kept values; true when a wanted position is outside of what was kept."""
    slots = values.shape[2]
    g, c, s = (np.array(x) for x in zip(*cells))
    spots = pa.table(
        {
            "g": g.astype(np.int32),
            "slot": (c * slots + s).astype(np.int32),
            "low_pos": np.floor(exact[g, c, s]).astype(np.int64),
            "high_pos": np.ceil(exact[g, c, s]).astype(np.int64),
        }
    )
    if long:
        placed = running_totals(inside, ["g", "slot"], "value", ["n"]).withColumn("upto", F.col("n_before") + F.col("n"))
    else:
        upto = Window.partitionBy("g", "slot").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        placed = inside.withColumn("upto", F.sum("n").over(upto))
    placed = placed.join(below, ["g", "slot"], "left").join(inside.sparkSession.createDataFrame(spots), ["g", "slot"])
    under = F.coalesce("below", F.lit(0))
    rank = F.col("upto") + under
    found = placed.groupBy("g", "slot").agg(
        F.min(F.when(rank > F.col("low_pos"), F.col("value"))).alias("low"),
        F.min(F.when(rank > F.col("high_pos"), F.col("value"))).alias("high"),
        (F.max(under) > F.max("low_pos")).alias("over"),
    )
    seen = {(r.g, r.slot): r for r in found.collect()}
    for gi, ci, si in cells:
        r = seen.get((gi, ci * slots + si))
        if r is None or r.low is None or r.high is None or r.over:
            return True
        share = exact[gi, ci, si] - np.floor(exact[gi, ci, si])
        values[gi, ci, si] = r.low + (r.high - r.low) * share
    return False


def _answers(
    rows: DataFrame, table: pa.Table, columns: Sequence[str], probs: Sequence[float], by: Sequence[str], values, deviation: bool, moments: bool, counts=None
) -> DataFrame:
    """The answers as a local relation; every group and column has a row."""
    spark, n_probs = rows.sparkSession, len(probs)
    entries = []
    # a sketch without rows still answers for the table as a whole
    for g in range(len(values)):
        held = table.column("moments")[g].as_py() if moments and table.num_rows else [dict.fromkeys(MOMENTS)] * len(columns)
        for c, name in enumerate(columns):
            numbers = [None if np.isnan(v) else float(v) for v in values[g][c]]
            entry = {"g": g, "feature": name, "n": int(counts[g, c]), "values": numbers[:n_probs]}
            entry |= {"mad": numbers[n_probs]} if deviation else {}
            entries.append(entry | (held[c] if moments else {}))
    kinds = [("g", pa.int32()), ("feature", pa.string()), ("n", pa.int64()), ("values", pa.list_(pa.float64()))]
    kinds += [("mad", pa.float64())] * deviation + [(m, pa.float64()) for m in MOMENTS] * moments
    local = spark.createDataFrame(pa.Table.from_pylist(entries, pa.schema(kinds)))
    if not by:
        return local.drop("g")
    names = [c for c in local.columns if c != "g"]
    return _numbered(rows, table).join(local, "g").select(*[F.col("group_key")[b].alias(b) for b in by], *names)


def _by_join(
    rows: DataFrame, sketch: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str], deviation: bool, moments: bool, accuracy: int
) -> DataFrame:
    """Tables of very many groups: values are counted per group and ranked by running totals, one feature and group after another."""
    width = len(columns)
    names = F.array(*[F.lit(c) for c in columns])

    def ranked(cells: DataFrame, wanted: Sequence[float]) -> DataFrame:
        counted = cells.where("value IS NOT NULL").groupBy("group_key", "place", "value").agg(F.count("*").alias("n"))
        totals = running_totals(counted, ["group_key", "place"], "value", ["n"])
        upto = F.col("n_before") + F.col("n")

        def at(p: float) -> Column:
            exact = (F.col("n_total") - 1) * F.lit(p)
            low, high = (F.min(F.when(upto > f(exact), F.col("value"))) for f in (F.floor, F.ceil))
            share = F.max(exact - F.floor(exact))
            return low + (high - low) * share

        return totals.groupBy("group_key", "place").agg(F.max("n_total").alias("n"), F.array(*[at(p) for p in wanted]).alias("values"))

    cells = rows.select("group_key", F.posexplode(F.array(*[f"v{i}" for i in range(width)])).alias("place", "value"))
    found = written(ranked(cells, probs))
    base = sketch.select("group_key", F.posexplode("moments" if moments else "counts").alias("place", "held"))
    out = base.join(found, ["group_key", "place"], "left")
    if deviation:
        middle = found.select("group_key", "place", F.get("values", F.lit(list(probs).index(0.5))).alias("middle"))
        away = cells.join(middle, ["group_key", "place"]).select("group_key", "place", F.abs(F.col("value") - F.col("middle")).alias("value"))
        out = out.join(ranked(away, [0.5]).select("group_key", "place", F.get("values", F.lit(0)).alias("mad")), ["group_key", "place"], "left")
    values = F.coalesce("values", F.array_repeat(F.lit(None).cast("double"), len(probs)))
    kept = [values.alias("values")] + (["mad"] if deviation else []) + ([F.col("held")[m].alias(m) for m in MOMENTS] if moments else [])
    keys = [F.col("group_key")[b].alias(b) for b in by]
    return out.select(*keys, F.get(names, F.col("place")).alias("feature"), F.coalesce("n", F.lit(0)).alias("n"), *kept)

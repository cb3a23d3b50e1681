"""Relations between features and between features and the label."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardscope.functions.scalars import finite, numeric_columns, quoted
from shardscope.functions.tails import chi2_tail, f_tail
from shardscope.operators.clean import impute_median, most_frequent
from shardscope.operators.quantiles import exact_quantiles, medians
from shardscope.operators.totals import as_text, running_totals, value_counts
from shardscope.session import local_if_small, settle, written

HOT_ROWS = 100_000

# The functions travel with the task, so workers need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def pearson(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``a, b, r`` for every ordered pair, over rows where both have a value; undefined is 0."""
    columns = list(columns or numeric_columns(df))
    values = df.select(*[finite(quoted(c)).alias(f"c{i}") for i, c in enumerate(columns)])
    return _correlate(settle(values.mapInArrow(_moments, MOMENTS)), columns)


def _correlate(parts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``a, b, r`` for every ordered pair of columns, from partial moments of pairs of places i <= j.

    Every task brings, per pair, the number of its rows with both values, their means, and squares
    and products about these means; they combine like those of groups of rows. 0 where a side does not vary.
    """
    n = F.sum("n")
    means = parts.groupBy("i", "j").agg((F.sum(F.col("n") * F.col("mx")) / n).alias("gx"), (F.sum(F.col("n") * F.col("my")) / n).alias("gy"))
    dx, dy = F.col("mx") - F.col("gx"), F.col("my") - F.col("gy")
    whole = parts.join(means, ["i", "j"]).groupBy("i", "j").agg(
        F.sum(F.col("xx") + F.col("n") * dx * dx).alias("xx"),
        F.sum(F.col("yy") + F.col("n") * dy * dy).alias("yy"),
        F.sum(F.col("xy") + F.col("n") * dx * dy).alias("xy"),
        # What rounding of a mean may leave of a column that does not vary.
        (n * F.pow(F.max(F.abs("gx")) * 1e-14, F.lit(2))).alias("ex"),
        (n * F.pow(F.max(F.abs("gy")) * 1e-14, F.lit(2))).alias("ey"),
    )
    listed = [(columns[i], columns[j], i, j) for i, j in combinations_with_replacement(range(len(columns)), 2)]
    wanted = parts.sparkSession.createDataFrame(listed, "a string, b string, i long, j long")
    varies = (F.col("xx") > F.col("ex")) & (F.col("yy") > F.col("ey"))
    r = F.coalesce(F.when(varies, F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))), F.lit(0.0))
    half = wanted.join(whole, ["i", "j"], "left").select("a", "b", r.alias("r"))
    flip = F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    sides = F.when(F.col("a") == F.col("b"), F.slice(flip, 1, 1)).otherwise(flip)
    return half.select(F.inline(sides), "r").select("a", "b", "r")


MOMENTS = "i long, j long, n double, mx double, my double, xx double, yy double, xy double"


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, origin = None, None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
        known = ~np.isnan(x)
        if origin is None:
            origin = np.where(known.any(axis=0), x[known.argmax(axis=0), np.arange(x.shape[1])], 0.0)
        x, known = np.where(known, x - origin, 0.0), known.astype(float)
        sums = np.stack([known.T @ known, x.T @ known, (x * x).T @ known, x.T @ x])
        total = sums if total is None else total + sums
    if total is None:
        return
    i, j = np.triu_indices(len(origin))
    keep = total[0][i, j] > 0
    i, j = i[keep], j[keep]
    n, sx, sy = total[0][i, j], total[1][i, j], total[1][j, i]
    squares = [total[2][i, j] - sx * sx / n, total[2][j, i] - sy * sy / n, total[3][i, j] - sx * sy / n]
    found = [i, j, n, origin[i] + sx / n, origin[j] + sy / n, np.maximum(squares[0], 0), np.maximum(squares[1], 0), squares[2]]
    yield pa.RecordBatch.from_arrays([pa.array(v) for v in found], ["i", "j", "n", "mx", "my", "xx", "yy", "xy"])


def spearman(df: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of average ranks, pair by pair over rows where both have a value.

    ``key`` identifies a row. Columns that miss in the same rows form a group. Beside the rows of each (column, value) stands how many of
    them have each group, so the running totals over a column's values give a value's rank among the rows of every group at once:
    its rank for any pair. Cells are unfolded once, rows x columns, however many values are missing.
    """
    columns = list(columns or numeric_columns(df, exclude=key))
    clean = df.select(*[quoted(k) for k in key], *[finite(quoted(c)).alias(f"c{i}") for i, c in enumerate(columns)])
    both = np.zeros((len(columns),) * 2)
    counts = clean.select(*[f"c{i}" for i in range(len(columns))]).mapInArrow(_together, "i long, j long, n double")
    for r in counts.groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        both[r.i, r.j] = r.n
    rows = int(both.diagonal().max(initial=0))
    group_of, heads = [], []
    for i in range(len(columns)):
        same = [g for g, h in enumerate(heads) if both[i, h] == both[i, i] == both[h, h]]
        group_of.append(same[0] if same else len(heads))
        heads += [] if same else [i]
    sums = [f"n{g}" for g in range(len(heads))]
    cells = clean.select(
        *[quoted(k) for k in key],
        *[F.col(f"c{h}").isNotNull().cast("int").alias(s) for h, s in zip(heads, sums)],
        F.posexplode(F.array(*[f"c{i}" for i in range(len(columns))])).alias("feature", "value"),
    ).filter("value is not null")
    freq = cells.groupBy("feature", "value").agg(F.count("*").alias("n"), *[F.sum(s).alias(s) for s in sums])
    ranks = running_totals(freq, ["feature"], "value", sums).select(
        "feature", "value", "n", F.array(*[F.col(f"{s}_before") + (F.col(s) + 1) / 2 for s in sums]).alias("rank")
    )
    ranked = _attach_ranks(cells.drop(*sums), ranks, rows, len(columns))
    wide = ranked.groupBy(*[quoted(k) for k in key]).agg(F.collect_list("feature").alias("places"), F.collect_list("rank").alias("ranks"))
    parts = wide.select("places", "ranks").mapInArrow(_rank_moments(group_of, len(heads)), MOMENTS)
    return _correlate(settle(parts), columns)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows have both columns of each pair."""
    total = None
    for batch in batches:
        known = np.column_stack([~np.isnan(c.to_numpy(zero_copy_only=False).astype(float)) for c in batch.columns]).astype(float)
        total = known.T @ known if total is None else total + known.T @ known
    if total is not None:
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(x.ravel()) for x in (i, j, total)], ["i", "j", "n"])


def _rank_moments(group_of: Sequence[int], n_groups: int):
    """Partial moments of all pairs from rows of (place, ranks by group); a pair's ranks are those for the other one's group."""
    group = np.array(group_of)
    members = [np.flatnonzero(group == g) for g in range(n_groups)]
    width = len(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = (width, width)
        n, sx, sy, xx, yy, xy = (np.zeros(shape) for _ in range(6))
        origin: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            lists = batch.column(0)
            sizes = np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(len(sizes)), sizes)
            ranks = np.full((len(sizes), width, n_groups), np.nan)
            held = batch.column(1).flatten().flatten().to_numpy(zero_copy_only=False)
            ranks[owner, lists.flatten().to_numpy()] = held.reshape(-1, n_groups)
            present = [~np.isnan(ranks[:, m[0], 0]) for m in members]
            for g in range(n_groups):
                for h in range(g, n_groups):
                    on = np.flatnonzero(present[g] & present[h])
                    if len(on) == 0:
                        continue
                    x, y = ranks[on][:, members[g], h], ranks[on][:, members[h], g]
                    start = origin.setdefault((g, h), (x[0].copy(), y[0].copy()))
                    x, y = x - start[0], y - start[1]
                    at = np.ix_(members[g], members[h])
                    n[at] += len(on)
                    sx[at] += x.sum(axis=0)[:, None]
                    sy[at] += y.sum(axis=0)[None, :]
                    xx[at] += (x * x).sum(axis=0)[:, None]
                    yy[at] += (y * y).sum(axis=0)[None, :]
                    xy[at] += x.T @ y
        found = []
        for (g, h), (left, right) in origin.items():
            for k, a in enumerate(members[g].tolist()):
                for m, b in enumerate(members[h].tolist()):
                    if g == h and b < a:
                        continue
                    c, p, q = n[a, b], sx[a, b], sy[a, b]
                    sides = [(left[k] + p / c, xx[a, b] - p * p / c), (right[m] + q / c, yy[a, b] - q * q / c)]
                    if a > b:
                        sides.reverse()
                    (mx, x2), (my, y2) = sides
                    found.append((min(a, b), max(a, b), c, mx, my, max(x2, 0.0), max(y2, 0.0), xy[a, b] - p * q / c))
        if found:
            names = [x.split()[0] for x in MOMENTS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*found)], names)

    return run


def _attach_ranks(cells: DataFrame, ranks: DataFrame, rows: int, features: int) -> DataFrame:
    """Join ranks to cells, frequent values on a side of their own.

    A value counts as frequent when more than 1/k of the rows hold it. At most k values of a feature
    can, and k is chosen so that all features together have at most ``HOT_ROWS`` of them: that side
    has a size bound and is broadcast. The other side is shuffled and has no frequent key left.
    """
    per_feature = max(1, HOT_ROWS // max(features, 1))
    hot = F.col("n") * per_feature > F.lit(rows)
    hot_ranks = F.broadcast(ranks.filter(hot).drop("n").withColumnRenamed("rank", "hot_rank"))
    marked = cells.join(hot_ranks, ["feature", "value"], "left")
    cold = marked.filter("hot_rank is null").drop("hot_rank").join(ranks.filter(~hot).drop("n"), ["feature", "value"])
    warm = marked.filter("hot_rank is not null").withColumnRenamed("hot_rank", "rank")
    return warm.unionByName(cold)


def anova(df: DataFrame, label: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One-way F statistic and p-value per numeric feature, after filling with global medians."""
    columns = list(columns or numeric_columns(df, exclude=[label]))
    known = [finite(quoted(c)) for c in columns]
    # One wide aggregate: what is filled in adds to a class in closed form, so no row is filled or unfolded.
    per_column = [F.struct(F.lit(c).alias("feature"), F.count(v).alias("known"), F.avg(v).alias("centre"), F.var_pop(v).alias("var")) for c, v in zip(columns, known)]
    moments = df.groupBy(quoted(label).alias("class")).agg(F.count("*").alias("n"), F.array(*per_column).alias("cells"))
    parts = settle(moments.select("class", "n", F.inline("cells")))
    short = [r.feature for r in parts.groupBy("feature").agg((F.sum("n") - F.sum("known")).alias("gaps")).filter("gaps > 0").collect()]
    middles = F.create_map(*[x for c, m in medians(df, short).items() for x in (F.lit(c), F.lit(m).cast("double"))]) if short else None
    middle = F.lit(None).cast("double") if middles is None else F.try_element_at(middles, F.col("feature"))
    gaps = F.when(F.col("middle").isNotNull(), F.col("n") - F.col("known")).otherwise(F.lit(0))
    size = F.col("known") + F.col("gaps")
    centre, var = F.coalesce("centre", F.lit(0.0)), F.coalesce("var", F.lit(0.0))
    at = F.coalesce("middle", F.lit(0.0))
    mean = (F.col("known") * centre + F.col("gaps") * at) / F.nullif(size, F.lit(0))
    spread = F.col("known") * (var + F.pow(centre - F.col("mean"), 2)) + F.col("gaps") * F.pow(at - F.col("mean"), 2)
    per_class = (
        parts.filter(F.col("class").isNotNull())
        .withColumn("middle", middle)
        .withColumn("gaps", gaps)
        .withColumn("mean", mean)
        .select("feature", "class", size.alias("n"), "mean", (spread / F.nullif(size, F.lit(0))).alias("var"))
        .filter("n > 0")
    )
    grand = F.sum(F.col("n") * F.col("mean")).over(Window.partitionBy("feature")) / F.sum("n").over(
        Window.partitionBy("feature")
    )
    return (
        per_class.withColumn("grand", grand)
        .groupBy("feature")
        .agg(
            F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), 2)).alias("between"),
            F.sum(F.col("n") * F.col("var")).alias("within"),
            (F.count("*") - 1).alias("df1"),
            (F.sum("n") - F.count("*")).alias("df2"),
        )
        .withColumn(
            "f_score",
            (F.col("between") / F.nullif("df1", F.lit(0))) / F.nullif(F.col("within") / F.nullif("df2", F.lit(0)), F.lit(0.0)),
        )
        .select("feature", "f_score", f_tail("f_score", "df1", "df2").alias("p_value"))
    )


def chi2(df: DataFrame, label: str, columns: Sequence[str], filled: bool = True) -> DataFrame:
    """``feature, value, chi2, p_value``: one-hot chi-square of every text value against the label.

    Observed counts per class are compared with the class shares of the whole table. Missing text
    counts as the most frequent value of its column.
    """
    rows = df.filter(quoted(label).isNotNull())
    cells = value_counts(rows, columns, by=[quoted(label).alias("class")], read=as_text)
    if filled:
        modes = most_frequent(df, columns)
        known = F.create_map(*[F.lit(x) for c in columns for x in (c, modes[c])])
        cells = (
            cells.withColumn("value", F.coalesce("value", F.element_at(known, F.col("feature"))))
            .groupBy("class", "feature", "value")
            .agg(F.sum("n").alias("n"))
        )
    cells = cells.filter("value is not null")
    classes = local_if_small(rows.groupBy(quoted(label).alias("class")).agg(F.count("*").alias("class_n")))
    size = classes.agg(F.sum("class_n").alias("rows"), F.count("*").alias("k")).first()
    of_value = F.sum("n").over(Window.partitionBy("feature", "value"))
    expected = F.col("class_n") * F.col("value_n") / F.lit(size.rows or 1)
    return (
        cells.withColumn("value_n", of_value)
        .join(classes, "class")
        .withColumn("expected", expected)
        .groupBy("feature", "value", "value_n")
        .agg(
            # Classes without this value add their whole expected count.
            (
                F.sum(F.pow(F.col("n") - F.col("expected"), 2) / F.col("expected"))
                + F.greatest(F.col("value_n") - F.sum("expected"), F.lit(0.0))
            ).alias("chi2")
        )
        .select("feature", "value", "chi2", chi2_tail("chi2", F.lit(float((size.k or 1) - 1))).alias("p_value"))
    )


def chi2_name(feature: Column, value: Column) -> Column:
    """Name of a one-hot column in result files."""
    return F.concat(F.lit("cat__"), feature, F.lit("_"), value)


def mutual_info(
    df: DataFrame, label: str, columns: Sequence[str] | None = None, bins: int = 16, discrete: Sequence[str] = ()
) -> DataFrame:
    """Plug-in mutual information with the label in nats, after filling with global medians.

    Continuous features are cut at exact quantiles into ``bins`` parts; features named in
    ``discrete`` are used value by value.
    """
    columns = list(columns or numeric_columns(df, exclude=[label]))
    filled = impute_median(df.filter(quoted(label).isNotNull()), columns, fitted_on=df)
    continuous = [c for c in columns if c not in set(discrete)]
    edges: dict[str, list[float]] = {c: [] for c in continuous}
    probs = [i / bins for i in range(1, bins)]
    for r in exact_quantiles(filled, continuous, probs).select("feature", "value").collect() if continuous else []:
        edges[r.feature].append(r.value)

    def part(c: str) -> Column:
        if c not in edges:
            return finite(quoted(c))
        total = F.lit(0)
        for e in edges[c]:
            total = total + (quoted(c) > F.lit(e)).cast("int")
        return total.cast("double")

    binned = filled.select(quoted(label).alias("class"), *[part(c).alias(c) for c in columns])
    joint = value_counts(binned, columns, by=["class"])
    # Margins by aggregation: a window per feature would hold all values of a feature in one task.
    of_class = local_if_small(joint.groupBy("feature", "class").agg(F.sum("n").alias("class_n")))
    size = F.sum("class_n").over(Window.partitionBy("feature"))
    margins = of_class.select("feature", "class", "class_n", size.alias("rows"))
    by_value = F.sum("n").over(Window.partitionBy("feature", "value"))
    terms = joint.withColumn("value_n", by_value).join(margins, ["feature", "class"])
    term = F.col("n") / F.col("rows") * F.log(F.col("n") * F.col("rows") / (F.col("value_n") * F.col("class_n")))
    return terms.groupBy("feature").agg(F.greatest(F.sum(term), F.lit(0.0)).alias("mutual_info"))


def digamma(n: Column) -> Column:
    """Digamma of a positive whole number: the asymptotic series six steps further up."""
    x = n.cast("double") + 6
    series = F.log(x) - 1 / (2 * x) - 1 / (12 * F.pow(x, F.lit(2))) + 1 / (120 * F.pow(x, F.lit(4))) - 1 / (252 * F.pow(x, F.lit(6))) + 1 / (240 * F.pow(x, F.lit(8)))
    for i in range(6):
        series = series - 1 / (n + i)
    return series


def neighbour_info(df: DataFrame, label: str, columns: Sequence[str] | None = None, neighbours: int = 3) -> DataFrame:
    """Nearest-neighbour estimate of mutual information with the label in nats, after filling with global medians.

    For each value, r is the distance to its k-th neighbour among the values of its class (k at most ``neighbours`` and the others of its class), and m
    counts the values of all classes strictly nearer than r, itself included (equal ones when r is 0). The estimate is psi(N) + mean psi(k) - mean
    psi(size of the class) - mean psi(m), at least 0. Classes of one value are left out; no noise is added.

    Equal values of a class are one counted row. The k-th neighbour is found inside range partitions, each of which gets the ``neighbours`` distinct values
    on either side of it; how many values lie in a range is read from running totals over all values.
    """
    columns = list(columns or numeric_columns(df, exclude=[label]))
    filled = impute_median(df.filter(quoted(label).isNotNull()), columns, fitted_on=df)
    counts = written(value_counts(filled, columns, by=[quoted(label).alias("class")]).filter("value is not null"))
    sizes = local_if_small(counts.groupBy("feature", "class").agg(F.sum("n").alias("class_n")))
    points = counts.join(sizes, ["feature", "class"]).filter("class_n > 1")
    near = written(_radius(points, neighbours))
    sides = F.array(
        F.struct(F.lit("low").alias("side"), (F.col("value") - F.col("radius")).alias("at"), F.when(F.col("radius") > 0, 1).otherwise(-1).alias("kind")),
        F.struct(F.lit("high").alias("side"), (F.col("value") + F.col("radius")).alias("at"), F.when(F.col("radius") > 0, -1).otherwise(1).alias("kind")),
    )
    asked = near.select("feature", "value", "radius", F.inline(sides))
    # a question before a value counts what is smaller, one behind it also what is equal
    place = F.struct("at", "kind").alias("place")
    data = near.select("feature", F.struct(F.col("value").alias("at"), F.lit(0).alias("kind")).alias("place"), "n")
    merged = data.unionByName(asked.select("feature", place, F.lit(0).cast("long").alias("n"))).groupBy("feature", "place").agg(F.sum("n").alias("n"))
    totals = written(running_totals(merged, ["feature"], "place", ["n"]).filter("place.kind <> 0").select("feature", "place", "n_before"))
    answered = asked.select("feature", "value", "radius", "side", place).distinct().join(totals, ["feature", "place"])
    inside = answered.groupBy("feature", "value", "radius").agg(F.sum(F.when(F.col("side") == "high", F.col("n_before")).otherwise(-F.col("n_before"))).alias("m"))
    size = F.sum("n").cast("double")
    mean = [F.sum(F.col("n") * digamma(F.col(c))) / size for c in ("k", "class_n", "m")]
    estimate = digamma(F.sum("n")) + mean[0] - mean[1] - mean[2]
    return near.join(inside, ["feature", "value", "radius"]).groupBy("feature").agg(F.greatest(estimate, F.lit(0.0)).alias("mutual_info"))


def _radius(points: DataFrame, neighbours: int) -> DataFrame:
    """``points`` with ``k`` and ``radius``, the distance of each distinct value of a class to its k-th neighbour there."""
    group, entry = ["feature", "class"], F.struct("value", "n")
    placed = written(points.repartitionByRange(*group, "value").withColumn("slice", F.spark_partition_id()))
    within = Window.partitionBy(*group, "slice")
    numbered = placed.withColumn("up", F.row_number().over(within.orderBy("value"))).withColumn("down", F.row_number().over(within.orderBy(F.desc("value"))))
    # the outermost values of each slice, few per slice, and a marker where a slice begins or ends
    edges = settle(numbered.filter((F.col("up") <= neighbours) | (F.col("down") <= neighbours)).select(*group, "slice", "value", "n", "up", "down"))
    marker = edges.select(*group, "slice").distinct().select(*group, "slice", F.lit(True).alias("marker"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("long").alias("n"))
    halos = []
    for side, forward in (("down", True), ("up", False)):
        rows = edges.filter(F.col(side) <= neighbours).select(*group, "slice", F.lit(False).alias("marker"), "value", "n").unionByName(marker)
        step = F.col("slice") if forward else -F.col("slice")
        inner = F.col("value") if forward else -F.col("value")
        frame = Window.partitionBy(*group).orderBy(step, (~F.col("marker")).cast("int"), inner).rowsBetween(-2 * neighbours, -1)
        listed = F.collect_list(F.when(~F.col("marker"), entry)).over(frame)
        name = "before" if forward else "after"
        halos.append(rows.withColumn(name, listed).filter("marker").select(*group, "slice", name))
    halo = halos[0].join(halos[1], [*group, "slice"])
    ordered = within.orderBy("value")
    inside = placed.withColumn("left", F.collect_list(entry).over(ordered.rowsBetween(-neighbours, -1))).withColumn(
        "right", F.collect_list(entry).over(ordered.rowsBetween(1, neighbours))
    )
    met = inside.join(halo, [*group, "slice"])
    # the halo before a slice ends with the nearest; the one behind it too, as it was gathered backwards
    left, right = F.concat("before", "left"), F.concat("right", F.reverse("after"))
    own = F.array(F.struct(F.lit(0.0).alias("away"), (F.col("n") - 1).alias("n")))

    def away(side: Column) -> Column:
        return F.transform(side, lambda x: F.struct(F.abs(x["value"] - F.col("value")).alias("away"), x["n"].alias("n")))

    nearest = F.array_sort(F.concat(own, away(F.slice(F.reverse(left), 1, neighbours)), away(F.slice(right, 1, neighbours))))
    start = F.struct(F.col("k").alias("open"), F.lit(None).cast("double").alias("radius"))
    found = F.aggregate(
        nearest,
        start,
        lambda a, x: F.when(a["radius"].isNotNull(), a)
        .when(a["open"] <= x["n"], F.struct(F.lit(0).cast("long").alias("open"), x["away"].alias("radius")))
        .otherwise(F.struct((a["open"] - x["n"]).alias("open"), F.lit(None).cast("double").alias("radius"))),
        lambda a: a["radius"],
    )
    counted = met.withColumn("k", F.least(F.lit(neighbours).cast("long"), F.col("class_n") - 1))
    return counted.select(*group, "value", "n", "class_n", "k", found.alias("radius"))


def top(table: DataFrame, score: str, k: int, tie: Sequence[str] = ("feature",)) -> DataFrame:
    """The k highest scores, ties by name."""
    return table.orderBy(F.desc(score), *tie).limit(k)

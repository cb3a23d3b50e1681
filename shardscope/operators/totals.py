"""Value counts per feature and running totals over them.

``value_counts`` collapses equal values on the map side, so a value held by a third of all rows is
one row afterwards. ``running_totals`` spreads the distinct values over range partitions, sums each
partition on its own and adds the sum of the partitions before it: no feature has to fit one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardscope.functions.scalars import finite, quoted
from shardscope.session import local_if_small, materialise


def as_text(column: Column) -> Column:
    return column.cast("string")


def long_values(
    df: DataFrame,
    columns: Sequence[str],
    by: Sequence[str | Column] = (),
    read: Callable[[Column], Column] = finite,
) -> DataFrame:
    """One row per cell: ``by..., feature, value``; ``read`` is applied to every cell.

    Cells travel as one array and are cleaned after the unfolding, so the generated code stays short
    for tables of a hundred columns.
    """
    cells = placed_values(df, columns, by, read)
    kept = [quoted(c) for c in cells.columns if c not in ("place", "value")]
    return cells.select(*kept, name_at(columns).alias("feature"), "value")


def name_at(columns: Sequence[str]) -> Column:
    """The name of the column at ``place``."""
    return F.get(F.array(*[F.lit(c) for c in columns]), F.col("place"))


def placed_values(
    df: DataFrame,
    columns: Sequence[str],
    by: Sequence[str | Column] = (),
    read: Callable[[Column], Column] = finite,
) -> DataFrame:
    """The same cells as ``by..., place, value``, with the number of the column (the first of its name), a shorter key to group by."""
    kind = "string" if read is as_text else "double"
    by_columns = [quoted(b) if isinstance(b, str) else b for b in by]
    rows = df.select(*by_columns, F.posexplode(F.array(*[quoted(c).cast(kind) for c in columns])).alias("place", "cell"))
    kept = [c for c in rows.columns if c not in ("place", "cell")]
    first = F.col("place")
    if len(set(columns)) < len(columns):
        first = F.get(F.array(*[F.lit(list(columns).index(c)) for c in columns]), first)
    return rows.select(*[quoted(c) for c in kept], first.alias("place"), read(F.col("cell")).alias("value"))


def value_counts(
    df: DataFrame,
    columns: Sequence[str],
    by: Sequence[str | Column] = (),
    read: Callable[[Column], Column] = finite,
) -> DataFrame:
    """``by..., feature, value, n``; missing values keep a row of their own with a NULL value."""
    cells = placed_values(df, columns, by, read)
    counts = cells.groupBy(*[quoted(c) for c in cells.columns]).agg(F.count("*").alias("n"))
    kept = [quoted(c) for c in cells.columns if c not in ("place", "value")]
    return counts.select(*kept, name_at(columns).alias("feature"), "value", "n")


def running_totals(freq: DataFrame, by: Sequence[str], value: str, sums: Sequence[str]) -> DataFrame:
    """Add ``<name>_before`` (sum over smaller values) and ``<name>_total`` for each column in ``sums``.

    Rows must be unique on ``by`` and ``value``.
    """
    placed = materialise(
        freq.repartitionByRange(*by, value).withColumn("slice", F.spark_partition_id())
    )
    slices = placed.groupBy(*by, "slice").agg(*[F.sum(s).alias(s) for s in sums])
    group = Window.partitionBy(*by)
    earlier = group.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = local_if_small(
        slices.select(
            *by,
            "slice",
            *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"{s}_offset") for s in sums],
            *[F.sum(s).over(group).alias(f"{s}_total") for s in sums],
        )
    )
    within = Window.partitionBy(*by, "slice").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.select(
        "*", *[F.coalesce(F.sum(s).over(within), F.lit(0)).alias(f"{s}_within") for s in sums]
    )
    return local.join(offsets, [*by, "slice"]).select(
        *freq.columns,
        *[(F.col(f"{s}_offset") + F.col(f"{s}_within")).alias(f"{s}_before") for s in sums],
        *[f"{s}_total" for s in sums],
    )

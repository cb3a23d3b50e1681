"""How labels and features are spread over clients."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardscope.functions.scalars import numeric_columns, quoted
from shardscope.operators.clean import MAX_CLASSES
from shardscope.operators.totals import name_at, placed_values, running_totals
from shardscope.session import local_if_small, written


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """``class, count, percent, log_count``; log_count is log10(count + 1)."""
    counts = df.groupBy(quoted(label).alias("class")).agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy())
    return counts.select(
        "class",
        "count",
        F.coalesce(F.col("count") * 100.0 / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("percent"),
        F.log10(F.col("count") + 1).alias("log_count"),
    )


def client_counts(df: DataFrame, client: str = "client") -> DataFrame:
    """``client, n, percent`` of all rows."""
    counts = df.groupBy(quoted(client).alias("client")).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def class_client_grid(df: DataFrame, client: str = "client", label: str = "label") -> DataFrame:
    """``class, client, count``: every class beside every client, 0 where they never meet.

    A missing class or client is one of its own.
    """
    counts = df.groupBy(quoted(client).alias("client"), quoted(label).alias("class")).agg(F.count("*").alias("count"))
    counts = local_if_small(counts)
    # One row per client with its classes; structs keep a missing class beside the others.
    entry = F.struct(F.struct("class").alias("key"), "count")
    held = counts.groupBy("client").agg(F.map_from_entries(F.collect_list(entry)).alias("held"))
    kind = counts.schema["class"].dataType
    classes = [r["class"] for r in counts.select("class").distinct().limit(MAX_CLASSES + 1).collect()]
    if len(classes) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    if not classes:
        return counts.select("class", "client", "count")
    listed = F.array(*[F.struct(F.lit(c).cast(kind).alias("class")) for c in classes])
    grid = held.select("client", "held", F.explode(listed).alias("entry"))
    return grid.select("entry.class", "client", F.coalesce(F.try_element_at("held", F.col("entry")), F.lit(0)).alias("count"))


def label_counts(df: DataFrame, client: str = "client", label: str = "label") -> DataFrame:
    """The grid with ``percent`` within the client; a client without rows has 0 everywhere."""
    return with_client_percent(class_client_grid(df, client, label))


def with_client_percent(grid: DataFrame) -> DataFrame:
    total = F.sum("count").over(Window.partitionBy("client"))
    return grid.withColumn(
        "percent", F.coalesce(F.col("count") * 100.0 / F.nullif(total, F.lit(0)), F.lit(0.0))
    )


def wide_by_client(grid: DataFrame, clients: Sequence[str], value: str = "count") -> DataFrame:
    """One row per class, one column per client."""
    return grid.groupBy("class").pivot("client", list(clients)).agg(F.first(value))


def long_by_client(wide: DataFrame, value: str = "percent") -> DataFrame:
    """Back from one column per client to ``class, client, <value>``."""
    clients = [c for c in wide.columns if c != "class"]
    return wide.unpivot(["class"], clients, "client", value)


def client_totals(grid: DataFrame) -> DataFrame:
    return grid.groupBy("client").agg(F.sum("count").alias("n"))


def class_totals(grid: DataFrame) -> DataFrame:
    return grid.groupBy("class").agg(F.sum("count").alias("n"))


def assign(df: DataFrame, label_map: Mapping[str, Sequence[str]], label: str = "label") -> DataFrame:
    """Add ``client`` by label; a row goes to every client that holds its label."""
    holders: dict[str, list[str]] = {}
    for client, labels in label_map.items():
        for value in labels:
            holders.setdefault(value, []).append(client)
    if not holders:
        return df.withColumn("client", F.lit(None).cast("string")).limit(0)
    # The map is a parameter, not data: expanding it in the row needs no join and no shuffle.
    listed = F.create_map(*[x for v, c in holders.items() for x in (F.lit(v), F.array(*[F.lit(i) for i in c]))])
    return df.select("*", F.explode(F.try_element_at(listed, quoted(label))).alias("client"))


def class_weights(df: DataFrame, label: str = "label", client: str | None = None) -> DataFrame:
    """``[client,] label, n, weight`` with weight = rows / (classes * n).

    Globally, missing labels are left out. Per client, only the client's own classes count and a
    class the client lacks gets weight 1.
    """
    rows = df.filter(quoted(label).isNotNull())
    if client is None:
        counts = rows.groupBy(quoted(label).alias("label")).agg(F.count("*").alias("n"))
        whole = Window.partitionBy()
        return counts.withColumn("weight", F.sum("n").over(whole) / (F.count("*").over(whole) * F.col("n")))
    grid = class_client_grid(rows, client, label)
    own = Window.partitionBy("client")
    present = F.count(F.when(F.col("count") > 0, F.lit(1))).over(own)
    weight = F.sum("count").over(own) / (present * F.nullif(F.col("count"), F.lit(0)))
    return grid.select("client", F.col("class").alias("label"), F.col("count").alias("n"), F.coalesce(weight, F.lit(1.0)).alias("weight"))


def ks_drift(
    df: DataFrame,
    label_map: Mapping[str, Sequence[str]],
    label: str = "label",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """``client, feature, ks_stat``: largest gap between a client's and the whole table's
    cumulative shares. Missing values count as the global median; the whole includes the client.
    """
    columns = list(columns or numeric_columns(df, exclude=[label]))
    clients = list(label_map)
    sums = ["whole", *[f"member{i}" for i in range(len(clients))]]
    cells = placed_values(df, columns, by=[quoted(label).alias("class")])
    counted = cells.groupBy("place", "value").agg(
        F.count("*").alias("whole"),
        *[F.count_if(F.col("class").isin(list(label_map[c]))).alias(f"member{i}") for i, c in enumerate(clients)],
    )
    freq = written(counted.select(name_at(columns).alias("feature"), "value", *sums))
    gaps = freq.filter("value is null").select("feature", *[F.col(s).alias(f"{s}_gaps") for s in sums])
    cumulative = written(running_totals(freq.filter("value is not null"), ["feature"], "value", sums))
    # The median is one or two rows of the running totals. Filled cells lie on it, so cumulative shares rise by them from there on.
    upto = F.col("whole_before") + F.col("whole")
    place = (F.col("whole_total") - 1) * 0.5
    ends = [F.min(F.when(upto > f(place), F.struct("value", *[(F.col(f"{s}_before") + F.col(s)).alias(s) for s in sums]))) for f in (F.floor, F.ceil)]
    middles = local_if_small(
        cumulative.groupBy("feature")
        .agg(ends[0].alias("low"), ends[1].alias("high"), *[F.max(f"{s}_total").alias(f"{s}_all") for s in sums])
        .join(gaps, "feature", "left")
        .select(
            "feature",
            ((F.col("low.value") + F.col("high.value")) / 2).alias("middle"),
            # between two values the median takes the shares of the lower one, with all filled cells
            F.when(F.col("low.value") < F.col("high.value"), F.col("low")).alias("between"),
            *[F.coalesce(f"{s}_gaps", F.lit(0)).alias(f"{s}_gaps") for s in sums],
            *[f"{s}_all" for s in sums],
        )
    )

    def shares(counts: dict[str, Column]) -> dict[str, Column]:
        return {s: counts[s] / F.nullif(F.col(f"{s}_all") + F.col(f"{s}_gaps"), F.lit(0)) for s in sums}

    filled = F.col("value") >= F.col("middle")
    at_values = shares({s: F.col(f"{s}_before") + F.col(s) + F.when(filled, F.col(f"{s}_gaps")).otherwise(0) for s in sums})
    at_middle = shares({s: F.col(f"between.{s}") + F.col(f"{s}_gaps") for s in sums})
    gap = [F.greatest(*[F.abs(at["whole"] - at[f"member{i}"]) for at in (at_values, at_middle)]) for i in range(len(clients))]
    largest = (
        cumulative.join(middles, "feature")
        .groupBy("feature")
        .agg(F.array(*[F.struct(F.lit(c).alias("client"), F.max(g).alias("ks_stat")) for c, g in zip(clients, gap)]).alias("per_client"))
    )
    return largest.select("feature", F.inline("per_client")).select("client", "feature", "ks_stat")


def top_k(table: DataFrame, k: int, by: Sequence[str], score: str, tie: Sequence[str] = ("feature",)) -> DataFrame:
    """The k highest scores of each group, ties by name. Ranks are cut before the shuffle."""
    ranked = Window.partitionBy(*by).orderBy(F.desc(score), *tie)
    return table.withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= k).drop("place")

"""Evaluation of predictions, per class, per client and per round.

Everything starts from the long confusion table, which has classes x classes rows per group however
many predictions there are; the metrics after it never see single rows again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardscope.functions.scalars import quoted

MACRO = ("macro_f1", "macro_precision", "macro_recall")


def confusion(
    predictions: DataFrame,
    classes: Sequence[str],
    by: Sequence[str] = (),
    true: str = "true",
    pred: str = "pred",
) -> DataFrame:
    """``by..., true, pred, n``: every pair of listed classes, 0 where it never occurs.

    Predictions outside the list are errors: they form one more cell per true class, with a missing
    ``pred``, where they occur. A true class outside the list fails the job.
    """
    counts = predictions.groupBy(*[quoted(b) for b in by], quoted(true).alias("true"), quoted(pred).alias("pred")).agg(
        F.count("*").alias("n")
    )
    return full_grid(counts, classes, by)


def full_grid(counts: DataFrame, classes: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Extend a confusion table to the whole class list, gaps become 0.

    A group's counts become one map of at most classes x classes entries, looked up per grid cell.
    """
    listed = F.array(*[F.lit(c) for c in classes])
    unknown = F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce("true", F.lit("NULL")))).cast("string")
    known = counts.select(
        *by,
        F.when(F.col("true").isin(list(classes)), F.col("true")).otherwise(unknown).alias("true"),
        F.when(F.col("pred").isin(list(classes)), F.col("pred")).alias("pred"),
        "n",
    )
    cells = known.groupBy(*by, "true", "pred").agg(F.sum("n").cast("bigint").alias("n"))
    entry = F.struct(F.struct("true", "pred").alias("pair"), "n")
    groups = cells.groupBy(*by).agg(F.map_from_entries(F.collect_list(entry)).alias("cells"))
    outside = F.struct(F.lit(None).cast("string").alias("name"))
    columns = F.concat(F.transform(listed, lambda c: F.struct(c.alias("name"))), F.array(outside))
    grid = groups.select(*by, "cells", F.explode(listed).alias("true")).select(
        *by, "cells", "true", F.explode(columns).alias("column")
    )
    pred = F.col("column.name")
    found = F.try_element_at("cells", F.struct("true", pred.alias("pred")))
    return grid.select(*by, "true", pred.alias("pred"), F.coalesce(found, F.lit(0)).alias("n")).filter("pred is not null or n > 0")


def merge(matrices: DataFrame) -> DataFrame:
    """Sum of confusion tables over all groups."""
    return matrices.groupBy("true", "pred").agg(F.sum("n").alias("n"))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def per_class(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by..., label, precision, recall, f1, support``; undefined ratios are 0."""
    cell = F.array(
        F.struct(F.col("true").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted")),
    )
    hit = F.when((F.col("true") == F.col("pred")) & (F.col("support") > 0), F.col("support")).otherwise(0)
    sums = (
        matrix.select(*by, "true", "pred", F.inline(cell))
        .filter("label is not null")
        .groupBy(*by, "label")
        .agg(F.sum(hit).alias("hits"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    )
    rated = sums.select(
        *by,
        "label",
        _ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        _ratio(F.col("hits"), F.col("support")).alias("recall"),
        "support",
        "predicted",
    )
    f1 = _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return rated.select(*by, "label", "precision", "recall", f1.alias("f1"), "support", "predicted")


def macro(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Macro metrics over the classes present in the truth, with accuracy and sizes."""
    present = F.col("support") > 0

    def mean(c: str) -> Column:
        return F.avg(F.when(present, F.col(c)))

    return (
        per_class(matrix, by)
        .groupBy(*by)
        .agg(
            mean("f1").alias("macro_f1"),
            mean("precision").alias("macro_precision"),
            mean("recall").alias("macro_recall"),
            # Recall times support is the number of hits of the class.
            (F.sum(F.col("recall") * F.col("support")) / F.nullif(F.sum("support"), F.lit(0))).alias("accuracy"),
            F.sum("support").alias("n_test"),
            F.count(F.when(present, F.lit(1))).alias("n_classes_test"),
        )
    )


def averaged_f1(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """F1 weighted by support, and its plain mean over classes seen in truth or prediction."""
    seen = (F.col("support") > 0) | (F.col("predicted") > 0)
    return (
        per_class(matrix, by)
        .groupBy(*by)
        .agg(
            (F.sum(F.col("f1") * F.col("support")) / F.nullif(F.sum("support"), F.lit(0))).alias("weighted_f1"),
            F.avg(F.when(seen, F.col("f1"))).alias("macro_f1"),
        )
    )


def report(matrix: DataFrame) -> DataFrame:
    """Per-class rows plus ``accuracy``, ``macro avg`` and ``weighted avg`` rows."""
    rows = per_class(matrix).filter((F.col("support") > 0) | (F.col("predicted") > 0))
    total = F.sum("support")

    def weighted(c: str) -> Column:
        return F.sum(F.col(c) * F.col("support")) / F.nullif(total, F.lit(0))

    missing = F.lit(None).cast("double")
    summary = rows.agg(
        F.array(
            F.struct(
                F.lit("accuracy").alias("label"), missing.alias("precision"), missing.alias("recall"),
                weighted("recall").alias("f1"), total.alias("support"),
            ),
            F.struct(
                F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                F.avg("f1").alias("f1"), total.alias("support"),
            ),
            F.struct(
                F.lit("weighted avg").alias("label"), weighted("precision").alias("precision"),
                weighted("recall").alias("recall"), weighted("f1").alias("f1"), total.alias("support"),
            ),
        ).alias("rows")
    ).select(F.inline("rows"))
    return rows.drop("predicted").unionByName(summary)


def weighted_mean(metrics: DataFrame, columns: Sequence[str], weight: str, by: Sequence[str] = ()) -> DataFrame:
    """Row-weighted means over clients; a client without a metric is left out of that metric."""

    def mean(c: str) -> Column:
        # A client's missing metric must not weigh in the denominator.
        held = F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c)), F.col(weight))
        return F.sum(F.when(held.isNotNull(), F.col(c) * held)) / F.nullif(F.sum(held), F.lit(0))

    return metrics.groupBy(*by).agg(*[mean(c).alias(f"{c}_weighted") for c in columns])


def rounds(metrics: DataFrame, round_column: str = "round") -> DataFrame:
    """One row per round with the row-weighted macro metrics of its clients."""
    have = [c for c in (*MACRO, *[f"central_{m}" for m in MACRO]) if c in metrics.columns]
    return weighted_mean(metrics, have, "n_test", [round_column])


def central(predictions: DataFrame, classes: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Metrics on a shared held-out table, per round or client, with the prefix ``central_``."""
    table = macro(confusion(predictions, classes, by), by)
    return table.select(*by, *[F.col(c).alias(f"central_{c}") for c in table.columns if c not in by])


def diagnostics_status(received: DataFrame) -> DataFrame:
    """Per round: clients, and how many sent local or central details (non-empty text)."""

    def sent(c: str) -> Column:
        return F.count(F.when(F.length(F.col(c)) > 0, F.lit(1)))

    return received.groupBy("round").agg(
        F.count("*").alias("num_clients"),
        sent("details_json").alias("num_local_details_received"),
        sent("central_details_json").alias("num_central_details_received"),
    )


def wide_matrix(matrix: DataFrame, classes: Sequence[str]) -> DataFrame:
    """One row per true class, one column per predicted class."""
    return matrix.groupBy("true").pivot("pred", list(classes)).agg(F.first("n"))


def details_json(matrix: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group: its confusion table as JSON text, the payload a client reports."""
    cells = F.array_sort(F.collect_list(F.struct("true", "pred", "n")))
    return matrix.groupBy(*by).agg(F.to_json(cells).alias("details_json"))

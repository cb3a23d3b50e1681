"""Attribution of predictions to features, and text prompts built from it."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardscope.functions.labels import PFCP_CLASSES
from shardscope.functions.scalars import argmax, code_name, confidence, quoted
from shardscope.operators.scoring import Scorer, feature_array


# Most background rows a plan may carry.
MAX_BACKGROUND = 1_000


def occlusion(
    df: DataFrame, scorer: Scorer, features: Sequence[str], key: Sequence[str], background: DataFrame
) -> DataFrame:
    """``key..., output, feature, value``: fall of the predicted output when one feature takes its
    background mean. All rows are scored once as they are and once per feature.
    """
    means = background.agg(*[F.avg(quoted(c)).alias(c) for c in features]).first()
    rows = df.select(*[quoted(k) for k in key], feature_array(df, features).alias("inputs"))
    base = scorer(rows, "inputs", "base").withColumn("output", argmax(F.col("base")))
    changed = base.select(
        *[quoted(k) for k in key],
        "output",
        F.get("base", F.col("output")).alias("before"),
        "inputs",
        F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1))).alias("slot"),
    ).withColumn(
        "swapped",
        F.array(
            *[
                F.when(F.col("slot") == i, F.lit(means[c]).cast("double")).otherwise(F.get("inputs", F.lit(i)))
                for i, c in enumerate(features)
            ]
        ),
    )
    after = scorer(changed, "swapped", "after")
    return after.select(
        *[quoted(k) for k in key],
        "output",
        _name(features, F.col("slot")).alias("feature"),
        (F.col("before") - F.get("after", F.col("output"))).alias("value"),
    )


def shapley(
    df: DataFrame,
    scorer: Scorer,
    features: Sequence[str],
    key: Sequence[str],
    background: DataFrame,
    permutations: int = 4,
    seed: int = 0,
) -> DataFrame:
    """``key..., output, feature, value`` for every output, by sampled feature orders.

    Each background row is used with ``permutations`` orders, every second one the reverse of the
    one before. A feature's value is the mean gain of the outputs when it turns from background to
    own; for each row and output the values sum to f(row) - mean f(background). ``background`` is a
    bounded sample (``sampling.background``) and travels with the plan; more than ``MAX_BACKGROUND``
    rows are an error. A scorer with a matrix function is evaluated inside the tasks, once per prefix of
    an order, without unfolding rows; a fitted model scores unfolded rows.
    """
    taken = background.select(*[quoted(c).cast("double") for c in features]).limit(MAX_BACKGROUND + 1).collect()
    if len(taken) > MAX_BACKGROUND:
        raise ValueError(f"the background has more than {MAX_BACKGROUND} rows")
    base = [[float(v) for v in r] for r in taken]
    draw = random.Random(seed)
    walks = []
    for row in base:
        for p in range(permutations):
            if p % 2 == 0:
                order = list(range(len(features)))
                draw.shuffle(order)
            else:
                order = order[::-1]
            place = [order.index(i) for i in range(len(features))]
            walks.append((place, row))
    rows = df.select(*[quoted(k) for k in key], feature_array(df, features).alias("inputs"))
    if getattr(scorer, "matrix", None) is not None:
        return _walked(rows, scorer.matrix, features, key, walks)
    listed = F.array(*[_walk(place, row) for place, row in walks])
    steps = rows.select("*", F.explode(listed).alias("walk")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1))).alias("slot")
    )
    turn = F.get("walk.place", F.col("slot"))

    def mixed(upto: Column) -> Column:
        return F.array(
            *[
                F.when(F.get("walk.place", F.lit(i)) < upto, F.get("inputs", F.lit(i))).otherwise(F.get("walk.base", F.lit(i)))
                for i in range(len(features))
            ]
        )

    scored = scorer(
        scorer(steps.withColumn("without", mixed(turn)).withColumn("with", mixed(turn + 1)), "without", "before"),
        "with",
        "after",
    )
    gains = scored.select(
        *[quoted(k) for k in key], "slot", F.posexplode(F.zip_with("after", "before", lambda a, b: a - b)).alias("output", "gain")
    )
    return (
        gains.groupBy(*[quoted(k) for k in key], "output", "slot")
        .agg(F.avg("gain").alias("value"))
        .select(*[quoted(k) for k in key], "output", _name(features, F.col("slot")).alias("feature"), "value")
    )


def _walked(
    rows: DataFrame, matrix: Callable[[np.ndarray], np.ndarray], features: Sequence[str], key: Sequence[str], walks: list
) -> DataFrame:
    """Mean gains over all walks, batch by batch; every row of the table is read and kept in its task."""
    width = len(features)
    orders = [(np.argsort(place), np.array(base)) for place, base in walks]
    names = list(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = np.array(batch.column(len(key)).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width)
            gains = None
            for order, base in orders:
                point = np.repeat(base[None, :], len(x), axis=0)
                before = matrix(point)
                gains = np.zeros((len(x), before.shape[1], width)) if gains is None else gains
                for feature in order:
                    point[:, feature] = x[:, feature]
                    after = matrix(point)
                    gains[:, :, feature] += after - before
                    before = after
            gains /= len(orders)
            n, outputs = len(x), gains.shape[1]
            owner = pa.array(np.repeat(np.arange(n), outputs * width))
            columns = [batch.column(i).take(owner) for i in range(len(key))]
            columns.append(pa.array(np.tile(np.repeat(np.arange(outputs, dtype=np.int32), width), n)))
            columns.append(pa.array(names * (n * outputs), pa.string()))
            columns.append(pa.array(gains.reshape(-1)))
            yield pa.RecordBatch.from_arrays(columns, [*key, "output", "feature", "value"])

    schema = T.StructType(
        [*[rows.schema[k] for k in key], T.StructField("output", T.IntegerType()), T.StructField("feature", T.StringType()), T.StructField("value", T.DoubleType())]
    )
    return rows.mapInArrow(run, schema)


def _walk(place: Sequence[int], row: Sequence[float]) -> Column:
    return F.struct(
        F.array(*[F.lit(p) for p in place]).alias("place"), F.array(*[F.lit(v) for v in row]).alias("base")
    )


def _name(features: Sequence[str], slot: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in features]), slot)


def summary(attributions: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """``key..., feature, abs_mean``: mean absolute value over outputs (and rows, without a key)."""
    return attributions.groupBy(*[quoted(k) for k in key], "feature").agg(F.avg(F.abs("value")).alias("abs_mean"))


def top_features(summarised: DataFrame, key: Sequence[str], k: int) -> DataFrame:
    """The k strongest features of each row with their ``place`` from 1; at most one row per feature."""
    ranked = Window.partitionBy(*[quoted(c) for c in key]).orderBy(F.desc("abs_mean"), "feature")
    return summarised.withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= k)


def joined_predictions(summarised: DataFrame, predictions: DataFrame, key: Sequence[str]) -> DataFrame:
    """Attribution rows beside the prediction of the same row."""
    return summarised.join(predictions, list(key))


def outcome(pred: Column, true: Column, names: Sequence[str], family: Sequence[str] = PFCP_CLASSES) -> list[Column]:
    """``pred_name, true_name, is_correct, is_family``."""
    said, was = code_name(pred, names), code_name(true, names)
    return [
        said.alias("pred_name"),
        was.alias("true_name"),
        (said == was).alias("is_correct"),
        said.isin(list(family)).alias("is_family"),
    ]


PROMPT_LINES = (
    "Predicted class: %s",
    "True class: %s",
    "",
    "Outcome:",
    "- The prediction is right: %s",
    "- Family: %s",
    "- Confidence: %.1f%%",
    "",
    "Features that moved the prediction most:",
)
# Fixed value: the line of a feature.
FEATURE_LINE = "- %s: importance %.6f"
PREAMBLE = "Explain the following traffic classification to a security analyst."


def prompts(
    summarised: DataFrame,
    predictions: DataFrame,
    key: Sequence[str],
    names: Sequence[str],
    k: int = 10,
    preamble: str = PREAMBLE,
    family: Sequence[str] = PFCP_CLASSES,
    family_name: str = "PFCP",
) -> DataFrame:
    """``key..., prompt``: one text per prediction with its outcome and its k strongest features.

    ``preamble`` carries whatever instructions the receiver of the text needs.
    """
    line = F.format_string(FEATURE_LINE, "feature", "abs_mean")
    lines = F.array_sort(F.collect_list(F.struct("place", line.alias("line"))))
    listed = top_features(summarised, key, k).groupBy(*[quoted(c) for c in key]).agg(
        F.array_join(F.transform(lines, lambda e: e["line"]), "\n").alias("feature_lines")
    )
    facts = predictions.select(
        *[quoted(c) for c in key],
        *outcome(F.col("pred").cast("string"), F.col("true"), names, family),
        (confidence(F.col("probs")) * 100).alias("sure"),
    )
    head = F.format_string(
        preamble.replace("%", "%%") + "\n\n" + "\n".join(PROMPT_LINES),
        "pred_name",
        "true_name",
        F.initcap(F.col("is_correct").cast("string")),
        F.when(F.col("is_family"), family_name).otherwise(f"Non-{family_name}"),
        "sure",
    )
    # both sides have a row per prediction, and Spark underrates a side of few narrow columns: as a broadcast it would fill the driver
    return facts.join(listed.hint("merge"), list(key)).select(
        *[quoted(c) for c in key], F.concat_ws("\n", head, F.col("feature_lines")).alias("prompt")
    )

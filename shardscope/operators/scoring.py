"""Scorers and batch scoring.

A scorer adds to a table an ``array<double>`` column of class outputs, computed from an
``array<double>`` column of features. The same attribution code so serves JVM expressions, fitted
ML models and Python functions. Scorers that know their function on a (rows x features) matrix carry
it as ``matrix``, for operators that score many variants of each row inside a task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardscope.functions.scalars import argmax, quoted

Scorer = Callable[[DataFrame, str, str], DataFrame]


@dataclass(frozen=True)
class Linear:
    """Weights of a linear model: one row of ``coef`` and one ``intercept`` per class."""

    coef: Sequence[Sequence[float]]
    intercept: Sequence[float]

    def outputs(self, features: Column) -> list[Column]:
        def one(weights: Sequence[float], start: float) -> Column:
            total = F.lit(float(start))
            for i, w in enumerate(weights):
                total = total + F.get(features, F.lit(i)) * F.lit(float(w))
            return total

        return [one(w, b) for w, b in zip(self.coef, self.intercept)]


def with_softmax(df: DataFrame, outputs: Sequence[Column], target: str) -> DataFrame:
    """Add the shares of the outputs' exponentials as an array.

    Done in steps with a column each: every output is evaluated once, inside generated code.
    """
    raw = [f"{target}_raw_{k}" for k in range(len(outputs))]
    powers = [f"{target}_exp_{k}" for k in range(len(outputs))]
    named = df.withColumns(dict(zip(raw, outputs)))
    top = F.greatest(*raw) if len(raw) > 1 else F.col(raw[0])
    lifted = named.withColumn(f"{target}_top", top)
    raised = lifted.withColumns({p: F.exp(F.col(r) - F.col(f"{target}_top")) for p, r in zip(powers, raw)})
    total = F.col(powers[0])
    for p in powers[1:]:
        total = total + F.col(p)
    summed = raised.withColumn(f"{target}_sum", total)
    shares = F.array(*[F.col(p) / F.col(f"{target}_sum") for p in powers])
    return summed.withColumn(target, shares).drop(*raw, *powers, f"{target}_top", f"{target}_sum")


def linear_scorer(model: Linear, probabilities: bool = True) -> Scorer:
    def run(df: DataFrame, source: str, target: str) -> DataFrame:
        outputs = model.outputs(F.col(source))
        return with_softmax(df, outputs, target) if probabilities else df.withColumn(target, F.array(*outputs))

    coef, intercept = np.array(model.coef, float).T, np.array(model.intercept, float)

    def matrix(x: np.ndarray) -> np.ndarray:
        raw = x @ coef + intercept
        if not probabilities:
            return raw
        powers = np.exp(raw - raw.max(axis=1, keepdims=True))
        return powers / powers.sum(axis=1, keepdims=True)

    run.matrix = matrix
    return run


def python_scorer(predict: Callable[[np.ndarray], np.ndarray]) -> Scorer:
    """Scorer from a function on a (rows x features) matrix, run on Arrow batches; no row becomes an object of its own."""

    @F.arrow_udf("array<double>")
    def outputs(features: pa.Array) -> pa.Array:
        if not len(features):
            return pa.array([], pa.list_(pa.float64()))
        lengths = features.value_lengths().to_numpy(zero_copy_only=False)
        if features.null_count or (lengths != lengths[0]).any():
            raise ValueError("every row needs the same number of features")
        values = features.flatten().to_numpy(zero_copy_only=False)
        found = np.asarray(predict(values.reshape(len(features), -1).copy()), dtype=float)
        ends = np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]
        # an output that is no number is missing
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel(), from_pandas=True))

    def run(df: DataFrame, source: str, target: str) -> DataFrame:
        return df.withColumn(target, outputs(F.col(source)))

    run.matrix = lambda x: np.asarray(predict(x), dtype=float)
    return run


def fitted_scorer(model) -> Scorer:
    """Scorer from a fitted ML classifier."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    def run(df: DataFrame, source: str, target: str) -> DataFrame:
        inputs = df.withColumn(model.getFeaturesCol(), array_to_vector(F.col(source)))
        made = [model.getFeaturesCol(), model.getRawPredictionCol(), model.getPredictionCol(), model.getProbabilityCol()]
        scored = model.transform(inputs).withColumn(target, vector_to_array(F.col(model.getProbabilityCol())))
        return scored.drop(*[c for c in made if c not in df.columns])

    return run


def feature_array(df: DataFrame, features: Sequence[str]) -> Column:
    return F.array(*[quoted(c).cast("double") for c in features])


def score(df: DataFrame, scorer: Scorer, features: Sequence[str], key: Sequence[str], label: str | None = None) -> DataFrame:
    """``key..., pred, true, probs`` for every row; ``pred`` is the first largest output."""
    true = quoted(label).cast("string") if label else F.lit(None).cast("string")
    rows = df.select(*[quoted(k) for k in key], true.alias("true"), feature_array(df, features).alias("inputs"))
    scored = scorer(rows, "inputs", "probs")
    return scored.select(*[quoted(k) for k in key], argmax(F.col("probs")).alias("pred"), "true", "probs")


def score_fitted(df: DataFrame, model, key: Sequence[str], label: str | None = None) -> DataFrame:
    """The same table from a fitted ML model or pipeline with a ``probability`` column."""
    from pyspark.ml.functions import vector_to_array

    true = quoted(label).cast("string") if label else F.lit(None).cast("string")
    scored = model.transform(df)
    return scored.select(
        *[quoted(k) for k in key],
        F.col("prediction").cast("int").alias("pred"),
        true.alias("true"),
        vector_to_array("probability").alias("probs"),
    )


def wide_probabilities(scored: DataFrame, classes: int) -> DataFrame:
    """Inference rows with one column ``p_<i>`` per class."""
    kept = [quoted(c) for c in scored.columns if c != "probs"]
    return scored.select(*kept, *[F.get("probs", F.lit(i)).alias(f"p_{i}") for i in range(classes)])

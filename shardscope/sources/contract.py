"""Schema contract of the model table and class weights given as JSON."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardscope.functions.scalars import quoted


@dataclass(frozen=True)
class Contract:
    """Label column and ordered feature columns."""

    label: str
    features: Sequence[str]


def load_contract(spark: SparkSession, path: str) -> Contract:
    """Read a contract from a JSON file with ``label_col`` and ``feature_cols``."""
    text = spark.read.text(path, wholetext=True).first()[0]
    payload = json.loads(text)
    return Contract(payload["label_col"], tuple(payload["feature_cols"]))


def apply_contract(df: DataFrame, contract: Contract, keep: Sequence[str] = ()) -> DataFrame:
    """The label and the features in contract order as floats; a missing column is an error."""
    missing = [c for c in (contract.label, *contract.features) if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing from the table: {missing}")
    return df.select(
        *[quoted(c) for c in keep], quoted(contract.label), *[quoted(c).cast("float").alias(c) for c in contract.features]
    )


def parse_class_weights(payload: Column, classes: Sequence[str]) -> Column:
    """Weights in class order from JSON text, as ``array<double>``.

    Accepted are a list in class order, an object class -> weight, and an object holding such an
    object under ``label_weights``. A listed class without a weight fails the job.
    """
    nested = F.from_json(payload, "struct<label_weights:map<string,double>>")["label_weights"]
    flat = F.from_json(payload, "map<string,string>")
    listed = F.from_json(payload, "array<double>")

    def weight(c: str) -> Column:
        found = F.coalesce(F.try_element_at(nested, F.lit(c)), F.try_element_at(flat, F.lit(c)).try_cast("double"))
        return F.coalesce(found, F.raise_error(F.lit(f"no weight for class {c}")).cast("double"))

    return F.when(F.ltrim(payload).startswith("["), listed).otherwise(F.array(*[weight(c) for c in classes]))


def class_weight_rows(payloads: DataFrame, column: str, classes: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``keep..., label, weight``: one row per class and payload."""
    names = F.array(*[F.lit(c) for c in classes])
    rows = payloads.select(*[quoted(k) for k in keep], F.posexplode(parse_class_weights(quoted(column), classes)).alias("place", "weight"))
    return rows.select(*[quoted(k) for k in keep], F.get(names, F.col("place")).alias("label"), "weight")

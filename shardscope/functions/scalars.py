"""Scalar column functions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def quoted(name: str) -> Column:
    """Column by exact name; names of flow tables may contain dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, NUMERIC) and f.name not in skip]


def text_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if not isinstance(f.dataType, NUMERIC) and f.name not in skip]


def finite(column: Column) -> Column:
    """Double value with NaN and both infinities turned into NULL; -0.0 becomes 0.0."""
    value = column.cast("double")
    return F.when(F.abs(value) < F.lit(float("inf")), value + F.lit(0.0))


def not_nan(column: Column) -> Column:
    """Double value with NaN turned into NULL; infinities stay, -0.0 becomes 0.0."""
    value = column.cast("double")
    return F.when(~F.isnan(value), value + F.lit(0.0))


def to_number(column: Column) -> Column:
    """Number in a text, NULL when the text is not a number."""
    return column.try_cast("double")


def safe_div(numerator: Column, denominator: Column) -> Column:
    """Quotient; a zero denominator or a missing operand gives 0."""
    return F.coalesce(numerator / F.nullif(denominator, F.lit(0)), F.lit(0.0))


def clip(column: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(column, F.lit(high)), F.lit(low))


def argmax(probabilities: Column) -> Column:
    """0-based position of the largest entry, the first one on ties."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def confidence(probabilities: Column) -> Column:
    return F.array_max(probabilities)


def literal_map(mapping: Mapping) -> Column:
    """Map literal from a driver-side dict; meant for label lists, not for data."""
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def code_name(code: Column, names: Sequence[str]) -> Column:
    """Class name of an integer code; codes outside the list keep their text form."""
    position = code.try_cast("int")
    inside = position.between(0, len(names) - 1)
    listed = F.array(*[F.lit(n) for n in names])
    return F.coalesce(F.when(inside, F.get(listed, position)), code.cast("string"))


def hash_order(key: Sequence[str | Column], seed: int) -> Column:
    """Repeatable pseudo-random order text: 32 hex digits of an MD5 over seed and row key."""
    parts = [quoted(k) if isinstance(k, str) else k for k in key]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))

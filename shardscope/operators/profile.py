"""Column profiles: missing values, zeros, constants, duplicates, robust statistics, screening."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardscope.functions.scalars import finite, not_nan, numeric_columns, quoted, text_columns
from shardscope.operators.quantiles import order_statistics
from shardscope.operators.totals import as_text, value_counts

MOSTLY_MISSING_PCT = 95.0
ALWAYS_ZERO_PCT = 99.999
NEAR_CONSTANT = 0.999
# Name endings and names that identify a row or a moment instead of describing traffic.
LEAKY_ENDINGS = ("_ip", "_mac", "_oui", "_first_seen_ms", "_last_seen_ms")
LEAKY_NAMES = ("id", "expiration_id")


def _is_missing(name: str, df: DataFrame) -> Column:
    if df.schema[name].dataType.typeName() in ("float", "double"):
        return quoted(name).isNull() | F.isnan(quoted(name))
    return quoted(name).isNull()


def _type_name(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def _frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``feature, hidden, n``: one row per distinct value, ``hidden`` marking the missing one.

    Floating-point columns are counted as numbers; all others by their exact text, which also
    keeps integers beyond 2^53 apart. NaN is missing, an infinity is a value.
    """
    floats = [c for c in columns if _type_name(df, c) in ("float", "double")]
    others = [c for c in columns if c not in floats]
    parts = [
        value_counts(df, names, read=read).select("feature", F.col("value").isNull().alias("hidden"), "n")
        for names, read in ((floats, not_nan), (others, as_text))
        if names
    ]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def missingness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``feature, missing_count, missing_pct, nunique_non_null, dtype`` per column."""
    columns = list(columns or df.columns)
    types = F.element_at(F.create_map(*[F.lit(x) for c in columns for x in (c, _type_name(df, c))]), F.col("feature"))
    missing = F.coalesce(F.sum(F.when(F.col("hidden"), F.col("n"))), F.lit(0))
    return (
        _frequencies(df, columns)
        .groupBy("feature")
        .agg(
            missing.alias("missing_count"),
            F.round(missing / F.sum("n") * 100, 6).alias("missing_pct"),
            F.count(F.when(~F.col("hidden"), F.lit(1))).alias("nunique_non_null"),
        )
        .withColumn("dtype", types)
    )


def ordered_missingness(table: DataFrame) -> DataFrame:
    return table.orderBy(F.desc("missing_pct"), F.desc("missing_count"), "feature")


def missingness_by(df: DataFrame, by: str, columns: Sequence[str] | None = None) -> DataFrame:
    """``feature, <by>, missing_pct``: share of missing values within each class, one scan."""
    columns = list(columns or [c for c in df.columns if c != by])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.avg(_is_missing(c, df).cast("int")).alias("share")) for c in columns])
    shares = df.filter(quoted(by).isNotNull()).groupBy(quoted(by).alias(by)).agg(cells.alias("cells"))
    return shares.select(F.inline("cells"), by).select("feature", by, F.round(F.col("share") * 100, 6).alias("missing_pct"))


def zero_rates(df: DataFrame, columns: Sequence[str] | None = None, by: str | None = None) -> DataFrame:
    """``feature[, <by>], zero_pct``: zeros among all rows; a missing value is not a zero."""
    columns = list(columns or numeric_columns(df, exclude=[by] if by else []))
    cells = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.avg(F.when(quoted(c) == 0, 1).otherwise(0)).alias("share")) for c in columns]
    )
    if by is None:
        shares = df.agg(cells.alias("cells")).select(F.inline("cells"))
        return shares.select("feature", F.round(F.col("share") * 100, 6).alias("zero_pct"))
    shares = df.filter(quoted(by).isNotNull()).groupBy(quoted(by).alias(by)).agg(cells.alias("cells"))
    return shares.select(F.inline("cells"), by).select("feature", by, F.round(F.col("share") * 100, 6).alias("zero_pct"))


def pivot_classes(table: DataFrame, by: str, value: str, classes: Sequence[str]) -> DataFrame:
    """Long class table to one column per class."""
    return table.groupBy("feature").pivot(by, list(classes)).agg(F.first(value))


def constants(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = NEAR_CONSTANT) -> DataFrame:
    """``feature, kind, top_fraction, nunique`` for constant and near-constant columns.

    Missing counts as a value of its own.
    """
    table = _value_spread(df, list(columns or df.columns))
    kind = F.when(F.col("nunique") <= 1, "constant").when(F.col("top_fraction") >= threshold, "near_constant")
    return table.withColumn("kind", kind).filter("kind is not null").select("feature", "kind", "top_fraction", "nunique")


def _value_spread(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return (
        _frequencies(df, columns)
        .groupBy("feature")
        .agg((F.max("n") / F.sum("n")).alias("top_fraction"), F.count("*").alias("nunique"))
    )


def duplicates(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Rows minus distinct rows, over all columns and over all but ``exclude``; missing equals missing.

    Copies collapse on the map side; the second grouping runs on the distinct rows of the first.
    """
    kept = [c for c in df.columns if c not in set(exclude)]
    rows = df.groupBy(*[quoted(c) for c in df.columns]).agg(F.count("*").alias("copies_of_row"))
    groups = rows.groupBy(*[quoted(c) for c in kept]).agg(
        F.sum("copies_of_row").alias("copies_of_row"), F.count("*").alias("distinct_rows")
    )
    total = F.coalesce(F.sum("copies_of_row"), F.lit(0))
    return groups.agg(
        (total - F.coalesce(F.sum("distinct_rows"), F.lit(0))).alias("exact_duplicate_rows"),
        (total - F.count("*")).alias("duplicate_rows_excluding_cols"),
    )


def robust_stats(df: DataFrame, columns: Sequence[str] | None = None, by: str | None = None) -> DataFrame:
    """Moments, quartiles and MAD per numeric column, for the table or within each class.

    Variance and deviation divide by n; skewness and (excess) kurtosis are population moments.
    Missing and non-finite values are skipped and ``count`` counts the rest.
    """
    columns = list(columns or numeric_columns(df, exclude=[by] if by else []))
    keys = [by] if by else []
    rows = df.filter(quoted(by).isNotNull()) if by else df
    found = order_statistics(rows, columns, [0.25, 0.5, 0.75], keys, deviation=True, moments=True)
    q1, median, q3 = (F.get("values", F.lit(i)) for i in range(3))
    return found.select(
        *[quoted(k) for k in keys], "feature", F.col("n").alias("count"), "mean", median.alias("median"), "var", "std", "skew", "kurtosis",
        q1.alias("q1"), q3.alias("q3"), (q3 - q1).alias("iqr"), "mad",
    )


def mad(df: DataFrame, columns: Sequence[str], by: str | None = None, **options: float) -> DataFrame:
    """``[<by>,] feature, mad``: median absolute deviation from the median.

    ``options`` go to ``order_statistics``.
    """
    keys = [by] if by else []
    rows = df.filter(quoted(by).isNotNull()) if by else df
    return order_statistics(rows, columns, [0.5], keys, deviation=True, **options).select(*[quoted(k) for k in keys], "feature", "mad")


def leaky_name(feature: Column) -> Column:
    """Whether a column name looks like an identifier or an absolute time."""
    name = F.lower(feature)
    ending = F.lit(False)
    for end in LEAKY_ENDINGS:
        ending = ending | name.endswith(end)
    return ending | feature.isin(*LEAKY_NAMES)


def screen(df: DataFrame, label: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per feature with screening flags and a ``keep`` decision.

    Constant, always-zero and leaking features go. A feature that is almost always zero stays when
    some class has non-zero values beyond the threshold; mostly missing features are only flagged.
    """
    columns = list(columns or [c for c in df.columns if c != label])
    numbers = [c for c in columns if c not in text_columns(df)]
    # Least, greatest and number of values say whether a column is constant: no value is counted.
    cells = []
    for c in columns:
        held = F.when(~_is_missing(c, df), quoted(c))
        missing = F.count(F.lit(1)) - F.count(held)
        one = (missing == 0) & (F.min(held) == F.max(held))
        share = F.round(missing / F.nullif(F.count(F.lit(1)), F.lit(0)) * 100, 6)
        constant = F.coalesce(one, F.lit(False)) | (F.count(held) == 0)
        cells.append(F.struct(F.lit(c).alias("feature"), share.alias("missing_pct"), constant.alias("is_constant")))
    spread = df.agg(F.array(*cells).alias("cells")).select(F.inline("cells")).filter("missing_pct is not null")
    zeros = zero_rates(df, numbers).join(
        zero_rates(df, numbers, by=label).groupBy("feature").agg(F.min("zero_pct").alias("least_zero_pct")), "feature"
    )
    always_zero = F.coalesce(F.col("zero_pct") >= ALWAYS_ZERO_PCT, F.lit(False))
    in_some_class = F.coalesce(F.col("least_zero_pct") < ALWAYS_ZERO_PCT, F.lit(False))
    leaky = leaky_name(F.col("feature"))
    return spread.join(zeros, "feature", "left").select(
        "feature",
        "missing_pct",
        "zero_pct",
        "is_constant",
        always_zero.alias("is_always_zero"),
        (F.col("missing_pct") >= MOSTLY_MISSING_PCT).alias("is_mostly_missing"),
        leaky.alias("is_leaky"),
        (~F.col("is_constant") & ~leaky & (~always_zero | in_some_class)).alias("keep"),
    )


def apply_screen(df: DataFrame, screened: DataFrame) -> DataFrame:
    """Drop the columns a screening table rejects."""
    rejected = {r.feature for r in screened.filter(~F.col("keep")).select("feature").collect()}
    return df.select(*[quoted(c) for c in df.columns if c not in rejected])


def mostly_missing(table: DataFrame, pct: float = MOSTLY_MISSING_PCT) -> DataFrame:
    return table.filter(F.col("missing_pct") >= pct)


def always_zero(table: DataFrame, pct: float = ALWAYS_ZERO_PCT) -> DataFrame:
    return table.filter(F.col("zero_pct") >= pct)

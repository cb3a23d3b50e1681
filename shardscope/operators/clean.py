"""Row and column clean-up: dropping, coding, imputing, scaling, positions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardscope.functions.scalars import finite, literal_map, quoted, to_number
from shardscope.operators.quantiles import exact_quantiles, medians
from shardscope.operators.totals import as_text, value_counts
from shardscope.session import local_if_small

# Most distinct labels that a plan may list.
MAX_CLASSES = 10_000
# Columns that only record where a row came from.
PROVENANCE = ("original_file", "original_index")
# Text columns that are mostly absent.
SPARSE_TEXT = ("user_agent", "content_type", "requested_server_name", "client_fingerprint", "server_fingerprint")


def replace_columns(df: DataFrame, new: Mapping[str, Column]) -> DataFrame:
    """Replace columns in one projection, keeping their order; unknown names are appended."""
    kept = [new[c].alias(c) if c in new else quoted(c) for c in df.columns]
    return df.select(*kept, *[v.alias(c) for c, v in new.items() if c not in df.columns])


def drop_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop artifact columns by exact name; absent names are ignored."""
    gone = set(names)
    return df.select(*[quoted(c) for c in df.columns if c not in gone])


def drop_provenance(df: DataFrame) -> DataFrame:
    return drop_columns(df, PROVENANCE)


def coerce_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Read columns as numbers, bad text becomes NULL; absent names are ignored."""
    return replace_columns(df, {c: to_number(quoted(c)) for c in columns if c in df.columns})


def impute_median(df: DataFrame, columns: Sequence[str], fitted_on: DataFrame | None = None) -> DataFrame:
    """Fill missing and non-finite values with global medians, by default those of ``df`` itself.

    A client table filled with the medians of the whole table passes the whole as ``fitted_on``.
    Only columns that have something to fill need their median.
    """
    short = with_gaps(df, columns)
    found = medians(df if fitted_on is None else fitted_on, short)
    filled = {c: F.coalesce(finite(quoted(c)), F.lit(found[c]).cast("double")) for c in short}
    return replace_columns(df, {c: filled.get(c, quoted(c).cast("double")) for c in columns})


def with_gaps(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with a missing or non-finite value; one scan with one counter per column."""
    if not columns:
        return []
    gaps = df.agg(F.count("*"), *[F.count(finite(quoted(c))) for c in columns]).first()
    return [c for c, n in zip(columns, gaps[1:]) if n < gaps[0]]


def most_frequent(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """Most frequent text per column, the smallest one on ties."""
    freq = value_counts(df, columns, read=as_text).filter("value is not null")
    best = freq.groupBy("feature").agg(F.min(F.struct((-F.col("n")).alias("rank"), "value")).alias("best"))
    found = {r.feature: r.best.value for r in best.collect()}
    return {c: found.get(c) for c in columns}


def impute_most_frequent(df: DataFrame, columns: Sequence[str], fitted_on: DataFrame | None = None) -> DataFrame:
    """Fill missing texts with the most frequent one, by default of ``df`` itself."""
    found = most_frequent(df if fitted_on is None else fitted_on, columns)
    return replace_columns(df, {c: F.coalesce(quoted(c), F.lit(found[c]).cast(df.schema[c].dataType)) for c in columns})


def robust_scale(df: DataFrame, columns: Sequence[str], fitted_on: DataFrame | None = None) -> DataFrame:
    """(x - median) / IQR over the whole table or over ``fitted_on``; a zero IQR divides by 1."""
    rows = exact_quantiles(df if fitted_on is None else fitted_on, columns, [0.25, 0.5, 0.75]).select("feature", "prob", "value").collect()
    at = {(r.feature, r.prob): r.value for r in rows}

    def scaled(c: str) -> Column:
        q1, mid, q3 = (at[c, p] for p in (0.25, 0.5, 0.75))
        if mid is None:
            return F.lit(None).cast("double")
        return (finite(quoted(c)) - F.lit(mid)) / F.lit((q3 - q1) or 1.0)

    return replace_columns(df, {c: scaled(c) for c in columns})


def robust_scale_per_client(df: DataFrame, columns: Sequence[str], client: str = "client") -> DataFrame:
    """Robust scaling with the median and IQR of the row's own client."""
    fitted = (
        exact_quantiles(df, columns, [0.25, 0.5, 0.75], by=[client])
        .groupBy(client, "feature")
        .agg(
            F.max(F.when(F.col("prob") == 0.5, F.col("value"))).alias("mid"),
            (
                F.max(F.when(F.col("prob") == 0.75, F.col("value")))
                - F.max(F.when(F.col("prob") == 0.25, F.col("value")))
            ).alias("iqr"),
        )
        .groupBy(client)
        .agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mid", "iqr")))).alias("fit"))
    )
    fitted = local_if_small(fitted).withColumnRenamed(client, "fit_client")
    joined = df.join(fitted, df[client].eqNullSafe(fitted["fit_client"]))

    def scaled(c: str) -> Column:
        fit = F.col("fit")[c]
        iqr = F.when(fit["iqr"] == 0, F.lit(1.0)).otherwise(fit["iqr"])
        return (finite(quoted(c)) - fit["mid"]) / iqr

    return replace_columns(joined, {c: scaled(c) for c in columns}).drop("fit", "fit_client")


def presence_flags(df: DataFrame, columns: Sequence[str] = SPARSE_TEXT) -> DataFrame:
    """Add ``<column>__present`` = 1 / 0 for each of the given columns that exists."""
    return replace_columns(df, {f"{c}__present": quoted(c).isNotNull().cast("int") for c in columns if c in df.columns})


def drop_label(df: DataFrame, label: str, dropped: str, renames: Mapping[str, str], client: str = "client") -> DataFrame:
    """Remove one class, rename the remaining clients; clients without a new name are left out."""
    kept = df.filter((quoted(label) != F.lit(dropped)) | quoted(label).isNull())
    renamed = replace_columns(kept, {client: F.element_at(literal_map(renames), quoted(client))})
    return renamed.filter(quoted(client).isNotNull())


def keep_labels(df: DataFrame, label: str, labels: Sequence[str]) -> DataFrame:
    return df.filter(quoted(label).isin(list(labels)))


def encode_labels(df: DataFrame, label: str, classes: Sequence[str], into: str = "code") -> DataFrame:
    """Integer code by position in ``classes``; an unknown label fails the job."""
    code = F.try_element_at(literal_map({c: i for i, c in enumerate(classes)}), quoted(label))
    unknown = F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(quoted(label), F.lit("NULL")))).cast("int")
    return df.withColumn(into, F.coalesce(code, unknown))


def category_codes(df: DataFrame, label: str, into: str = "code") -> DataFrame:
    """Integer code by sorted order of the labels found; missing labels get -1. More than ``MAX_CLASSES`` labels are an error."""
    labels = [r[0] for r in df.select(quoted(label)).distinct().limit(MAX_CLASSES + 2).collect() if r[0] is not None]
    if len(labels) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    if not labels:
        return df.withColumn(into, F.lit(-1))
    codes = literal_map({v: i for i, v in enumerate(sorted(labels))})
    return df.withColumn(into, F.coalesce(F.element_at(codes, quoted(label)), F.lit(-1)))


def row_weights(df: DataFrame, weights: DataFrame, label: str = "label") -> DataFrame:
    """Add the weight of the row's label; ``weights`` has one row per label."""
    return df.join(local_if_small(weights.select(label, "weight")), label, "left")


# Digits by which a descent reads a code, and keys that it sorts in the end.
DESCENT, FEW = 4, 50_000


def order_code(df: DataFrame, key: Sequence[str]) -> Column:
    """A text of hexadecimal digits whose order is that of the composite key: NULL first, numbers by value, texts by their bytes."""

    def signed(value: Column) -> Column:
        # the largest half of the digits for positive numbers
        return F.lpad(F.hex(value.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")

    parts = []
    for name in key:
        kind, value = df.schema[name].dataType, quoted(name)
        if kind.typeName() in ("byte", "short", "integer", "long", "boolean"):
            code = signed(value.cast("int").cast("long") if kind.typeName() == "boolean" else value.cast("long"))
        elif kind.typeName() == "date":
            code = signed(F.unix_date(value).cast("long"))
        elif kind.typeName() in ("timestamp", "timestamp_ntz"):
            code = signed(F.unix_micros(value.cast("timestamp")))
        elif kind.typeName() in ("string", "binary"):
            code = F.concat(F.hex(value.cast("binary")), F.lit(" "))
        elif kind.typeName() in ("float", "double"):
            code = _double_code(value.cast("double"))
        else:
            raise TypeError(f"a key of type {kind.simpleString()} has no code")
        parts.append(F.when(value.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), code)))
    return F.concat(*parts)


def _double_code(value: Column) -> Column:
    """Sign, shifted exponent and 17 digits, complemented for negative numbers; the infinities and NaN at the ends."""
    text = F.format_string("%.16e", F.abs(value))
    exponent = F.lpad((F.substring_index(text, "e", -1).cast("int") + 500).cast("string"), 3, "0")
    digits = F.when(value == 0, F.lit("0" * 20)).otherwise(F.concat(exponent, F.replace(F.substring_index(text, "e", 1), F.lit("."), F.lit(""))))
    infinite = F.abs(value) == F.lit(float("inf"))
    size = F.when(infinite, F.lit("9" * 20)).otherwise(digits)
    return F.when(F.isnan(value), F.lit("2" * 21)).when(value >= 0, F.concat(F.lit("1"), size)).otherwise(F.concat(F.lit("0"), F.translate(size, "0123456789", "9876543210")))


def row_at(df: DataFrame, key: Sequence[str], position: int) -> DataFrame:
    """The row at a 0-based position in the order of a unique key; outside the table is an error.

    The position is looked for by descent: the codes of what is left are counted by their next digits after those they all share, and
    the prefix that holds the position is what is left. Only a last prefix of at most ``FEW`` keys is sorted.
    """
    coded = df.select(order_code(df, key).alias("code"), *[quoted(k) for k in key])
    prefix, place = "", position
    found = coded.agg(F.count("*").alias("n"), F.min("code").alias("low"), F.max("code").alias("high")).first()
    if not 0 <= position < found.n:
        raise IndexError(f"position {position} is outside 0..{found.n - 1}")
    while found.n > FEW and found.low != found.high:
        shared = next(i for i, (a, b) in enumerate(zip(found.low + "~", found.high + "~")) if a != b)
        cut = F.substring("code", 1, shared + DESCENT)
        counts = coded.filter(F.col("code").startswith(prefix)).groupBy(cut.alias("part")).agg(
            F.count("*").alias("n"), F.min("code").alias("low"), F.max("code").alias("high")
        )
        # at most as many parts as there are texts of so many digits
        for found in counts.orderBy("part").collect():
            if place < found.n:
                break
            place -= found.n
        prefix = found.part
    left = coded.filter(F.col("code").startswith(prefix)).drop("code") if found.n <= FEW else coded.filter(F.col("code") == found.low).drop("code")
    wanted = left.orderBy(*[quoted(k).asc_nulls_first() for k in key]).offset(place).first().asDict()
    same = [quoted(k).eqNullSafe(F.lit(wanted[k]).cast(df.schema[k].dataType)) for k in key]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return df.filter(condition)

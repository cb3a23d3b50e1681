"""Ratio features of flow tables and one-hot coding of text columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardscope.functions.scalars import quoted, safe_div
from shardscope.operators.clean import impute_most_frequent, replace_columns
from shardscope.operators.totals import as_text, running_totals, value_counts
from shardscope.session import written

# Engineered ratio -> (numerator, denominator, added to the denominator).
RATIOS = {
    "fe_bytes_per_packet_bi": ("bidirectional_bytes", "bidirectional_packets", 0),
    "fe_bytes_per_packet_s2d": ("src2dst_bytes", "src2dst_packets", 0),
    "fe_bytes_per_packet_d2s": ("dst2src_bytes", "dst2src_packets", 0),
    "fe_byte_ratio_s2d_over_d2s": ("src2dst_bytes", "dst2src_bytes", 1),
    "fe_packet_ratio_s2d_over_d2s": ("src2dst_packets", "dst2src_packets", 1),
    "fe_packets_per_ms_bi": ("bidirectional_packets", "bidirectional_duration_ms", 1),
    "fe_bytes_per_ms_bi": ("bidirectional_bytes", "bidirectional_duration_ms", 1),
    "fe_syn_rate_bi": ("bidirectional_syn_packets", "bidirectional_packets", 1),
    "fe_rst_rate_bi": ("bidirectional_rst_packets", "bidirectional_packets", 1),
    "fe_fin_rate_bi": ("bidirectional_fin_packets", "bidirectional_packets", 1),
    "fe_ack_rate_bi": ("bidirectional_ack_packets", "bidirectional_packets", 1),
    "fe_psh_rate_bi": ("bidirectional_psh_packets", "bidirectional_packets", 1),
    "fe_udps_session_report_req_per_packet": (
        "udps.session_report_request_counter",
        "bidirectional_packets",
        1,
    ),
}

# The further feature names of the model table -> (formula, inputs). The formulas are our own
# definitions: ``share`` n / (d + 1), ``part`` n / d, ``burstiness`` and ``imbalance`` as below, ``rate_gap`` the
# imbalance of two shares.
MODEL_RATIOS = {
    "fe_bidirectional_piat_burstiness": ("burstiness", ["bidirectional_stddev_piat_ms", "bidirectional_mean_piat_ms"]),
    "fe_dst2src_piat_burstiness": ("burstiness", ["dst2src_stddev_piat_ms", "dst2src_mean_piat_ms"]),
    "fe_src2dst_piat_burstiness": ("burstiness", ["src2dst_stddev_piat_ms", "src2dst_mean_piat_ms"]),
    "fe_src2dst_fin_rate": ("share", ["src2dst_fin_packets", "src2dst_packets"]),
    "fe_src2dst_psh_rate": ("share", ["src2dst_psh_packets", "src2dst_packets"]),
    "fe_src2dst_rst_rate": ("share", ["src2dst_rst_packets", "src2dst_packets"]),
    "fe_dst2src_syn_rate": ("share", ["dst2src_syn_packets", "dst2src_packets"]),
    "fe_dst2src_ack_rate": ("share", ["dst2src_ack_packets", "dst2src_packets"]),
    "fe_dst2src_fin_rate": ("share", ["dst2src_fin_packets", "dst2src_packets"]),
    "fe_dst2src_psh_rate": ("share", ["dst2src_psh_packets", "dst2src_packets"]),
    "fe_ack_rate_imbalance": ("rate_gap", ["src2dst_ack_packets", "src2dst_packets", "dst2src_ack_packets", "dst2src_packets"]),
    "fe_src2dst_min_over_mean_ps": ("part", ["src2dst_min_ps", "src2dst_mean_ps"]),
    "fe_session_del_req_per_packet": ("share", ["udps.session_deletion_request_counter", "bidirectional_packets"]),
    "fe_session_del_resp_per_packet": ("share", ["udps.session_deletion_response_counter", "bidirectional_packets"]),
    "fe_session_est_req_per_packet": ("share", ["udps.session_establishment_request_counter", "bidirectional_packets"]),
    "fe_session_mod_req_per_packet": ("share", ["udps.session_modification_request_counter", "bidirectional_packets"]),
    "fe_session_mod_resp_per_packet": ("share", ["udps.session_modification_response_counter", "bidirectional_packets"]),
    "fe_session_rep_req_per_packet": ("share", ["udps.session_report_request_counter", "bidirectional_packets"]),
    "fe_session_rep_resp_per_packet": ("share", ["udps.session_report_response_counter", "bidirectional_packets"]),
    "fe_session_del_req_resp_imbalance": ("imbalance", ["udps.session_deletion_request_counter", "udps.session_deletion_response_counter"]),
    "fe_session_mod_req_resp_imbalance": ("imbalance", ["udps.session_modification_request_counter", "udps.session_modification_response_counter"]),
    "fe_session_rep_req_resp_imbalance": ("imbalance", ["udps.session_report_request_counter", "udps.session_report_response_counter"]),
}


def add_ratios(df: DataFrame, ratios: Mapping[str, tuple[str, str, int]] = RATIOS) -> DataFrame:
    """Add each ratio whose two inputs exist; undefined ratios are 0."""
    have = set(df.columns)
    new = {
        name: safe_div(quoted(top), quoted(bottom) + F.lit(shift) if shift else quoted(bottom))
        for name, (top, bottom, shift) in ratios.items()
        if top in have and bottom in have
    }
    return replace_columns(df, new)


def burstiness(spread: Column, mean: Column) -> Column:
    """(spread - mean) / (spread + mean): -1 for regular, towards 1 for bursty arrivals."""
    return safe_div(spread - mean, spread + mean)


def imbalance(a: Column, b: Column) -> Column:
    return safe_div(a - b, a + b + F.lit(1))


def add_model_ratios(df: DataFrame) -> DataFrame:
    """Add the further ratio features of the model table, where their inputs exist."""
    have = set(df.columns)
    formulas = {
        "burstiness": burstiness,
        "imbalance": imbalance,
        "share": lambda n, d: safe_div(n, d + 1),
        "part": safe_div,
        "rate_gap": lambda a, n, b, m: imbalance(safe_div(a, n + 1), safe_div(b, m + 1)),
    }
    new = {
        name: formulas[formula](*[quoted(c) for c in inputs])
        for name, (formula, inputs) in MODEL_RATIOS.items()
        if have.issuperset(inputs)
    }
    return replace_columns(df, new)


def one_hot_long(df: DataFrame, columns: Sequence[str], key: Sequence[str]) -> DataFrame:
    """The set entries of a one-hot matrix: ``key..., feature, value`` after most-frequent filling."""
    filled = impute_most_frequent(df, columns)
    cells = [F.struct(F.lit(c).alias("feature"), quoted(c).cast("string").alias("value")) for c in columns]
    return filled.select(*[quoted(k) for k in key], F.inline(F.array(*cells)))


def dictionary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``feature, value, code, size``: the distinct texts of each column, numbered in their order from 0.

    Texts are range-partitioned and numbered by the sums of the partitions before, so a column may have as many distinct
    texts as rows: none of them reaches the driver.
    """
    distinct = value_counts(df, columns, read=as_text).filter("value is not null").select("feature", "value", F.lit(1).alias("n"))
    numbered = running_totals(distinct, ["feature"], "value", ["n"])
    return numbered.select("feature", "value", F.col("n_before").alias("code"), F.col("n_total").alias("size"))


def text_codes(df: DataFrame, columns: Sequence[str], words: DataFrame) -> DataFrame:
    """Add ``<column>_code``, the number of the text in the dictionary ``words``; NULL for a missing or unknown text.

    A short dictionary is broadcast by its known size, a long one meets the rows in a shuffle whose hot texts
    adaptive execution splits.
    """
    for c in columns:
        own = words.filter(F.col("feature") == c).select(F.col("value").alias("own_text"), F.col("code").alias(f"{c}_code"))
        df = df.join(own, quoted(c).cast("string") == F.col("own_text"), "left").drop("own_text")
    return df


def one_hot(df: DataFrame, columns: Sequence[str], fitted_on: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Add one sparse vector ``<column>_hot`` per text column; an unknown or missing text is all zeros.

    Returns the table and the dictionary of the fitting rows. The vectors' stored form (size, one index, one value) is put together by column
    expressions, written to the shared folder and read back as vectors: no Python, and no list of categories in the schema.
    """
    from pyspark.ml.linalg import VectorUDT

    words = written(dictionary(df if fitted_on is None else fitted_on, columns))
    sizes = {r.feature: r.size for r in words.groupBy("feature").agg(F.max("size").alias("size")).collect()}
    coded = text_codes(df, columns, words)
    kind = "struct<type: tinyint, size: int, indices: array<int>, values: array<double>>"

    def vector(c: str) -> Column:
        code = quoted(f"{c}_code").cast("int")
        known = F.struct(F.lit(0), F.lit(sizes.get(c, 0)), F.array(code), F.array(F.lit(1.0)))
        unknown = F.struct(F.lit(0), F.lit(sizes.get(c, 0)), F.array().cast("array<int>"), F.array().cast("array<double>"))
        return F.when(code.isNotNull(), known.cast(kind)).otherwise(unknown.cast(kind)).alias(f"{c}_hot")

    table = coded.select(*[quoted(c) for c in df.columns], *[vector(c) for c in columns])
    schema = T.StructType([*df.schema.fields, *[T.StructField(f"{c}_hot", VectorUDT()) for c in columns]])
    return written(table, schema), words

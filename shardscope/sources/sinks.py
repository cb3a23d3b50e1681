"""Writing result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", "true").csv(path)


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "error", by: tuple[str, ...] = ()) -> None:
    """Columnar copy for reuse, optionally in one folder per client or label."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)

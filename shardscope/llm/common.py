"""Helpers shared by the operators of this subpackage: tables, written results, words as arrays."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that an array step takes at once (a longer text is taken alone).
SLICE_BYTES = 2 << 20


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, whatever folder the session was started in.

    A cluster whose machines do not share that folder has the package installed; the entry then changes nothing.
    """
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *known])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="shardscope-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str = "part", compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and go on from there.

    The written rows survive lost executors and cut the lineage; unlike a checkpoint of rows they are
    compressed and read by column. The folder belongs to the job, whose owner empties it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucket_of(column: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets))


def crc_part(doc_id: Column, parts: int) -> Column:
    """crc32 of the identifier as text, modulo ``parts``; an identifier of null counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts


FILTER_SLOTS = 1 << 18


def key_filter(keys: DataFrame, *columns: str) -> DataFrame:
    """A bitmap of the keys, at most ``FILTER_SLOTS`` rows of 64 bits whatever their number: columns _slot and _bits."""
    bits = keys.select(_slot(columns).alias("_slot"), _bit(columns).alias("_bit"))
    return bits.groupBy("_slot").agg(F.bit_or("_bit").alias("_bits"))


def maybe_in(rows: DataFrame, bitmap: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with a flag _maybe: false only where the key is surely not among the bitmap's keys.

    The flag saves shuffling rows that an equi-join would drop; it never decides a result. The bitmap is bounded by construction and so
    can be broadcast.
    """
    met = rows.withColumn("_slot", _slot(columns)).join(F.broadcast(bitmap), "_slot", "left")
    return met.withColumn("_maybe", F.coalesce(F.col("_bits"), F.lit(0)).bitwiseAND(_bit(columns)) != 0).drop("_slot", "_bits")


def _slot(columns: tuple[str, ...]) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(FILTER_SLOTS))


def _bit(columns: tuple[str, ...]) -> Column:
    place = F.pmod(F.shiftright(F.xxhash64(*columns), 32), F.lit(64)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


# Words as arrays ---------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(have, out=have)
        if size <= 4 * SLICE_BYTES:
            _POWERS[name] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) of runs of texts of about ``limit`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if column.null_count == 0 else column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, "right")) - 1)
        last = min(last, len(column))
        yield first, bytes_[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        first = last


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each text (and the end) the index of its first word."""
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | cut[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word that depends on its bytes alone."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data + np.uint64(1)) * _powers("up", _BASE, len(data)), out=sums[1:])
        return mix64((sums[ends] - sums[starts]) * _powers("down", _BASE_INVERSE, len(data))[starts])


def window_hashes(words: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` hashed words (empty when there are fewer)."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    factor, out = np.uint64((0xD6E8FEB86659FD93 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF | 1), np.zeros(len(words) - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * factor + words[k : k + len(out)]
    return mix64(out + np.uint64(width))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)

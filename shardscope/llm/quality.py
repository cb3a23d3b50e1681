"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

One vectorised pass turns every whole text into statistics (shares of character classes, repeated words and lines, word lengths),
each mapped by log(share + offset) so that a class is closer to normal. Class means and covariances are one aggregate over the
labelled rows; each covariance is shrunk towards the pooled one and towards a multiple of the identity. A score is the logistic
function of the difference of the two log densities, by Mahalanobis distances through Cholesky factors computed once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardscope.llm.common import LOWER, crc_part, key_filter, maybe_in, mix64, reach_workers, slices, table, window_hashes, word_bounds, word_hashes, written

STATISTICS = (
    "upper", "bang", "pipe", "symbol", "accent", "newline", "same_next", "repeated_words", "repeated_pairs",
    "repeated_lines", "word_mean", "word_spread", "upper_words",
)
#: Parts of a shrunk covariance: pooled covariance, multiple of the identity; the rest is the class's own.
POOLED, ROUND = 0.1, 0.02
OFFSET = 0.01
#: Bytes and words of a neutral text added to every text, so that the shares of very short texts are not extreme.
EVEN_BYTES, EVEN_WORDS, EVEN_LENGTH = 120.0, 20.0, 5.0
FOLDS, HELD_OUT = 3, 1

_KINDS = np.zeros(256, np.uint8)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!", b"|", b"#$%&*+<=>@\\^_`{}~/[]\"()'-"), 1):
    _KINDS[list(_chars)] = _k
_KINDS[128:] = 5
_KINDS[10] = 6


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` over each run bounds[i]:bounds[i+1]."""
    total = np.zeros(len(flags) + 1, np.float64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _again(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Per owner, how many of its values repeat an earlier one of the same owner."""
    with np.errstate(over="ignore"):
        keys = np.sort(mix64(values + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & ~np.uint64(0xFFFF) | owner.astype(np.uint64) & np.uint64(0xFFFF))
    same = keys[1:] == keys[:-1]
    return np.bincount((keys[1:][same] & np.uint64(0xFFFF)).astype(np.int64), minlength=n)[:n].astype(np.float64)


def text_statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of ``STATISTICS`` for a run of texts (fewer than 65,536); an empty text has the neutral text's."""
    n = len(offsets) - 1
    kinds, length = _KINDS[data], np.diff(offsets) + EVEN_BYTES
    shares = [_sums(kinds == k, offsets) / length for k in range(1, 7)]
    starts, ends, first = word_bounds(data, offsets)
    counts = np.diff(first)
    many, owner = counts + EVEN_WORDS, np.repeat(np.arange(n), counts)
    hashes = word_hashes(LOWER[data], starts, ends)
    next_same = np.zeros(len(hashes), bool)
    next_same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    pairs, inner = window_hashes(hashes, 2), owner[1:] == owner[:-1]
    # lines, as words of a text whose only space is the line feed
    lines = np.where(data == 10, np.uint8(10), np.maximum(data, np.uint8(33)))
    line_starts, line_ends, line_first = word_bounds(lines, offsets)
    line_owner = np.repeat(np.arange(n), np.diff(line_first))
    line_hashes = word_hashes(lines, line_starts, line_ends)
    sizes = (ends - starts).astype(np.float64)
    mean = (_sums(sizes, first) + EVEN_WORDS * EVEN_LENGTH) / many
    spread = np.sqrt(np.maximum((_sums(sizes * sizes, first) + EVEN_WORDS * (EVEN_LENGTH**2 + 9)) / many - mean * mean, 0))
    capital = np.zeros(len(data) + 1)
    np.cumsum(kinds == 1, out=capital[1:])
    shouted = (capital[ends] - capital[starts]) >= np.maximum(2, sizes / 2)
    logs = [np.log(x + OFFSET) for x in (
        *shares, _sums(next_same, first) / many, _again(hashes, owner, n) / many,
        _again(pairs[inner], owner[1:][inner], n) / many, _again(line_hashes, line_owner, n) / (np.diff(line_first) + 2),
    )]
    return np.column_stack([*logs, np.log1p(mean), np.log1p(spread), np.log(_sums(shouted, first) / many + OFFSET)])


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and one column per statistic; reads no other column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in slices(batch.column(1)):
                found = text_statistics(data, offsets)
                rows = batch.column(0).slice(first, len(found))
                yield pa.RecordBatch.from_arrays([rows, *(pa.array(x) for x in found.T)], ["doc_id", *STATISTICS])

    reach_workers(docs.sparkSession)
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(s, T.DoubleType()) for s in STATISTICS)])
    return docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


@dataclass(frozen=True)
class Discriminant:
    """Per class: mean, inverse of the Cholesky factor of its shrunk covariance, log determinant and prior (all logs)."""

    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        logs = [
            offset - 0.5 * (((x - mean) @ factor.T) ** 2).sum(axis=1)
            for mean, factor, offset in zip(self.means, self.factors, self.offsets)
        ]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(rows: DataFrame, label: str = "quality", pooled: float = POOLED, identity: float = ROUND) -> Discriminant:
    """Fit on all rows labelled 0 or 1. The sums are one aggregate; its two rows of fixed width come to the driver.

    Without rows of one class every score is the share of label 1 (0.5 without any row).
    """
    d = len(STATISTICS)
    cross = [F.sum(F.col(STATISTICS[i]) * F.col(STATISTICS[j])) for i in range(d) for j in range(i + 1)]
    sums = rows.where(F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int").alias("label")).agg(
        F.count("*").alias("n"), F.array(*[F.sum(s) for s in STATISTICS]).alias("sums"), F.array(*cross).alias("cross")
    )
    found = {r["label"]: r for r in sums.collect()}
    if len(found) < 2 or min(r["n"] for r in found.values()) < 2:
        n = sum(r["n"] for r in found.values())
        return Discriminant(np.zeros(0), np.zeros(0), np.zeros(0), found[1]["n"] / n if n and 1 in found else 0.0 if n else 0.5)
    means, spreads, counts = [], [], []
    for c in (0, 1):
        n, mean, square = found[c]["n"], np.array(found[c]["sums"]) / found[c]["n"], np.zeros((d, d))
        square[np.tril_indices(d)] = found[c]["cross"]
        square = square + np.tril(square, -1).T
        means, spreads, counts = [*means, mean], [*spreads, square / n - np.outer(mean, mean)], [*counts, n]
    common = sum(n * s for n, s in zip(counts, spreads)) / sum(counts)
    factors, offsets = [], []
    for n, spread in zip(counts, spreads):
        level = max(np.trace(spread) / d, 1e-6)
        shrunk = (1 - pooled - identity) * spread + pooled * common + identity * level * np.eye(d)
        factor = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(factor))
        offsets.append(np.log(n / sum(counts)) - np.log(np.diag(factor)).sum())
    return Discriminant(np.array(means), np.array(factors), np.array(offsets))


def scored(features: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id, score, predicted; a score is from 0 to 1, and predicted is 1 from 0.5 on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(len(STATISTICS))])
            score = model.score(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"]
            )

    kind = features.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return features.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Learns from the labelled documents whose crc32(doc_id as text) mod 3 is not 1; labels, languages, sources and identifiers are no
    inputs of a score. Null texts count as empty; identifiers of null or with several labels are scored like any other, and all
    of a document's labels count. An empty table gives no rows.
    """
    features = written(statistics(docs, key, text), "statistics")
    marks = labels.select(F.col("doc_id").alias("_llm_id"), F.col(label).alias("_llm_label")).distinct()
    learning = features.where(crc_part(F.col("doc_id"), FOLDS) != HELD_OUT).join(marks, F.col("doc_id") == F.col("_llm_id"))
    model = fit(learning, "_llm_label")
    return scored(features, model).select("doc_id", (crc_part(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents the classifier does not reject, with the columns they came with: one pass of scoring over the texts.

    Learns like ``classify``. A bitmap of the labelled identifiers keeps most other texts out of the pass for learning; it decides nothing. Documents with a
    null identifier or text are scored like any other.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("_llm_id"), F.col("quality").alias("_llm_label")).distinct()
    named = docs.select(F.col(key).cast("long").alias("_llm_id"), F.col(text).alias("_llm_text")).where(crc_part(F.col(key), FOLDS) != HELD_OUT)
    likely = maybe_in(named, key_filter(marks, "_llm_id"), "_llm_id").where("_maybe")
    features = written(statistics(likely, "_llm_id", "_llm_text"), "statistics")
    model = fit(features.join(marks, F.col("doc_id") == F.col("_llm_id")), "_llm_label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in slices(batch.column(text)):
                good = model.score(text_statistics(data, offsets)) >= 0.5
                yield batch.slice(first, len(good)).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return classify(table(spark, folder, "documents"), table(spark, folder, "labels"))

"""Prediction by partial matching: code length of every text under a byte-context trie counted over the whole corpus.

Counting. Every task counts the grams of ``ORDER`` + 1 symbols (bytes after lower-casing, an end, padding before a text) of its training
texts; Spark sums them and folds them to all shorter grams. All of them stay, as written tables that grow with the corpus.

Scoring. From the longest seen context down: a symbol seen in the context costs (c - 1/2) / n; otherwise an escape of half the number of its
seen symbols goes to the next shorter context, where all symbols seen in the longer one are excluded. Below order 0 the unseen symbols of 256
bytes and the end share evenly. As the model is fixed while it scores, a gram has one cost. The costs of grams with at least 1 / ``SHARE`` of all symbols, which
are at most ``SHARE`` by construction, are sent to the tasks, in the same way for a corpus of any size. What is left of a text, gathered by gram, meets its costs in an equi-join: a gram of the training texts has
its cost from its count and the total of its context, any other (held-out texts only) from all its shorter contexts.

Beside it the base score of a text under smoothed counts of whole tokens: frequent tokens (at most ``FREQUENT``, by the same kind of share) are
sent to the tasks, all others meet their counts in an equi-join.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardscope.llm.common import LOWER, crc_part, key_filter, maybe_in, reach_workers, slices, table, written

ORDER = 5
#: A gram with 1 / SHARE of all symbols is sent to the tasks.
SHARE = 1 << 22
FREQUENT, FREQUENT_BYTES = 1 << 16, 64
FOLDS, HELD_OUT = 7, 2
BITS, END, SYMBOLS = np.uint64(9), 257, 257
#: Stands for the end of a text among the tokens; no word is empty.
END_TOKEN = b""
CACHE_BITS = 21
#: Bytes of text that are scored at once.
SLICE = 1 << 20


def grams(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the gram that ends at each symbol of each text (its end included), and where each text's begin."""
    n, lengths = len(offsets) - 1, np.diff(offsets)
    begins = offsets[:-1] + np.arange(n) * (order + 1) + order
    padded = np.zeros(len(data) + n * (order + 1), np.uint64)
    real = np.zeros(len(padded), bool)
    within = np.arange(len(data)) + np.repeat(np.arange(n) * (order + 1) + order, lengths)
    padded[within] = LOWER[data] + np.uint64(1)
    padded[begins + lengths] = END
    real[within] = True
    real[begins + lengths] = True
    codes = padded.copy()
    for k in range(1, order + 1):
        codes[k:] |= padded[:-k] << np.uint64(9 * k)
    return codes[real], offsets[:-1] + np.arange(n)


def _counts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    heads = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[heads], np.diff(np.concatenate([heads, [len(codes)]]))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, n = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    heads = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[heads], np.add.reduceat(n, heads)


def _by_code(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes)
    return codes[order], counts[order].astype(float)


class Cached:
    """Frequent grams with a table of costs by gram: one slot per hash, replaced on collision."""

    def __init__(self, frequent: Frequent):
        self.frequent = frequent
        self.keys = np.full(1 << CACHE_BITS, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.costs = np.zeros(1 << CACHE_BITS)

    def log10(self, codes: np.ndarray) -> np.ndarray:
        slot = (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CACHE_BITS)
        out, miss = self.costs[slot], np.flatnonzero(self.keys[slot] != codes)
        if len(miss):
            new, back = np.unique(codes[miss], return_inverse=True)
            costs = self.frequent.log10(new)
            out[miss] = costs[back]
            at = (new * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CACHE_BITS)
            self.keys[at], self.costs[at] = new, costs
        return out


_CACHED: dict[int, Cached] = {}


def cached(shared) -> Cached:
    """This worker's table for broadcast costs; the tasks that a worker runs one after another share it."""
    if shared.value.mark not in _CACHED:
        _CACHED.clear()
        _CACHED[shared.value.mark] = Cached(shared.value)
    return _CACHED[shared.value.mark]


def gram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """code, n of all grams of ``order`` + 1 symbols of ``texts`` (a column text without nulls)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list = []
        for batch in batches:
            for _, data, offsets in slices(batch.column(0)):
                parts.append(_counts(grams(data, offsets, order)[0]))
                if len(parts) >= 8:
                    parts = [_merged(parts)]
                if len(parts[0][0]) > 2_000_000:
                    yield _gram_rows(_merged(parts))
                    parts = []
        if parts:
            yield _gram_rows(_merged(parts))

    reach_workers(texts.sparkSession)
    counted = texts.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return written(counted, "grams", "zstd")


def _low(code: str, symbols: str) -> Column:
    """The last symbols of a gram."""
    return F.expr(f"{code} & (shiftleft(1L, 9 * ({symbols})) - 1)")


def _each(order: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(order))).alias("d")


def gram_levels(counted: DataFrame, contexts: DataFrame, order: int = ORDER) -> DataFrame:
    """d, code, n of the grams of d + 1 symbols, for d from 0 to ``order``, in one of the ``contexts`` (d, context) at least.

    A bitmap of the contexts drops most grams before they are counted again; it lets some others pass.
    """
    every = counted.select("n", _each(order), "code").select("d", _low("code", "d + 1").alias("code"), "n")
    needed = maybe_in(every.withColumn("context", F.shiftright("code", 9)), key_filter(contexts, "d", "context"), "d", "context").where("_maybe")
    return needed.groupBy("d", "code").agg(F.sum("n").alias("n"))


# The whole model ----------------------------------------------------------------------------------


@dataclass
class Frequent:
    """Costs of the most frequent grams; not a number for all others."""

    codes: np.ndarray
    costs: np.ndarray
    mark: int = field(default_factory=lambda: uuid.uuid4().int)

    def log10(self, codes: np.ndarray) -> np.ndarray:
        if len(self.codes) == 0:
            return np.full(len(codes), np.nan)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.costs[at], np.nan)


def seen_costs(counted: DataFrame) -> DataFrame:
    """code, n, cost of all grams of the training texts. A context has at most as many grams as there are symbols."""
    total = F.sum("n").over(Window.partitionBy(F.shiftright("code", 9)))
    return counted.select("code", "n", F.log10((F.col("n") - 0.5) / total).alias("cost"))


def unseen_costs(unseen: DataFrame, counted: DataFrame, order: int = ORDER) -> DataFrame:
    """code, cost of distinct grams (a column code) that the training texts do not have.

    Each gram meets, for each of its contexts, the context's occurrences, its number of symbols, and what these symbols count in the next
    shorter context; and the count of its own symbol there. Contexts of up to two symbols and grams of up to two are few whatever the corpus
    and shared by many grams, so their tables are broadcast.
    """
    contexts = unseen.select("code", _each(order)).select("code", "d", F.shiftright(_low("code", "d + 1"), 9).alias("context"))
    contexts = written(contexts, "contexts", "zstd")
    # the symbols of a context, and what they count in the next shorter one, all lie in contexts of the same gram
    levels = written(gram_levels(counted, contexts.select("d", "context"), order), "levels", "zstd")
    children = levels.withColumn("context", F.shiftright("code", 9)).join(contexts.select("d", "context").distinct(), ["d", "context"], "left_semi")
    shorter = levels.select((F.col("d") + 1).alias("d"), F.col("code").alias("_suffix"), F.col("n").alias("_n"))
    children = children.withColumn("_suffix", _low("code", "d")).join(shorter, ["d", "_suffix"], "left")
    stats = children.groupBy("d", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.coalesce(F.sum("_n"), F.lit(0)).alias("lower"))
    stats = written(stats, "stats", "zstd")
    counts = levels.select("d", F.col("code").alias("_gram"), "n")
    contexts = contexts.withColumn("_gram", _low("code", "d + 1"))

    def met(upto: int, context: bool) -> DataFrame:
        """Rows by the two keys, each once by broadcast (short) and once by shuffle (long)."""
        table, keys = (stats, ["d", "context"]) if context else (counts, ["d", "_gram"])
        short = contexts.where(F.col("d") <= upto).join(F.broadcast(table.where(F.col("d") <= upto)), keys)
        long = contexts.where(F.col("d") > upto).join(table.where(F.col("d") > upto), keys)
        return short.select("code", "d", *table.columns[2:]).unionByName(long.select("code", "d", *table.columns[2:]))

    values = ["total", "kinds", "lower", "n"]
    rows = met(2, True).withColumn("n", F.lit(None).cast("long")).unionByName(met(1, False).select("code", "d", *[F.lit(None).cast("long").alias(c) for c in values[:3]], "n"))
    # a gram none of whose contexts was seen keeps its row
    rows = rows.unionByName(unseen.select("code", F.lit(-1).alias("d"), *[F.lit(None).cast("long").alias(c) for c in values]))
    wide = rows.groupBy("code").agg(*[F.coalesce(F.max(F.when(F.col("d") == d, F.col(c))), F.lit(0)).alias(f"{c}_{d}") for d in range(order + 1) for c in values])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[batch.column(1 + 4 * d + k).to_numpy().astype(float) for k in range(4)] for d in range(order + 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_escaped(found))], ["code", "cost"])

    return wide.mapInArrow(run, "code long, cost double")


def _escaped(levels: list[list[np.ndarray]]) -> np.ndarray:
    """log10 probabilities; by d the context's total, kinds and what its symbols count one level below, and the gram's count, 0 if unseen."""
    size = len(levels[0][0])
    out, open_, seen_kinds, seen_mass = np.zeros(size), np.ones(size, bool), np.zeros(size), np.zeros(size)
    for total, kinds, lower, n in reversed(levels):
        here = np.flatnonzero(open_ & (total > 0))
        left, others = total[here] - seen_mass[here], kinds[here] - seen_kinds[here]
        hit = n[here] > 0
        out[here[hit]] += np.log10((n[here][hit] - 0.5) / left[hit])
        missed = ~hit & (left > 0)
        out[here[missed]] += np.log10(0.5 * others[missed] / left[missed])
        open_[here[hit]] = False
        seen_kinds[here], seen_mass[here] = kinds[here], lower[here]
    out[open_] -= np.log10(SYMBOLS - seen_kinds[open_])
    return out


def _gram_rows(counted: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(counted[0].view(np.int64)), pa.array(counted[1].astype(np.int64))], ["code", "n"])


# Base score ---------------------------------------------------------------------------------------


def _tokens(data: np.ndarray, offsets: np.ndarray) -> Iterator[list[bytes]]:
    whole = LOWER[data].tobytes()
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield whole[lo:hi].split()


def token_counts(texts: DataFrame) -> DataFrame:
    """token, c of all words and ends of ``texts``; each task sends a token once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["token", "c"])

        for batch in batches:
            for _, data, offsets in slices(batch.column(0)):
                for words in _tokens(data, offsets):
                    counts.update(words)
                counts[END_TOKEN] += len(offsets) - 1
                if len(counts) > 500_000:
                    yield rows()
                    counts.clear()
        if counts:
            yield rows()

    return texts.select("text").mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


DOCUMENT = T.StructType([
    T.StructField("row", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()),
    T.StructField("n_tokens", T.LongType()), T.StructField("known", T.LongType()), T.StructField("logs", T.DoubleType()), T.StructField("score", T.DoubleType()),
    T.StructField("codes", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.IntegerType())),
    T.StructField("token", T.ArrayType(T.BinaryType())), T.StructField("token_times", T.ArrayType(T.IntegerType())),
])


def _left(codes: np.ndarray, begins: np.ndarray, at: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """For each text its distinct grams among those at the places ``at``, and how often each occurs."""
    owner, codes = np.searchsorted(begins, at, "right") - 1, codes[at]
    order = np.lexsort((codes, owner))
    owner, codes = owner[order], codes[order]
    heads = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])])) if len(codes) else np.zeros(0, np.int64)
    times = np.diff(np.concatenate([heads, [len(codes)]]))
    offsets = pa.array(np.searchsorted(owner[heads], np.arange(len(begins) + 1)), pa.int32())
    return tuple(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (codes[heads].astype(np.int64), times.astype(np.int32)))


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, share: int = SHARE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Learns from the rows whose crc32(doc_id as text) mod 7 is not 2. Null counts as an empty text, which still has its end. Rows that repeat
    an identifier are scored by their own texts. Without training rows no token is known and all symbols are equally likely.
    An empty table gives no rows; other columns are not read. At most ``share`` grams are sent to the tasks; the scores do not depend on it.
    The counts hold the training texts themselves, which therefore never escape: only scores of held-out texts compare with one another.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    part = crc_part(F.col(key), FOLDS)
    # the row number is written with the first result and names the row from there on
    plain = docs.select(
        whole.alias("text"), F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("doc_id"), (part == HELD_OUT).alias("held_out")
    )
    learning = docs.select(whole.alias("text"), (part == HELD_OUT).alias("held_out")).where(~F.col("held_out"))
    counted = gram_counts(learning, order)
    costs = written(seen_costs(counted), "costs", "zstd")
    symbols = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    often_seen = F.col("n").cast("double") * share >= symbols
    sent = costs.where(often_seen).select("code", "cost").toArrow()
    sent_codes, sent_costs = (sent.column(k).to_numpy() for k in (0, 1))
    shared = docs.sparkSession.sparkContext.broadcast(Frequent(*_by_code(sent_codes.astype(np.uint64), sent_costs)))
    del sent, sent_codes, sent_costs
    counts = written(token_counts(learning), "tokens", "zstd")
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = int(totals[0]), int(totals[1])
    # the end is in every text, so it is sent whatever its share
    frequent = ((F.col("c") * FREQUENT >= n) & (F.octet_length("token") <= FREQUENT_BYTES)) | (F.octet_length("token") == 0)
    often = {bytes(r["token"]): r["c"] for r in counts.where(frequent).collect()}
    base = math.log10(n + v + 1)
    often_logs = {w: math.log10(c + 1) for w, c in often.items()}

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = cached(shared)
        for batch in batches:
            for first, data, offsets in slices(batch.column(0), SLICE):
                sizes, known, logs, seldom = [], [], [], []
                for words in _tokens(data, offsets):
                    words.append(END_TOKEN)
                    found = [x for x in map(often_logs.get, words) if x is not None]
                    seldom.append(Counter(x for x in words if x not in often) if len(found) < len(words) else {})
                    sizes.append(len(words))
                    known.append(len(found))
                    logs.append(math.fsum(found))
                codes, begins = grams(data, offsets, order)
                logs10 = model.log10(codes)
                rare = np.isnan(logs10)
                scores = np.add.reduceat(np.where(rare, 0.0, logs10), begins)
                rows = [batch.column(k).slice(first, len(sizes)) for k in (1, 2, 3)]
                found = [pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(logs, pa.float64()), pa.array(scores), *_left(codes, begins, np.flatnonzero(rare))]
                ends = pa.array(np.concatenate([[0], np.cumsum([len(c) for c in seldom])]).astype(np.int32))
                found.append(pa.ListArray.from_arrays(ends, pa.array([w for c in seldom for w in c], pa.binary())))
                found.append(pa.ListArray.from_arrays(ends, pa.array([k for c in seldom for k in c.values()], pa.int32())))
                yield pa.RecordBatch.from_arrays([*rows, *found], schema=pa.schema([(f.name, a.type) for f, a in zip(DOCUMENT, [*rows, *found])]))

    scored = written(plain.mapInArrow(documents, DOCUMENT), "scored", "zstd")
    rare = scored.select("row", F.explode(F.arrays_zip("token", F.col("token_times").alias("times"))).alias("x")).select("row", "x.token", "x.times")
    met = rare.join(counts.where(~frequent), "token").groupBy("row").agg(
        F.sum(F.col("times").cast("long")).alias("_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("_logs")
    )
    left = scored.select("row", "held_out", F.explode(F.arrays_zip(F.col("codes").alias("code"), "times")).alias("x")).select("row", "held_out", "x.code", "x.times")
    unseen = written(left.where("held_out").select("code").distinct().join(costs, "code", "left_anti"), "unseen", "zstd")
    others = costs.where(~often_seen).select("code", "cost").unionByName(unseen_costs(unseen, counted, order))
    far = left.join(others, "code").groupBy("row").agg(F.sum(F.col("times") * F.col("cost")).alias("_far"))
    rows = scored.drop("codes", "times", "token", "token_times").join(met, "row", "left").join(far, "row", "left")
    return rows.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(base)).alias("base_score"),
        (F.col("score") + F.coalesce("_far", F.lit(0.0))).alias("score"),
    )


SQL_BASE = r"""
WITH w AS (
  SELECT doc_id, crc, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), '') AS ws FROM documents JOIN folds USING (doc_id)
), t AS (SELECT doc_id, crc, unnest(ws) AS t FROM w
), c AS (SELECT t, count(*) AS c FROM t WHERE crc % 7 <> 2 GROUP BY 1
), n AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT t.doc_id, count(*) AS n_tokens, count(c.c) AS n_known, any_value(n.n) AS train_tokens,
  sum(log10((coalesce(c.c, 0) + 1) / (n.n + n.v + 1.0::DOUBLE))) AS base_score
FROM t LEFT JOIN c USING (t), n GROUP BY 1
"""


def op4_ppm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return score_texts(table(spark, folder, "documents"))

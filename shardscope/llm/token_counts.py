"""Token counts by a lookup of two tiers on the map side: no pre-token is ever shuffled.

A text with the space that the model puts before it is cut wherever no piece of the model holds the two bytes beside the cut. Merges only ever make pieces,
so none crosses such a cut, and a text's count is the sum of its pre-tokens' counts. The cuts come from the model alone.

The first pass gathers the frequent pre-tokens of all texts: every task keeps a summary of at most ``FREQUENT`` counters in which a new
pre-token wears down the others (Misra and Gries), so each pre-token with more than 1 / ``FREQUENT`` of all occurrences is in it. A summary is
one row, and summaries merge in rounds into one, whatever the order. Its pre-tokens with their lengths are a hash table of a few
MB, which is broadcast; pre-tokens of up to 15 bytes are their own key, so a hit is never mistaken. What misses is encoded once per worker and
kept in a bounded cache. The summary only saves work: the counts do not depend on it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardscope.llm.common import mix64, reach_workers, slices, table

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Pre-tokens in the broadcast table, at most.
FREQUENT = 1 << 16
#: Tasks of each round that merges summaries.
ROUNDS = (64, 1)
KEY_BYTES = 15
CACHE_ENTRIES, CACHE_BYTES = 1 << 18, 256
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [0xFFFFFFFFFFFFFFFF], np.uint64)


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """The model with its cuts. ``joins[a, b]``: some piece holds a character that ends in byte a before one that starts with byte b."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.decode(model.encode("ﬁ  ｆ\t x ")) != "ﬁ  ｆ\t x ":
            raise ValueError("the model changes texts before it encodes them")
        self.joins = np.zeros((256, 256), bool)
        for i in range(model.get_piece_size()):
            if model.is_byte(i) or model.is_control(i) or model.is_unknown(i):
                continue
            piece = model.id_to_piece(i)
            for left, right in zip(piece, piece[1:]):
                # the model reads a space and U+2581 alike
                ends = {left.encode()[-1]} | ({32} if left == "▁" else set())
                heads = {right.encode()[0]} | ({32} if right == "▁" else set())
                for a in ends:
                    self.joins[a, list(heads)] = True
        free = np.flatnonzero(~(self.joins.any(0) | self.joins.any(1))[:128])
        if len(free) == 0:
            raise ValueError("the model needs an ASCII character that is in no piece of several")
        self.guard = chr(free[0])
        self.extra = len(model.encode(self.guard))
        self.cache: dict[bytes, int] = {}

    def encode_lengths(self, units: list[bytes]) -> list[int]:
        """Tokens of each pre-token; a character that joins with nothing keeps the model's own space away."""
        return [len(x) - self.extra for x in self.model.encode([self.guard + u.decode() for u in units], num_threads=1)]

    def lengths(self, units: list[bytes]) -> list[int]:
        """As ``encode_lengths``, through the worker's cache."""
        new = list({u for u in units if u not in self.cache})
        if not new:
            return [self.cache[u] for u in units]
        known = dict(zip(new, self.encode_lengths(new)))
        found = [known[u] if u in known else self.cache[u] for u in units]
        if len(self.cache) + len(known) > CACHE_ENTRIES:
            self.cache.clear()
        for u, n in known.items():
            if len(u) <= CACHE_BYTES and len(self.cache) < CACHE_ENTRIES:
                self.cache[u] = n
        return found

    def pretokens(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes with a space before each text that is not empty, starts and ends of its pre-tokens, and each text's first one (and the end)."""
        some = np.diff(offsets) > 0
        bounds = offsets + np.concatenate([[0], np.cumsum(some)])
        inner = np.full(len(data) + int(some.sum()), 32, np.uint8)
        own = np.ones(len(inner), bool)
        own[bounds[:-1][some]] = False
        inner[own] = data
        cut = np.zeros(len(inner) + 1, bool)
        if len(inner):
            lead = (inner[1:] < 128) | (inner[1:] >= 192)
            cut[1:-1] = lead & ~self.joins[inner[:-1], inner[1:]]
        cut[bounds] = True
        starts = np.flatnonzero(cut[:-1])
        ends = np.append(starts[1:], len(inner)) if len(starts) else starts
        return inner, starts, ends, np.searchsorted(starts, bounds)


@lru_cache(maxsize=2)
def load(path: str) -> Encoder:
    return Encoder(path)


def packed(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pre-tokens of at most ``KEY_BYTES`` bytes as two numbers that hold their bytes and size."""
    wide = np.concatenate([data, np.zeros(16, np.uint8)])
    words = np.ndarray((len(data) + 9,), "<u8", wide, strides=(1,))
    low = words[starts] & _MASK[np.minimum(sizes, 8)]
    high = words[starts + 8] & _MASK[np.clip(sizes - 8, 0, 7)]
    return low, high | (sizes.astype(np.uint64) << np.uint64(56))


def unpacked(low: np.ndarray, high: np.ndarray) -> list[bytes]:
    raw = np.stack([low, high], axis=1).astype("<u8").tobytes()
    return [raw[16 * k : 16 * k + raw[16 * k + 15]] for k in range(len(low))]


def _hashed(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return mix64(low ^ mix64(high))


class Summary:
    """Counters of frequent keys. Keys of equal hash share a counter; they differ again in the table."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.keys = np.zeros((0, 2), np.uint64)
        self.counts = np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        keys, counts = np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts])
        _, first, kind = np.unique(_hashed(keys[:, 0], keys[:, 1]), return_index=True, return_inverse=True)
        self.keys, self.counts = keys[first], np.bincount(kind, counts, len(first)).astype(np.int64)

    def trim(self) -> None:
        if len(self.counts) > self.size:
            counts = self.counts - np.partition(self.counts, len(self.counts) - self.size - 1)[len(self.counts) - self.size - 1]
            self.keys, self.counts = self.keys[counts > 0], counts[counts > 0]

    def to_batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (self.keys, self.counts)], ["keys", "counts"])

    def add_batch(self, batch: pa.RecordBatch) -> None:
        for keys, counts in zip(*(c.to_pylist() for c in batch.columns)):
            self.add(np.frombuffer(keys, np.uint64).reshape(-1, 2), np.frombuffer(counts, np.int64))
            self.trim()


@dataclass(frozen=True)
class Table:
    """An open hash table from packed pre-tokens to their numbers of tokens."""

    keys: np.ndarray
    tokens: np.ndarray
    slots: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray, tokens: np.ndarray) -> Table:
        bits = max(4, int(len(keys)).bit_length() + 1)
        slots = np.full(1 << bits, -1, np.int32)
        for place, slot in enumerate((_hashed(keys[:, 0], keys[:, 1]) >> np.uint64(64 - bits)).tolist()):
            while slots[slot] >= 0:
                slot = (slot + 1) & (len(slots) - 1)
            slots[slot] = place
        return cls(keys, tokens, slots)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Tokens of each key, -1 where the table has none."""
        if len(self.keys) == 0:
            return np.full(len(low), -1, np.int64)
        slot = (_hashed(low, high) >> np.uint64(64 - int(len(self.slots)).bit_length() + 1)).astype(np.int64)
        place = self.slots[slot]
        open_ = np.flatnonzero((place >= 0) & ((self.keys[place, 0] != low) | (self.keys[place, 1] != high)))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.slots) - 1)
            place[open_] = self.slots[slot[open_]]
            at = place[open_]
            open_ = open_[(at >= 0) & ((self.keys[at, 0] != low[open_]) | (self.keys[at, 1] != high[open_]))]
        return np.where(place >= 0, self.tokens[place].astype(np.int64), -1)


def frequent(docs: DataFrame, text: str, path: str, size: int = FREQUENT) -> Table:
    """The frequent pre-tokens of all texts with their lengths."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, summary = load(path), Summary(size)
        for batch in batches:
            for _, data, offsets in slices(batch.column(0)):
                inner, starts, ends, _ = encoder.pretokens(data, offsets)
                sizes = ends - starts
                short = sizes <= KEY_BYTES
                low, high = packed(inner, starts[short], sizes[short])
                summary.add(np.stack([low, high], axis=1), np.ones(len(low), np.int64))
                if len(summary.counts) > 4 * size:
                    summary.trim()
        summary.trim()
        yield summary.to_batch()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = Summary(size)
        for batch in batches:
            summary.add_batch(batch)
        yield summary.to_batch()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = []
            for keys in batch.column(0).to_pylist():
                pair = np.frombuffer(keys, np.uint64).reshape(-1, 2)
                lengths.append(np.array(load(path).encode_lengths(unpacked(pair[:, 0], pair[:, 1])), np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.binary())], ["keys", "tokens"])

    found = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).mapInArrow(gather, "keys binary, counts binary")
    for tasks in ROUNDS:
        found = found.repartition(tasks).mapInArrow(merge, "keys binary, counts binary")
    rows = found.select("keys").mapInArrow(measure, "keys binary, tokens binary").collect()
    keys = np.concatenate([np.frombuffer(r["keys"], np.uint64).reshape(-1, 2) for r in rows] or [np.zeros((0, 2), np.uint64)])
    return Table.build(keys, np.concatenate([np.frombuffer(r["tokens"], np.uint8) for r in rows] or [np.zeros(0, np.uint8)]))


def token_counts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None, limit: int = LIMIT, size: int = FREQUENT
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens): one row per row of ``docs``.

    Null counts as empty; an empty text has no tokens. Repeated identifiers and identifiers of null keep a row each. An empty table gives no
    rows. Texts of any length are read whole; other columns are not read. The result does not depend on ``size``.
    """
    spark = docs.sparkSession
    reach_workers(spark)
    path = model or model_path()
    known = spark.sparkContext.broadcast(frequent(docs, text, path, size))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lookup = load(path), known.value
        for batch in batches:
            for first, data, offsets in slices(batch.column(1)):
                inner, starts, ends, bounds = encoder.pretokens(data, offsets)
                sizes = ends - starts
                tokens = np.full(len(starts), -1, np.int64)
                short = np.flatnonzero(sizes <= KEY_BYTES)
                tokens[short] = lookup.find(*packed(inner, starts[short], sizes[short]))
                missed = np.flatnonzero(tokens < 0)
                raw = inner.tobytes()
                tokens[missed] = encoder.lengths([raw[a:b] for a, b in zip(starts[missed].tolist(), ends[missed].tolist())])
                upto = np.concatenate([[0], np.cumsum(tokens)])
                columns = [batch.column(0).slice(first, len(offsets) - 1), pa.array(np.diff(offsets)), pa.array(np.diff(upto[bounds]))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens"])

    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    counted = plain.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op13_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"))

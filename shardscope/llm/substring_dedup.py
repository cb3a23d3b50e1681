"""Removal of repeated passages with suffix automata of reference shards.

The reference of a document is all that starts before it, that is the corpus itself, so the automata cannot be whole copies of it in every
task. They are sharded by content, and a document is streamed only through the shards that can match it:

1. Anchors. Of every window of ``words`` words the run of ``ANCHOR`` words with the least hash is its anchor; equal windows have equal
   anchors. Anchors that occur once are dropped by a count and a join. The first occurrence of an anchor is its owner.
2. Pieces. The windows under an owner form reference pieces, those under the other occurrences pieces to be streamed; neighbouring windows
   of one shard form one piece. A shard holds the owners of a range of documents, a few ten thousand words.
3. Automata. In each unit (shard, block of streamed pieces) the suffix automaton of the reference pieces is built over words, in the order
   of the corpus, so that each state knows its first end. Pieces run through it for matching statistics; where the match reaches ``words``
   and its first end lies earlier, the window is a repeat. Maximal runs of such windows are the removed spans. Each block of a hot shard
   gets the shard's references, so a passage in a third of all documents is split over many tasks.
4. A streamed window that its owner does not hold can only equal other such windows. They are few (the rims of passages); equal ones meet
   by a 128-bit hash, and all but the first are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardscope.llm.common import key_filter, maybe_in, reach_workers, signed, slices, table, window_hashes, word_bounds, word_hashes, written

WINDOW, ANCHOR = 20, 10
#: Words of a shard's references and of a block of streamed pieces (aims, not limits), and of the range whose owners share a shard.
SHARD_WORDS, BLOCK_WORDS, RANGE_WORDS = 40_000, 400_000, 8192


def anchors(words: np.ndarray, first: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts whose hashed words begin at ``first``: each anchor's hash, word, and first and last window start."""
    none = np.zeros(0, np.int64)
    width = window - anchor + 1
    if len(words) < window:
        return none.astype(np.uint64), none, none, none
    runs = window_hashes(words, anchor)
    least = np.arange(len(words) - window + 1) + np.lib.stride_tricks.sliding_window_view(runs, width).argmin(axis=1)
    # windows that reach into the next text are none
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = owner[: len(least)] == owner[window - 1 :]
    starts = np.flatnonzero(inside)
    if len(starts) == 0:
        return none.astype(np.uint64), none, none, none
    at = least[starts]
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return runs[at[new]], at[new], starts[new], starts[np.append(new[1:] - 1, len(starts) - 1)]


def _anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(1).to_numpy()
            for row, data, offsets in slices(batch.column(2)):
                starts, ends, first = word_bounds(data, offsets)
                hashes, at, _, _ = anchors(word_hashes(data, starts, ends), first, window)
                owner = np.searchsorted(first, at, "right") - 1
                place = (at - first[owner]).astype(np.int32)
                ids, own = batch.column(0).take(pa.array(row + owner)), marks[row + owner]
                for k in range(0, max(len(at), 1), 1 << 16):
                    end = k + (1 << 16)
                    found = [pa.array(signed(hashes[k:end])), ids[k:end], pa.array(own[k:end]), pa.array(place[k:end])]
                    yield pa.RecordBatch.from_arrays(found, ["h", "d", "mark", "place"])

    return docs.select("d", "mark", "text").mapInArrow(run, "h long, d long, mark long, place int")


PIECES = "shard long, role int, d long, mark long, start int, n int, piece binary"


def _pieces(docs: DataFrame, hits: DataFrame, shards: int, window: int) -> DataFrame:
    """Reference and streamed pieces. ``hits``: d, mark, at (words of repeated anchors), to (their shards), own (whether first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for row, data, offsets in slices(batch.column(2)):
                starts, ends, first = word_bounds(data, offsets)
                _, at, low, high = anchors(word_hashes(data, starts, ends), first, window)
                out: list[tuple] = []
                for k in range(row, row + len(offsets) - 1):
                    base = int(first[k - row])
                    hit = np.array(batch.column(3)[k].as_py(), np.int64)
                    order = np.argsort(hit)
                    # the repeated row of a document finds its anchors twice
                    place = np.searchsorted(at, hit[order] + base)
                    to, own = (np.array(batch.column(c)[k].as_py())[order] for c in (4, 5))
                    keep = np.concatenate([[True], place[1:] != place[:-1]])
                    place, to, own = place[keep], to[keep], own[keep]
                    begin, end = low[place], high[place]
                    joined = (begin[1:] == end[:-1] + 1) & (to[1:] == to[:-1]) & (own[1:] == own[:-1])
                    heads = np.flatnonzero(np.concatenate([[True], ~joined]))
                    tails = np.append(heads[1:] - 1, len(begin) - 1)
                    for a, b in zip(heads.tolist(), tails.tolist()):
                        lo, hi = int(begin[a]), int(end[b]) + window
                        out.append((int(to[a]), 0 if own[a] else 1, ids[k], marks[k], lo - base, hi - lo, b" ".join(data[starts[lo] : ends[hi - 1]].tobytes().split())))
                yield _batch(out, PIECES)

    rows = hits.groupBy("d", "mark").agg(*[F.collect_list(F.struct("at", "to", "own")).alias("hits")])
    rows = rows.select("d", "mark", F.col("hits.at").alias("at"), F.col("hits.to").alias("to"), F.col("hits.own").alias("own"))
    some = maybe_in(docs, key_filter(rows, "d", "mark"), "d", "mark").where("_maybe").drop("_maybe")
    return some.join(rows, ["d", "mark"]).select("d", "mark", "text", "at", "to", "own").mapInArrow(run, PIECES)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.strip().split() for c in schema.split(",")))
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), _ARROW[k]) for c, k in zip(columns, kinds)], list(names))


class Automaton:
    """Suffix automaton of several sequences; every state knows the first place at which its sequences end.

    Sequences are added in the order of their places, so the place at which a state is made is its first.
    """

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [(0, 0, 0)]

    def _state(self, length: int, after: dict, link: int, first: tuple) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.length) - 1

    def _split(self, p: int, c: bytes, q: int) -> int:
        """The state of the sequences of q that end p's longest by c."""
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], self.first[q])
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        self.link[q] = twin
        return twin

    def add(self, words: list[bytes], d: int, mark: int, start: int) -> None:
        last = 0
        for at, c in enumerate(words, start):
            q = self.next[last].get(c)
            if q is not None:
                last = self._split(last, c, q)
                continue
            new = self._state(self.length[last] + 1, {}, 0, (d, mark, at))
            p = last
            while p != -1 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p != -1:
                self.link[new] = self._split(p, c, self.next[p][c])
            last = new

    def repeats(self, words: list[bytes], d: int, mark: int, start: int, window: int) -> list[bool]:
        """For each window of ``words`` whether it ends earlier in a sequence of the automaton."""
        after, link, length, first = self.next, self.link, self.length, self.first
        state, match, out = 0, 0, []
        for at, c in enumerate(words, start):
            to = after[state].get(c)
            while to is None and state:
                state = link[state]
                match = length[state]
                to = after[state].get(c)
            if to is not None:
                state, match = to, match + 1
                while length[link[state]] >= window:
                    state = link[state]
                    match = length[state]
            out.append(match >= window and first[state] < (d, mark, at))
        return out[window - 1 :]


FOUND = "d long, mark long, lo int, hi int, h1 long, h2 long"


def _streamed(pieces: DataFrame, window: int) -> DataFrame:
    """Removed spans lo:hi (h1 null), and by their hashes the windows lo:hi that their shard does not hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, automaton = None, None
        for batch in batches:
            out: list[tuple] = []
            for u, role, d, mark, start, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if u != unit:
                    unit, automaton = u, Automaton()
                words = piece.split()
                if role == 0:
                    automaton.add(words, d, mark, start)
                    continue
                known = np.array(automaton.repeats(words, d, mark, start, window))
                edges = np.flatnonzero(np.diff(np.concatenate([[0], known.astype(np.int8), [0]])))
                out += [(d, mark, start + int(a), start + int(b) - 1 + window, None, None) for a, b in edges.reshape(-1, 2)]
                open_ = np.flatnonzero(~known)
                if len(open_):
                    data = np.frombuffer(piece, np.uint8)
                    hashes = word_hashes(data, *word_bounds(data, np.array([0, len(data)]))[:2])
                    h1, h2 = (signed(window_hashes(hashes, window, seed)).tolist() for seed in (1, 2))
                    out += [(d, mark, start + k, start + k + window, h1[k], h2[k]) for k in open_.tolist()]
            yield _batch(out, FOUND)

    # a block of streamed pieces per BLOCK_WORDS of them; every block of a shard gets its references
    blocks = pieces.groupBy("shard").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("role") == 1, F.col("n"))) / BLOCK_WORDS)).alias("blocks"))
    placed = pieces.join(blocks.where("blocks IS NOT NULL"), "shard")
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    one = F.array(F.pmod(F.xxhash64("d", "mark", "start"), F.col("blocks")))
    placed = placed.withColumn("block", F.explode(F.when(F.col("role") == 0, every).otherwise(one)))
    placed = placed.select(F.xxhash64("shard", "block").alias("unit"), "role", "d", "mark", "start", "piece")
    return placed.repartition("unit").sortWithinPartitions("unit", "role", "d", "mark", "start").mapInArrow(run, FOUND)


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """d, mark, lo, hi: spans of words covered by windows that start earlier too. ``docs`` has d, mark and text."""
    rows = _anchor_rows(docs, window)
    firsts = rows.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("d", "mark", "place")).alias("first")).where("n > 1").drop("n")
    # written first: the join then has both its shuffles to itself, and a hot anchor's side of it can be split
    firsts = written(firsts, "firsts")
    firsts_of = [F.col(f"first.{c}").alias(n) for c, n in (("d", "fd"), ("mark", "fm"), ("place", "fp"))]
    hits = written(rows.join(firsts, "h").select("d", "mark", "place", *firsts_of), "hits")
    own = (F.col("d") == F.col("fd")) & (F.col("mark") == F.col("fm")) & (F.col("place") == F.col("fp"))
    shards = max(1, hits.where(own).count() * (window - ANCHOR) // SHARD_WORDS)
    to = F.pmod(F.xxhash64("fd", "fm", F.floor(F.col("fp") / RANGE_WORDS)), F.lit(shards))
    named = hits.select("d", "mark", F.col("place").alias("at"), to.alias("to"), own.alias("own"))
    found = written(_streamed(written(_pieces(docs, named, shards, window), "pieces"), window), "found")
    open_ = found.where("h1 IS NOT NULL").withColumn("own", F.struct("d", "mark", "lo"))
    least = open_.groupBy("h1", "h2").agg(F.min("own").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    late = open_.join(least, ["h1", "h2"]).where(F.col("own") > F.col("least"))
    return found.where("h1 IS NULL").select("d", "mark", "lo", "hi").unionByName(late.select("d", "mark", "lo", "hi"))


KEPT = "doc_id long, n_words long, n_removed long, kept string"


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) of every row.

    A word goes when a window of ``window`` words covers it that also starts earlier: in a smaller identifier, or before in the same text. A null text has no
    words; a null identifier is smaller than any other. Rows that repeat an identifier follow each other by a hash of their texts, and those that
    repeat the text too count as one document. An empty table gives no rows; other columns are not read. With ``digest``, kept is its SHA-256.
    """
    reach_workers(docs.sparkSession)
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # tells texts of one identifier apart
    mark = F.xxhash64(whole)
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("d"), mark.alias("mark"), whole.alias("text"))
    spans = repeated_spans(plain.select("d", "mark", "text"), window)
    spans = written(spans.groupBy("d", "mark").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi")), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, lo, hi in zip(*(c.to_pylist() for c in batch.columns)):
                words = text.encode().split()
                n, gone = len(words), 0
                if lo:
                    cover = np.zeros(n + 1, np.int32)
                    np.add.at(cover, lo, 1)
                    np.add.at(cover, hi, -1)
                    stays = np.cumsum(cover)[:n] == 0
                    words = [w for w, s in zip(words, stays.tolist()) if s]
                    gone = n - len(words)
                kept = b" ".join(words)
                out.append((doc_id, n, gone, hashlib.sha256(kept).hexdigest() if digest else kept.decode()))
            yield _batch(out, KEPT)

    # only texts that may have spans are shuffled
    flagged = maybe_in(plain, key_filter(spans, "d", "mark"), "d", "mark")
    none = F.lit(None).cast("array<int>")
    untouched = flagged.where(~F.col("_maybe")).select("doc_id", "text", none.alias("lo"), none.alias("hi"))
    touched = flagged.where("_maybe").join(spans, ["d", "mark"], "left").select("doc_id", "text", "lo", "hi")
    return untouched.mapInArrow(run, KEPT).unionByName(touched.mapInArrow(run, KEPT))


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), x AS (
  SELECT doc_id, unnest(range(1, len(ws) - 18)) AS s, unnest(list_transform(range(1, len(ws) - 18), lambda i: array_to_string(ws[i:i + 19], ' '))) AS t FROM w WHERE len(ws) >= 20
), r AS (
  SELECT doc_id, s FROM x QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id, s) > 1
), c AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM r
), k AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY 1)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(len(k.ps), 0)::BIGINT AS n_removed,
  sha256(coalesce(CASE WHEN k.ps IS NULL THEN array_to_string(w.ws, ' ') ELSE array_to_string(list_transform(list_filter(range(1, len(w.ws) + 1), lambda i: NOT list_contains(k.ps, i)), lambda i: w.ws[i]), ' ') END, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return without_repeats(table(spark, folder, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")

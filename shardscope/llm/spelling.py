"""Spelling variants of the corpus's words by search schemes over bidirectional FM-indexes.

Words that differ by one code point share one of the halves of either: the error lies in the other half. So a word is looked for by two
schemes: its left half is matched exactly and then extended to the right, or its right half and then extended to the left; in either case across the
other half with one error (a replaced, an inserted or a missing code point) up to the delimiter. What both find is counted by the first.

An index holds the words of a shard, sorted, with a delimiter before each, read as a ring. A pattern's occurrences are an interval of suffix ranks; a
rank directory (bit planes per symbol with counts per 64 ranks) narrows it by one symbol on the left, and the same directory of the reversed text by one on the
right while both intervals are kept in step. Ranks of suffixes that begin with a delimiter are the words' numbers. All
queries of a shard advance together, one symbol a step.

A shared half means a shared beginning (or end) of three code points: words are dealt to shards by it, once for each scheme. One with very many words is split into
blocks of words and blocks of queries, and every query visits all blocks of its beginning, so no task holds it whole. A shard answers with a
count and the best near word of each query, never with pairs; a word of length m has fewer than 200 m near words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardscope.llm.common import reach_workers, table, written

#: Words of a shard, and queries of one beginning that meet it at once in multiples of that.
SHARD, QUERY_BLOCKS = 1 << 15, 8
#: Code points that both halves of a word hold at least.
STEM = 3
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
DAMAGE = 31
#: Queries that advance together.
TOGETHER = 1 << 13


class Directory:
    """Ranks in the last column of a ring's sorted rotations: how often a symbol occurs before a place."""

    def __init__(self, text: np.ndarray, symbols: int) -> None:
        self.order = rotations(text, symbols)
        last = text[self.order - 1]
        blocks = len(text) // 64 + 1
        self.bits = np.empty((blocks, symbols), np.uint64)
        for c in range(symbols):
            plane = np.zeros(blocks * 64, bool)
            plane[: len(last)] = last == c
            self.bits[:, c] = np.packbits(plane, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.bits).astype(np.int32)
        self.before = np.cumsum(counts, axis=0, dtype=np.int32) - counts
        total = counts.sum(0)
        self.first = np.cumsum(total) - total

    def ranks(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        block = place >> 6
        inside = self.bits[block, symbol] & _below(place)
        return self.before[block, symbol] + np.bitwise_count(inside)

    def all_ranks(self, place: np.ndarray) -> np.ndarray:
        block = place >> 6
        return self.before[block] + np.bitwise_count(self.bits[block] & _below(place)[:, None])

    def narrowed(self, symbol: np.ndarray, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Interval of the pattern with ``symbol`` before it; an unknown symbol (-1) leaves nothing."""
        known = np.maximum(symbol, 0)
        start = self.ranks(known, low)
        return self.first[known] + start, np.where(symbol >= 0, self.ranks(known, low + size) - start, 0)


def _below(place: np.ndarray) -> np.ndarray:
    return (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)


def rotations(text: np.ndarray, symbols: int) -> np.ndarray:
    """Starts of the sorted rotations of a ring whose rotations all differ, by prefix doubling."""
    width = max(1, int(62 // np.log2(max(symbols, 2))))
    rank = np.zeros(len(text), np.int64)
    for k in range(width):
        rank = rank * symbols + np.roll(text, -k)
    while True:
        order = np.argsort(rank, kind="stable")
        ordered = rank[order]
        step = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if step[-1] == len(text) - 1:
            return order
        rank[order] = step
        rank = rank * len(text) + np.roll(rank, -width)
        width *= 2


class BidirectionalIndex:
    """An index of distinct words. The reversed text is indexed when a scheme first extends to the right."""

    def __init__(self, words: list[str]) -> None:
        self.words = sorted(words)
        points, self.starts = _points(self.words)
        self.alphabet = np.unique(points)
        symbols = len(self.alphabet) + 1
        n = len(self.words)
        ring = np.zeros(len(points) + n, np.int64)
        ring[np.arange(len(points)) + np.repeat(np.arange(n), np.diff(self.starts)) + 1] = np.searchsorted(self.alphabet, points) + 1
        self.ring, self.symbols, self.codes = ring, symbols, points
        self.left = Directory(ring, symbols)
        self._right: Directory | None = None

    @property
    def right(self) -> Directory:
        if self._right is None:
            self._right = Directory(self.ring[::-1], self.symbols)
            # a delimiter of the reversed text comes right after the word that it begins
            ahead = np.cumsum(self.ring == 0)
            at = len(self.ring) - 1 - self._right.order[: len(self.words)]
            self.word_of_right = (ahead[at] - 2) % len(self.words)
        return self._right

    def coded(self, points: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[place] == points, place + 1, -1)

    def near(self, queries: list[str], scheme: str) -> tuple[np.ndarray, np.ndarray]:
        """Query and word numbers of all near words whose left (scheme ``left``) half is the query's, or only whose right half is (``right``)."""
        found = [self._near(queries[k : k + TOGETHER], scheme, k) for k in range(0, len(queries), TOGETHER)]
        if not found or not self.words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([q for q, _ in found]), np.concatenate([w for _, w in found])

    def _near(self, queries: list[str], scheme: str, base: int) -> tuple[np.ndarray, np.ndarray]:
        points, starts = _points(queries)
        codes, sizes = self.coded(points), np.diff(starts)
        half = sizes // 2
        if scheme == "left":
            # the left half from its inner end to the delimiter, both intervals in step; then to the right
            low, size = self._in_step(codes, starts[:-1], half)
            directory, rest, origin, step = self.right, sizes - half, starts[:-1] + half, 1
            number = self.word_of_right
        else:
            low, size = np.zeros(len(queries), np.int64), np.full(len(queries), len(self.words))
            for k in range(int((sizes - half).max())):
                on = np.flatnonzero((k < sizes - half) & (size > 0))
                low[on], size[on] = self.left.narrowed(codes[starts[1:][on] - 1 - k], low[on], size[on])
            directory, rest, origin, step = self.left, half, starts[:-1] + half - 1, -1
            number = np.arange(len(self.words))
        query, word = self._extended(codes, low, size, rest, origin, step, directory, number)
        pairs = np.unique(query * len(self.words) + word)
        query, word = pairs // len(self.words), pairs % len(self.words)
        if scheme == "right":
            own = ~self._starts_alike(points, starts, half, query, word)
            query, word = query[own], word[own]
        return query + base, word

    def _in_step(self, codes: np.ndarray, begins: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Interval in the reversed text of each left half after a delimiter, matched from its inner end."""
        n = len(begins)
        low, back, size = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, len(self.ring))
        for k in range(int(half.max()) + 1):
            on = np.flatnonzero((k <= half) & (size > 0))
            symbol = np.where(k < half[on], codes[begins[on] + np.maximum(half[on] - 1 - k, 0)], 0)
            size[on[symbol < 0]] = 0
            on, symbol = on[symbol >= 0], symbol[symbol >= 0]
            start = self.left.all_ranks(low[on])
            counts = self.left.all_ranks(low[on] + size[on]) - start
            row = np.arange(len(on))
            back[on] += np.cumsum(counts, axis=1)[row, symbol] - counts[row, symbol]
            low[on] = self.left.first[symbol] + start[row, symbol]
            size[on] = counts[row, symbol]
        self.right  # noqa: B018  the other directory is needed from here on
        return back, size

    def _extended(
        self,
        codes: np.ndarray,
        low: np.ndarray,
        size: np.ndarray,
        rest: np.ndarray,
        origin: np.ndarray,
        step: int,
        directory: Directory,
        number: np.ndarray,
    ) -> tuple[np.ndarray, np.ndarray]:
        """Words reached with exactly one error. Query q's next symbols are ``codes[origin[q] + step * k]``, k < ``rest[q]``, then a delimiter."""
        padded = np.append(codes, 0)

        def wanted(q: np.ndarray, k: np.ndarray) -> np.ndarray:
            return np.where(k < rest[q], padded[np.where(k < rest[q], origin[q] + step * k, len(codes))], 0)

        exact = np.flatnonzero(size > 0)
        low, size = low[exact], size[exact]
        erred = [np.zeros(0, np.int64) for _ in range(4)]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        depth = 0
        while len(exact) or len(erred[0]):
            # one symbol further for those that have their error behind them
            q, k, at, n = erred
            symbol = wanted(q, k)
            at, n = directory.narrowed(symbol, at, n)
            on = np.flatnonzero(n > 0)
            q, k, at, n, symbol = q[on], k[on], at[on], n[on], symbol[on]
            done = symbol == 0
            found.append((q[done], number[at[done]]))
            erred = [x[~done] for x in (q, k + 1, at, n)]
            if len(exact) == 0:
                continue
            # the error of the others may be here
            start = directory.all_ranks(low)
            counts = directory.all_ranks(low + size) - start
            symbol = wanted(exact, np.full(len(exact), depth))
            counts[:, 0] = 0
            row, c = np.nonzero(counts)
            child = directory.first[c] + start[row, c]
            width = counts[row, c]
            inside = depth < rest[exact]
            other = np.flatnonzero(inside[row] & (c != symbol[row]))
            skip = np.flatnonzero(inside)
            erred = [
                np.concatenate([erred[0], exact[row], exact[row[other]], exact[skip]]),
                np.concatenate([erred[1], np.full(len(row), depth), np.full(len(other) + len(skip), depth + 1)]),
                np.concatenate([erred[2], child, child[other], low[skip]]),
                np.concatenate([erred[3], width, width[other], size[skip]]),
            ]
            same = np.flatnonzero(inside[row] & (c == symbol[row]))
            exact, low, size = exact[row[same]], child[same], width[same]
            depth += 1
        return np.concatenate([q for q, _ in found]), np.concatenate([w for _, w in found])

    def _starts_alike(self, points: np.ndarray, starts: np.ndarray, half: np.ndarray, query: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Whether the word begins with the query's left half."""
        alike = np.diff(self.starts)[word] >= half[query]
        k, on = 0, np.flatnonzero(alike)
        while len(on):
            on = on[k < half[query[on]]]
            differs = points[starts[query[on]] + k] != self.codes[self.starts[word[on]] + k]
            alike[on[differs]] = False
            on, k = on[~differs], k + 1
        return alike


def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words and where each word's begin."""
    starts = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64), starts


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: runs of letters of at least ``least_length`` code points, A-Z in lower case, that occur ``least_count`` times or more.

    Of each 31st run, by a hash of identifier and run, one code point is left out. Null texts hold no runs; a null identifier hashes as an
    empty text.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = F.translate(F.col(text).cast("string"), upper, upper.lower())
    runs = docs.select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(lowered, F.lit(f"[a-z\\u00C0-\\u00FF]{{{least_length},}}"), F.lit(0))).alias("run"),
    )
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    place = (F.col("h") % F.char_length("run")).cast("int")
    damaged = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.char_length("run")))
    words = hashed.select(F.when(F.col("h") % DAMAGE == 0, damaged).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


CELL = ["scheme", "unit", "stem", "block", "turn"]


def _dealt(words: DataFrame, shard: int, stem: int) -> DataFrame:
    """Words and queries (``asked``) of every cell: a unit of whole stems, or a block of words and a turn of queries of one long stem."""
    sides = words.select(
        "word",
        "n",
        F.inline(
            F.array(
                F.struct(F.lit("left").alias("scheme"), F.substring("word", 1, stem).alias("stem")),
                F.struct(F.lit("right").alias("scheme"), F.substring("word", -stem, stem).alias("stem")),
            )
        ),
    )
    counts = sides.groupBy("scheme", "stem").agg(F.count("*").alias("c"))
    blocks, turns = F.ceil(F.col("c") / shard), F.ceil(F.col("c") / (shard * QUERY_BLOCKS))
    grid = written(counts.select("scheme", "stem", "c", blocks.alias("blocks"), turns.alias("turns")), "stems")
    short = grid.where("blocks = 1").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()["n"]
    units = max(1, -(-short // (2 * shard)))
    # each cell of a long stem is alone, so that a query meets a word in one cell only
    long = F.col("blocks") > 1
    dealt = sides.join(grid, ["scheme", "stem"]).select(
        "scheme",
        F.when(long, -1).otherwise(F.pmod(F.xxhash64("stem"), F.lit(units))).alias("unit"),
        F.when(long, F.col("stem")).otherwise("").alias("stem"),
        "word",
        "n",
        "blocks",
        "turns",
    )
    own_block, own_turn = F.pmod(F.xxhash64("word"), "blocks"), F.pmod(F.xxhash64("word"), "turns")
    indexed = dealt.withColumn("block", own_block).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).withColumn("asked", F.lit(False))
    asked = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("turn", own_turn).withColumn("asked", F.lit(True))
    return indexed.unionByName(asked).select(*CELL, "word", "n", "asked")


def _answers(cell: pa.Table) -> pa.Table:
    """Per query of a cell the number of near words and the best of them."""
    asked = cell.column("asked").to_numpy()
    words, counts = np.array(cell.column("word").to_pylist(), object), cell.column("n").to_numpy()
    queries = words[asked].tolist()
    index = BidirectionalIndex(words[~asked].tolist())
    count_of = dict(zip(words[~asked].tolist(), counts[~asked].tolist()))
    ordered = np.array([count_of[w] for w in index.words], np.int64)
    query, word = index.near(queries, cell.column("scheme")[0].as_py())
    order = np.lexsort((word, -ordered[word], query))
    query, word = query[order], word[order]
    first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else query
    return pa.table(
        {
            "word": pa.array([queries[k] for k in query[first].tolist()], pa.string()),
            "n_near": pa.array(np.diff(np.append(first, len(query))).astype(np.int64)),
            "form_n": pa.array(ordered[word[first]]),
            "form": pa.array([index.words[k] for k in word[first].tolist()], pa.string()),
        }
    )


def near_words(words: DataFrame, shard: int = SHARD, stem: int = STEM) -> DataFrame:
    """word, n_near, form, form_n: the number of near words of each word that has any, and the near word of largest n (ties: the smallest).

    ``words`` has distinct words of at least 2 * ``stem`` code points. The result does not depend on ``shard``.
    """
    reach_workers(words.sparkSession)
    found = _dealt(words, shard, stem).groupBy(*CELL).applyInArrow(_answers, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return merged.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of each chain of forms, by doubling. Counts grow along a chain, so it ends."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        met = now.join(ahead, "root", "left")
        new = written(met.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = new.select("word", "root")
        if new.where("moved").isEmpty():
            return now


def spelling_variants(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    ratio: int = RATIO,
    shard: int = SHARD,
) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word of the corpus.

    A word's form is its most frequent near word, if that is ``ratio`` times as frequent; form and form_n are null otherwise. Null and empty texts hold no
    words, rows that repeat an identifier count each, an empty table gives no rows, other columns are not read.
    """
    if least_length < 2 * STEM:
        raise ValueError(f"words need {2 * STEM} code points")
    words = written(vocabulary(docs, key, text, least_length, least_count), "words")
    near = near_words(words, shard)
    kept = (F.col("form_n") >= ratio * F.col("n")).alias("kept")
    met = words.join(near, "word", "left").withColumn("kept", F.coalesce(kept, F.lit(False)))
    judged = written(
        met.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("kept"), F.col("form")).alias("form"), F.when(F.col("kept"), F.col("form_n")).alias("form_n")
        ),
        "judged",
    )
    ends = roots(judged.where("form IS NOT NULL"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: crc32 by its table, which the polynomial gives; near words by the words that both become when one code point is left out.
SQL = """
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS tab
  FROM range(256) t(i)
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{7,}')) AS run
  FROM documents
), counted AS (
  SELECT run, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS code, count(*) AS n FROM runs GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(0, length(code), 2), lambda p: ('0x' || substr(code, p + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS h
  FROM counted, crc
), words AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1
), vocabulary AS (
  SELECT * FROM words WHERE length(word) >= 7 AND n >= 2
), shorter AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM vocabulary, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)
), near AS (
  SELECT a.word, b.word AS other, b.n FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM shorter a JOIN vocabulary b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM shorter a JOIN vocabulary b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(n) AS top_n FROM near GROUP BY word
), judged AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 10 * v.n THEN top_n END AS form_n,
    CASE WHEN top_n >= 10 * v.n THEN (SELECT min(other) FROM near x WHERE x.word = v.word AND x.n = top_n) END AS form
  FROM vocabulary v LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS reached, 0 AS hops FROM judged
  UNION ALL SELECT c.word, j.form, hops + 1 FROM chain c JOIN judged j ON j.word = c.reached WHERE j.form IS NOT NULL
)
SELECT word, form, (SELECT arg_max(reached, hops) FROM chain c WHERE c.word = j.word) AS root, n, n_near, form_n FROM judged j
"""


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(table(spark, folder, "documents"))

"""Jaccard join of word shingles with skips over related sets, and the components of its links.

1. Each text becomes the set of its hashed shingles; equal sets are one set from here on (their smallest identifier).
2. Prefix filter. Two sets of similarity t share a shingle among the first |x| - ceil(t |x|) + 1 of each, in any one order of all shingles.
   The order here is: hashes below a fixed level by document frequency, then the others by hash. Frequencies are needed only below
   the level, a third of all shingles; they are counted over all documents and joined back, hot shingles aggregating before the shuffle.
   Shingles of one document come first and are never sent on, so texts with enough of their own have no candidates at all.
3. The sets of a prefix shingle meet at the smallest of them, their hub. A hub's sets are verified in blocks of bounded size.
   In a block, index lists run by set size and are read from the first size that can match up to the set itself; what lies before and after is
   skipped by position. The overlaps of a set that is close to its predecessor are the predecessor's, corrected by the lists of the few shingles in
   which the two differ, and counted anew only for the sizes that the predecessor could not match.
4. Where a hub has several blocks, each holds the hub too. Sets that its links do not tie to the hub meet all other blocks in a second
   pass; two sets that are tied to it need no link of their own to be in one component. No pair is ever expanded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardscope.llm.common import LOWER, key_filter, maybe_in, mix64, reach_workers, signed, slices, table, window_hashes, word_bounds, word_hashes, written
from shardscope.llm.graph import components

WIDTH, PERCENT = 5, 75
#: Share of the hash range whose shingles are ordered by frequency; shingles of a block.
LEVEL = 0.36
BLOCK_SHINGLES = 1_000_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text. Fewer words than ``width`` are one shingle, none are none."""
    data = LOWER[data]
    starts, ends, first = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends)
    windows = window_hashes(words, width)
    for lo, hi in zip(first[:-1], first[1:]):
        if hi - lo >= width:
            yield np.unique(windows[lo : hi - width + 1])
        else:
            yield window_hashes(words[lo:hi], int(hi - lo)) if hi > lo else windows[:0]


def prefix_length(n, percent: int = PERCENT):
    return n - -(-n * percent // 100) + 1


def _summaries(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, low (hashes below the level) and the set's hash in two numbers."""
    level = np.uint64(int(LEVEL * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in slices(batch.column(1)):
                out = []
                with np.errstate(over="ignore"):
                    for s in shingle_sets(data, offsets):
                        marks = [int(mix64(s + np.uint64(c)).sum(dtype=np.uint64).view(np.int64)) for c in (1, 0x5851F42D4C957F2D)]
                        out.append((len(s), int(np.searchsorted(s, level)), *marks))
                n, low, s1, s2 = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(out)), *(pa.array(x, pa.int64()) for x in (n, low, s1, s2))],
                    ["doc_id", "n_shingles", "low", "s1", "s2"],
                )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, low long, s1 long, s2 long")


def _prefix_tokens(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id and token: all hashes below the level, and more by hash where the prefix is longer."""
    level = np.uint64(int(LEVEL * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in slices(batch.column(1)):
                sets = [s[: max(int(np.searchsorted(s, level)), prefix_length(len(s), percent))] if len(s) else s for s in shingle_sets(data, offsets)]
                owner = np.repeat(np.arange(first, first + len(sets)), [len(s) for s in sets])
                tokens = np.concatenate(sets)
                for k in range(0, len(tokens), 1 << 17):
                    ids = batch.column(0).take(pa.array(owner[k : k + (1 << 17)]))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(signed(tokens[k : k + (1 << 17)]))], ["doc_id", "token"])

    return docs.mapInArrow(run, "doc_id long, token long")


def _hubs(docs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """hub, node, n: every two similar sets meet under at least one hub."""
    tokens = _prefix_tokens(docs, percent)
    # counts and hubs are written before their joins: these then have both shuffles to themselves, and hot keys can be split
    counts = written(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "counts")
    shared = tokens.join(counts, "token")
    below = (F.col("token") >= 0) & (F.col("token") < int(LEVEL * 2**64))
    nodes = sets.where("doc_id = node").select("doc_id", "n_shingles", "low", "texts")
    mine = shared.join(nodes, "doc_id")
    order = Window.partitionBy("doc_id").orderBy((~below).cast("int"), "df", "token")
    mine = mine.withColumn("place", F.row_number().over(order))
    mine = mine.withColumn("n_low", F.sum(below.cast("int")).over(Window.partitionBy("doc_id")))
    n = F.col("n_shingles")
    length = n - F.ceil(n * percent / F.lit(100)) + 1
    # shingles of one document alone stand before the shared ones; an identifier with several texts keeps all
    kept = mine.where((F.col("texts") > 1) | ~below | (F.col("place") <= length - (F.col("low") - F.col("n_low"))))
    kept = written(kept.select(F.col("doc_id").alias("node"), "token", F.col("n_shingles").alias("n")), "prefixes")
    met = kept.groupBy("token").agg(F.min("node").alias("hub"), F.max("node").alias("_last")).where("hub < _last").drop("_last")
    met = written(met, "met")
    return written(kept.join(met, "token").select("hub", "node", "n").distinct(), "hubs")


def block_links(sets: list[np.ndarray], percent: int = PERCENT, tally: list[int] | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that span the components of the similar pairs among ``sets``; ``sets`` are sorted and not empty.

    ``tally`` is given the number of entries of index lists that each step read.
    """
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    n, sizes = len(order), np.array([len(sets[i]) for i in order])
    flat = np.concatenate([sets[i] for i in order])
    _, flat = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    # index lists by token, each in the order of sizes: a place in all of them is token * n + set
    places = np.sort(flat * n + owner)
    lists = places % n
    ends = np.cumsum(sizes)
    own = [np.sort(flat[e - s : e]) for s, e in zip(sizes, ends)]
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def counted(tokens: np.ndarray, first: int, last: int) -> np.ndarray:
        """How many of ``tokens`` each set from ``first`` to before ``last`` holds. Lists are entered and left by position; the rest of them is skipped."""
        enter, leave = (np.searchsorted(places, tokens * n + at) for at in (first, last))
        size = leave - enter
        if tally is not None:
            tally.append(int(size.sum()))
        at = np.repeat(enter - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.bincount(lists[at] - first, minlength=last - first)

    links: list[tuple[int, int]] = []
    # overlaps with the sets from ``known`` on of the set ``before``
    overlaps, known, before = None, 0, 0
    for i in range(n - 1, -1, -1):
        least = int(np.searchsorted(sizes, -(-int(sizes[i]) * percent // 100)))
        if least == i:
            overlaps = None
            continue
        derived = overlaps is not None and known <= i
        if derived:
            gone, come = np.setdiff1d(own[before], own[i], True), np.setdiff1d(own[i], own[before], True)
            derived = len(gone) + len(come) < len(own[i]) // 2
        if derived:
            # sets too small for the larger set before are met here for the first time
            upper = overlaps[: i - known] - counted(gone, known, i) + counted(come, known, i)
            overlaps = np.concatenate([counted(own[i], least, known), upper])
        else:
            overlaps = counted(own[i], least, i)
        known, before = least, i
        similar = 100 * overlaps >= percent * (sizes[i] + sizes[least:i] - overlaps)
        for j in (np.flatnonzero(similar) + least).tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[a] = b
                links.append((order[i], order[j]))
    return links


def _verified(docs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """a, b: spanning links of every unit. ``members`` has unit and node."""
    named = maybe_in(docs.withColumnRenamed("doc_id", "node"), key_filter(members, "node"), "node").where("_maybe").select("node", "text")
    rows = named.join(members, "node").repartition("unit").sortWithinPartitions("unit", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, ids, sets = None, [], []

        def linked() -> pa.RecordBatch:
            links = block_links(sets, percent) if len(sets) > 1 else []
            a, b = ([ids[x[k]] for x in links] for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array([unit] * len(a), pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["unit", "a", "b"])

        for batch in batches:
            units, nodes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, data, offsets in slices(batch.column(2)):
                for k, s in enumerate(shingle_sets(data, offsets), first):
                    if units[k] != unit:
                        if len(sets) > 1:
                            yield linked()
                        unit, ids, sets = units[k], [], []
                    if len(s):
                        ids.append(nodes[k])
                        sets.append(s)
        if len(sets) > 1:
            yield linked()

    return rows.select("unit", "node", "text").mapInArrow(run, "unit long, a long, b long")


def near_links(docs: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK_SHINGLES) -> DataFrame:
    """a, b: links between sets whose components are those of all similar pairs."""
    hubs = _hubs(docs, sets, percent)
    weights = hubs.groupBy("hub").agg(F.sum("n").alias("w")).withColumn("blocks", F.ceil(F.col("w") / block)).drop("w")
    weights = written(weights, "weights")
    placed = hubs.join(weights, "hub").withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")))
    # every block of a hub holds the hub itself
    copies = placed.where("node = hub AND blocks > 1").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = placed.where("node <> hub OR blocks = 1").unionByName(copies.select(*placed.columns))
    placed = written(placed.withColumn("unit", F.xxhash64("hub", "block")), "units")
    links = written(_verified(docs, placed.select("unit", "node"), percent), "found")
    hot = placed.where("blocks > 1")
    if hot.isEmpty():
        return links.select("a", "b")
    # sets of hot hubs that no link of their block ties to the hub meet all blocks of that hub
    tied = components(links.join(hot.select("unit").distinct(), "unit", "left_semi").select("a", "b"))
    named = hot.select("hub", "node", "n", "blocks", "block").where("node <> hub").join(tied, "node", "left")
    named = named.join(tied.select(F.col("node").alias("hub"), F.col("component").alias("_of_hub")), "hub", "left")
    loose = named.where(~F.col("component").eqNullSafe(F.col("_of_hub")) | F.col("component").isNull())
    loose = written(loose.select("hub", "node", "n", "blocks"), "loose")
    if loose.isEmpty():
        return links.select("a", "b")
    parts = loose.groupBy("hub", "blocks").agg(F.ceil(F.sum("n") / block).alias("parts"))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    left = loose.join(parts.drop("blocks"), "hub").withColumn("part", F.pmod(F.xxhash64("node", F.lit(5)), F.col("parts")))
    left = left.withColumn("block", F.explode(every)).select("hub", "block", "part", "node")
    right = hot.join(parts.drop("blocks"), "hub").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    pairs = left.unionByName(right.select("hub", "block", "part", "node")).distinct()
    more = _verified(docs, pairs.select(F.xxhash64("hub", "block", "part").alias("unit"), "node"), percent)
    return links.select("a", "b").unionByName(more.select("a", "b"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, block: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest identifier reachable by links, itself included) of every row.

    Texts of null or without words have no shingles and no links. Rows with a null identifier are linked with nothing and have a
    null component. Rows that repeat an identifier are compared by their own texts and share a component. An empty table gives
    no rows; other columns are not read.
    """
    reach_workers(docs.sparkSession)
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = written(_summaries(plain), "sets")
    by_set = ["s1", "s2", "n_shingles"]
    same = rows.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy(*by_set, "low").agg(F.min("doc_id").alias("node"))
    distinct = rows.where("doc_id IS NOT NULL AND n_shingles > 0").select("doc_id", *by_set, "low").distinct()
    texts = distinct.groupBy("doc_id").agg(F.count("*").alias("texts"))
    sets = written(distinct.join(same.drop("low"), by_set).join(texts, "doc_id"), "named")
    links = near_links(plain.where("doc_id IS NOT NULL"), sets, percent, block)
    # identifiers that share a set, or have several
    ties = sets.where("doc_id <> node").select(F.col("doc_id").alias("b"), F.col("node").alias("a"))
    several = sets.where("texts > 1")
    if several.isEmpty():
        # the usual case: one set per identifier, so the smallest of a set stands for all of its identifiers
        found = components(links)
        to = sets.select("doc_id", "node").join(found, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component_id"))
    else:
        found = components(links.unionByName(ties.select("a", "b")))
        to = sets.select("doc_id").distinct().join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        to = to.select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))
    return rows.select("doc_id", "n_shingles").join(to, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component stays, the one of the smallest identifier, with the columns it came with."""
    found = near_duplicates(docs, key, text)
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias("_llm_gone")).distinct()
    return docs.join(gone, F.col(key) == F.col("_llm_gone"), "left_anti").select(*docs.columns)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS g FROM w
), e AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s
), m AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (SELECT a, b FROM m WHERE 100 * i >= 75 * (na + nb - i)
), u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id AS d, doc_id AS c FROM s UNION SELECT u.b, r.c FROM r JOIN u ON r.d = u.a
)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, (SELECT min(c) FROM r WHERE r.d = s.doc_id) AS component_id FROM s
"""


def op9_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))

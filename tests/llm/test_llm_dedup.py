"""Exact, near and substring duplicates against plain versions."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import plain
import pytest
from conftest import texts_of

from shardscope.llm import exact_dedup, graph, ngram_join, substring_dedup


def test_exact_duplicates(spark, docs):
    twin = spark.createDataFrame([(2, "twin", None, None, 0, 0, 0.0, "")] * 3 + [(None, "twin", None, None, 0, 0, 0.0, "")], plain.SCHEMA)
    every = docs.where("doc_id <> 2").unionByName(twin)
    texts = texts_of(every)
    size = Counter(t or "" for _, t in texts)
    keep = {}
    for d, t in texts:
        keep[t or ""] = max(keep.get(t or "", -1), -1 if d is None else d)
    found = exact_dedup.exact_duplicates(every).collect()
    assert len(found) == len(texts)
    by_text = {hashlib.sha256(t.encode()).hexdigest(): t for t in keep}
    for r in found:
        t = by_text[r.text_sha256]
        assert (r.keep_id, r.group_size) == (keep[t], size[t])
    # repeated rows too: one stays of each text
    assert Counter(r.text_sha256 for r in found if r.kept) == Counter(list(by_text))
    stays = exact_dedup.keep_one(every)
    assert stays.columns == every.columns and sorted(r.doc_id for r in stays.collect()) == sorted(keep.values())
    assert stays.where("doc_id = 2").count() == 1


@pytest.mark.parametrize("runs, fan_in", [(1, 2), (5, 2), (64, 8)])
def test_merge_does_not_depend_on_runs(docs, runs, fan_in):
    rows = exact_dedup.digests(docs.repartition(7)).cache()
    one = {r.text_sha256: (r.keep.doc_id, r.group_size) for r in exact_dedup.merge_runs(rows, 64, 4, "smallest").collect()}
    assert one == {r.text_sha256: (r.keep.doc_id, r.group_size) for r in exact_dedup.merge_runs(rows, runs, fan_in, "smallest").collect()}
    with pytest.raises(ValueError):
        exact_dedup.merge_runs(rows, keep="first")


def test_components(spark):
    pick = random.Random(5)
    links = [(pick.randrange(300), pick.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)]
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert found == plain.components(nodes, [x for x in links if x[0] != x[1]])


def test_block_links_equal_all_pairs():
    pick = random.Random(3)
    for size in (1, 2, 12, 60):
        base = [sorted(pick.sample(range(400), pick.randint(1, 60))) for _ in range(max(1, size // 4))]
        sets = []
        for _ in range(size):
            own = set(pick.choice(base))
            own -= set(pick.sample(sorted(own), len(own) // 9))
            own |= set(pick.sample(range(400), pick.randint(0, 3)))
            sets.append(np.array(sorted(own), np.uint64))
        real = [
            (i, j)
            for i in range(size) for j in range(i)
            if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))
        ]
        found = ngram_join.block_links(sets)
        assert set(map(tuple, map(sorted, found))) <= set(map(tuple, map(sorted, real)))
        assert plain.components(range(size), found) == plain.components(range(size), real)


def test_index_lists_are_skipped_where_sizes_cannot_match():
    """Sets of sizes from 20 to 400 that all share twenty tokens: a list entered whole would be read to its end for every set."""
    shared = list(range(20))
    sets = [np.array(sorted([*shared, *range(1000 * i, 1000 * i + 4 * i)]), np.uint64) for i in range(1, 96)]
    sets += [np.array(sorted([*s.tolist()[:-1], 9_000_000 + i]), np.uint64) for i, s in enumerate(sets)]
    tally = []
    found = ngram_join.block_links(sets, tally=tally)
    real = [
        (i, j) for i in range(len(sets)) for j in range(i)
        if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))
    ]
    assert plain.components(range(len(sets)), found) == plain.components(range(len(sets)), real)
    sizes = [len(s) for s in sets]
    could = sum(len(shared) for a in sizes for b in sizes if 75 * a <= 100 * b <= 100 * a)
    every = len(shared) * len(sets) ** 2
    assert sum(tally) < every / 3 and sum(tally) < 1.2 * could


@pytest.mark.parametrize("block", [1_000_000, 90])
def test_near_duplicates(spark, docs, block):
    """With small blocks every hub is split, and its loose sets meet the other blocks."""
    pick = random.Random(8)
    base = [f"h{i}" for i in range(60)]
    more = []
    for i in range(40):
        own = list(base)
        for _ in range(pick.randint(1, 3)):
            own[pick.randrange(60)] = f"e{i}"
        more.append(" ".join(own))
    every = docs.unionByName(spark.createDataFrame(plain.rows(more, 1000), plain.SCHEMA))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(every, block=block).collect()}
    assert found == plain.near_components(texts_of(every))


def test_near_duplicates_of_odd_rows(spark, none):
    text = " ".join(f"t{i}" for i in range(40))
    other = " ".join(f"u{i}" for i in range(40))
    rows = [(5, text), (5, text), (5, other), (9, other), (None, text), (3, text + " end"), (7, None)]
    df = spark.createDataFrame([(d, t, None, None, 0, 0, 0.0, "") for d, t in rows], plain.SCHEMA)
    found = Counter((r.doc_id, r.component_id) for r in ngram_join.near_duplicates(df).collect())
    assert found == Counter({(5, 3): 3, (9, 3): 1, (None, None): 1, (3, 3): 1, (7, 7): 1})
    assert ngram_join.near_duplicates(none).count() == 0
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns and Counter(r.doc_id for r in kept.collect()) == Counter([None, 3, 7])


def test_automaton_finds_earlier_windows():
    pick = random.Random(4)
    texts = [[pick.choice([b"a", b"b", b"c"]) for _ in range(pick.randint(1, 60))] for _ in range(12)]
    automaton = substring_dedup.Automaton()
    for d, t in enumerate(texts):
        automaton.add(t, d, 0, 7)
    first = {}
    for d, t in enumerate(texts):
        for e in range(4, len(t)):
            first.setdefault(tuple(t[e - 4 : e + 1]), (d, 0, 7 + e))
    for d, t in enumerate(texts):
        assert automaton.repeats(t, d, 0, 7, 5) == [first[tuple(t[e - 4 : e + 1])] < (d, 0, 7 + e) for e in range(4, len(t))]


def test_repeated_passages(docs, spark, none):
    long = " ".join(f"k{i % 977}" for i in range(30_000))
    more = spark.createDataFrame(plain.rows([long, long[: len(long) // 2]], 500), plain.SCHEMA)
    every = docs.unionByName(more)
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.without_repeats(every).collect()}
    assert found == plain.without_repeats(texts_of(every))
    assert sum(x[1] for x in found.values()) > 30_000
    assert substring_dedup.without_repeats(none).count() == 0


def test_repeated_passages_in_blocks(docs, monkeypatch):
    """Small shards and blocks: the same spans."""
    for name, value in (("SHARD_WORDS", 50), ("BLOCK_WORDS", 60), ("RANGE_WORDS", 16)):
        monkeypatch.setattr(substring_dedup, name, value)
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.without_repeats(docs).collect()}
    assert found == plain.without_repeats(texts_of(docs))


def test_repeated_rows_count_as_one_document(spark):
    text = " ".join(f"r{i}" for i in range(25))
    rows = [(4, text), (4, text), (None, text), (8, "new " + text)]
    df = spark.createDataFrame([(d, t, None, None, 0, 0, 0.0, "") for d, t in rows], plain.SCHEMA)
    found = Counter((r.doc_id, r.n_removed) for r in substring_dedup.without_repeats(df).collect())
    assert found == Counter({(None, 0): 1, (4, 25): 2, (8, 25): 1})


def test_texts_of_one_identifier_are_told_apart(spark):
    """Two texts of an identifier whose hashes agree in their last 16 bits: only the one that repeats a passage loses it."""
    made = spark.range(60_000).selectExpr("concat('own', id, ' ', array_join(transform(sequence(1, 30), i -> concat('q', id, 'x', i)), ' ')) AS text")
    twins = made.selectExpr("text", "xxhash64(text) & 65535 AS m").groupBy("m").agg({"text": "min", "m": "count"}).where("`count(m)` > 1").limit(1).collect()[0]
    other = made.where(f"xxhash64(text) & 65535 = {twins.m}").where(f"text <> '{twins['min(text)']}'").first().text
    passage = twins["min(text)"]
    rows = [(1, passage), (7, passage), (7, other)]
    found = {(r.doc_id, r.kept): r.n_removed for r in substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(1, passage): 0, (7, ""): 31, (7, other): 0}

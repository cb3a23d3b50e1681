"""Spelling variants against all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import plain
import pytest
from conftest import texts_of

from shardscope.llm import spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(docs):
    counts = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = plain.lower(run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    out, forms = {}, {}
    for w, n in words.items():
        others = [u for u in words if near(u, w)]
        best = min(others, key=lambda u: (-words[u], u), default=None)
        if best is not None and words[best] >= 10 * n:
            forms[w] = best
        out[w] = (forms.get(w), n, len(others), words[best] if w in forms else None)
    for w, (form, *rest) in out.items():
        root = w
        while root in forms:
            root = forms[root]
        out[w] = (form, root, *rest)
    return out


@pytest.mark.parametrize("letters", ["ab", "abcé", "abcdefghijklmno÷"])
def test_schemes_find_each_near_word_once(letters):
    pick = random.Random(letters)
    words = sorted({"".join(pick.choices(letters, k=pick.randint(7, 10))) for _ in range(500)} | {"a" * 7, "a" * 8, "a" * 300, "a" * 299, "aaaaaab"})
    queries = [*words, *("".join(pick.choices(letters + "z", k=pick.randint(7, 10))) for _ in range(200))]
    index = spelling.BidirectionalIndex(words)
    found = Counter((int(q), index.words[w]) for scheme in ("left", "right") for q, w in zip(*index.near(queries, scheme)))
    assert found == Counter((i, w) for i, q in enumerate(queries) for w in words if near(q, w))


def test_intervals_are_suffix_ranks():
    words = ["banana", "bandana", "ananas", "nab"]
    index = spelling.BidirectionalIndex(words)
    ring = index.ring.tolist()
    turned = sorted(range(len(ring)), key=lambda i: ring[i:] + ring[:i])
    assert index.left.order.tolist() == turned
    for pattern in ("an", "ana", "nab", "x"):
        low, size = np.array([0]), np.array([len(ring)])
        for c in reversed(index.coded(np.array([ord(x) for x in pattern]))):
            low, size = index.left.narrowed(np.array([c]), low, size)
        assert size[0] == sum(w[i:].startswith(pattern) for w in words for i in range(len(w)))
    assert index.left.all_ranks(np.array([5]))[0].tolist() == [int(index.left.ranks(np.array([c]), np.array([5]))[0]) for c in range(index.symbols)]


@pytest.fixture(scope="module")
def misspelt(spark):
    pick = random.Random(12)
    stems = ["spelling", "variant", "grouping", "spellinga", "éclair÷age", "Interval"]
    texts = []
    for _ in range(300):
        words = []
        for w in pick.choices(stems, k=40):
            if pick.random() < 0.06:
                at = pick.randrange(len(w))
                w = pick.choice([w[:at] + w[at + 1 :], w[:at] + pick.choice("abé") + w[at:], w[:at] + "x" + w[at + 1 :]])
            words.append(w)
        texts.append(pick.choice([" ", "-", "1"]).join(words))
    texts += plain.corpus() + ["q" * 5000 + " " + "q" * 4999, "Q" * 5000]
    rows = plain.rows(texts) + [(3, "spelling spellinh spellinh", None, None, 0, 0, 0.0, ""), (None, "Spellinh VARIANT", None, None, 0, 0, 0.0, "")]
    return spark.createDataFrame(rows, plain.SCHEMA).withColumnRenamed("token", "word").repartition(3)


@pytest.mark.parametrize("shard", [spelling.SHARD, 10])
def test_variants_equal_all_pairs(misspelt, shard):
    expected = variants(texts_of(misspelt))
    found = spelling.spelling_variants(misspelt, shard=shard).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found} == expected and len(found) == len(expected)
    assert len(expected) > 100 and sum(x[0] is not None for x in expected.values()) > 30


def test_hot_beginnings_are_split(misspelt):
    words = spelling.vocabulary(misspelt)
    held = spelling._dealt(words, 5, spelling.STEM).groupBy(*spelling.CELL, "asked").count().collect()
    assert any(r.turn > 0 for r in held) and any(r.block > 0 for r in held)
    assert max(r["count"] for r in held) < words.count() / 2


def test_roots_follow_chains(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(13)] + [("a", "w3"), ("b", "c")]
    found = {r.word: r.root for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert found == {**{f"w{i}": "w13" for i in range(13)}, "a": "w13", "b": "c"}


def test_variants_of_nothing(none, spark):
    found = spelling.spelling_variants(none)
    assert found.count() == 0 and found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert spelling.spelling_variants(spark.createDataFrame([(1, None), (2, ""), (3, "alonehere")], "doc_id long, text string")).count() == 0

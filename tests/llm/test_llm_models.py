"""Classifier, language model, segmentations and nearest neighbours."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import plain
import pytest
from conftest import texts_of

from shardscope.llm import ppm, quality, segmentation, vantage
from shardscope.llm.common import table

FOLDER = "/root/testdata/sf0.01"


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def test_classifier_tells_held_out_quality(spark):
    labels = {r.doc_id: r.quality for r in table(spark, FOLDER, "labels").collect()}
    found = quality.classify(table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")).collect()
    assert all(r.held_out == (crc(r.doc_id) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    held = [(labels[r.doc_id], r.predicted) for r in found if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert np.mean([b for a, b in held if a == 1]) > 0.98


def test_classifier_does_not_read_held_out_labels(spark):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels").toPandas()
    turned = labels.assign(quality=[1 - q if crc(d) % 3 == 1 else q for d, q in zip(labels.doc_id, labels.quality)])
    one, two = ({r.doc_id: r.score for r in quality.classify(docs, spark.createDataFrame(x)).collect()} for x in (labels, turned))
    assert all(math.isclose(one[d], two[d], abs_tol=1e-9) for d in one)


def test_scores_equal_the_plain_discriminant(spark):
    """Statistics counted one by one, covariances from the definition, inverses instead of factors."""
    docs, labels = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels")
    texts, marks = texts_of(docs), {r.doc_id: r.quality for r in labels.collect()}
    rows = {d: plain.statistics(t) for d, t in texts}
    learned = [d for d in rows if d in marks and crc(d) % 3 != 1]
    scores = plain.quadratic_scores([rows[d] for d, _ in texts], [rows[d] for d in learned], [marks[d] for d in learned], quality.POOLED, quality.ROUND)
    found = {r.doc_id: (r.score, r.predicted) for r in quality.classify(docs, labels).collect()}
    assert len(learned) > 30 and set(found) == set(rows)
    assert all(found[d][0] == pytest.approx(s, abs=1e-6) for (d, _), s in zip(texts, scores))
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert kept == {d for d, (_, predicted) in found.items() if predicted == 1}


def test_classifier_on_odd_tables(spark, docs, none):
    marks = spark.createDataFrame([(1, 1), (1, 1), (2, None), (4, 1)], "doc_id long, quality int")
    found = quality.classify(docs, marks).collect()
    assert len(found) == docs.count() and {r.score for r in found} == {1.0}
    assert {r.score for r in quality.classify(docs, marks.where("quality = 5")).collect()} == {0.5}
    assert quality.classify(none, marks).count() == 0
    assert quality.keep_good(none, marks).count() == 0
    kept = quality.keep_good(docs, marks)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_statistics_do_not_depend_on_neighbours():
    texts = [t or "" for t in plain.corpus()]
    raw = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    together = quality.text_statistics(np.frombuffer(raw, np.uint8), offsets)
    for i, t in enumerate(texts):
        own = np.frombuffer(t.encode(), np.uint8)
        assert np.allclose(together[i], quality.text_statistics(own, np.array([0, len(own)]))[0])


def test_plain_ppm_is_a_distribution(docs):
    model = plain.Ppm([t or "" for _, t in texts_of(docs)], 3)
    for before in ("w1 ", "zz", "", "p12"):
        context = tuple([0] * 3 + [b + 1 for b in before.encode()])[-3:]
        assert math.isclose(sum(model.probability(context, s) for s in range(1, 258)), 1, rel_tol=1e-9)


def test_ppm_scores(spark, docs, none):
    every = docs.unionByName(docs.where("doc_id = 3")).unionByName(spark.createDataFrame([(3, "w1 unseen", None, None, 0, 0, 0.0, ""), (None, "W1 w2", None, None, 0, 0, 0.0, "")], plain.SCHEMA))
    texts = texts_of(every)
    train = Counter()
    for d, t in texts:
        if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2:
            train.update(plain.words(plain.lower(t)) + [""])
    n, v = sum(train.values()), len(train)
    expected = Counter()
    for d, t in texts:
        tokens = plain.words(plain.lower(t)) + [""]
        base = sum(math.log10((train[w] + 1) / (n + v + 1)) for w in tokens)
        expected[(d, len(tokens), sum(train[w] > 0 for w in tokens), n, round(base, 6))] += 1
    found = ppm.score_texts(every).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == expected
    assert all(r.score < 0 for r in found)
    assert ppm.score_texts(none).count() == 0
    untrained = ppm.score_texts(docs.where("doc_id IN (0)").where("crc32(cast(doc_id AS string)) % 7 = 2"))
    assert untrained.count() == 0 or untrained.first().n_known == 0


@pytest.mark.parametrize("share", [ppm.SHARE, 200])
def test_ppm_scores_equal_plain_dictionaries(spark, docs, share):
    """Training and held-out texts, however few grams are sent to the tasks."""
    every = docs.unionByName(spark.createDataFrame([(2, "zebra quilt vex w1 w2", None, None, 0, 0, 0.0, ""), (2, "Jumping w3 über", None, None, 0, 0, 0.0, "")], plain.SCHEMA))
    texts = texts_of(every)
    model = plain.Ppm([t or "" for d, t in texts if crc(d) % 7 != 2], 3)
    expected = Counter((d, round(model.score(t or ""), 6)) for d, t in texts)
    assert any(crc(d) % 7 == 2 for d, _ in texts)
    assert Counter((r.doc_id, round(r.score, 6)) for r in ppm.score_texts(every, order=3, share=share).collect()) == expected


def test_ppm_knows_the_end_of_very_long_texts(spark):
    docs = spark.createDataFrame([(2, "aa bb " * 100_000), (3, "aa zz")], "doc_id long, text string")
    assert [crc(d) % 7 == 2 for d in (2, 3)] == [False, False]
    found = {r.doc_id: r for r in ppm.score_texts(docs).collect()}
    assert (found[3].n_tokens, found[3].n_known, found[2].n_known) == (3, 3, 200_001)
    counts, n, v = (100_001, 1, 2), 200_004, 4
    assert math.isclose(found[3].base_score, sum(math.log10((c + 1) / (n + v + 1)) for c in counts), abs_tol=1e-9)


def test_ppm_cache_changes_nothing():
    raw = "\n".join(t or "" for t in plain.corpus(2)).encode()
    codes, _ = ppm.grams(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    known = np.unique(codes)[::2]
    frequent = ppm.Frequent(known, np.arange(len(known)) / 7.0)
    cached = ppm.Cached(frequent)
    for _ in range(2):
        assert np.array_equal(cached.log10(codes), frequent.log10(codes), equal_nan=True)


def test_ppm_beats_tokens_on_held_out_text(spark):
    found = [r for r in ppm.score_texts(table(spark, "/root/testdata/sf0.1", "documents")).collect() if r.held_out]
    assert sum(r.score for r in found) > sum(r.base_score for r in found)


@pytest.fixture(scope="module")
def pieces():
    return segmentation.load(segmentation.model_path())


def ways(text, pieces):
    """All segmentations of a short text with their probabilities."""
    inner = (b" " + text).replace(b" ", bytes([segmentation.SPACE]))
    known = {}
    for i, raw in enumerate(pieces.texts):
        key = raw.replace(b" ", bytes([segmentation.SPACE]))
        if raw and i not in set(pieces.ids[len(pieces.prefixes) :].tolist()):
            h = np.zeros(1, np.uint64)
            with np.errstate(over="ignore"):
                for b in key:
                    h = h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(b + 1)
            at = pieces.find(h)[0]
            if at >= 0 and pieces.ids[at] == i:
                known[key] = (i, pieces.weights[at])
    out = {}

    def go(at, ids, weight):
        if at == len(inner):
            out[tuple(ids)] = math.exp(weight)
        for end in range(at + 1, len(inner) + 1):
            if inner[at:end] in known:
                i, w = known[inner[at:end]]
                go(end, [*ids, i], weight + w)

    go(0, [], 0.0)
    total = sum(out.values())
    return {k: x / total for k, x in out.items()}


def draw(texts, keys, pieces, samples):
    raw = b"".join(texts)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    return segmentation.segment(np.frombuffer(raw, np.uint8), offsets, np.array(keys), pieces, samples)


def test_segmentations_follow_the_lattice(pieces):
    exact = ways(b"new to", pieces)
    n = 6000
    found = draw([b"new to"] * n, range(n), pieces, 3)
    top = max(exact, key=exact.get)
    firsts = Counter(tuple(rows[0][0].tolist()) for rows in found)
    assert abs(firsts[top] / n - exact[top]) < 4 * math.sqrt(exact[top] * (1 - exact[top]) / n)
    # the second given the first is drawn from the others in proportion
    second = [tuple(rows[1][0].tolist()) for rows in found if tuple(rows[0][0].tolist()) == top]
    others = {k: p / (1 - exact[top]) for k, p in exact.items() if k != top}
    best = max(others, key=others.get)
    assert abs(Counter(second)[best] / len(second) - others[best]) < 4 * math.sqrt(others[best] * (1 - others[best]) / len(second))
    for rows in found:
        assert len({tuple(r[0].tolist()) for r in rows}) == len(rows) == min(3, len(exact))
        assert [r[2] for r in rows] == sorted((r[2] for r in rows), reverse=True)
        assert all(math.isclose(r[1], math.log(exact[tuple(r[0].tolist())]), abs_tol=1e-9) for r in rows)
    # 1 / inclusion weighs the sampled so that they estimate the whole mass
    mass = np.mean([sum(math.exp(r[1]) / r[3] for r in rows) for rows in found])
    assert abs(mass - 1) < 0.05


def test_all_segmentations_of_a_short_text(pieces):
    exact = ways(b"ab", pieces)
    rows = draw([b"ab"], [5], pieces, len(exact) + 5)[0]
    assert {tuple(r[0].tolist()) for r in rows} == set(exact) and all(r[3] == 1.0 for r in rows)


def test_segmentations_decode_and_stand_alone(pieces):
    texts = [(t or "").encode() for t in plain.corpus()] + ["▁ odd ▁▁ \x00\n\n x  y ".encode(), b"a" * 5000, "漢字仮名".encode()]
    keys = list(range(100, 100 + len(texts)))
    together = draw(texts, keys, pieces, 2)
    for t, k, rows in zip(texts, keys, together):
        assert all(segmentation.decode(r[0].tolist(), pieces) == t for r in rows) and rows
        alone = draw([t], [k], pieces, 2)[0]
        assert [r[0].tolist() for r in rows] == [r[0].tolist() for r in alone]
    assert len(together[texts.index(b"")]) == 1


def test_segmentation_query_columns(spark, docs, none):
    found = segmentation.sampled(docs, digest=True).collect()
    assert all(r.same for r in found) and {r.doc_id for r in found} == {r.doc_id for r in docs.collect()}
    assert segmentation.sampled(none).count() == 0
    ids = {(r.doc_id, r["rank"]): r.ids for r in segmentation.sampled(docs).collect()}
    assert len(ids) == len(found)


def brute(vectors, queries, k=10):
    out = []
    for q, v in queries:
        near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w))), i) for i, w in vectors if i != q)[:k]
        out += [(q, r + 1, i, d) for r, (d, i) in enumerate(near)]
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    pick = random.Random(6)
    rows = [(i, [float(pick.randrange(4)) for _ in range(6)]) for i in range(1, 400)]
    rows += [(i, [1.0] * 6) for i in range(400, 460)]
    odd = [(900, None), (901, [0.0] * 6), (902, [1.0, None] + [1.0] * 4), (903, [float("nan")] + [1.0] * 5), (904, [float("inf")] + [1.0] * 5), (None, [1.0] * 6)]
    df = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id long, embedding array<float>, rank int")
    return [(i, v) for i, v in rows if any(v)], df


@pytest.mark.parametrize("shard_rows", [4096, 50])
def test_exact_neighbours(vectors, shard_rows):
    rows, df = vectors
    found = vantage.nearest(df, df.where("vec_id % 20 = 0 OR vec_id > 890"), shard_rows=shard_rows).collect()
    expected = brute(rows, [(i, v) for i, v in rows if i % 20 == 0])
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == sorted(expected)


def test_queries_and_trees_are_not_broadcast(spark, vectors):
    """Blocks of queries of every shard are more than any estimate says; queries of a width that no shard has find nothing."""
    rows, df = vectors
    queries = df.where("vec_id % 20 = 0").unionByName(spark.createDataFrame([(20, [1.0] * 3, 1)], df.schema))
    found = vantage.nearest(df, queries, shard_rows=50)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect())
    assert got == sorted(brute(rows, [(i, v) for i, v in rows if i % 20 == 0]))


def test_relaxed_pruning_keeps_recall(spark):
    df = table(spark, FOLDER, "embeddings")
    queries = df.where("vec_id % 10 = 0")
    exact, relaxed = ({(r.query_id, r.vec_id) for r in vantage.nearest(df, queries, factor=f).collect()} for f in (1.0, 1.2))
    assert len(exact & relaxed) / len(exact) > 0.9
    assert vantage.nearest(df.limit(0), queries.limit(0)).count() == 0


@pytest.mark.parametrize("leaf", [1, 4, 64])
def test_tree_of_any_leaf_size(vectors, leaf):
    rows, _ = vectors
    tree = vantage.Tree.build(np.array([i for i, _ in rows]), np.array([v for _, v in rows]), leaf)
    tree = vantage.Tree.from_row(tree.to_row())
    for q, v in rows[::37]:
        ids, away = tree.search(np.array(v), q, 10, 1.0)
        assert [(q, r + 1, i, d) for r, (i, d) in enumerate(zip(ids.tolist(), away.tolist()))] == brute(rows, [(q, v)])


def test_segmentations_do_not_depend_on_slices(spark):
    docs = spark.createDataFrame([(i, f"row {i} of some words and numbers {i * i}") for i in range(30)], "doc_id long, text string").coalesce(1)
    found = [sorted((r.doc_id, r.rank, r.n_pieces, tuple(r.ids)) for r in segmentation.sampled(docs, step=step).collect()) for step in (segmentation.SLICE, 64)]
    assert found[0] == found[1] and len(found[0]) == 60

"""Mixing, personal data, revisits and the pipeline."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import plain
import pytest
from conftest import texts_of

import corpus_pipeline
from shardscope.llm import mixing, personal_data, quality, revisits, segmentation
from shardscope.llm.common import table, written

FOLDER = "/root/testdata/sf0.01"


def shared(sizes):
    """Targets by sharing again and again, sources in order."""
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sizes)}
    capped = {}
    while True:
        left = 1.5 * sum(sizes.values()) - sum(capped.values())
        free = [s for s in sizes if s not in capped]
        target = {s: weight[s] * left / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if target[s] > 2 * sizes[s]]
        if not over:
            return {**target, **capped}
        capped.update({s: 2.0 * sizes[s] for s in over})


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    size = defaultdict(int)
    for r in rows:
        size[r.source] += r.size * r.n_rows
    sizes = {s: size[s] for s in [*sorted(x for x in size if x is not None), *([None] if None in size else [])]}
    target, taken, largest = shared(sizes), defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.source_size == size[r.source] and np.isclose(r.target, target[r.source])
        assert r.copies * r.size <= 2 * r.size and r.copies >= r.target // r.source_size
        taken[r.source] += r.size * r.n_rows * r.copies
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)
    assert {r.doc_id: r.size for r in rows} == {d: len(plain.words(t)) for d, t in texts_of(docs)}
    assert mixing.mix(none).count() == 0
    made = Counter(r.doc_id for r in mixing.mixed_rows(docs).collect())
    assert made == Counter({r.doc_id: r.copies * r.n_rows for r in rows if r.copies})
    assert mixing.mixed_rows(docs).columns == docs.columns


def test_no_document_is_taken_more_often_than_its_epochs(spark):
    """A small source reaches its cap of two epochs; its empty texts are taken twice like all others, whatever the columns are called."""
    rows = [(i, "" if i % 3 == 0 else f"a{i} b c", "small", 1, 2, 3) for i in range(30)] + [(100 + i, f"x{i} y z " * 9, "tall", 1, 2, 3) for i in range(40)]
    names = "doc_id long, text string, source string, _llm_n int, _llm_words int, copies int"
    made = Counter(r.doc_id for r in mixing.mixed_rows(spark.createDataFrame(rows, names)).collect())
    assert {made[i] for i in range(30)} == {2} and max(made.values()) == 2
    assert mixing.mixed_rows(spark.createDataFrame(rows, names)).columns == ["doc_id", "text", "source", "_llm_n", "_llm_words", "copies"]


def test_mixing_prefers_quality(spark):
    """Of equally many texts with and without repetition fewer repetitive ones are taken."""
    good = [" ".join(f"g{i}x{j}" for j in range(20)) for i in range(200)]
    bad = [" ".join(["same"] * 20)] * 200
    rows = [(i, t, None, "a", 0, 0, 0.0, "") for i, t in enumerate(good + bad)] + [(1000 + i, " ".join(["b"] * 20), None, "b", 0, 0, 0.0, "") for i in range(400)]
    found = mixing.mix(spark.createDataFrame(rows, plain.SCHEMA)).where("source = 'b' OR source = 'a'").collect()
    more = [np.mean([r.copies for r in found if r.source == "a" and (r.doc_id < 200) == g]) for g in (True, False)]
    assert more[0] >= more[1]


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def spans(text):
    return sorted((m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, rx) in enumerate(BASE.items()) for m in re.finditer(rx, text or "") if valid(kind, m.group()))


ODD = [
    "a@b.com_x@y.co.uk a@b c@d..e x@é.com ü.k@l-m.n", "1.2.3.4.5.6.7.8 999.1.1.1 001.002.003.004 1.2.3.4", "4111 1111 1111 1111-4111111111111111 5500-0000-0000-0004",
    "+1 (555) 010-9999, +49.30.1234567- +1234 +1 23456789012345678", "é" * 50 + " mail: q@r.st\n+44 20 7946 0958\t10.0.0.255", "", None, "no data",
    "9" * 3000 + "@" + "a" * 3000, "1 " * 9000, "a.b@" + "c." * 3000 + "d",
]


def test_base_spans(spark):
    texts = [*ODD, *ODD[:3], "z" * 200_000 + " z@z.zz"]
    df = spark.createDataFrame(plain.rows(texts), plain.SCHEMA)
    for r in personal_data.personal_data(df).collect():
        expected = spans(texts[r.doc_id])
        joined = ",".join(x[2] for x in expected)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and r.spans == joined
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[1] == k for x in expected) for k in range(4)]


def test_contexts_find_unseen_identifiers(spark, none):
    known = [f"please call me at +1 555 010 {1000 + i} today or later" for i in range(12)]
    unseen = ["please call me at 555.777.1234 today or later", "build number 555.777.9999 passed all tests"]
    df = spark.createDataFrame(plain.rows(known + unseen), plain.SCHEMA)
    found = {r.doc_id: (r.n_phone, r.spans) for r in personal_data.personal_data(df).collect()}
    at = unseen[0].index("555")
    assert found[12] == (0, f"phone:{at}:{at + 12}") and found[13] == (0, "")
    assert all(found[i] == (1, spans(t)[0][2]) for i, t in enumerate(known))
    assert personal_data.personal_data(none).count() == 0


def test_revisits(spark):
    full = [
        (1, "http://www.A.org:80/x/?b=2&a=1&utm_source=q#f", 10, False, {"ETag": '"one"', "Content-Length": "5", "Expires": "never"}, "d1"),
        (2, "https://a.org/x?a=1&b=2", 20, False, {"etag": '"two"', "last-modified": "noon"}, "d2"),
        (3, "https://a.org/y", 5, False, None, "d3"),
        (3, "https://a.org/y", 5, False, None, "d3"),
        (4, "not a url ", 1, False, {}, "d4"),
    ]
    asked = [
        (10, "http://a.org/x?a=1&b=2", 15, True, {"ETag": 'W/"one"', "Content-Length": "0", "Expires": "soon"}, None),
        (11, "http://a.org/x/?a=1&b=2", 20, True, {"ETag": '"one"', "Last-Modified": "noon"}, None),
        (12, "http://a.org/x?a=1&b=2", 900, True, {"Last-Modified": "noon"}, None),
        (13, "http://a.org/x?a=1&b=2", 9, True, {}, "d1"),
        (14, "http://a.org/y", 6, True, {"Vary": "*"}, None),
        (15, "http://a.org/y", 6, True, None, "d3"),
        (16, None, 6, True, {}, "d3"),
        (17, "not a url", None, True, {}, "d4"),
        (18, "not a url", 1, True, {"Date": "now"}, "d4"),
        (19, None, None, None, None, None),
    ]
    df = spark.createDataFrame(full + asked, "record_id long, url string, at long, revisit boolean, headers map<string,string>, digest string")
    expected = {
        10: ("resolved", 1, {"etag": 'W/"one"', "content-length": "5", "expires": "soon"}), 11: ("changed", 2, None), 12: ("resolved", 2, {"etag": '"two"', "last-modified": "noon"}),
        13: ("missing", None, None), 14: ("unchecked", 3, {"vary": "*"}), 15: ("resolved", 3, {}), 16: ("missing", None, None), 17: ("missing", None, None),
        18: ("resolved", 4, {"date": "now"}),
    }
    for ranges in (1, 7, 64):
        found = revisits.resolve(df, ranges).collect()
        assert {r.record_id: (r.outcome, r.response_id, r.headers) for r in found} == expected and len(found) == len(expected)
    assert revisits.resolve(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, FOLDER, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, FOLDER), name)
        out.append(docs)
    return out


def test_pipeline_against_plain_stages(spark, stages):
    before = table(spark, FOLDER, "documents")
    good = {r.doc_id for r in quality.classify(before, table(spark, FOLDER, "labels")).where("predicted = 1").collect()}
    texts = dict(texts_of(before))
    assert {r.doc_id for r in stages[0].collect()} == good
    last = {}
    for d in sorted(good):
        last[texts[d]] = d
    assert {r.doc_id for r in stages[1].collect()} == set(last.values())
    found = plain.near_components([(d, texts[d]) for d in last.values()])
    assert {r.doc_id for r in stages[2].collect()} == {c for _, c in found.values()}
    copies = Counter({r.doc_id: r.copies for r in mixing.mix(stages[2]).collect() if r.copies})
    assert Counter(r.doc_id for r in stages[3].collect()) == copies
    pieces = segmentation.load(segmentation.model_path())
    rows = stages[4].collect()
    assert Counter(r.doc_id for r in rows if r["rank"] == 1) == copies
    assert all(segmentation.decode(r.ids, pieces).decode() == texts[r.doc_id] for r in rows)
    for s in stages[:4]:
        assert s.columns == before.columns


def test_pipeline_run_equals_its_stages(spark, stages):
    def rows(df):
        return Counter((r.doc_id, r["rank"], tuple(r.ids)) for r in df.collect())

    assert rows(corpus_pipeline.run(spark, FOLDER)) == rows(stages[4])


def test_bootstrap_equals_plain_rounds(spark):
    """Random graphs of patterns and instances, repeated links included."""
    pick = random.Random(7)
    links = []
    for _ in range(400):
        value = pick.randrange(60)
        links.append((pick.choice(["ip", "phone"]), f"p{pick.randrange(12)}", f"v{value}", value < 25))
    links += [("ip", "alone _", "v99", False), ("ip", "sure _", "s1", True), ("ip", "sure _", "s2", True), ("ip", "sure _", "s3", True), ("ip", "sure _", "v98", False)]
    table_ = spark.createDataFrame(links, "kind string, pattern string, value string, seed boolean")
    expected = plain.bootstrap(links, personal_data.ROUNDS, personal_data.SUPPORT, personal_data.LIMIT)
    found = {(r.kind, r.value): r.score for r in personal_data.bootstrap(table_).collect()}
    assert found.keys() == expected.keys() and all(np.isclose(found[k], expected[k]) for k in expected)
    assert any(0 < s for s in expected.values()) and expected["ip", "v99"] == 0

"""Token counts and alignments against whole encodings."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import plain
import pyarrow as pa
import pytest
from conftest import texts_of

from shardscope.llm import token_alignment, token_counts

ODD = ["▁ odd ▁▁ \x00\n\n x  y ", "a" * 3000, "漢字仮名 mixed", " ", "\x00", "<s> </s><unk> <0x41> <|endoftext|>", "naïve œuvre ǅ ½² ĳ", " \u0085 tab\t\t", "😀👍🏽 é", "x" * 14, " " + "y" * 15, " " * 40]


@pytest.fixture(scope="module")
def odd_docs(spark):
    texts = plain.corpus() + ODD
    rows = plain.rows(texts) + [(3, "another text of three", None, None, 0, 0, 0.0, ""), (None, "no identifier", None, None, 0, 0, 0.0, ""), (None, None, None, None, 0, 0, 0.0, "")]
    return spark.createDataFrame(rows, plain.SCHEMA).repartition(3)


@pytest.mark.parametrize("size", [1, 7, 1 << 16])
def test_counts_are_the_librarys(odd_docs, size):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=token_counts.model_path())
    found = token_counts.token_counts(odd_docs, limit=50, size=size).collect()
    expected = Counter()
    for d, t in texts_of(odd_docs):
        n = len(model.encode(t or ""))
        expected[(d, len((t or "").encode()), n, n > 50)] += 1
    assert Counter(tuple(r) for r in found) == expected


def test_counts_of_nothing(none):
    found = token_counts.token_counts(none)
    assert found.count() == 0 and found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_pretokens_of_random_characters():
    encoder = token_counts.load(token_counts.model_path())
    pick = random.Random(4)
    kinds = "ab<>/s_0x41 \t\n\r,.;'()é漢ａ▁​😀"
    texts = ["".join(pick.choices(kinds, k=pick.randint(0, 60))) for _ in range(3000)]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    inner, starts, ends, bounds = encoder.pretokens(data, offsets)
    units = [inner[s:e].tobytes() for s, e in zip(starts, ends)]
    lengths = np.concatenate([[0], np.cumsum(encoder.lengths(units))])
    assert np.diff(lengths[bounds]).tolist() == [len(encoder.model.encode(t)) for t in texts]
    short = [u for u in units if len(u) <= token_counts.KEY_BYTES]
    sizes = np.array([len(u) for u in short])
    firsts = np.cumsum(sizes) - sizes
    assert token_counts.unpacked(*token_counts.packed(np.frombuffer(b"".join(short), np.uint8), firsts, sizes)) == short


def test_cache_stays_bounded(monkeypatch):
    encoder = token_counts.Encoder(token_counts.model_path())
    monkeypatch.setattr(token_counts, "CACHE_ENTRIES", 20)
    for k in range(12):
        units = [f" word{i}".encode() for i in range(k, k + 9)]
        assert encoder.lengths(units) == encoder.encode_lengths(units)
        assert len(encoder.cache) <= 20


def test_summary_keeps_what_is_frequent():
    pick, summary, truth = np.random.default_rng(3), token_counts.Summary(20), Counter()
    for _ in range(30):
        drawn = np.where(pick.random(400) < 0.4, pick.integers(0, 4, 400), pick.integers(4, 5000, 400)).astype(np.uint64)
        truth.update(drawn.tolist())
        summary.add(np.stack([drawn, drawn], axis=1), np.ones(400, np.int64))
        summary.trim()
    assert len(summary.counts) <= 20
    held = dict(zip(summary.keys[:, 0].tolist(), summary.counts.tolist()))
    for k, n in truth.items():
        assert held.get(k, 0) <= n
        assert n <= sum(truth.values()) / 21 or k in held


def align_plain(docs):
    """Rows by a walk over bytes: the group and the token of either side that hold each byte."""
    import sentencepiece
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(token_alignment.model_path(token_alignment.A_MODEL))
    own.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=token_alignment.model_path(token_alignment.B_MODEL))
    names, byte_of, links, out = {i: t for t, i in own.get_vocab().items()}, token_alignment.byte_characters(), Counter(), []
    rows = []
    for d, t in docs:
        whole = (" " + t).encode() if t else b""
        a = [(i, bytes(byte_of[c] for c in names[i])) for i in own.encode(" " + t, add_special_tokens=False).ids] if t else []
        b = []
        for i in model.encode(t or ""):
            p = model.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()))
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            a, b, whole = [], [], b""
        over_a, over_b = ([k for k, (_, x) in enumerate(side) for _ in x] for side in (a, b))
        own_links = [(a[i][0], b[j][0]) for i, j in sorted(set(zip(over_a, over_b)))]
        links.update(own_links)
        groups, first = [], 0
        for at in range(1, len(whole) + 1):
            if at == len(whole) or (over_a[at] != over_a[at - 1] and over_b[at] != over_b[at - 1]):
                ids = [dict.fromkeys(over[first:at]) for over in (over_a, over_b)]
                groups.append("|".join(",".join(str(side[k][0]) for k in keys) for side, keys in zip((a, b), ids)))
                first = at
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        rows.append((d, len(a), len(b), len(groups), own_links, digest))
    top = Counter()
    for (_, j), n in links.items():
        top[j] = max(top[j], n)
    for d, n_a, n_b, n_groups, own_links, digest in rows:
        best = sum(links[p] == top[p[1]] for p in own_links)
        out.append((d, n_a, n_b, n_groups, len(own_links), best, sum(links[p] for p in own_links), digest))
    return Counter(out)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("piece, share", [(1 << 14, 1 << 17), (5, 40), (64, 1)])
def test_alignment_equals_a_walk_over_bytes(odd_docs, piece, share):
    found = token_alignment.align(odd_docs, piece=piece, share=share)
    assert sorted(found.columns) == sorted(COLUMNS)
    assert Counter(tuple(r) for r in found.select(COLUMNS).collect()) == align_plain(texts_of(odd_docs))


def test_alignment_of_nothing(none):
    assert token_alignment.align(none).count() == 0


def test_pieces_are_of_equal_work():
    pick = np.random.default_rng(1)
    a, b = (np.unique(pick.integers(1, 5000, 1500)) for _ in range(2))
    a, b = np.append(a, 5000), np.append(b, 5000)
    text, i, j = token_alignment.merge_path(a, b, np.array([0, len(a)]), np.array([0, len(b)]), 100)
    sizes = np.diff(np.append(i + j, len(a) + len(b)))
    assert set(text.tolist()) == {0} and len(sizes) == -(-(len(a) + len(b)) // 100) and sizes[:-1].min() >= 99 and sizes.max() <= 101
    for k in range(1, len(i)):
        assert max(a[i[k] - 1], b[j[k] - 1]) < min(a[i[k]], b[j[k]])


def test_both_ways_to_a_agree():
    model = token_alignment.load(*(token_alignment.model_path(x) for x in (token_alignment.A_MODEL, token_alignment.A_RANKS, token_alignment.B_MODEL)))
    pick = random.Random(9)
    kinds = [chr(c) for c in range(0x240) if not 0xD800 <= c < 0xE000] + [" "] * 100 + list("'stremdl") * 5
    texts = ["".join(pick.choices(kinds, k=pick.randint(1, 80))) for _ in range(4000)]
    for text in texts:
        assert model.ranks.encode_ordinary(text) == model.own.encode(text, add_special_tokens=False).ids
    raw = pa.array(["ab", "漢", "x" * 600, "ok " * 900])
    from shardscope.llm.common import slices

    for _, data, offsets in slices(raw):
        assert model.usual(data, offsets).tolist() == [True, False, False, True]

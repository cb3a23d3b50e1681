"""Alignment of two tokenizers' tokens by merge paths, with links counted over the whole corpus.

The ends of a text's A tokens and of its B tokens are two sorted lists. Their merge is cut into pieces of equal work: the point where the merge crosses a
diagonal (so many ends taken from both together) is found by binary search, for all diagonals of a slice at once, without
merging anything. An end that both lists hold is never cut in two. A piece holds its own tokens, the bytes where they start and the next token of each
side, so that it can be merged alone, wherever it is: every end in it closes one overlap, whose two tokens are known inside the piece.
Ends of both sides close a group. Groups that begin in one piece and close in another are stitched by a pass over the pieces of
a text in order, which holds one piece and the open group at a time.

Links are counted by id pair: per task first, then by a shuffle of pairs. Pairs with at least 1 / ``SHARE`` of all links, at most ``SHARE`` by construction, are
sent to the tasks; all others meet their counts in an equi-join, once per piece and pair, where no pair can be hot.

Texts go to A through the ranks of its vocabulary where all characters are below U+0240 and no run of white space or of other characters is very long, else
through its own file; both give the same tokens there, the first four times faster.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardscope.llm.common import reach_workers, shared_folder, slices, table, written

A_MODEL, A_RANKS, B_MODEL = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: Ends of both sides in a piece.
PIECE = 1 << 14
#: A pair with 1 / SHARE of all links is sent to the tasks.
SHARE = 1 << 20
#: Tokens that an array step takes at once, and distinct pairs a task holds before it hands them on.
STEP, HELD = 1 << 20, 1 << 21
#: Texts with a longer run go to A through its own file.
LONG_RUN = 512


def model_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from U+0100 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and their ids as decimal text."""

    def __init__(self, a_path: str, ranks_path: str | None, b_path: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.own = Tokenizer.from_file(a_path)
        self.own.encode_special_tokens = True
        byte_of = byte_characters()
        vocabulary = self.own.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.ranks = None
        if ranks_path is not None:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            with open(a_path, encoding="utf-8") as file:
                special = {t["id"] for t in json.load(file).get("added_tokens", []) if t["special"]}
            if {b: r for r, b in enumerate(self.a_bytes) if r not in special} != ranks:
                raise ValueError("the ranks are not those of the vocabulary")
            self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = []
        for i in range(self.pieces.get_piece_size()):
            piece = self.pieces.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.size = max(len(self.a_bytes), len(self.b_bytes))
        self.id_type = "<u2" if self.size <= 1 << 16 else "<u4"
        self.decimal = np.array([f"{i}{mark}" for mark in ",|;" for i in range(self.size)], object)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[list[int]], list[list[int]]]:
        """A and B tokens of each text; none where they do not spell the text after a space."""
        raw = data.tobytes()
        bounds = offsets.tolist()
        parts = [raw[s:e] for s, e in zip(bounds, bounds[1:])]
        texts = [p.decode() for p in parts]
        usual = self.usual(data, offsets)
        a = [self._a(" " + t, u) if t else [] for t, u in zip(texts, usual.tolist())]
        b = self.pieces.encode(texts, num_threads=1)
        for k, part in enumerate(parts):
            spelled = b" " + part
            if b"".join(map(self.a_bytes.__getitem__, a[k])) != spelled or b"".join(map(self.b_bytes.__getitem__, b[k])) != spelled:
                a[k] = b[k] = []
        return a, b

    def _a(self, text: str, usual: bool) -> list[int]:
        if usual:
            return self.ranks.encode_ordinary(text)
        return self.own.encode(text, add_special_tokens=False).ids

    def usual(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether a text may go to A through its ranks."""
        out = np.full(len(offsets) - 1, self.ranks is not None)
        if len(data) == 0 or self.ranks is None:
            return out
        high = np.flatnonzero(data > 0xC8)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        turn = np.ones(len(data) + 1, bool)
        turn[1:-1] = space[1:] != space[:-1]
        turn[offsets] = True
        turns = np.flatnonzero(turn)
        long = turns[:-1][np.diff(turns) > LONG_RUN]
        out[np.searchsorted(offsets, np.concatenate([high, long]), "right") - 1] = False
        return out


@lru_cache(maxsize=2)
def load(a_path: str, ranks_path: str | None, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, ranks_path, b_path)


def merge_path(a: np.ndarray, b: np.ndarray, a_first: np.ndarray, b_first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first A end and first B end of each piece of ``size`` ends, texts in order; each text has a piece at least.

    ``a`` and ``b`` hold the ends of all texts, those of text t from ``a_first[t]`` to ``a_first[t + 1]``.
    """
    n_a, n_b = np.diff(a_first), np.diff(b_first)
    total = n_a + n_b
    pieces = np.maximum(-(-total // size), 1)
    text = np.repeat(np.arange(len(total)), pieces)
    diagonal = (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * size
    low, high = np.maximum(diagonal - n_b[text], 0), np.minimum(diagonal, n_a[text])
    open_ = np.flatnonzero(low < high)
    while len(open_):
        mid = (low[open_] + high[open_]) >> 1
        t = text[open_]
        # on equal ends A's is taken first
        before = a[a_first[t] + mid] <= b[b_first[t] + diagonal[open_] - 1 - mid]
        low[open_] = np.where(before, mid + 1, low[open_])
        high[open_] = np.where(before, high[open_], mid)
        open_ = open_[low[open_] < high[open_]]
    i, j = low, diagonal - low
    some = np.flatnonzero((i > 0) & (j < n_b[text]))
    t = text[some]
    j[some] += a[a_first[t] + i[some] - 1] == b[b_first[t] + j[some]]
    keep = (diagonal == 0) | (i + j < total[text])
    return text[keep], (a_first[text] + i)[keep], (b_first[text] + j)[keep]


PIECES = "row long, doc_id long, piece int, pieces int, a binary, b binary, a_from long, b_from long, a_next int, b_next int"


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    first = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    return np.concatenate([np.array(x, np.int64) for x in lists] or [np.zeros(0, np.int64)]), first


def _ends(ids: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """End byte of each token within its text."""
    upto = np.concatenate([[0], np.cumsum(sizes[ids])])
    return upto[1:] - np.repeat(upto[first[:-1]], np.diff(first))


def pieces_of(model: Tokenizers, rows: pa.Array, keys: pa.Array, data: np.ndarray, offsets: np.ndarray, size: int) -> pa.RecordBatch:
    """The pieces of a slice of texts, one row each."""
    (a, a_first), (b, b_first) = (_flat(x) for x in model.encode(data, offsets))
    a_ends, b_ends = _ends(a, a_first, model.a_sizes), _ends(b, b_first, model.b_sizes)
    text, i, j = merge_path(a_ends, b_ends, a_first, b_first, size)
    last = np.append(text[1:] != text[:-1], True) if len(text) else np.zeros(0, bool)
    number = np.arange(len(text)) - np.searchsorted(text, text)
    columns = [rows.take(pa.array(text)), keys.take(pa.array(text)), pa.array(number.astype(np.int32)), pa.array(np.bincount(text)[text].astype(np.int32))]
    sides, starts, follows = [], [], []
    for ids, ends, first, at in ((a, a_ends, a_first, i), (b, b_ends, b_first, j)):
        until = np.where(last, first[text + 1], np.append(at[1:], len(ids)))
        raw = ids.astype(model.id_type).tobytes()
        width = np.dtype(model.id_type).itemsize
        sides.append(pa.array([raw[width * s : width * e] for s, e in zip(at.tolist(), until.tolist())], pa.binary()))
        padded = np.append(ends, 0)
        starts.append(pa.array(np.where(at > first[text], padded[at - 1], 0)))
        follows.append(pa.array(np.where(last, -1, np.append(ids, -1)[until]).astype(np.int32)))
    return pa.RecordBatch.from_arrays([*columns, *sides, *starts, *follows], [x.split()[0] for x in PIECES.split(", ")])


class Merged:
    """Pieces, each merged alone: ids with the next one after each piece, ends, and where ends of both sides meet."""

    def __init__(self, model: Tokenizers, batch: pa.RecordBatch) -> None:
        self.model = model
        column = {n: batch.column(n) for n in batch.schema.names}
        self.n = batch.num_rows
        self.follow = [column[x].to_numpy() for x in ("a_next", "b_next")]
        self.ids, self.first, ends = [], [], []
        for side, start, sizes in (("a", "a_from", model.a_sizes), ("b", "b_from", model.b_sizes)):
            parts = [np.frombuffer(x, model.id_type) for x in column[side].to_pylist()]
            first = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            ids = np.concatenate(parts or [np.zeros(0, model.id_type)]).astype(np.int64)
            own = _ends(ids, first, sizes)
            ends.append(own + np.repeat(column[start].to_numpy(), np.diff(first)))
            self.ids.append(ids)
            self.first.append(first)
        self.piece = [np.repeat(np.arange(self.n), np.diff(f)) for f in self.first]
        # pieces are set apart so that ends rise through all of them
        least = np.minimum(column["a_from"].to_numpy(), column["b_from"].to_numpy())
        most = np.maximum(*(np.where(np.diff(f) > 0, np.append(e, 0)[f[1:] - 1], least) for e, f in zip(ends, self.first)))
        shift = np.cumsum(most - least + 1) - (most - least + 1) - least
        self.ends = [e + shift[p] for e, p in zip(ends, self.piece)]
        a_ends, b_ends = self.ends
        #: for each A end the number of B ends before it, and the other way round
        self.b_at, self.a_at = np.searchsorted(b_ends, a_ends), np.searchsorted(a_ends, b_ends)
        padded = np.append(b_ends, -1)
        self.meets = padded[np.minimum(self.b_at, len(b_ends))] == a_ends

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Piece and id pair of every overlap; each end closes one."""
        with_next = []
        for ids, first, follow in zip(self.ids, self.first, self.follow):
            wide = np.empty(len(ids) + self.n, np.int64)
            wide[np.arange(len(ids)) + np.repeat(np.arange(self.n), np.diff(first))] = ids
            wide[first[1:] + np.arange(self.n)] = follow
            with_next.append(wide)
        alone = np.ones(len(self.ids[1]), bool)
        alone[self.b_at[self.meets]] = False
        a = np.concatenate([self.ids[0], with_next[0][(self.a_at + self.piece[1])[alone]]])
        b = np.concatenate([with_next[1][self.b_at + self.piece[0]], self.ids[1][alone]])
        return np.concatenate([self.piece[0], self.piece[1][alone]]), a << 32 | b

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A tokens, B tokens and groups closed of each piece."""
        return np.diff(self.first[0]), np.diff(self.first[1]), np.bincount(self.piece[0][self.meets], minlength=self.n)

    def spelled(self) -> list[str]:
        """The groups of each piece as text. Every piece must end where a group does."""
        group_a = np.cumsum(self.meets) - self.meets
        last_b = self.b_at[self.meets]
        group_b = np.searchsorted(last_b, np.arange(len(self.ids[1])))
        last_a = np.flatnonzero(self.meets)
        at_a = np.arange(len(self.ids[0])) + np.concatenate([[0], last_b + 1])[group_a]
        at_b = np.arange(len(self.ids[1])) + (last_a + 1)[group_b]
        order = np.empty(len(at_a) + len(at_b), np.int64)
        order[at_a] = self.ids[0] + self.meets * self.model.size
        closes = np.zeros(len(self.ids[1]), bool)
        closes[last_b] = True
        order[at_b] = self.ids[1] + 2 * closes * self.model.size
        words = self.model.decimal[order].tolist()
        begins = (self.first[0] + self.first[1]).tolist()
        return ["".join(words[s:e])[:-1] for s, e in zip(begins, begins[1:])]


def _steps(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The batches' rows, about ``STEP`` tokens at a time."""
    for batch in batches:
        sizes = np.cumsum([len(a) + len(b) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())]) // width
        first = 0
        while first < batch.num_rows:
            until = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + STEP, "right")))
            yield batch.slice(first, until - first)
            first = until


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, kind = np.unique(codes, return_inverse=True)
    return distinct, np.bincount(kind, counts, len(distinct)).astype(np.int64)


RESULT = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long"


def align(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    a_path: str | None = None,
    ranks_path: str | None = None,
    b_path: str | None = None,
    piece: int = PIECE,
    share: int = SHARE,
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per row of ``docs``.

    Null and empty texts, and texts that the tokens of a side do not spell after a space (those with U+2581), have no tokens: zeros and an empty
    digest. Rows that repeat an identifier, and identifiers of null, keep a row each; equal texts count as often as they occur. An
    empty table gives no rows; other columns are not read. The result depends neither on ``piece`` nor on ``share``.
    """
    spark = docs.sparkSession
    reach_workers(spark)
    paths = (a_path or model_path(A_MODEL), model_path(A_RANKS) if a_path is None and ranks_path is None else ranks_path, b_path or model_path(B_MODEL))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(*paths)
        for batch in batches:
            for first, data, offsets in slices(batch.column(2)):
                n = len(offsets) - 1
                yield pieces_of(model, batch.column(0).slice(first, n), batch.column(1).slice(first, n), data, offsets, piece)

    plain = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    pieces = _compact(plain.mapInArrow(cut, PIECES), "pieces")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(*paths)
        held, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in _steps(batches, np.dtype(model.id_type).itemsize):
            new, n = np.unique(Merged(model, batch).links()[1], return_counts=True)
            held, counts = _summed(np.concatenate([held, new]), np.concatenate([counts, n]))
            if len(held) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts)], ["code", "n"])
                held, counts = held[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts)], ["code", "n"])

    links = pieces.select("a", "b", "a_from", "b_from", "a_next", "b_next").mapInArrow(count, "code long, n long")
    pairs = written(links.groupBy("code").agg(F.sum("n").alias("n")), "pairs")
    b_id = F.col("code").bitwiseAND(0xFFFFFFFF)
    # one row per B id: bounded by its vocabulary
    tops = pairs.groupBy(b_id.alias("b")).agg(F.max("n").alias("top"))
    judged = written(pairs.withColumn("b", b_id).join(F.broadcast(tops), "b").select("code", "n", (F.col("n") == F.col("top")).alias("best")), "judged")
    total = judged.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    often = F.col("n").cast("double") * share >= total
    sent = judged.where(often).toArrow().sort_by("code")
    known = spark.sparkContext.broadcast([sent.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("code", "n", "best")])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, (codes, n, best) = load(*paths), known.value
        for batch in _steps(batches, np.dtype(model.id_type).itemsize):
            merged = Merged(model, batch)
            at, code = merged.links()
            place = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
            hit = codes[place] == code if len(codes) else np.zeros(len(code), bool)
            n_best = np.bincount(at[hit], best[place[hit]], merged.n).astype(np.int64)
            sums = np.zeros(merged.n, np.int64)
            np.add.at(sums, at[hit], n[place[hit]])
            # what is left, once per piece and pair
            rest = np.flatnonzero(~hit)
            rest = rest[np.lexsort((code[rest], at[rest]))]
            new = np.ones(len(rest), bool)
            new[1:] = (at[rest][1:] != at[rest][:-1]) | (code[rest][1:] != code[rest][:-1])
            head = np.flatnonzero(new)
            pairs_left = pa.StructArray.from_arrays([pa.array(code[rest][head]), pa.array(np.diff(np.append(head, len(rest))))], ["code", "times"])
            cuts = np.searchsorted(at[rest][head], np.arange(merged.n + 1)).astype(np.int32)
            whole = batch.column("pieces").to_numpy() == 1
            n_a, n_b, groups = merged.counts()
            digests: list[str | None] = [None] * merged.n
            alone = np.flatnonzero(whole)
            for k, spelled in zip(alone.tolist(), (merged if whole.all() else Merged(model, batch.take(pa.array(alone)))).spelled()):
                digests[k] = hashlib.sha256(spelled.encode()).hexdigest() if spelled else ""
            numbers = [n_a, n_b, groups, np.bincount(at, minlength=merged.n), n_best, sums]
            columns = [batch.column("row"), batch.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in numbers), pa.array(digests, pa.string())]
            names = ["row", "doc_id", *(x.split()[0] for x in RESULT.split(", ")), "groups_sha256", "rare"]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(cuts), pairs_left)], names)

    schema = f"row long, doc_id long, {RESULT}, groups_sha256 string, rare array<struct<code: long, times: long>>"
    scored = written(pieces.drop("piece").mapInArrow(score, schema), "scored")
    rare = scored.select("row", F.inline("rare")).join(judged.where(~often), "code")
    added = rare.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    )
    several = pieces.where("pieces > 1").repartition("row").sortWithinPartitions("row", "piece")
    stitched = several.mapInArrow(_stitch(paths), "row long, groups_sha256 string")
    every = scored.drop("rare").unionByName(added, allowMissingColumns=True).unionByName(stitched, allowMissingColumns=True)
    names = [x.split()[0] for x in RESULT.split(", ")]
    found = every.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in names), F.max("groups_sha256").alias("groups_sha256"))
    return found.drop("row")


def _compact(df: DataFrame, name: str) -> DataFrame:
    """As ``written``, compressed harder: token numbers are the largest table here."""
    import uuid

    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _stitch(paths: tuple[str, str | None, str]):
    """A pass over the pieces of texts, in order: digests of their groups, with one piece and the open group held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(*paths)
        row, digest, open_ = None, hashlib.sha256(), None
        for batch in batches:
            done: list[tuple[int, str]] = []
            for k in range(batch.num_rows):
                part = batch.slice(k, 1).to_pylist()[0]
                if part["row"] != row:
                    if row is not None:
                        done.append((row, digest.hexdigest()))
                    row, digest, open_, begun = part["row"], hashlib.sha256(), None, False
                if open_ is not None:
                    part = part | {"a": open_["a"] + part["a"], "b": open_["b"] + part["b"], "a_from": open_["a_from"], "b_from": open_["b_from"]}
                merged = Merged(model, _one(part))
                closed = np.flatnonzero(merged.meets)
                if len(closed) == 0:
                    open_ = part
                    continue
                n_a, n_b = int(closed[-1]) + 1, int(merged.b_at[closed[-1]]) + 1
                width = np.dtype(model.id_type).itemsize
                whole = part | {"a": part["a"][: n_a * width], "b": part["b"][: n_b * width]}
                digest.update((";" if begun else "").encode() + Merged(model, _one(whole)).spelled()[0].encode())
                begun = True
                end = part["a_from"] + int(model.a_sizes[merged.ids[0][:n_a]].sum())
                open_ = part | {"a": part["a"][n_a * width :], "b": part["b"][n_b * width :], "a_from": end, "b_from": end}
            if done:
                yield _digests(done)
        if row is not None:
            yield _digests([(row, digest.hexdigest())])

    return run


def _one(part: dict) -> pa.RecordBatch:
    kinds = {"a": pa.binary(), "b": pa.binary(), "a_from": pa.int64(), "b_from": pa.int64(), "a_next": pa.int32(), "b_next": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array([part[n]], t) for n, t in kinds.items()], list(kinds))


def _digests(rows: list[tuple[int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int64()), pa.array([d for _, d in rows])], ["row", "groups_sha256"])


def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return align(table(spark, folder, "documents"))

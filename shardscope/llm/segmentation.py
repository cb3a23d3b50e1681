"""SentencePiece segmentations drawn without replacement by Gumbel top-k, and their decoding.

A text is cut into units (a run of spaces and what follows up to the next; line feeds alone) that no used piece crosses, so its lattice
is the chain of its units' lattices, over bytes. Pieces weigh by Zipf's law in their rank; bytes of characters without a piece are the byte pieces.
Backward sums give each edge its probability, for the distinct units of a slice of texts at once.

The search is A*: the whole lattice has a Gumbel value; its best path inherits it and is drawn edge by edge. What a step leaves aside (the
other edges of its node) is one region with its own probability, whose best value is a Gumbel truncated at the parent's. The next
distinct segmentation is in the region of the largest value: another edge of that node, then edges drawn to the end, with regions
of their own. No region is opened before it holds the next sample. The value of the best region left over is the threshold: a segmentation
of log probability f is among the sampled with probability 1 - exp(-exp(f - threshold)), its inclusion score.
All random numbers are hashes of seed, row key, sample, unit and step, so a row's samples do not depend on its neighbours.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardscope.llm.common import mix64, reach_workers, slices, table, word_hashes

MODEL = "piece_bpe_32k.model"
SAMPLES, SEED = 2, 20240601
SLICE = 2 << 20
#: Zipf offset: a piece of rank r weighs 1 / (r + ZIPF).
ZIPF = 10.0
#: Stands for the space inside the lattice; it occurs in no UTF-8 text.
SPACE = 0xFF
_BASE = np.uint64(0x9E3779B97F4A7C15)
SLOT_BITS = 20
LIFT, EARLY = 37.5, 128
#: Steps of all paths that are looked at together.
WIDEST = 1 << 20


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass(frozen=True)
class Pieces:
    """Pieces as byte strings, and the hashes of all their prefixes in a table of slots.

    ``ids`` and ``weights`` have an entry per prefix (-1 where it is no piece) and then one per byte.
    """

    texts: list[bytes]
    prefixes: np.ndarray
    ids: np.ndarray
    weights: np.ndarray
    longest: int
    slots: np.ndarray

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash among the prefixes, -1 where it is none."""
        slot = (h * _BASE) >> np.uint64(64 - SLOT_BITS)
        place = self.slots[slot]
        open_ = np.flatnonzero((place >= 0) & (self.prefixes[place] != h))
        while len(open_):
            slot[open_] = (slot[open_] + np.uint64(1)) & np.uint64((1 << SLOT_BITS) - 1)
            place[open_] = self.slots[slot[open_]]
            open_ = open_[(place[open_] >= 0) & (self.prefixes[place[open_]] != h[open_])]
        return place


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    texts, byte_ids, found = [b""] * n, np.full(256, -1, np.int64), {}
    normal = []
    for i in range(n):
        if model.is_byte(i):
            value = int(model.id_to_piece(i)[3:5], 16)
            byte_ids[value], texts[i] = i, bytes([value])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            raw = model.id_to_piece(i).replace("▁", " ").encode()
            texts[i] = raw
            inner = raw.replace(b" ", bytes([SPACE]))
            if inner.lstrip(bytes([SPACE])).count(SPACE) == 0 and b"\n" not in inner[1:] and (b"\n" not in inner or len(inner) == 1):
                normal.append((-model.get_score(i), inner, i))
    if (byte_ids < 0).any():
        raise ValueError("the model needs a piece for every byte")
    normal.sort()
    mass = sum(1 / (r + ZIPF) for r in range(len(normal) + 256))
    for rank, (_, inner, i) in enumerate(normal):
        h = 0
        for k, b in enumerate(inner):
            h = (h * int(_BASE) + b + 1) & 0xFFFFFFFFFFFFFFFF
            found.setdefault(h, (-1, 0.0))
            if k == len(inner) - 1:
                found[h] = (i, -float(np.log((rank + ZIPF) * mass)))
    prefixes = np.array(sorted(found), np.uint64)
    ids, weights = (np.array([found[int(h)][k] for h in prefixes]) for k in (0, 1))
    slots = np.full(1 << SLOT_BITS, -1, np.int32)
    for place, h in enumerate(prefixes.tolist()):
        slot = (h * int(_BASE) & 0xFFFFFFFFFFFFFFFF) >> (64 - SLOT_BITS)
        while slots[slot] >= 0:
            slot = (slot + 1) % len(slots)
        slots[slot] = place
    lowest = -float(np.log((len(normal) + ZIPF) * mass))
    ids, weights = np.concatenate([ids, byte_ids]).astype(np.int32), np.concatenate([weights, np.full(256, lowest)])
    return Pieces(texts, prefixes, ids, weights, max(len(x[1]) for x in normal), slots)


@dataclass
class Lattice:
    """Edges of the lattices of distinct units, ordered by their first byte.

    ``rest`` counts the bytes from a node to its unit's end, ``heads`` says where a node's edges begin, ``logs`` are their log probabilities at
    the node, ``aside`` those of taking another, ``upto`` the sums of probabilities up to each, 1 for a node's last.
    """

    rest: np.ndarray
    start: np.ndarray
    length: np.ndarray
    piece: np.ndarray
    logs: np.ndarray
    aside: np.ndarray
    upto: np.ndarray
    heads: np.ndarray


def lattice(data: np.ndarray, rest: np.ndarray, pieces: Pieces) -> Lattice:
    """``data``: the bytes of the units one after another."""
    n = len(data)
    lead = (data < 128) | (data >= 192)
    at, h = np.flatnonzero(lead).astype(np.int32), np.zeros(int(lead.sum()), np.uint64)
    found: list[tuple[np.ndarray, ...]] = []
    width = np.ones(n, np.int8)
    for low, size in ((192, 2), (224, 3), (240, 4)):
        width[(data >= low) & (data < 248)] = size
    whole = np.zeros(n, bool)
    with np.errstate(over="ignore"):
        for length in range(1, pieces.longest + 1):
            fits = rest[at] >= length
            at, h = at[fits], h[fits]
            if len(at) == 0:
                break
            h = h * _BASE + (data[at + length - 1] + np.uint64(1))
            place = pieces.find(h)
            known = place >= 0
            at, h, place = at[known], h[known], place[known]
            is_piece = pieces.ids[place] >= 0
            ends = at[is_piece]
            found.append((ends, np.full(len(ends), length, np.int16), place[is_piece]))
            whole[ends[width[ends] == length]] = True
    bare = np.flatnonzero(lead & ~whole).astype(np.int32)
    bare = np.concatenate([bare[width[bare] > k] + k for k in range(4)]) if len(bare) else bare
    found.append((bare, np.ones(len(bare), np.int16), len(pieces.prefixes) + data[bare].astype(np.int32)))
    start, length, place = (np.concatenate(x) for x in zip(*found))
    found.clear()
    order = np.argsort(start, kind="stable")
    start, length, place = start[order], length[order], place[order]
    piece, weight = pieces.ids[place], pieces.weights[place]
    del order, place
    heads = np.concatenate([[0], np.cumsum(np.bincount(start, minlength=n))])
    # backward sums, all nodes with the same number of bytes left at once
    beta = np.zeros(n + 1)
    left = rest[start]
    short = left.astype(np.int16) if len(left) and left.max() < 1 << 15 else left  # sorted by digits
    by_rest = np.argsort(short, kind="stable").astype(np.int32)
    left = left[by_rest]
    cuts = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1], [True]]))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        e = by_rest[lo:hi]
        node = start[e]
        value = weight[e] + np.where(length[e] == left[lo], 0.0, beta[node + length[e]])
        head = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        top = np.maximum.reduceat(value, head)
        raised = np.exp(value - np.repeat(top, np.diff(np.append(head, len(e)))))
        beta[node[head]] = top + np.log(np.add.reduceat(raised, head))
    logs = weight + np.where(length == rest[start], 0.0, beta[start + length]) - beta[start]
    sums = np.cumsum(np.exp(logs))
    first = heads[start]
    upto = sums - np.where(first > 0, sums[first - 1], 0.0)
    last = heads[start + 1] - 1
    upto = np.minimum(upto / upto[last], 1.0)
    upto[last] = 1.0
    with np.errstate(divide="ignore"):
        aside = np.where(logs < 0, np.log(-np.expm1(np.minimum(logs, 0))), -np.inf)
    return Lattice(rest, start, length, piece, logs, aside, upto, heads)


def _folded(*parts: np.ndarray | int, start: np.ndarray | None = None) -> np.ndarray:
    """One hash of ``parts``, numbers or arrays of one length, going on from the hash ``start``."""
    h = np.zeros(1, np.uint64) if start is None else start
    with np.errstate(over="ignore"):
        for p in parts:
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + np.asarray(p, np.uint64) + np.uint64(0x632BE59BD9B4E019))
    return h


def _uniform(*parts: np.ndarray | int) -> np.ndarray:
    """Numbers in (0, 1) from a hash of ``parts``."""
    return ((_folded(*parts) >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _walk(lat: Lattice, nodes: np.ndarray, chances: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Draw edges from each node to its unit's end: the edges, one unit after another, and where each unit's begin.

    ``chances`` are hashes of row key and sample, folded with the unit here.
    """
    active, now, drawn = np.arange(len(nodes)), nodes, []
    chance, step = _folded(units, start=chances), 0
    while len(active):
        edge = lat.heads[now]
        open_ = np.flatnonzero(lat.heads[now + 1] - edge > 1)
        aim = _uniform(chance[active[open_]] + np.uint64(step))
        while len(open_):
            on = lat.upto[edge[open_]] <= aim
            open_, aim = open_[on], aim[on]
            edge[open_] += 1
        drawn.append((active, edge))
        on = lat.length[edge] < lat.rest[now]
        active, now = active[on], now[on] + lat.length[edge[on]]
        step += 1
    counts = np.zeros(len(nodes), np.int64)
    for a, _ in drawn:
        counts[a] += 1
    begins = np.concatenate([[0], np.cumsum(counts)])
    edges = np.zeros(begins[-1], np.int64)
    for depth, (a, e) in enumerate(drawn):
        edges[begins[a] + depth] = e
    return edges, begins


def _truncated(location: np.ndarray, top: np.ndarray | float, uniform: np.ndarray) -> np.ndarray:
    """Gumbel values of ``location`` given that they are at most ``top``; -inf where the location is."""
    with np.errstate(divide="ignore", over="ignore"):
        return np.minimum(location - np.logaddexp(location - top, np.log(-np.log(uniform))), top)


@dataclass
class Path:
    """A drawn segmentation: its edges, the unit of each, and the regions that its steps leave aside from ``fresh`` on."""

    edges: np.ndarray
    units: np.ndarray
    value: float
    regions: np.ndarray
    fresh: int
    tried: dict[int, list[int]]

    def log_prob(self, lat: Lattice) -> float:
        return float(lat.logs[self.edges].sum())


def _regions(lat: Lattice, edges: np.ndarray, begins: np.ndarray, before: np.ndarray, value: np.ndarray, chance: np.ndarray, most: int) -> list[np.ndarray]:
    """Per path, the values of the regions that its steps leave aside; -inf, or past the end, where one cannot be among its ``most`` largest.

    Path p has ``edges[begins[p] : begins[p + 1]]``. A uniform number of 53 bits lifts a location by less than ``LIFT``, and no location lies above what the steps before it
    leave, so late steps need no number, and no look at all once that is too low. All paths go on together, each along its own row.
    """
    lengths = np.diff(begins)
    parts: list[list[np.ndarray]] = [[np.zeros(0)] for _ in lengths]
    prefix, floor = np.array(before, float), np.full(len(lengths), -np.inf)
    open_, first, width = np.flatnonzero(lengths), 0, EARLY
    while len(open_):
        left = []
        for on in np.array_split(open_, -(-len(open_) * width // WIDEST)):
            size = np.minimum(width, lengths[on] - first)
            inside = np.arange(width) < size[:, None]
            edge = edges[np.where(inside, (begins[on] + first)[:, None] + np.arange(width), 0)]
            upto = np.cumsum(np.where(inside, lat.logs[edge], 0.0), axis=1)
            location = lat.aside[edge] + prefix[on, None]
            location[:, 1:] += upto[:, :-1]
            row, step = np.nonzero(inside & (location + LIFT >= floor[on, None]))
            found = np.full(location.shape, -np.inf)
            found[row, step] = _truncated(location[row, step], value[on][row], _uniform((first + step).astype(np.uint64) + chance[on][row]))
            if first == 0 and most <= EARLY:
                floor[on] = np.partition(found, EARLY - most, axis=1)[:, EARLY - most]
            for k, p in enumerate(on.tolist()):
                parts[p].append(found[k, : size[k]].copy())
            prefix[on] += upto[:, -1]
            left.append(on[(lengths[on] > first + width) & (prefix[on] + LIFT >= floor[on])])
        open_, first, width = np.concatenate(left), first + width, min(width * 8, 1 << 13)
    return [np.concatenate(p) for p in parts]


def segment(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, pieces: Pieces, samples: int = SAMPLES) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """Per text up to ``samples`` distinct segmentations: piece numbers, log probability, perturbed value, inclusion score; best first.

    A text with fewer segmentations gets all it has; an empty text has one, without pieces.
    """
    n = len(offsets) - 1
    # a space goes before every text that is not empty, as the pieces expect
    some = np.diff(offsets) > 0
    shift = np.cumsum(some)
    inner = np.full(len(data) + int(some.sum()), SPACE, np.uint8)
    bounds = offsets + np.concatenate([[0], shift])
    own = np.ones(len(inner), bool)
    own[bounds[:-1][some]] = False
    inner[own] = np.where(data == 32, np.uint8(SPACE), data)
    cut = np.zeros(len(inner) + 1, bool)
    cut[bounds] = True
    space, feed = inner == SPACE, inner == 10
    cut[:-1] |= feed
    cut[1:] |= feed
    cut[1:-1] |= space[1:] & ~space[:-1]
    starts = np.flatnonzero(cut[:-1])
    ends = np.append(starts[1:], len(inner)) if len(starts) else starts
    first_unit = np.searchsorted(starts, bounds)
    lat, at = None, np.zeros(0, np.int64)
    if len(starts):
        _, example, kind = np.unique(word_hashes(inner, starts, ends), return_index=True, return_inverse=True)
        sizes = ends[example] - starts[example]
        begins = np.concatenate([[0], np.cumsum(sizes)])
        take = np.repeat(starts[example] - begins[:-1], sizes) + np.arange(begins[-1])
        rest = (np.repeat(begins[1:], sizes) - np.arange(begins[-1])).astype(np.int32)
        lat, at = lattice(inner[take], rest, pieces), begins[kind]
    seeds = mix64(keys.astype(np.int64).view(np.uint64) + np.uint64(SEED))
    roots = -np.log(-np.log(_uniform(seeds, 0, 1 << 41)))
    counts = np.diff(first_unit)
    within = np.arange(len(starts)) - np.repeat(first_unit[:-1], counts)
    edges, begins = _walk(lat, at, np.repeat(_folded(seeds, 0), counts), within) if lat else (at, np.zeros(1, np.int64))
    unit_of = np.repeat(within, np.diff(begins))
    chances_of = _folded(seeds, 0, 1 << 40)
    paths: list[list[Path]] = []
    cuts = begins[first_unit]
    regions = _regions(lat, edges, cuts, np.zeros(n), roots, chances_of, samples + 1) if lat else [np.zeros(0)] * n
    for t, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
        paths.append([Path(edges[lo:hi], unit_of[lo:hi], float(roots[t]), regions[t], 0, {})])
    for sample in range(1, samples):
        turns, nodes, node_units, node_keys, sizes = [], [], [], [], []
        begun = _folded(seeds, sample)
        chances_of, picks, rests = _folded(1 << 40, start=begun), _uniform(seeds, sample, 1 << 42), _uniform(seeds, sample, 1 << 43)
        for t in range(n):
            best = _best(paths[t]) if len(paths[t]) == sample else None
            if best is None:
                continue
            path, step = best
            value = float(path.regions[step - path.fresh])
            tried = path.tried.setdefault(step, [int(path.edges[step])])
            node = int(lat.start[path.edges[step]])
            options = np.arange(lat.heads[node], lat.heads[node + 1])
            chances = np.exp(lat.logs[options])
            chances[[e - options[0] for e in tried]] = 0.0
            pick = np.searchsorted(np.cumsum(chances), picks[t] * chances.sum(), "right")
            edge = int(options[min(pick, int(np.flatnonzero(chances)[-1]))])
            tried.append(edge)
            # what the node still leaves aside
            prefix = float(lat.logs[path.edges[:step]].sum())
            left = chances.sum() - chances[edge - options[0]]
            aside = prefix + np.log(left) if left > 0 and len(tried) < len(options) else -np.inf
            path.regions[step - path.fresh] = _truncated(np.array([aside]), value, rests[t : t + 1])[0]
            unit = int(path.units[step])
            rest_of = [node + int(lat.length[edge])] if lat.length[edge] < lat.rest[node] else []
            later = at[first_unit[t] + unit + 1 : first_unit[t + 1]]
            nodes += [np.array(rest_of, np.int64), later]
            numbers = np.concatenate([np.full(len(rest_of), unit), np.arange(unit + 1, unit + 1 + len(later))])
            node_units.append(numbers)
            node_keys.append(np.full(len(numbers), begun[t]))
            sizes.append(len(numbers))
            turns.append((t, path, step, edge, value, prefix))
        if not turns:
            break
        units = np.concatenate(node_units)
        edges, begins = _walk(lat, np.concatenate(nodes), np.concatenate(node_keys), units)
        edge_units = np.repeat(units, np.diff(begins))
        begins = begins[np.concatenate([[0], np.cumsum(sizes)])]
        before = np.array([prefix + float(lat.logs[edge]) for _, _, _, edge, _, prefix in turns])
        values, own_chances = np.array([turn[4] for turn in turns]), chances_of[[turn[0] for turn in turns]]
        regions = _regions(lat, edges, begins, before, values, own_chances, samples + 1)
        for k, ((t, path, step, edge, value, _), lo, hi) in enumerate(zip(turns, begins[:-1], begins[1:])):
            all_edges = np.concatenate([path.edges[:step], [edge], edges[lo:hi]])
            all_units = np.concatenate([path.units[: step + 1], edge_units[lo:hi]])
            paths[t].append(Path(all_edges, all_units, value, regions[k], step + 1, {}))
    out = []
    for own in paths:
        best = _best(own)
        limit = float(best[0].regions[best[1] - best[0].fresh]) if best else -np.inf
        rows = []
        for p in own:
            f = p.log_prob(lat) if lat else 0.0
            inclusion = 1.0 if limit == -np.inf else float(-np.expm1(-np.exp(min(f - limit, 700.0))))
            rows.append((lat.piece[p.edges] if lat else p.edges, f, p.value, inclusion))
        out.append(rows)
    return out


def _best(paths: list[Path]) -> tuple[Path, int] | None:
    """The path and step of the region with the largest value."""
    found, top = None, -np.inf
    for p in paths:
        if len(p.regions):
            k = int(p.regions.argmax())
            if p.regions[k] > top:
                found, top = (p, p.fresh + k), p.regions[k]
    return found


def decode(ids: list[int], pieces: Pieces) -> bytes:
    """The text of a segmentation: its pieces joined, without the space put before the text."""
    joined = b"".join([pieces.texts[i] for i in ids])
    return joined[1:] if joined else joined


SCHEMA = "doc_id long, rank int, n_pieces int, log_prob double, perturbed double, inclusion double"


def sampled(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES, model: str | None = None, digest: bool = False, step: int = SLICE) -> DataFrame:
    """doc_id, rank (from 1), ids, n_pieces, log_prob, perturbed, inclusion: the sampled segmentations of every row.

    Null counts as empty; an empty text has one segmentation without pieces. Rows that repeat an identifier draw from the same random numbers, so equal
    texts get equal samples. A null identifier draws as -1. An empty table gives no rows; other columns are not read. With ``digest``, ids_sha256 (of the numbers
    as little-endian integers of 4 bytes) and same (whether decoding gives the text back) take the place of ids. Texts are cut in slices of about ``step`` bytes, which
    share a lattice: smaller ones take less memory and more time.
    """
    reach_workers(docs.sparkSession)
    path = model or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for batch in batches:
            keys = batch.column(0).fill_null(-1).to_numpy()
            for first, data, offsets in slices(batch.column(1), step):
                n = len(offsets) - 1
                found = segment(data, offsets, keys[first : first + n], pieces, samples)
                owner = [k for k, rows in enumerate(found) for _ in rows]
                flat = [x for rows in found for x in rows]
                ids = [x[0] for x in flat]
                columns = [
                    batch.column(0).take(pa.array(np.array(owner, np.int64) + first)),
                    pa.array([r + 1 for rows in found for r in range(len(rows))], pa.int32()),
                    pa.array([len(x) for x in ids], pa.int32()),
                    *(pa.array([x[c] for x in flat], pa.float64()) for c in (1, 2, 3)),
                ]
                names = ["doc_id", "rank", "n_pieces", "log_prob", "perturbed", "inclusion"]
                if digest:
                    lists = [x.tolist() for x in ids]
                    columns.append(pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids]))
                    columns.append(pa.array([decode(x, pieces) == data[offsets[k] : offsets[k + 1]].tobytes() for k, x in zip(owner, lists)], pa.bool_()))
                    names += ["ids_sha256", "same"]
                else:
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return plain.mapInArrow(run, SCHEMA + (", ids_sha256 string, same boolean" if digest else ", ids array<int>"))


def op6_gumbel_segmentations(spark: SparkSession, folder: str) -> DataFrame:
    return sampled(table(spark, folder, "documents"), digest=True)

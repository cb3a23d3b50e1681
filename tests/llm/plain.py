"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import math
import random
import re

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def corpus(seed=1, n=60, kinds=40, longest=120):
    """Texts over few words, with copies, near copies, shared passages and odd cases."""
    pick = random.Random(seed)
    names = [f"w{i}" for i in range(kinds)] + ["été", "ß", "漢字", "A,B"]
    texts = [" ".join(pick.choices(names, k=pick.randint(1, longest))) for _ in range(n)]
    passage = " ".join(f"p{i}" for i in range(30))
    for i in range(0, n, 5):
        texts[i] = f"{' '.join(pick.choices(names, k=12))} {passage} {texts[i]}"
    for i in range(3, n, 7):
        own = texts[i - 1].split()
        if len(own) > 3:
            own[pick.randrange(len(own))] = "edit"
        texts[i] = " ".join(own)
    for i in range(4, n, 9):
        texts[i] = texts[i - 2]
    texts += ["", None, "  \n\t ", "x", "x", "only four words here", "Only FOUR words here", "a\nb  c\td", " ".join(["loop"] * 70)]
    return texts


def rows(texts, first=0):
    """Rows of documents with columns whose names operators use themselves."""
    return [(first + i, t, "en" if i % 3 else None, None if i % 11 == 0 else f"src{i % 4}", len(t or ""), i, float(i), "t") for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, score double, token string"


def shingles(text, width=5):
    w = words(lower(text))
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def near_components(docs):
    sets = {d: shingles(t) for d, t in docs}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return {d: (len(sets[d]), c) for d, c in components(ids, links).items()}


def without_repeats(docs, window=20):
    seen, out = set(), {}
    for d, t in sorted(docs):
        w = words(t)
        gone = set()
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone |= set(range(s, s + window))
            seen.add(key)
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


class Ppm:
    """Prediction by partial matching with dictionaries: counts of every symbol after every context of up to ``order`` symbols."""

    def __init__(self, texts, order):
        self.order, self.after = order, {}
        for text in texts:
            for context, symbol in self.steps(text):
                for d in range(order + 1):
                    seen = self.after.setdefault(context[len(context) - d :], {})
                    seen[symbol] = seen.get(symbol, 0) + 1

    def steps(self, text):
        """Each symbol (bytes from 1, the end 257) with the symbols before it; a text starts after ``order`` zeros."""
        symbols = [b + 1 for b in lower(text).encode()] + [257]
        whole = [0] * self.order + symbols
        return [(tuple(whole[i : i + self.order]), s) for i, s in enumerate(symbols)]

    def probability(self, context, symbol):
        p, excluded = 1.0, set()
        for d in range(self.order, -1, -1):
            seen = self.after.get(context[len(context) - d :], {})
            if not seen:
                continue
            left = {s: n for s, n in seen.items() if s not in excluded}
            if symbol in left:
                return p * (left[symbol] - 0.5) / sum(left.values())
            if left:
                p *= 0.5 * len(left) / sum(left.values())
            excluded = set(seen)
        return p / (257 - len(excluded))

    def score(self, text):
        return math.fsum(math.log10(self.probability(c, s)) for c, s in self.steps(text))


def statistics(text):
    """The thirteen document statistics, one by one."""
    raw = (text or "").encode()
    length = len(raw) + 120
    words_of = [w for w in re.split(rb"[\x20\x09-\x0d]+", raw) if w]
    low = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words_of]
    pairs = list(zip(low, low[1:]))
    lines = [bytes(max(b, 33) for b in x) for x in raw.split(b"\n") if x]
    many = len(low) + 20
    mean = (sum(map(len, low)) + 100) / many
    spread = math.sqrt(max((sum(len(w) ** 2 for w in low) + 20 * 34) / many - mean * mean, 0))
    capitals = [sum(65 <= b <= 90 for b in w) for w in words_of]
    kinds = [
        sum(65 <= b <= 90 for b in raw), raw.count(b"!"), raw.count(b"|"), sum(b in b"#$%&*+<=>@\\^_`{}~/[]\"()'-" for b in raw),
        sum(b >= 128 for b in raw), raw.count(b"\n"),
    ]
    shares = [k / length for k in kinds]
    shares += [sum(a == b for a, b in pairs) / many, (len(low) - len(set(low))) / many, (len(pairs) - len(set(pairs))) / many, (len(lines) - len(set(lines))) / (len(lines) + 2)]
    shouted = sum(c >= max(2, len(w) / 2) for c, w in zip(capitals, words_of)) / many
    return [math.log(x + 0.01) for x in shares] + [math.log1p(mean), math.log1p(spread), math.log(shouted + 0.01)]


def quadratic_scores(rows, learned, labels, pooled, identity):
    """Probability of label 1 under two Gaussians with shrunk covariances, by inverses and determinants."""
    import numpy as np

    rows, learned, labels = np.array(rows), np.array(learned), np.array(labels)
    spreads = [np.cov(learned[labels == k].T, bias=True) for k in (0, 1)]
    common = sum((labels == k).sum() * spreads[k] for k in (0, 1)) / len(labels)
    logs = []
    for k in (0, 1):
        own, width = learned[labels == k], rows.shape[1]
        shrunk = (1 - pooled - identity) * spreads[k] + pooled * common + identity * max(np.trace(spreads[k]) / width, 1e-6) * np.eye(width)
        away = rows - own.mean(axis=0)
        distance = np.einsum("ij,jk,ik->i", away, np.linalg.inv(shrunk), away)
        logs.append(math.log(len(own) / len(labels)) - 0.5 * (distance + np.linalg.slogdet(shrunk)[1]))
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def bootstrap(links, rounds, support, limit):
    """Scores of instances that are no seeds; ``links`` are (kind, pattern, value, seed)."""
    seeds = {(k, v) for k, _, v, seed in links if seed}
    graph = {(k, p, v) for k, p, v, _ in links}
    trust = {(k, v): float((k, v) in seeds) for k, _, v, _ in links}
    for _ in range(rounds):
        weights = {}
        for k, p in {(k, p) for k, p, _ in graph}:
            scores = [trust[k, v] for a, b, v in graph if (a, b) == (k, p)]
            if sum(s >= limit for s in scores) >= support:
                weights[k, p] = sum(scores) / (len(scores) + 0.5)
        new = {}
        for k, v in trust:
            doubt = math.prod(1 - weights[a, p] for a, p, b in graph if (a, b) == (k, v) and (a, p) in weights)
            new[k, v] = 1.0 if (k, v) in seeds else 1 - doubt
        trust = new
    return {x: s for x, s in trust.items() if x not in seeds}

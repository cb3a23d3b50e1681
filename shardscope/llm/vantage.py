"""Nearest neighbours by vantage-point trees, one per shard.

Rows are dealt into shards of bounded size by a hash of their identifier. Each shard's tree is built in one task, written as a row of
bytes, and searched by blocks of queries, which follow it in the rows of its shard. A subtree is left out when ``factor`` times the triangle
bound exceeds the distance of the k-th neighbour so far: factor one is exact search, a larger one leaves out more. The best of each shard meet
in a window per query, whose limit Spark applies before the shuffle. Work is queries x shards, as the contract asks for; no side is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardscope.llm.common import reach_workers, table, written

SHARD_ROWS = 4096
LEAF_ROWS = 256
BLOCK_QUERIES = 128
FACTOR = 1.0
K = 10


class Tree:
    """A vantage-point tree in flat arrays.

    Node i splits rows ``lo[i]:hi[i]`` of the permuted matrix: the vantage point stands first, ``mid[i]`` parts the near from the far half, and
    the bounds hold the least and largest distance of each half from the vantage point. A leaf has ``mid`` 0.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, nodes: np.ndarray, bounds: np.ndarray, children: np.ndarray):
        self.ids, self.rows, self.nodes, self.bounds, self.children = ids, rows, nodes, bounds, children

    @classmethod
    def build(cls, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF_ROWS) -> Tree:
        order = np.argsort(ids, kind="stable")
        ids, rows = ids[order].copy(), rows[order].copy()
        nodes, bounds, children, stack = [], [], [], [(0, len(ids), -1, 0)]
        while stack:
            lo, hi, parent, side = stack.pop()
            here = len(nodes)
            if parent >= 0:
                children[parent][side] = here
            nodes.append([lo, hi, 0])
            bounds.append([0.0] * 4)
            children.append([-1, -1])
            if hi - lo <= leaf:
                continue
            far = lo + int(_distances(rows[lo:hi], rows[lo]).argmax())  # a point at the rim parts better than one in the middle
            for x in (ids, rows):
                x[[lo, far]] = x[[far, lo]]
            away = _distances(rows[lo + 1 : hi], rows[lo])
            order = np.argsort(away, kind="stable")
            ids[lo + 1 : hi], rows[lo + 1 : hi], away = ids[lo + 1 : hi][order], rows[lo + 1 : hi][order], away[order]
            half = len(away) // 2
            nodes[here][2] = lo + 1 + half
            bounds[here] = [away[0], away[half - 1], away[half], away[-1]]
            stack += [(lo + 1 + half, hi, here, 1), (lo + 1, lo + 1 + half, here, 0)]
        return cls(ids, rows, np.array(nodes, np.int64).reshape(-1, 3), np.array(bounds).reshape(-1, 4), np.array(children, np.int64).reshape(-1, 2))

    def search(self, query: np.ndarray, own: int, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers and distances of the k nearest, nearest first, ties to the smaller identifier; ``own`` is left out."""
        ids, away, worst = np.zeros(0, np.int64), np.zeros(0), math.inf
        stack = [(0.0, 0)]
        while stack:
            least, node = stack.pop()
            if least > worst:
                continue
            lo, hi, mid = self.nodes[node]
            found = slice(lo, lo + 1 if mid else hi)
            distances = _distances(self.rows[found], query)
            new = self.ids[found] != own
            if mid == 0 or distances[0] <= worst:
                ids, away = np.concatenate([ids, self.ids[found][new]]), np.concatenate([away, distances[new]])
                if len(ids) > k:
                    best = np.lexsort((ids, away))[:k]
                    ids, away = ids[best], away[best]
                if len(ids) >= k:
                    worst = away.max()
            if mid:
                d = distances[0]
                sides = []
                for side in (0, 1):
                    low, high = self.bounds[node, 2 * side : 2 * side + 2]
                    gap = max(low - d, d - high, 0.0)
                    sides.append((factor * (gap - 1e-9 * (d + high)), self.children[node, side]))
                stack += sorted(sides, key=lambda s: -s[0])
        best = np.lexsort((ids, away))[:k]
        return ids[best], away[best]

    def search_all(self, asked: list[dict], k: int, factor: float) -> Iterator[tuple[int, int, float]]:
        for q in asked:
            ids, away = self.search(np.array(q["v"]), q["query_id"], k, factor)
            yield from zip([q["query_id"]] * len(ids), ids.tolist(), away.tolist())

    def to_row(self) -> dict[str, bytes]:
        return {n: getattr(self, n).tobytes() for n in ("ids", "rows", "nodes", "bounds", "children")}

    @classmethod
    def from_row(cls, row: dict[str, bytes]) -> Tree:
        ids = np.frombuffer(row["ids"], np.int64)
        kinds = {"rows": (np.float64, len(ids)), "nodes": (np.int64, -1), "bounds": (np.float64, -1), "children": (np.int64, -1)}
        width = {"rows": -1, "nodes": 3, "bounds": 4, "children": 2}
        return cls(ids, *(np.frombuffer(row[n], t).reshape(m, width[n]) for n, (t, m) in kinds.items()))


def _distances(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    # summed one component after another, as a plain loop does, so that equal vectors and other engines give equal figures
    return np.sqrt(np.cumsum((rows - point) ** 2, axis=1)[:, -1])


TREE = "_shard int, width int, ids binary, rows binary, nodes binary, bounds binary, children binary"


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and v (doubles) of the vectors that take part: not null, not zero, without null or non-finite components."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(fine)


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR, shard_rows: int = SHARD_ROWS,
    key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance): the k nearest of each query among all rows but its own.

    Vectors of another length than the query are no candidates. Equal distances go to the smaller identifier; rows that repeat an
    identifier are candidates each. Empty tables give no rows.
    """
    reach_workers(vectors.sparkSession)
    base = usable(vectors, key, vector)
    shards = max(1, math.ceil(base.count() / shard_rows))
    dealt = base.select("vec_id", "v", F.size("v").alias("width"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("_shard"))

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        tree = Tree.build(part["vec_id"].to_numpy(np.int64), np.stack(part["v"].to_numpy()).astype(np.float64))
        return pd.DataFrame([{"_shard": part["_shard"].iat[0], "width": part["width"].iat[0], **tree.to_row()}])

    trees = written(dealt.groupBy("_shard", "width").applyInPandas(grow, TREE), "trees")
    asked = usable(queries, key, vector).select(F.col("vec_id").alias("query_id"), "v", F.size("v").alias("width"))
    blocks = max(1, math.ceil(asked.count() / BLOCK_QUERIES))
    asked = asked.withColumn("_block", F.pmod(F.xxhash64("query_id", F.lit(7)), F.lit(blocks)).cast("int"))
    packed = asked.groupBy("_block", "width").agg(F.collect_list(F.struct("query_id", "v")).alias("asked"))
    # every block of queries goes to every shard, whose tree comes first; a join might broadcast the blocks of all shards, which Spark underrates
    packed = packed.withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    rows = trees.withColumn("_block", F.lit(-1)).unionByName(packed, allowMissingColumns=True)
    rows = rows.repartition("_shard", "width").sortWithinPartitions("_shard", "width", "_block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, tree = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["_block"] < 0:
                    place, tree = (row["_shard"], row["width"]), Tree.from_row(row)
                # a shard without vectors of a width has no tree for it
                elif place == (row["_shard"], row["width"]):
                    columns = [list(x) for x in zip(*tree.search_all(row["asked"], k, factor))] or [[], [], []]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())],
                        ["query_id", "vec_id", "score"],
                    )

    found = rows.mapInArrow(search, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM p
) WHERE rank <= 10
"""


def op5_vantage_point_trees(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))

"""Largest inner products through vantage-point trees, one for each shard.

Rows are dealt into shards of bounded size, queries into blocks; each shard and block is one group.
Inner products become distances by one more coordinate: with M the largest length of all rows, a row
x gets sqrt(M^2 - |x|^2) and a query gets 0, so that nearer means a larger product. A node splits its
rows at the median distance to a vantage point and keeps the range of distances of both halves. A
half is skipped when ``factor`` times the lower bound that the triangle inequality gives is not below
the distance of the k-th best row so far: factor 1 is exact search, a larger one prunes more.

All vectors are divided by one power of two, which is exact, so that no square overflows in the trees; scores
are those of the original vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drivetrace.llm.vectors import dot_in_order, matrix, one_row_each, usable

#: Rows of a leaf, and what rounding may take from a distance or a product relative to the lengths.
LEAF, SLACK = 128, 1e-9
#: Stands for no row.
NONE = np.iinfo(np.int64).max


class Tree:
    """Nested nodes over rows of an augmented matrix: leaves hold row numbers, others two halves."""

    def __init__(self, points: np.ndarray, seed: int = 7):
        self.points = points
        self.squares = (points * points).sum(1)
        self.random = np.random.default_rng(seed)
        self.root = self._node(np.arange(len(points)))

    def distances(self, rows: np.ndarray, point: np.ndarray) -> np.ndarray:
        squares = self.squares[rows] + point @ point - 2 * (self.points[rows] @ point)
        return np.sqrt(np.maximum(squares, 0))

    def _node(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        vantage = int(self.random.choice(rows))
        far = self.distances(rows, self.points[vantage])
        order = np.argsort(far, kind="stable")
        half = len(rows) // 2
        near, rest = order[:half], order[half:]
        ranges = (far[near].min(), far[near].max()), (far[rest].min(), far[rest].max())
        return vantage, ranges, (self._node(rows[near]), self._node(rows[rest]))


class Search:
    """The k best rows of one tree for each query of a block.

    ``rows`` and ``queries`` are the original vectors; ``power`` is that of two which the tree's were divided by.
    """

    def __init__(self, tree: Tree, ids, rows, query_ids, queries, k: int, factor: float, length: float, power: int = 0):
        self.tree, self.ids, self.query_ids = tree, ids, query_ids
        self.original_rows, self.original_queries = rows, queries
        self.rows, self.queries = np.ldexp(rows, -power), np.ldexp(queries, -power)
        self.k, self.factor, self.length = k, factor, length
        self.lengths = np.sqrt((self.queries * self.queries).sum(1))
        self.slack = SLACK * (1 + length * self.lengths)
        # Scores of the best rows, and their products as the tree has them.
        self.best = np.full((len(queries), k), -np.inf)
        self.rough = np.full((len(queries), k), -np.inf)
        self.best_ids = np.full((len(queries), k), NONE)
        self.visited = 0

    def run(self) -> None:
        if len(self.queries) and len(self.rows):
            self._visit(self.tree.root, np.arange(len(self.queries)))

    def _worst(self, q: np.ndarray) -> np.ndarray:
        """Distance of the k-th best so far."""
        squares = self.length**2 + self.lengths[q] ** 2 - 2 * self.rough[q, -1]
        return np.sqrt(np.maximum(squares, 0))

    def _visit(self, node, q: np.ndarray) -> None:
        if isinstance(node, np.ndarray):
            self._leaf(node, q)
            return
        vantage, ranges, halves = node
        point = self.tree.points[vantage]
        squares = self.length**2 + self.lengths[q] ** 2 - 2 * (self.queries[q] @ point[:-1])
        far = np.sqrt(np.maximum(squares, 0))
        bounds = np.array([np.maximum(0, np.maximum(far - high, low - far)) for low, high in ranges])
        inner = bounds[0] <= bounds[1]
        for first in (0, 1):
            group = np.flatnonzero(inner if first == 0 else ~inner)
            for half in (first, 1 - first):
                worst = self._worst(q[group])
                slack = np.sqrt(self.slack[q[group]])
                open_ = group[self.factor * bounds[half][group] < worst + slack]
                if len(open_):
                    self._visit(halves[half], q[open_])

    def _leaf(self, rows: np.ndarray, q: np.ndarray) -> None:
        for top in range(0, len(q), 2048):
            part = q[top : top + 2048]
            self.visited += len(part) * len(rows)
            rough = self.queries[part] @ self.rows[rows].T
            better = rough >= (self.rough[part, -1] - self.slack[part])[:, None]
            better &= self.ids[rows][None, :] != self.query_ids[part][:, None]
            some = np.flatnonzero(better.any(axis=1))
            if not len(some):
                continue
            i, j = np.nonzero(better[some])
            scores = np.full((len(some), len(rows)), -np.inf)
            with np.errstate(over="ignore", invalid="ignore"):
                scores[i, j] = dot_in_order(self.original_queries[part[some[i]]], self.original_rows[rows[j]])
            ids = np.where(better[some], self.ids[rows][None, :], NONE)
            scores = np.concatenate([self.best[part[some]], scores], axis=1)
            ids = np.concatenate([self.best_ids[part[some]], ids], axis=1)
            products = np.concatenate([self.rough[part[some]], np.where(better[some], rough[some], -np.inf)], axis=1)
            order = np.lexsort((ids, -scores), axis=1)[:, : self.k]
            self.best[part[some]] = np.take_along_axis(scores, order, 1)
            self.best_ids[part[some]] = np.take_along_axis(ids, order, 1)
            # The k-th product in the tree's numbers: of rows that score alike the least.
            self.rough[part[some]] = np.minimum.accumulate(np.take_along_axis(products, order, 1), axis=1)

    def found(self) -> pd.DataFrame:
        q, j = np.nonzero(self.best_ids != NONE)
        return pd.DataFrame({"query_id": self.query_ids[q], "vec_id": self.best_ids[q, j], "score": self.best[q, j]})


def nearest(
    vectors: DataFrame,
    every: int = 20,
    k: int = 20,
    factor: float = 1.0,
    shard_rows: int = 8192,
    block_rows: int = 4096,
) -> DataFrame:
    """The ``k`` rows of largest inner product for each query: query_id, rank, vec_id, score.

    Queries are the rows whose vec_id ``every`` divides; candidates are all rows of equal length but
    those of the query's own vec_id. Ties go to the smaller vec_id; fewer than ``k`` candidates are all
    returned. The score adds the products of the original components in double precision, one after
    another. Vectors that are null, empty, zero or hold null or non-finite components, and rows without
    vec_id, take no part; of rows with one vec_id the smallest embedding stands for all. Vectors of any
    finite length do; a product beyond double range is infinite. Other columns are ignored.
    """
    valid = one_row_each(vectors.select("vec_id", "embedding").where(usable(F.col("embedding"))), "embedding")
    valid = valid.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    most = F.array_max(F.transform("embedding", lambda x: F.abs(x)))
    long_ = most * F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + (x / most) * (x / most)))
    asked = F.col("vec_id") % every == 0
    n, n_asked, longest, size = valid.agg(F.count("*"), F.count_if(asked), F.max(long_), F.max(F.size("embedding"))).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n_asked // block_rows))
    # A length beyond double range leaves components below 1 after division by 2 ** 1024.
    length, power = np.frexp(longest or 0.0) if np.isfinite(longest or 0.0) else (np.sqrt(size), 1024)
    length, power = float(length) * (1 + 1e-12), int(power)
    dealt = valid.withColumn("length", F.size("embedding")).withColumn("_h", F.xxhash64("vec_id"))
    rows = dealt.withColumn("shard", F.pmod("_h", F.lit(shards)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    queries = dealt.where(asked).withColumn("block", F.pmod("_h", F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    )

    def search(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        rows, queries = rows.sort_values("vec_id"), queries.sort_values("vec_id")
        original = matrix(rows.embedding)
        points = np.ldexp(original, -power)
        room = np.sqrt(np.maximum(0, length**2 - (points * points).sum(1)))
        tree = Tree(np.concatenate([points, room[:, None]], axis=1))
        at = Search(
            tree, rows.vec_id.to_numpy(np.int64), original,
            queries.vec_id.to_numpy(np.int64), matrix(queries.embedding), k, factor, length, power,
        )
        at.run()
        return at.found()

    keys = ["length", "shard", "block"]
    keep = [*keys, "vec_id", "embedding"]
    found = (
        rows.select(*keep).groupBy(*keys).cogroup(queries.select(*keep).groupBy(*keys))
        .applyInPandas(search, "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

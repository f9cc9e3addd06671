"""Nearest neighbours by inner product: a vantage-point tree in every shard.

Vectors are lifted by one component, sqrt(M^2 - |x|^2) with M the largest norm,
so that the order by Euclidean distance to a query (lifted by 0) is the order
by inner product; distances obey the triangle inequality, which prunes. A
node keeps, for each child, the range of distances from its vantage point to
the child's vectors. A child is skipped for a query if the query's ball of
radius ``factor`` times its 20th distance so far misses that range: factor one
is exact search, a smaller one skips more.

Shards are dealt by a hash of the id and their number follows the row count
alone, so that a tree is bounded in size. Queries visit every shard in blocks of
bounded size (a stated query set against all rows): rows of a shard and block
stream through a task, points first, from which the tree is built once, then
queries, of which it holds ``block_rows``. The nearest are merged by query.

Matrix products only say which pairs may be near: within the bound of their
rounding every such pair is scored again in doubles, one product for each
component in order, and ranks and ties go by these scores alone. All this is done
on vectors times a power of two that brings the longest to a length of 1 to 2, which changes no
digit of a score; the scores returned are those of the vectors as they came, so
they may be infinite or zero where the order between them is still known.

Defined cases: vectors that are null, empty, zero, of another length than most
or hold a null, NaN or infinity take no part; so do null ids. Equal scores are
ordered by smaller id; rows that repeat an id stay candidates of their own, but
a query is asked once and never meets its own id. With fewer candidates than
``k`` all are returned. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAF = 128


class VantageTree:
    """Built over rows of ``points``; nodes are rows of flat arrays."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.nodes = points, []
        self.order = np.arange(len(points))
        if len(points):
            self._split(0, len(points), leaf)

    def _split(self, start: int, end: int, leaf: int) -> int:
        """Nodes are (start, end, vantage, left, left range, right, right range); leaves have no vantage."""
        me = len(self.nodes)
        self.nodes.append(None)
        if end - start <= leaf:
            self.nodes[me] = (start, end, -1, -1, None, -1, None)
            return me
        rows = self.order[start:end]
        mean = self.points[rows].mean(0)
        vantage = rows[int(np.argmax(((self.points[rows] - mean) ** 2).sum(1)))]
        far = np.sqrt(np.maximum(((self.points[rows] - self.points[vantage]) ** 2).sum(1), 0))
        by = np.argsort(far, kind="stable")
        self.order[start:end], far = rows[by], far[by]
        half = (end - start) // 2
        left = self._split(start, start + half, leaf)
        right = self._split(start + half, end, leaf)
        self.nodes[me] = (start, end, int(vantage), left, (far[0], far[half - 1]), right, (far[half], far[-1]))
        return me

    def search(self, queries: np.ndarray, visit, radius: np.ndarray, factor: float, slack: np.ndarray) -> None:
        """Call ``visit(active queries, rows)`` for every leaf that may hold a near row; ``radius`` shrinks meanwhile.

        ``slack`` is what rounding may add to a distance.
        """
        if not self.nodes:
            return
        # Each query first goes straight to one leaf, which gives it a radius.
        self._walk(0, np.arange(len(queries)), queries, visit, radius, factor, slack, greedy=True)
        self._walk(0, np.arange(len(queries)), queries, visit, radius, factor, slack, greedy=False)

    def _walk(self, node: int, active: np.ndarray, queries: np.ndarray, visit, radius: np.ndarray, factor: float, slack: np.ndarray, greedy: bool) -> None:
        start, end, vantage, left, near, right, far = self.nodes[node]
        if not len(active):
            return
        if vantage < 0:
            visit(active, self.order[start:end], node, greedy)
            return
        d = np.sqrt(np.maximum(((queries[active] - self.points[vantage]) ** 2).sum(1), 0))
        if greedy:
            inside = d <= (near[1] + far[0]) / 2
            self._walk(left, active[inside], queries, visit, radius, factor, slack, greedy)
            self._walk(right, active[~inside], queries, visit, radius, factor, slack, greedy)
            return
        for child, (low, high) in ((left, near), (right, far)):
            reach = factor * radius[active] + slack[active]
            self._walk(child, active[(d - reach <= high) & (d + reach >= low)], queries, visit, radius, factor, slack, greedy)


class Shard:
    """A tree over the points of a shard, for any number of query blocks.

    The tree sees vectors times 2 ** -``exponent``, none longer than ``limit``.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, limit: float, exponent: int = 0):
        self.ids, self.vectors, self.limit, self.exponent = ids, vectors, limit, exponent
        scaled = np.ldexp(vectors, -exponent)
        self.tree = VantageTree(np.hstack([scaled, np.sqrt(np.maximum(limit**2 - (scaled**2).sum(1), 0))[:, None]]))

    def nearest(self, query_ids: np.ndarray, asked: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, ...]:
        """For each query the ``k`` best points, as (query position, id, score, scaled score)."""
        ids, vectors, queries = self.ids, self.tree.points[:, :-1], np.ldexp(asked, -self.exponent)
        n, width = queries.shape
        base = (queries**2).sum(1) + self.limit**2
        # What rounding may change of a product, of a squared distance and of a distance.
        unsure = 4 * width * np.finfo(float).eps
        margin = unsure * np.sqrt((queries**2).sum(1)) * self.limit
        best_score = np.full((n, k), -np.inf)
        best_row = np.full((n, k), -1)
        radius = np.full(n, np.inf)
        seen = np.full(n, -1)

        def visit(active: np.ndarray, rows: np.ndarray, node: int, greedy: bool) -> None:
            if greedy:
                seen[active] = node
            else:
                active = active[seen[active] != node]
            if not len(active):
                return
            may = (queries[active] @ vectors[rows].T >= best_score[active, -1:] - margin[active, None]) & (query_ids[active][:, None] != ids[rows][None, :])
            hit = may.any(1)
            active, may = active[hit], may[hit]
            if not len(active):
                return
            score = np.full(may.shape, -np.inf)
            q, at = np.nonzero(may)
            score[q, at] = products(queries[active[q]], vectors[rows[at]])
            all_score = np.hstack([best_score[active], score])
            all_row = np.hstack([best_row[active], np.broadcast_to(rows, score.shape)])
            all_row[np.isneginf(all_score)] = -1
            tie = np.where(all_row >= 0, ids[all_row], np.iinfo(np.int64).max)
            first = np.lexsort((tie, -all_score), axis=1)[:, :k]
            best_score[active] = np.take_along_axis(all_score, first, 1)
            best_row[active] = np.take_along_axis(all_row, first, 1)
            last = best_score[active, -1]
            radius[active] = np.where(np.isneginf(last), np.inf, np.sqrt(np.maximum(base[active] - 2 * last, 0) + unsure * base[active]))

        self.tree.search(np.hstack([queries, np.zeros((n, 1))]), visit, radius, factor, 1e-12 * np.sqrt(base))
        q, at = np.nonzero(best_row >= 0)
        with np.errstate(over="ignore", invalid="ignore"):
            return q, ids[best_row[q, at]], products(asked[q], self.vectors[best_row[q, at]]), best_score[q, at]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows; equal rows give equal results wherever they stand."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def valid_vectors(embeddings: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Rows (vec_id, v as doubles) that take part, all of the most frequent length."""
    v = F.col(column).cast("array<double>")
    rows = embeddings.select(F.col(id_column).cast("bigint").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & (F.size("v") > 0))
    ok = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.filter(ok)


def search(embeddings: DataFrame, is_query, k: int = 20, factor: float = 1.0, shard_rows: int = 131_072, least_shards: int = 8, block_queries: int = 262_144, block_rows: int = 2048) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest of each query row.

    ``is_query`` is a condition on ``vec_id``.
    """
    spark = embeddings.sparkSession
    rows = valid_vectors(embeddings)
    size = F.array_max(F.transform("v", F.abs))
    squares = F.aggregate(F.transform("v", lambda x: x / size), F.lit(0.0), lambda a, x: a + x * x)
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.log2(size) + F.log2(squares) / 2).alias("norm"), F.count_if(is_query).alias("asked")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    width, total, exponent = lengths[0]["d"], lengths[0]["n"], math.floor(lengths[0]["norm"])
    limit = 2.0 ** (lengths[0]["norm"] - exponent) * (1 + 1e-9)
    rows = rows.filter(F.size("v") == width)
    n_shards = max(math.ceil(total / shard_rows), min(math.ceil(total / 2048), least_shards))
    n_blocks = max(1, math.ceil(lengths[0]["asked"] / block_queries))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Rows that repeat an id go to shards of their own.
    shard = F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_shards)).cast("int")
    block = F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(n_blocks)).cast("int")
    points = rows.select(shard.alias("shard"), every(n_blocks).alias("block"), F.lit(False).alias("asked"), "vec_id", "v")
    # An id is asked once, by its least vector.
    once = rows.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = once.select(every(n_shards).alias("shard"), block.alias("block"), F.lit(True).alias("asked"), "vec_id", "v")
    order = ["shard", "block", "asked", "vec_id"]
    streamed = points.unionAll(asked).repartition("shard", "block").sortWithinPartitions(*order).select(*order, "v")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, tree = None, [], None
        waiting: list = []

        def answer() -> pa.RecordBatch:
            names, vectors = (np.concatenate(x) for x in zip(*waiting, strict=True))
            waiting.clear()
            q, near, score, order = tree.nearest(names, vectors, k, factor)
            return pa.RecordBatch.from_arrays([pa.array(names[q]), pa.array(near), pa.array(score), pa.array(order)], names=["query_id", "vec_id", "score", "scaled"])

        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)], axis=1)
            ids = batch.column(3).to_numpy(zero_copy_only=False)
            vectors = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            cuts = np.flatnonzero((np.diff(marks, axis=0) != 0).any(1)) + 1
            for a, b in zip(np.append(0, cuts), np.append(cuts, len(ids)), strict=True):
                if a == b:
                    continue
                if (marks[a, 0], marks[a, 1]) != place:
                    if waiting:
                        yield answer()
                    place, held, tree = (marks[a, 0], marks[a, 1]), [], None
                if not marks[a, 2]:
                    held.append((ids[a:b].copy(), vectors[a:b].copy()))
                elif held or tree is not None:
                    if tree is None:
                        tree = Shard(*(np.concatenate(x) for x in zip(*held, strict=True)), limit, exponent)
                        held = []
                    for at in range(a, b, block_rows):
                        end = min(at + block_rows, b)
                        waiting.append((ids[at:end].copy(), vectors[at:end].copy()))
                        if sum(len(w[0]) for w in waiting) >= block_rows:
                            yield answer()
        if waiting:
            yield answer()

    found = streamed.mapInArrow(work, "query_id bigint, vec_id bigint, score double, scaled double")
    best = Window.partitionBy("query_id").orderBy(F.desc("scaled"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

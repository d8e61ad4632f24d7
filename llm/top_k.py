"""Exact top-k search by inner product: ball trees with branch and bound.

The candidates are dealt into shards; each shard is one row with a ball tree:
vectors in leaf order, and per node a centre and a radius. Queries come in
blocks that meet every shard. For a query q, no vector in a ball scores more
than q.c + |q| r; nodes are taken in the order of this bound until it falls
below the k-th score so far. The first shard is searched first, and the k-th
scores found there are shared with the search of all the others.

Components become floor(scale * x), so scores are whole numbers. Sums are exact:
in floating point while they stay below 2^53, else in 64-bit integers.

Nulls and odd rows: vectors that are null or hold null or non-finite components
and rows without an id take no part; rows with equal id all count, as queries
(the k best of all of them together) and as candidates of every other id, equal
rows as often as they stand there; shorter vectors, empty ones included, count as
filled up with zeros; ties go to the smaller id; fewer than k candidates give all of them; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import stage

SCALE = 1024
LEAF = 64
SHARD_VECTORS = 8192
BLOCK_QUERIES = 2048
_EXACT = 2.0**52


def whole_vectors(rows: DataFrame, k: int, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id and v (array of long) of the rows that take part; of equal rows the first k, as no more can be among k best."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    scaled = F.transform(vector, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long"))
    usable = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).where(~bad)
    distinct = usable.select(F.col(key).cast("long").alias("vec_id"), scaled.alias("v")).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("n"))
    return distinct.select("vec_id", "v", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))).alias("copy")).drop("copy")


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    lists = vectors.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int64()))
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), sizes.max(initial=0)), dtype=np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


class BallTree:
    """Nodes in an array; leaves hold ranges of the vectors, which are in leaf order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        points = vectors.astype(np.float64)
        order = np.arange(len(ids))
        self.spans: list[tuple[int, int]] = []
        self.children: list[tuple[int, int]] = []
        centres, radii = [], []

        def build(low: int, high: int) -> int:
            node = len(self.spans)
            at = order[low:high]
            centre = points[at].mean(axis=0)
            distance = np.sqrt(((points[at] - centre) ** 2).sum(axis=1))
            self.spans.append((low, high))
            self.children.append((-1, -1))
            centres.append(centre)
            radii.append(distance.max())
            if high - low > LEAF and radii[node] > 0:
                # Split between the point farthest from the centre and the one farthest from that.
                one = points[at[distance.argmax()]]
                other = points[at[((points[at] - one) ** 2).sum(axis=1).argmax()]]
                order[low:high] = at[np.argsort(points[at] @ (other - one), kind="stable")]
                middle = (low + high) // 2
                self.children[node] = (build(low, middle), build(middle, high))
            return node

        build(0, len(ids))
        self.ids, self.vectors = ids[order], vectors[order]
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.largest = float(np.abs(vectors).max(initial=0))
        self.points = self.vectors.astype(np.float64)

    def search(self, query_id: int, query: np.ndarray, bounds: np.ndarray, k: int, least: int | None) -> list[tuple[int, int]]:
        """(score, vec_id) of the best; ``least`` is a score that k candidates reach already."""
        width = self.vectors.shape[1]
        exact = float(np.abs(query).max(initial=0)) * self.largest * max(1, width) < _EXACT
        best: list[tuple[int, int]] = []  # (score, -vec_id), the worst in front
        queue = [(-bounds[0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            floor = best[0][0] if len(best) == k else None
            floor = max(x for x in (floor, least) if x is not None) if floor is not None or least is not None else None
            if floor is not None and -bound < floor:
                break
            left, right = self.children[node]
            if left >= 0:
                heapq.heappush(queue, (-bounds[left], left))
                heapq.heappush(queue, (-bounds[right], right))
                continue
            low, high = self.spans[node]
            if exact:
                scores = (self.points[low:high] @ query.astype(np.float64)).astype(np.int64)
            else:
                scores = (self.vectors[low:high] * query).sum(axis=1)
            worth = np.flatnonzero((scores >= floor) & (self.ids[low:high] != query_id)) if floor is not None else np.flatnonzero(self.ids[low:high] != query_id)
            for i in worth.tolist():
                entry = (int(scores[i]), -int(self.ids[low + i]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return [(score, -negative) for score, negative in best]


_TREE = "shard int, ids binary, vectors binary, width int"


def trees(candidates: DataFrame, shards: int) -> DataFrame:
    """One row per shard: ids and vectors in leaf order. Building the nodes again from these takes milliseconds."""

    def run(table: pa.Table) -> pa.Table:
        ids, vectors = table.column("vec_id").to_numpy(), _matrix(table.column("v"))
        tree = BallTree(ids, vectors)
        return pa.table({
            "shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "ids": pa.array([tree.ids.tobytes()], pa.binary()),
            "vectors": pa.array([tree.vectors.tobytes()], pa.binary()), "width": pa.array([vectors.shape[1]], pa.int32()),
        })

    shard = F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int")
    return candidates.select("vec_id", "v", shard.alias("shard")).groupBy("shard").applyInArrow(run, _TREE)


_FOUND = "query_id long, vec_id long, score long"


def _search(queries: DataFrame, forest: DataFrame, blocks: int, first: int, last: int, k: int) -> DataFrame:
    """Best candidates of every query in each shard from first to last; queries have (query_id, block, v, least)."""

    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if held.num_rows and asked.num_rows:
            width = held.column("width")[0].as_py()
            ids = np.frombuffer(held.column("ids")[0].as_py(), dtype=np.int64)
            vectors = np.frombuffer(held.column("vectors")[0].as_py(), dtype=np.int64).reshape(len(ids), width)
            tree = BallTree(ids, vectors)
            queries_ = _matrix(asked.column("v"))
            fit = np.zeros((len(queries_), width), dtype=np.int64)
            fit[:, : min(width, queries_.shape[1])] = queries_[:, :width]
            points = fit.astype(np.float64)
            reach = points @ tree.centres.T + np.sqrt((points**2).sum(axis=1))[:, None] * tree.radii[None, :]
            # Rounding must not hide a candidate.
            reach += 1e-9 * np.abs(reach) + 1.0
            least = asked.column("least").to_pylist()
            for i, query_id in enumerate(asked.column("query_id").to_pylist()):
                found += [(query_id, v, s) for s, v in tree.search(query_id, fit[i], reach[i], k, least[i])]
        columns = list(zip(*found)) if found else ([], [], [])
        return pa.table([pa.array(list(c), pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    chosen = forest.where(F.col("shard").between(first, last))
    spread = chosen.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = queries.withColumn("shard", F.explode(F.sequence(F.lit(first), F.lit(last))))
    return spread.groupBy("shard", "block").cogroup(met.groupBy("shard", "block")).applyInArrow(run, _FOUND)


def search(rows: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """Per query (ids divisible by ``every``): query_id, rank, vec_id, score of the k best other rows."""
    vectors = stage(whole_vectors(rows, k), "vectors")
    total = vectors.count()
    shards = max(1, -(-total // SHARD_VECTORS))
    forest = stage(trees(vectors, shards), "ball-trees")
    asked = vectors.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    queries = asked.select(
        F.col("vec_id").alias("query_id"), "v", F.pmod(F.xxhash64("vec_id", "v", F.lit(1)), F.lit(blocks)).cast("int").alias("block")
    )
    first = stage(_search(queries.withColumn("least", F.lit(None).cast("long")), forest, blocks, 0, 0, k), "first-shard")
    # A k-th score is a bound only where the first shard gave k candidates.
    least = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    found = first
    if shards > 1:
        bounded = queries.join(least, "query_id", "left")
        found = found.unionByName(_search(bounded, forest, blocks, 1, shards - 1, k))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = f"""
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({float(SCALE)} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(COALESCE(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM usable AS q JOIN usable AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT query_id, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

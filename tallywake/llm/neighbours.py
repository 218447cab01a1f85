"""Nearest neighbours by a permutation index: pivots in order of nearness, inverted files, footrule, rerank."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywake.llm.storage import reach_workers

#: Pivots, a bounded sample of the rows, and how many of its nearest ones represent a vector.
PIVOTS, PREFIX = 256, 64
#: Rows of an index block and queries of a query block: rows are copied, and indexed again, once for so many queries.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 16_384
#: Share of a block's distinct vectors, and the least number of them, that are reranked.
CANDIDATE_SHARE, CANDIDATES_LEAST = 0.15, 512


@dataclass
class Pivots:
    """Sampled vectors, and the largest length of all vectors.

    Each vector gets one component more that brings it to that length (a query
    gets zero), so the largest inner product is the smallest distance.
    """

    points: np.ndarray
    longest: float

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate((x, np.sqrt(np.maximum(self.longest**2 - (x**2).sum(1), 0))[:, None]), 1)

    def order(self, x: np.ndarray, prefix: int) -> np.ndarray:
        """The ``prefix`` nearest pivots of each (lifted) vector, nearest first."""
        lengths = (self.points**2).sum(1)
        return np.argsort(lengths - 2 * (x @ self.points.T), axis=1, kind="stable")[:, :prefix]


class PermutationIndex:
    """One block: posting lists of (vector, place of the pivot in its order), one list per pivot."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: Pivots, prefix: int) -> None:
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
        _, first, inverse = np.unique(vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel(), return_index=True, return_inverse=True)
        self.pivots, self.prefix = pivots, prefix
        self.vectors = vectors[first]
        # Equal vectors share an entry; its ids lie together, in ascending order.
        self.ids = ids[np.argsort(inverse, kind="stable")]
        self.bounds = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.bincount(inverse, minlength=len(first)))))
        orders = pivots.order(pivots.lifted(self.vectors), prefix)
        n, k = orders.shape
        entry = np.repeat(np.arange(n, dtype=np.int32), k)
        weight = np.tile((prefix - np.arange(k)).astype(np.int32), n)
        by_pivot = np.argsort(orders.ravel(), kind="stable")
        starts = np.searchsorted(orders.ravel()[by_pivot], np.arange(len(pivots.points) + 1))
        self.lists = [(entry[by_pivot[a:b]], weight[by_pivot[a:b]]) for a, b in zip(starts[:-1], starts[1:])]

    def agreement(self, order: np.ndarray) -> np.ndarray:
        """How far the footrule distance to ``order`` lies below its largest value, halved.

        With a missing pivot at place ``prefix``, a pivot in both orders lowers the
        distance by twice ``prefix`` less the later of its places; no other counts.
        """
        total = np.zeros(len(self.vectors), np.int32)
        for place, pivot in enumerate(order):
            entries, weights = self.lists[pivot]
            total[entries] += np.minimum(weights, self.prefix - place)
        return total

    def search(self, query_id: int, query: np.ndarray, order: np.ndarray, k: int, candidates: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and inner products of the ``k`` nearest found, by score, then id; the query's own id is left out."""
        near = self.agreement(order)
        if candidates < len(near):
            least = np.partition(near, len(near) - candidates)[len(near) - candidates]
            chosen = np.flatnonzero(near > least)
            chosen = np.concatenate((chosen, np.flatnonzero(near == least)[: candidates - len(chosen)]))
        else:
            chosen = np.arange(len(near))
        scores = (self.vectors[chosen] * query).sum(1)
        if len(chosen) > k + 1:
            floor = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
            chosen, scores = chosen[scores >= floor], scores[scores >= floor]
        ids, each = [], []
        for entry, score in zip(chosen, scores):
            own = self.ids[self.bounds[entry] : self.bounds[entry + 1]]
            own = own[own != query_id][:k]
            ids.append(own)
            each.append(np.full(len(own), score))
        ids, each = np.concatenate([np.zeros(0, np.int64), *ids]), np.concatenate([np.zeros(0), *each])
        best = np.lexsort((ids, -each))[:k]
        return ids[best], each[best]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array<double>) of rows that take part.

    Left out: a null id, a null or empty vector, one of zeros, and one that holds
    a null or a number that is not finite.
    """
    v = F.col("embedding")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(sound, F.lit(False)))


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, share: float = CANDIDATE_SHARE, least: int = CANDIDATES_LEAST) -> DataFrame:
    """The ``k`` nearest rows by inner product of each row whose vec_id is divisible by ``every``.

    Rows lie in blocks of about BLOCK_ROWS, queries in blocks of about
    BLOCK_QUERIES; each pair of blocks is one small task that indexes its rows,
    takes from the inverted files the ``share`` of distinct vectors with the
    smallest footrule distance (at least ``least``), reranks them on the original
    vectors in double precision and returns its ``k`` best.

    Returns query_id, rank (from 1), vec_id and score. Ties go to the smaller
    vec_id, equal vectors included. A query meets every row but those of its own
    id; a repeated row counts as often as it stands among the answers and once as
    a query. Vectors that are null, zero or not finite, and those of another
    dimension than the first pivot's, take no part; with fewer than two rows
    there is no result. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    reach_workers(spark)
    rows = usable(vectors)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(4 * PIVOTS).collect()  # bounded: 4 * PIVOTS vectors
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = len(sample[0].embedding)
    rows = rows.where(F.size("embedding") == dim)
    sizes = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))).first()
    n_blocks, q_blocks = -(-sizes[0] // BLOCK_ROWS), max(1, -(-sizes[1] // BLOCK_QUERIES))
    points = np.array(list(dict.fromkeys(tuple(r.embedding) for r in sample if len(r.embedding) == dim)))[:PIVOTS]
    pivots = Pivots(points, float(np.sqrt(sizes[2])))
    pivots.points = pivots.lifted(points)
    prefix = min(PREFIX, len(points))

    placed = rows.select("*", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_blocks)).alias("block"))
    left = placed.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    queries = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    right = queries.select("*", F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).cast("int").alias("q_block")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])

    def matrix(t: pa.Table) -> np.ndarray:
        return t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)

    def search(block: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if block.num_rows and asked.num_rows:
            index = PermutationIndex(block.column("vec_id").to_numpy(), matrix(block), pivots, prefix)
            take = max(least, int(np.ceil(share * len(index.vectors))))
            q = matrix(asked)
            orders = pivots.order(np.concatenate((q, np.zeros((len(q), 1))), 1), prefix)
            for i, query_id in enumerate(asked.column("vec_id").to_pylist()):
                ids, scores = index.search(query_id, q[i], orders[i], k, take)
                found.append((np.full(len(ids), query_id), ids, scores))
        columns = zip(*found) if found else ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)])
        return pa.table([pa.array(np.concatenate(c)) for c in columns], names=schema.names)

    keys = ["block", "q_block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

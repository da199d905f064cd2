"""Nearest neighbours by collision counting over sorted projections, with windows that grow around each query.

Vectors are projected onto random lines; each line keeps its vectors sorted. Around a query's own projection a window
is opened on every line and widened by a factor per round (virtual rehashing: no new index per width). A vector seen in
the windows of enough lines is verified by its distance on the original components.

The index is a set of blocks of bounded size, each of all lines of its own vectors. Queries go to all blocks, a bounded
number at a time; each block returns its best, and those are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sieveline.sources.shared import written

LINES, ENOUGH = 64, 0.6  # lines, and the share of them whose windows must hold a vector
FIRST, WIDEN = 0.4, 1.25  # half of the first window, in standard deviations of the line, and the factor per round
VERIFIED = 0.2  # a block's search may end when this share of its vectors has been verified
BLOCK, CHUNK = 4096, 1024  # vectors of a block and queries of a chunk


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not NULL, no NULL or non-finite component, and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Block:
    """The sorted lines of some vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lines: int = LINES, seed: int = 5):
        self.ids, self.vectors = ids, vectors
        self.directions = np.random.default_rng(seed).normal(size=(vectors.shape[1], lines))
        places = vectors @ self.directions
        self.order = places.argsort(axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(places.T, self.order, axis=1)
        self.spread = max(float(places.std(axis=0).mean()), 1e-12)

    def search(self, own_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest found, but the query's own row (its id and vector); ties by id."""
        lines, count = len(self.order), len(self.ids)
        centre = query @ self.directions
        low = np.array([self.sorted[j].searchsorted(centre[j]) for j in range(lines)])
        high = low.copy()
        collisions = np.zeros(count, np.int64)
        done = self.ids == own_id
        done[done] = (self.vectors[done] == query).all(axis=1)
        enough, wanted = int(np.ceil(ENOUGH * lines)), max(10 * k, int(VERIFIED * count))
        half, verified, distances = FIRST * self.spread, [], []
        while True:
            new_low = [self.sorted[j].searchsorted(centre[j] - half, "left") for j in range(lines)]
            new_high = [self.sorted[j].searchsorted(centre[j] + half, "right") for j in range(lines)]
            seen = np.concatenate([x for j in range(lines) for x in (self.order[j, new_low[j]:low[j]], self.order[j, high[j]:new_high[j]])])
            low, high = np.minimum(low, new_low), np.maximum(high, new_high)
            collisions += np.bincount(seen, minlength=count)
            found = np.nonzero((collisions >= enough) & ~done)[0]
            if len(found):
                done[found] = True
                verified.append(found)
                distances.append(np.sqrt(((self.vectors[found] - query) ** 2).sum(axis=1)))
            if done.all() or sum(map(len, verified)) >= wanted:
                break
            half *= WIDEN
        if not verified:
            return np.empty(0, np.int64), np.empty(0)
        spots, far = np.concatenate(verified), np.concatenate(distances)
        best = np.lexsort((self.ids[spots], far))[:k]
        return self.ids[spots[best]], far[best]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query its k nearest rows of `vectors` by Euclidean distance.

    score is the distance in double precision on the original components; ties go to the smaller id. All candidates are
    returned where there are fewer than k. A candidate with the query's id and vector is its own row. Vectors that are NULL, zero,
    or hold a NULL or non-finite component, and rows without an id, take no part, neither do pairs of different lengths.
    Rows repeated with the same id are candidates each; equal queries are answered once, those of one id with different vectors
    each by itself. Other columns are not read.
    """
    def rows(df: DataFrame) -> DataFrame:
        v = F.col(vector).cast("array<double>")
        return df.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("size", F.size("v"))

    data, asked = written(rows(vectors)), written(rows(queries).distinct().withColumn("ask", F.monotonically_increasing_id()))
    n, q = data.count(), asked.count()
    blocks, chunks = max(16, -(-n // BLOCK)), max(1, -(-q // CHUNK))
    data = data.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)))
    data = data.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))) if chunks > 1 else data.withColumn("chunk", F.lit(0))
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
        return np.concatenate([c.flatten().to_numpy() for c in column.chunks]).reshape(-1, size)

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            size = key[0].as_py()
            block = Block(left["id"].to_numpy(), matrix(left["v"], size))
            found = [((ask, i), *block.search(i, v, k)) for ask, i, v in zip(right["ask"].to_pylist(), right["id"].to_pylist(), matrix(right["v"], size))]
        times = [len(f) for _, f, _ in found]
        return pa.table({"ask": pa.array(np.repeat([a for (a, _), _, _ in found], times).astype(np.int64)), "query_id": pa.array(np.repeat([i for (_, i), _, _ in found], times).astype(np.int64)),
                         "vec_id": pa.array(np.concatenate([np.empty(0, np.int64), *[f for _, f, _ in found]])),
                         "score": pa.array(np.concatenate([np.empty(0), *[s for _, _, s in found]]))})

    keys = "size", "block", "chunk"
    found = (data.groupBy(*keys).cogroup(asked.groupBy(*keys))
             .applyInArrow(search, "ask long, query_id long, vec_id long, score double"))
    rank = F.row_number().over(Window.partitionBy("ask").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

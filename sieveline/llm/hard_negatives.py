"""Hard negatives by best-first search in R-trees packed by sort-tile-recursive.

Rows are tiled by label and leading coordinates into regions, of which a bounded number exists at any size of the table, and regions are cut into
blocks of bounded size. Each block is an R-tree packed by sort-tile-recursive. A box of least and greatest coordinates
bounds the inner product of a query with anything inside, coordinate by coordinate. A queue takes boxes in the order of their upper bounds and
leaves out those outside the score window, those of labels that do not count, and those strictly below the k-th best score found.

A search has two rounds: each query first visits the region with the greatest upper bound, then those that may
still hold better rows than the k-th found there.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sieveline.sources.shared import written

#: Rows of a block and of a leaf, leaves of an inner node, queries that visit a block at once.
BLOCK, LEAF, FANOUT, CHUNK = 8192, 128, 8, 2048
#: Coordinates that the boxes of all regions may have together: they go to every task.
REGION_NUMBERS = 400_000
LARGEST = float(1 << 62)


class Tree:
    """An R-tree over vectors (rows of floats) with a label each."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order = self._tiled(labels, vectors)
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        edges = np.arange(0, len(order), LEAF)
        self.leaves = self._boxes(edges, self.vectors, self.vectors, self.labels, self.labels)
        self.nodes = self._boxes(np.arange(0, len(edges), FANOUT), *self.leaves)

    @staticmethod
    def _tiled(labels: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """An order in which every LEAF rows form a tile: sorted by label, cut, each slab sorted by a coordinate, cut, and so on."""
        widest = np.argsort(-vectors.var(axis=0), kind="stable") if len(vectors) else []
        keys = [labels, *[vectors[:, c] for c in widest[:3]]]
        slabs = [np.arange(len(labels))]
        for depth, key in enumerate(keys):
            cut: list[np.ndarray] = []
            for slab in slabs:
                slab = slab[np.argsort(key[slab], kind="stable")]
                leaves = -(-len(slab) // LEAF)
                per = -(-leaves // max(1, round(leaves ** (1 / (len(keys) - depth))))) * LEAF
                cut += [slab[i:i + per] for i in range(0, len(slab), per)] if per else []
            slabs = cut
        return np.concatenate(slabs) if slabs else np.empty(0, np.int64)

    @staticmethod
    def _boxes(edges: np.ndarray, low: np.ndarray, high: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
        return (np.minimum.reduceat(low, edges, axis=0), np.maximum.reduceat(high, edges, axis=0),
                np.minimum.reduceat(first, edges), np.maximum.reduceat(last, edges))

    def search(self, asked: list[dict], query: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        """(ask, id, score) of the k best rows for each request of one query vector.

        A request has the row's own id, its label, whether rows must have that label or any other, the window from low to high,
        and a score (floor) below which nothing is wanted.
        """
        plus, minus = np.maximum(query, 0), np.minimum(query, 0)
        upper = [high @ plus + low @ minus for low, high, _, _ in (self.nodes, self.leaves)]
        lower = [low @ plus + high @ minus for low, high, _, _ in (self.nodes, self.leaves)]
        scores: dict[int, np.ndarray] = {}
        found = []
        for ask in asked:
            label, same, low, high, own = ask["label"], ask["same"], ask["low"], ask["high"], ask["id"]
            floor, best = max(low, ask["floor"]), []  # best: a heap of (score, -id)
            usable = [(up >= floor) & (down <= high) & ((first <= label) & (last >= label) if same else (first != label) | (last != label))
                      for up, down, (_, _, first, last) in zip(upper, lower, (self.nodes, self.leaves))]
            queue = [(-upper[0][n], 0, n) for n in np.flatnonzero(usable[0]).tolist()]
            heapq.heapify(queue)
            while queue:
                top, level, n = heapq.heappop(queue)
                if -top < floor:
                    break
                if not level:
                    inside = range(n * FANOUT, min((n + 1) * FANOUT, len(upper[1])))
                    for m in inside:
                        if usable[1][m] and upper[1][m] >= floor:
                            heapq.heappush(queue, (-upper[1][m], 1, m))
                    continue
                rows = slice(n * LEAF, (n + 1) * LEAF)
                if n not in scores:
                    scores[n] = self.vectors[rows] @ query
                score = scores[n]
                good = (score >= floor) & (score <= high) & (self.ids[rows] != own) & ((self.labels[rows] == label) == same)
                places = np.flatnonzero(good)
                if len(places) > k:
                    places = places[np.lexsort((self.ids[rows][places], -score[places]))[:k]]
                for i in places.tolist():
                    item = (float(score[i]), -int(self.ids[n * LEAF + i]))
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
                if len(best) == k:
                    floor = max(floor, best[0][0])
            found += [(ask["ask"], -i, max(-LARGEST, min(LARGEST, s))) for s, i in best]
        return found


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    return np.concatenate([np.empty(0), *[c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]]).reshape(len(column), size)


def _rows(vectors: DataFrame, id_column: str, vector: str, label: str) -> DataFrame:
    """row (a number of its own), id, label, v (256 times each component, rounded down) and size of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * 256) < F.lit(float("inf"))))
    # From 2^52 on a double has no fraction.
    scaled = F.transform(v, lambda x: F.when(F.abs(x * 256) < 2.0 ** 52, F.floor(F.when(F.abs(x * 256) < 2.0 ** 52, x * 256)).cast("double")).otherwise(x * 256))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label).cast("long").alias("label"), v.alias("raw"), finite.alias("finite"), scaled.alias("v"))
    return rows.where("id IS NOT NULL AND label IS NOT NULL AND raw IS NOT NULL AND finite").select("id", "label", "v", F.size("v").alias("size"))


def _in_regions(rows: DataFrame, regions: int) -> DataFrame:
    """The rows, stored, with a region of about equal numbers of rows: cut by label, each part by the first coordinate, those by the second."""
    per = int(np.ceil(regions ** (1 / 3) - 1e-9))
    rows = rows.withColumn("region", F.lit(0).cast("long"))
    if per > 1:
        for key in (F.col("label").cast("double"), F.coalesce(F.get("v", F.lit(0)), F.lit(0.0)), F.coalesce(F.get("v", F.lit(1)), F.lit(0.0))):
            keyed = rows.withColumn("key", key)
            cuts = written(keyed.groupBy("region").agg(F.percentile_approx("key", [i / per for i in range(1, per)], 1000).alias("cuts")))
            below = F.size(F.filter("cuts", lambda c: c < F.col("key"))).cast("long")
            rows = keyed.join(F.broadcast(cuts), "region").withColumn("region", F.col("region") * per + below).drop("key", "cuts")
    ordered = rows.repartitionByRange("size", "region", "id").sortWithinPartitions("size", "region")
    return written(ordered.withColumn("row", F.monotonically_increasing_id()))


def _region_boxes(rows: DataFrame) -> DataFrame:
    """size, region, n, first, last (labels), low, high (coordinates), stored: one row per region."""
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, region, label = (batch.column(i).to_numpy() for i in (0, 1, 2))
            starts = np.concatenate([[0], np.flatnonzero((size[1:] != size[:-1]) | (region[1:] != region[:-1])) + 1, [len(size)]]) if len(size) else np.array([0])
            made = []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                v = batch.column(3).slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, int(size[a]))
                made.append((int(size[a]), int(region[a]), b - a, int(label[a:b].min()), int(label[a:b].max()), v.min(axis=0).tolist(), v.max(axis=0).tolist()))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
            columns = list(zip(*made)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["size", "region", "n", "first", "last", "low", "high"])

    def fold(group: pa.Table) -> pa.Table:
        size = group["size"][0].as_py()
        low, high = _matrix(group["low"], size).min(axis=0), _matrix(group["high"], size).max(axis=0)
        return pa.table({"size": [size], "region": [group["region"][0].as_py()], "n": [sum(group["n"].to_pylist())], "first": [min(group["first"].to_pylist())],
                         "last": [max(group["last"].to_pylist())], "low": [low.tolist()], "high": [high.tolist()]},
                        schema=pa.schema([("size", pa.int32()), ("region", pa.int64()), ("n", pa.int64()), ("first", pa.int64()), ("last", pa.int64()),
                                          ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))]))

    kinds = "size int, region long, n long, first long, last long, low array<double>, high array<double>"
    return written(rows.select("size", "region", "label", "v").mapInArrow(parts, kinds).groupBy("size", "region").applyInArrow(fold, kinds))


def _visits(asks: DataFrame, boxes: DataFrame, best_only: bool) -> DataFrame:
    """The asks with each region they visit: the one with the greatest upper bound, or all others that may hold a row wanted."""
    names = ["ask", "id", "label", "same", "low", "high", "floor", "visited", "v", "size"]
    kinds = "ask long, id long, label long, same boolean, low double, high double, floor double, visited long, v array<double>, size int, region long"
    numbers = boxes.agg(F.sum(F.col("size") + 4)).first()[0] or 0
    if numbers > 4 * REGION_NUMBERS:  # vectors of very many lengths: no region is left out, and the second round does all
        every = asks.join(boxes.select("size", "region"), "size").select(*names, "region")
        return every.where(F.lit(not best_only))
    of: dict[int, tuple[np.ndarray, ...]] = {}
    for r in boxes.orderBy("size", "region").collect():
        of.setdefault(r["size"], []).append((r.region, r["first"], r["last"], r.low, r.high))
    of = {s: (np.array([x[0] for x in rs]), np.array([x[1] for x in rs]), np.array([x[2] for x in rs]),
              np.array([x[3] for x in rs], float).reshape(len(rs), s), np.array([x[4] for x in rs], float).reshape(len(rs), s)) for s, rs in of.items()}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, CHUNK) for whole in batches for at in range(0, len(whole), CHUNK)):
            sizes = batch.column(9).to_numpy()
            for size in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == size))
                region, first, last, low, high = of[size]
                query = part.column(8).flatten().to_numpy(zero_copy_only=False).reshape(len(part), size)
                plus, minus = np.maximum(query, 0), np.minimum(query, 0)
                upper, lower = plus @ high.T + minus @ low.T, plus @ low.T + minus @ high.T
                label, same, least, most, floor, visited = (part.column(i).to_numpy(zero_copy_only=False)[:, None] for i in (2, 3, 4, 5, 6, 7))
                fits = np.where(same.astype(bool), (first <= label) & (last >= label), (first != label) | (last != label))
                fits &= (upper >= np.maximum(least, floor)) & (lower <= most) & (region != visited)
                if best_only:
                    fits &= np.arange(len(region)) == np.where(fits, upper, -np.inf).argmax(axis=1)[:, None]
                which, where = np.nonzero(fits)
                out = part.take(pa.array(which))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(region[where], pa.int64())], [*names, "region"])

    return asks.select(*names).mapInArrow(route, kinds)


def _found(rows: DataFrame, boxes: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """ask, found (an id), score: the k best of each block that an ask visits."""
    visits = written(visits)
    asked = visits.groupBy("size", "region").agg(F.count("*").alias("asks"))
    plan = written(boxes.join(asked, ["size", "region"]).select("size", "region", F.ceil(F.col("n") / BLOCK).alias("subs"), F.ceil(F.col("asks") / CHUNK).alias("chunks")))
    plan = F.broadcast(plan) if plan.limit(REGION_NUMBERS + 1).count() <= REGION_NUMBERS else plan
    data = rows.join(plan, ["size", "region"]).select("size", "region", F.pmod(F.xxhash64("row"), "subs").alias("sub"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "id", "label", "v")
    there = visits.join(plan, ["size", "region"]).select(
        "size", "region", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1)).alias("sub"), F.pmod(F.xxhash64("ask"), "chunks").alias("chunk"),
        "ask", "id", "label", "same", "low", "high", "floor", "v")

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            size = key[0].as_py()
            tree = Tree(left["id"].to_numpy(), left["label"].to_numpy(), _matrix(left["v"], size))
            queries = _matrix(right["v"], size)
            asks = right.select(["ask", "id", "label", "same", "low", "high", "floor"]).to_pylist()
            # Requests of one vector are answered together, so that a leaf is scored once for them.
            order = np.lexsort((np.array([a["ask"] for a in asks]), np.array([a["id"] for a in asks]))).tolist()
            at = 0
            while at < len(order):
                end = at + 1
                while end < len(order) and np.array_equal(queries[order[end]], queries[order[at]]):
                    end += 1
                found += tree.search([asks[i] for i in order[at:end]], queries[order[at]], k)
                at = end
        columns = list(zip(*found)) or [[]] * 3
        return pa.table({"ask": pa.array(columns[0], pa.int64()), "found": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    keys = ["size", "region", "sub", "chunk"]
    return written(data.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInArrow(search, "ask long, found long, score double"))


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "found"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(rows: DataFrame, boxes: DataFrame, asks: DataFrame, k: int) -> DataFrame:
    """ask, rank, found, score: the k rows of the highest scores for each ask (stored), ties by the smaller id."""
    fresh = asks.withColumn("floor", F.lit(float("-inf"))).withColumn("visited", F.lit(-1).cast("long"))
    one = written(_visits(fresh, boxes, True))
    first = _found(rows, boxes, one, k)
    kth = _best(first, k).where(F.col("rank") == k).select("ask", F.col("score").alias("kth"))
    later = asks.join(kth, "ask", "left").join(one.select("ask", F.col("region").alias("been")), "ask", "left").select(
        *asks.columns, F.coalesce("kth", F.lit(float("-inf"))).alias("floor"), F.coalesce("been", F.lit(-1)).cast("long").alias("visited"))
    return _best(first.unionByName(_found(rows, boxes, _visits(later, boxes, False), k)), k)


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, id_column: str = "vec_id",
         vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score for the rows of `vectors` whose id is a multiple of `every`.

    The score of two rows is the inner product of their components times 256, rounded down. The positives of an anchor are
    the first `positives` other rows of its label; its negatives for each are the first `negatives` rows of other labels with a score from
    `low` to `high` percent of the positive's. Higher scores come first, then smaller ids.

    Rows with a NULL id, label or vector, or with a component that is NULL or, times 256, not finite, take no part; so
    do pairs of vectors of different lengths. Rows with the anchor's id are no others of its own. Repeated ids are rows each; equal anchors are
    answered once, anchors of one id with other vectors or labels each. Scores are exact below 2^53 (and cut at 2^62). Other columns are not read.
    """
    rows = written(_rows(vectors, id_column, vector, label))
    facts = rows.agg(F.count("*").alias("n"), F.max("size").alias("size")).first()
    regions = min(-(-facts["n"] // BLOCK), max(1, REGION_NUMBERS // max(1, facts["size"] or 1)))
    rows = _in_regions(rows, regions)
    boxes = _region_boxes(rows)
    asked = rows.where(F.col("id") % every == 0).select("id", "label", "v", "size").distinct()
    asked = written(asked.withColumn("ask", F.monotonically_increasing_id()))
    any_score = {"same": F.lit(True), "low": F.lit(float("-inf")), "high": F.lit(float("inf"))}
    near = written(search(rows, boxes, asked.withColumns(any_score), positives).select(F.col("ask").alias("anchor"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score")))
    windows = near.join(asked.withColumnRenamed("ask", "anchor"), "anchor").withColumns({
        "ask": F.monotonically_increasing_id(), "same": F.lit(False),
        "low": F.ceil(F.col("positive_score") * low / 100).cast("double"), "high": F.floor(F.col("positive_score") * high / 100).cast("double")})
    windows = written(windows.where("low <= high"))
    found = search(rows, boxes, windows.drop("anchor", "positive_id", "positive_score"), negatives)
    return found.join(windows.select("ask", F.col("id").alias("anchor_id"), "positive_id", F.col("positive_score").cast("long").alias("positive_score")), "ask").select(
        "anchor_id", "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").cast("long").alias("negative_score"))

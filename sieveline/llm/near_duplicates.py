"""Near duplicates by BagMinHash signatures of word shingles, bands, and a check of the multisets.

A signature register holds the earliest point that any shingle of the document sends it. The points of a shingle come from one
Poisson process per dyadic level of weights, [0,1), [1,2), [2,4), and so on, at the level's width as rate; each point has a
place in its level, and counts if that is below the shingle's weight (how often it occurs). So two documents agree
in a register with the probability of their weighted Jaccard similarity, at a cost that grows with the logarithm of
weights. Points are drawn only until the latest register is certain.

Documents that agree in all registers of a band meet in a bucket. There, each is compared with the bucket's first one,
and the links found so are closed to classes. Members of a bucket that are still in different classes are compared
too: in a small bucket with each other; those of large ones get longer signatures, in which only pairs close to the bound meet again, and
go through the same steps. These carry a sketch, a bit of each of many registers, so that a pair is compared by its texts only
if its sketches do not rule the bound out. So no bucket's pairs are left out, and none is emitted within a class.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from sieveline.llm.common import partitions
from sieveline.llm.components import components, joined
from sieveline.sources.shared import written

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 30, 6
#: Buckets up to this size are compared by pairs; the members of larger ones by longer signatures.
SMALL_BUCKET = 16
WIDE_BANDS, WIDE_ROWS = 160, 14
#: Bits of a sketch, in whole numbers of 64. Two agree in a bit with a probability of (1 + similarity) / 2; pairs that agree in fewer than
#: expected at the bound, by this many standard deviations, are not compared: 1 in 9,000 at the bound itself.
SKETCH_BITS, SKETCH_DEVIATIONS = 2048, 3.7
#: Points drawn at once.
POINTS = 30_000
_WORD = re.compile(r"\w+")
_U = np.uint64


class _WordHashes(dict):
    """64-bit hashes of words, a bounded number kept."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        if len(word) <= 64:
            if len(self) >= 200_000:
                self.clear()
            self[word] = value
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str | None, hashes: dict) -> np.ndarray:
    """Hashes of the runs of five lower-cased words, repeats included; of all words where there are fewer; none of none."""
    words = _WORD.findall((text or "").lower())
    if not words:
        return np.empty(0, _U)
    codes = np.fromiter(map(hashes.__getitem__, words), _U, len(words))
    runs = max(1, len(codes) - WORDS + 1)
    total = np.zeros(runs, _U)
    for k in range(min(WORDS, len(codes))):
        total = _mixed(total * _U(0x9E3779B97F4A7C15) + codes[k:k + runs] + _U(k + 1))
    return total


def similarity(left: np.ndarray, right: np.ndarray) -> float:
    """The weighted Jaccard similarity of two multisets, 0 for empty ones."""
    if not len(left) or not len(right):
        return 0.0
    values, counts = np.unique(left, return_counts=True)
    others, theirs = np.unique(right, return_counts=True)
    _, i, j = np.intersect1d(values, others, True, True)
    both = int(np.minimum(counts[i], theirs[j]).sum())
    return both / (len(left) + len(right) - both)


def signatures(bags: list[np.ndarray], registers: int, seed: int = 1) -> np.ndarray:
    """The registers of each multiset: the time of its earliest point in each (infinite for an empty one)."""
    found = np.full((len(bags), registers), np.inf)
    flat = found.reshape(-1)
    owner, element, low, weight = [], [], [], []
    for d, bag in enumerate(bags):
        values, counts = np.unique(bag, return_counts=True)
        level, floor = 1, 0
        while len(values):
            owner.append(np.full(len(values), d))
            element.append(values)
            low.append(np.full(len(values), floor))
            weight.append(counts)
            values, counts = values[counts > level], counts[counts > level]
            level, floor = 2 * level, level
    if not owner:
        return found
    owner, element, low, weight = (np.concatenate(x) for x in (owner, element, low, weight))
    width = np.maximum(low, 1).astype(np.float64)  # [0,1), [1,2), [2,4), ...
    state = _mixed(element * _U(0x9E3779B97F4A7C15) + _mixed(low.astype(_U) + _U(seed)))
    time, number = np.zeros(len(owner)), 0
    while len(owner):
        # Several points of each process at once where few are left. Times add up one by one, so that they are the same
        # to the last bit in every document.
        many = max(1, min(1024, POINTS // len(owner)))
        bits = _mixed(state[:, None] + (np.arange(number + 1, number + many + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)))
        number += many
        gaps = -np.log(((bits >> _U(11)) + _U(1)) * 2.0 ** -53) / width[:, None]
        gaps[:, 0] += time
        times = np.add.accumulate(gaps, axis=1)
        place = _mixed(bits + _U(0x632BE59BD9B4E019))
        register = (((place >> _U(32)) * _U(registers)) >> _U(32)).astype(np.int64)
        counted = low[:, None] + width[:, None] * ((place & _U(0xFFFFFFFF)) * 2.0 ** -32) < weight[:, None]
        np.minimum.at(flat, (owner[:, None] * registers + register)[counted], times[counted])
        time = times[:, -1]
        going = time < found.max(axis=1)[owner]
        owner, low, weight, width, state, time = (x[going] for x in (owner, low, weight, width, state, time))
    return found


def band_hashes(found: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One integer per band and document, from the band's registers and its number."""
    bits = found.view(np.uint64).reshape(len(found), bands, rows)
    total = np.broadcast_to(np.arange(1, bands + 1, dtype=_U), (len(found), bands)).copy()
    for k in range(rows):
        total = _mixed(total * _U(0x9E3779B97F4A7C15) + bits[:, :, k])
    return total.view(np.int64)


def sketches(found: np.ndarray, bits: int) -> np.ndarray:
    """`bits` bits of each document as 64-bit integers: one of each of its first registers."""
    mixed = _mixed(found[:, :bits].copy().view(np.uint64) * _U(0x9E3779B97F4A7C15)) >> _U(63)
    return np.packbits(mixed.astype(np.uint8), axis=1).view(np.int64)


def least_agreement(least: float, bits: int) -> int:
    """The fewest equal bits of two sketches at which a similarity of `least` is not ruled out."""
    share = (1 + least) / 2
    return int(bits * share - SKETCH_DEVIATIONS * (bits * share * (1 - share)) ** 0.5)


def _signed(rows: DataFrame, key: str, bands: int, per_band: int, sketch_bits: int = 0) -> DataFrame:
    """The key, n (shingles) and bands for each row of a table with that key and a text; and its sketch, where bits are asked for."""
    at_once = max(16, 100_000 // (bands * per_band))
    kind = dict(rows.dtypes)[key]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for whole in batches:
            for at in range(0, len(whole), at_once):
                batch = whole.slice(at, at_once)
                bags = [shingles(t.as_py(), hashes) for t in batch.column(1)]
                found = signatures(bags, bands * per_band)
                keys = band_hashes(found, bands, per_band)
                sizes = np.array([len(b) for b in bags], np.int64)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                         for x in ([keys, sketches(found, sketch_bits)] if sketch_bits else [keys])]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), *lists], [key, "n", "bands", "sketch"][:2 + len(lists)])

    return rows.select(key, "text").mapInArrow(sign, f"{key} {kind}, n long, bands array<long>" + ", sketch array<long>" * bool(sketch_bits))


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are at least that similar. Pairs arrive grouped by a, whose shingles are then cut once.

    Both joins are by sorted shuffles at any size, so that a first document with very many pairs can be split.
    """
    both = (pairs.hint("merge").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").hint("merge")
            .join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, bag = _WordHashes(), None, None
        for batch in batches:
            good = []
            for a, ta, tb in zip(batch.column(0), batch.column(2), batch.column(3)):
                if a != last:
                    last, bag = a, shingles(ta.as_py(), hashes)
                good.append(similarity(bag, shingles(tb.as_py(), hashes)) >= least)
            kept = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], ["a", "b"])

    return both.mapInArrow(check, "a long, b long")


def _near(x: str, y: str, least: float) -> Column:
    """A necessary condition on the numbers of shingles."""
    return F.least(x, y) >= least * F.greatest(x, y)


def _shared(members: DataFrame) -> DataFrame:
    """bucket, node, n, and first, n_first, size of the bucket, for the members of buckets with more than one."""
    firsts = (members.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("low"), F.count("*").alias("size")).where("size > 1")
              .select("bucket", F.col("low.node").alias("first"), F.col("low.n").alias("n_first"), "size"))
    return members.join(firsts, "bucket")


def _open(members: DataFrame, classes: DataFrame) -> DataFrame:
    """The members of buckets that hold more than one class, with their class and the bucket's smallest one (main)."""
    placed = members.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("main"), F.max("component").alias("other")).where("main != other")
    return placed.join(mixed.select("bucket", "main"), "bucket")


def _across(rows: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of open members of a bucket that are in different classes; where rows have a sketch, those that it does not rule out."""
    words = SKETCH_BITS // 64 if "sketch" in rows.columns else 0

    def side(end: str) -> list[Column]:
        return [F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("component").alias(f"of_{end}"), *[F.get("sketch", F.lit(i)).alias(f"{end}_{i}") for i in range(words)]]

    both = (rows.where("component != main").select("bucket", *side("x")).join(rows.select("bucket", *side("y")), "bucket")
            .where((F.col("of_x") > F.col("of_y")) & _near("n_x", "n_y", least)))
    if words:
        apart = sum((F.bit_count(F.col(f"x_{i}").bitwiseXOR(F.col(f"y_{i}"))) for i in range(words)), F.lit(0))
        both = both.where(apart <= SKETCH_BITS - least_agreement(least, SKETCH_BITS))
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _classes(nodes: DataFrame, source: DataFrame, least: float) -> DataFrame:
    """node, component for the nodes (node, id, key, n, bands) that are linked to others."""
    members = written(_shared(nodes.where("n > 0").select("node", "n", F.explode("bands").alias("bucket"))))
    near = (F.col("node") != F.col("first")) & _near("n", "n_first", least)
    tried = written(members.where(near).select(F.col("first").alias("a"), F.col("node").alias("b")).distinct())
    wanted = members.select("node").distinct().join(nodes.select("node", "id", "key"), "node")
    texts = written(source.hint("merge").join(wanted, ["id", "key"]).select("node", "text").dropDuplicates(["node"]))
    classes = written(components(_verified(tried, texts, least)))
    crowded = written(_open(members.where(F.col("size") > SMALL_BUCKET), classes).select("node").distinct())
    across = None
    if not crowded.isEmpty():
        signed = written(_signed(texts.join(crowded, "node"), "node", WIDE_BANDS, WIDE_ROWS, SKETCH_BITS))
        # Dealt anew before bands become rows: a small stored table is read by few tasks.
        dealt = signed.select("node", "n", "bands").repartition(partitions(source.sparkSession), "node")
        wide = written(_shared(written(dealt.select("node", "n", F.explode("bands").alias("bucket")))))
        # Members already in the first one's class need no comparison.
        of_first = classes.select(F.col("node").alias("a"), F.col("component").alias("of_a"))
        pairs = wide.where(near).select(F.col("first").alias("a"), F.col("node").alias("b"), "node").distinct()
        apart = pairs.join(classes, "node", "left").join(of_first, "a", "left").where(F.coalesce("component", "node") != F.coalesce("of_a", "a"))
        more = written(apart.select("a", "b").join(tried, ["a", "b"], "left_anti"))
        classes, tried = written(joined(classes, _verified(more, texts, least))), tried.unionByName(more)
        across = _across(_open(wide, classes).join(signed.select("node", "sketch"), "node"), least)
    few = _across(_open(members.where(F.col("size") <= SMALL_BUCKET), classes), least)
    across = written((few.unionByName(across).distinct() if across is not None else few).join(tried, ["a", "b"], "left_anti"))
    return written(joined(classes, _verified(across, texts, least)))


def _labels(docs: DataFrame, id_column: str, text: str, least: float, bands: int, per_band: int) -> DataFrame:
    """key, class_id, first (the smallest id and key of the class) for each text with an id that is not empty."""
    body = F.col(text).cast("string")
    source = (docs.select(F.col(id_column).cast("long").alias("id"), _key(body).alias("key"), body.alias("text"))
              .where("id IS NOT NULL AND text IS NOT NULL AND text != ''"))
    # One node per text: copies collapse in each task first.
    keyed = source.select(F.struct("id", "key").alias("of"), "text")
    signed = written(_signed(keyed, "of", bands, per_band).select("of.id", "of.key", "n", "bands"))
    nodes = written(signed.groupBy("key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
                    .withColumn("node", F.monotonically_increasing_id()))
    classes = _classes(nodes, source, least)
    named = nodes.join(classes, "node").groupBy("component").agg(F.min(F.struct("id", "key")).alias("first"))
    first = F.coalesce("first", F.struct("id", "key"))
    return written(nodes.join(classes, "node", "left").join(named, "component", "left").select("key", first.alias("first"), first["id"].alias("class_id")))


def _key(body: Column) -> Column:
    return F.unhex(F.md5(F.nullif(body, F.lit("")).cast("binary")))


def duplicate_classes(docs: DataFrame, id_column: str = "doc_id", text: str = "text", least: float = SIMILARITY,
                      bands: int = BANDS, per_band: int = ROWS) -> DataFrame:
    """doc_id, class_id for every row of `docs`: the smallest id among the documents that chains of near duplicates join.

    Near duplicates have a weighted Jaccard similarity of `least` or more over runs of five lower-cased words. Equal
    texts are one class. Texts without a word are alike to none but equal ones. Rows without an id are in no class
    (class_id NULL); NULL and empty texts are classes of their own. A pair at 0.8 misses every bucket with a
    probability of 1 in 9,000, at 0.85 of 1 in 3 million; of pairs at 0.8 in crowded buckets, 1 in 1,300 misses those of the
    longer signatures, at 0.82 1 in 29,000, and 1 in 9,000 is ruled out by sketches, at 0.82 1 in 10 million. Whole texts are read; other columns are not.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), _key(F.col(text).cast("string")).alias("key"))
    named = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id"))
    return rows.join(_labels(docs, id_column, text, least, bands, per_band), "key", "left").select("doc_id", named.alias("class_id"))


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The rows of `docs`, all columns, that stay: of each class the document with the smallest id (and, of several texts with
    that id, the one with the smallest digest), once. An id with texts of several classes is that of several documents.

    Rows without an id stay; so does each id's empty text, once.
    """
    first = _labels(docs, id_column, text, least, BANDS, ROWS).select("first.id", "first.key").distinct()
    first = first.select(F.col("id").alias("stay_id"), F.col("key").alias("stay_key"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_column).cast("long").alias("stay_id"), _key(F.col(text).cast("string")).alias("stay_key"))
    one = rows.where("stay_id IS NOT NULL AND stay_key IS NOT NULL").join(first, ["stay_id", "stay_key"], "left_semi")
    one = one.unionByName(rows.where("stay_id IS NOT NULL AND stay_key IS NULL")).dropDuplicates(["stay_id", "stay_key"])
    return one.unionByName(rows.where("stay_id IS NULL")).select("row.*")

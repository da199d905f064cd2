"""Shards of near equal bytes, words and rows, by vector bin packing of groups of equal texts.

What is packed is bounded: each large group (in pieces where no shard can hold it), and the other groups dealt by hash into a
fixed number of lots. Items go, largest first, to the shard with room whose
residual capacity has the largest dot product with the item.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from sieveline.llm.common import small
from sieveline.llm.mixing import n_words
from sieveline.sources.shared import written

LOTS = 4096
#: A group with this share of the bytes, words or rows is packed by itself. One that does not fit into a shard is cut into pieces of PIECE.
LARGE, PIECE = 1 / 4096, 1 / 256


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item, a row of its bytes, words and rows.

    Capacities are equal shares of the sums. Where no shard has room in every dimension, that one with the most room
    left in bytes takes the item. Ties go to the smaller shard.
    """
    share = items / np.maximum(items.sum(axis=0), 1) * shards
    room = np.ones((shards, share.shape[1]))
    chosen = np.empty(len(items), np.int64)
    for i in np.lexsort((np.arange(len(items)), -share[:, 0], -share.max(axis=1))):
        fits = (room >= share[i]).all(axis=1)
        chosen[i] = np.where(fits, room @ share[i], -np.inf).argmax() if fits.any() else room[:, 0].argmax()
        room[chosen[i]] -= share[i]
    return chosen


def assign(docs: DataFrame, shards: int = 8, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of `docs`.

    size is the text's UTF-8 bytes (NULL: none) plus 1; the law is `bytes`: the sums of sizes are near equal. Equal texts
    share a shard, unless they are more than an equal share of the table's bytes, words or rows, when they go in pieces by the hash of their ids. Slots
    of a shard count from 0 without gaps, in the order of lots of rows (by hash of id and text), then ids; equal rows stand one after
    another. NULL texts are one group, with text_crc32 0; NULL ids are allowed. Other columns are not read.
    """
    body = F.col(text).cast("string")
    size = F.coalesce(F.octet_length(body), F.lit(0)).cast("long") + 1
    rows = written(docs.select(F.col(id_column).alias("doc_id"), size.alias("size"), n_words(body).alias("words"),
                               F.coalesce(F.crc32(body.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
                               F.coalesce(F.md5(body.cast("binary")), F.lit("")).alias("group")))
    everything = rows.agg(F.sum("size").alias("size"), F.sum("words").alias("words"), F.count("*").alias("rows")).first()
    share = F.greatest(*[F.col(c) / max(everything[c] or 0, 1) for c in ("size", "words", "rows")])
    groups = rows.groupBy("group").agg(F.sum("size").alias("size"), F.sum("words").alias("words"), F.count("*").alias("rows"))
    large = groups.where(share >= LARGE).select("group", F.when(share > 1 / shards, F.ceil(share / PIECE)).otherwise(1).alias("pieces"))
    # At most 3 / LARGE groups are large, so they may be broadcast.
    dealt = rows.join(F.broadcast(written(large)), "group", "left")
    piece = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("pieces"))
    lot = F.pmod(F.xxhash64("group"), F.lit(LOTS)).cast("string")
    dealt = dealt.withColumn("item", F.when(F.col("pieces").isNull(), lot).otherwise(F.concat_ws(":", "group", piece.cast("string"))))
    items = (dealt.groupBy("item").agg(F.sum("size").alias("size"), F.sum("words").alias("words"), F.count("*").alias("rows"))
             .orderBy("item").collect())  # at most LOTS lots, 3 / LARGE groups and 3 / PIECE more pieces
    chosen = pack(np.array([[i.size, i.words, i.rows] for i in items], float).reshape(-1, 3), shards)
    places = docs.sparkSession.createDataFrame([(i.item, int(s)) for i, s in zip(items, chosen)], "item string, shard int")
    placed = dealt.join(F.broadcast(places), "item")
    # A slot is the number of rows in the shard's earlier lots of rows, and the row's number in its own lot.
    lots = max(1, -(-everything["rows"] // 20_000))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "group"), F.lit(lots)))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = small(written(counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "group"))
    return (placed.withColumn("within", within).join(starts, ["shard", "part"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("first") + F.col("within") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")))


def write_shards(docs: DataFrame, folder: str, shards: int = 8, id_column: str = "doc_id", text: str = "text") -> None:
    """The documents as Parquet, a folder per shard, rows with a repeated id and text by the shard of all of them.

    Columns `shard` and `slot` are the operator's; columns of `docs` of those names are replaced. Rows without an id are joined
    by their text alone, so all copies of such a text go to the smallest of their shards.
    """
    key = [F.col(id_column).alias("shard_id"), F.coalesce(F.crc32(F.col(text).cast("string").cast("binary")), F.lit(0)).cast("long").alias("shard_crc")]
    places = assign(docs, shards, id_column, text).groupBy("doc_id", "text_crc32").agg(F.min("shard").alias("shard"), F.min("slot").alias("slot"))
    kept = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns if c.lower() not in ("shard", "slot")]).alias("row"), *key)
    (kept.join(places, F.col("shard_id").eqNullSafe(places["doc_id"]) & (F.col("shard_crc") == F.col("text_crc32")))
     .select("row.*", "shard", "slot")
     .write.partitionBy("shard").parquet(folder))

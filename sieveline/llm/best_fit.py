"""Packing of documents into sequences of a fixed length, by best-fit decreasing under certified bounds.

Documents are cut into pieces no longer than a sequence. Pieces are dealt into partitions of bounded size; each packs its own by
best-fit decreasing, and compares its number of sequences with a lower bound from dual feasible functions. Equal
numbers certify that no packing of that partition is shorter. Partitions with a gap exchange the pieces of their sequences that
are not full; so do the others while all together need more than the bound of the whole table, as then what one leaves free
may serve another. What was exchanged is dealt and packed anew, in partitions twice as large, for a bounded number of rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sieveline.llm.byte_ids import byte_ids
from sieveline.sources.shared import written

CAPACITY = 2048
#: Pieces of a partition, and rounds of exchange at most.
PART, ROUNDS = 20_000, 5
#: Texts encoded at once, and bytes after which a batch of them ends.
AT_ONCE, BYTES_AT_ONCE = 1000, 4 << 20
_PIECES = "doc_id long, key long, piece int, start long, length long, ids binary"
_PLACES = "key long, length long, part long, bin long, offset long, room long, certified boolean"


def bound(lengths: np.ndarray, capacity: int) -> int:
    """A number of sequences that no packing of pieces of these lengths (1 to `capacity`) can go below.

    The largest of the sums under three families of dual feasible functions: the length itself; lengths above capacity - t
    rounded up to one and those below t to none, for each t; lengths rounded down to multiples of 1/k after scaling by k + 1.
    """
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1))


def bound_of_counts(counts: np.ndarray) -> int:
    """The same, from the number of pieces of each length from 0 to the capacity."""
    capacity = len(counts) - 1
    size = np.arange(capacity + 1)
    least = -(-int((counts * size).sum()) // capacity)
    t = np.arange(1, capacity // 2 + 1)
    if len(t):
        number, weight = counts.cumsum(), (counts * size).cumsum()
        values = (number[-1] - number[capacity - t]) * capacity + weight[capacity - t] - weight[t - 1]
        least = max(least, -(-int(values.max()) // capacity))
    for k in range(1, 101):
        scaled = size * (k + 1)
        worth = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        least = max(least, -(-int((counts * worth).sum()) // (k * capacity)))
    return least


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """(sequence of each piece, its offset there, room left in each sequence). Lengths must descend; each piece goes where the
    least room is left that takes it."""
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]  # sequences by the room they have
    rooms = 0  # bit r: some sequence has room r
    chosen, offsets, left = [], [], []
    for length in lengths:
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            place = waiting[room].pop()
            if not waiting[room]:
                rooms ^= 1 << room
        else:
            room, place = capacity, len(left)
            left.append(capacity)
        chosen.append(place)
        offsets.append(capacity - room)
        room -= length
        left[place] = room
        if room:
            waiting[room].append(place)
            rooms |= 1 << room
    return chosen, offsets, left


def _packed(loose: DataFrame, salt: int, first_part: int, capacity: int, part: int) -> tuple[DataFrame, int]:
    """The pieces (key, length) dealt by a hash and packed per partition, and the number of partitions."""
    parts = max(1, -(-loose.count() // part))

    def pack(group: pa.Table) -> pa.Table:
        keys, lengths = group["key"].to_numpy(), group["length"].to_numpy()
        order = np.lexsort((keys, -lengths))
        chosen, offsets, left = best_fit(lengths[order].tolist(), capacity)
        n, sure = len(order), len(left) == bound(lengths, capacity)
        return pa.table({"key": keys[order], "length": lengths[order], "part": np.full(n, group["part"][0].as_py()), "bin": np.array(chosen, np.int64),
                         "offset": np.array(offsets, np.int64), "room": np.array(left, np.int64)[chosen], "certified": np.full(n, sure)})

    dealt = loose.select("key", "length", (F.pmod(F.xxhash64("key", F.lit(salt)), F.lit(parts)) + first_part).alias("part"))
    return written(dealt.groupBy("part").applyInArrow(pack, _PLACES)), parts


def _whole_bound(loose: DataFrame, capacity: int) -> int:
    """The bound of all pieces together, from how often each length occurs."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in loose.groupBy("length").count().collect():  # a row per length at most
        counts[r["length"]] = r["count"]
    return bound_of_counts(counts)


def pack(pieces: DataFrame, capacity: int = CAPACITY, part: int = PART, rounds: int = ROUNDS) -> DataFrame:
    """key, sequence_id, offset, certified for each row of `pieces` (key, unique; length from 1 to `capacity`).

    Offsets in a sequence have no gaps. certified says whether the partition that packed the sequence needed no more sequences
    than its bound. Partitions hold about `part` pieces at any size of the table, in round r of exchange 2^r times as many. A
    round is kept only if it needs fewer sequences for what was exchanged. No round follows once the bound of the whole table is met.
    """
    loose = pieces.where(F.col("length") < capacity).select("key", "length")
    places, parts = _packed(loose, 0, 0, capacity, part)
    least = _whole_bound(loose, capacity)
    total = places.select("part", "bin").distinct().count()
    settled: list[DataFrame] = []
    for number in range(1, rounds + 1):
        if parts == 1 or total <= least:
            break
        given = places.where("room > 0")
        again, fewer = _packed(given, number, number << 40, capacity, part << number)
        saved = given.select("part", "bin").distinct().count() - again.select("part", "bin").distinct().count()
        if saved > 0:
            settled.append(places.where("room = 0"))
            places, parts, total = again, fewer, total - saved
    done = places
    for earlier in settled:
        done = done.unionByName(earlier)
    # Parts number at most 2^20 per piece's own bin, so the two fit into one number apart from those of whole pieces.
    name = F.xxhash64("part", "bin") if part >= 1 << 20 else F.shiftleft(F.col("part") % F.lit(1 << 40), 20) + F.col("bin") + F.shiftleft(F.shiftright("part", 40), 58)
    whole = pieces.where(F.col("length") == capacity).select("key", (-F.col("key") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    return done.select("key", name.alias("sequence_id"), "offset", "certified").unionByName(whole)


def cut(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, id_column: str = "doc_id", text: str = "text",
        cached: int = 1_200_000) -> DataFrame:
    """doc_id, key, piece, start, length, ids (little-endian, 32 bits each), a stored table of the pieces of every row of `docs`.

    A NULL text counts as empty: its only token is the end id. A row of more than `capacity` tokens is cut so that all its pieces but
    the first are full. Ids may be NULL or repeat: each row is a document of its own. Other columns are not read.
    """
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, number = byte_ids(tokenizer, cached), TaskContext.get().partitionId() << 33
        for batch in _bounded(batches):
            rows = [(i, row + end) for i, row in zip(batch.column(0).to_pylist(), ids.encode(batch.column(1)))]
            made: list[tuple] = []
            for doc, row in rows:
                n = len(row) // 4
                edges = [0, *range(n % capacity or min(n, capacity), n + 1, capacity)]
                for p, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                    made.append((doc, number, p, a, b - a, row[4 * a:4 * b]))
                    number += 1
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], ["doc_id", "key", "piece", "start", "length", "ids"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return written(rows.mapInArrow(encode, _PIECES))


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of a bounded number of rows and bytes (or of one row)."""
    for whole in batches:
        at = 0
        while at < len(whole):
            part = whole.slice(at, AT_ONCE)
            while len(part) > 1 and part.column(1).nbytes > BYTES_AT_ONCE:
                part = part.slice(0, len(part) // 2)
            at += len(part)
            yield part


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, id_column: str = "doc_id", text: str = "text",
                   part: int = PART) -> DataFrame:
    """doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset, certified: where each piece of each row of `docs` goes.

    The rules for texts and ids are those of `cut`, those for sequences those of `pack`. ids are not moved where they are not asked for.
    """
    pieces = cut(docs, tokenizer, end_id, capacity, id_column, text).withColumn("ids_crc32", F.crc32("ids"))
    return pieces.join(written(pack(pieces.select("key", "length"), capacity, part)), "key").drop("key")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids: the sequences of `pack_documents`, each the ids of its pieces one after another."""
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("pieces"))
    return rows.select("sequence_id", "n_tokens", F.expr("aggregate(pieces, CAST('' AS BINARY), (all, p) -> concat(all, p.ids))").alias("ids"))

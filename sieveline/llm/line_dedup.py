"""Line deduplication by pairwise alignment.

Each document is aligned with every earlier one that shares a line, by patience diff: lines that are unique in both are
matched in the longest common order, and equal lines next to a match join it. Common blocks with enough words are deleted
from the later document.

Alignments that cannot delete anything more are left out. A rare line (held by few documents) pairs each of them with every
earlier one, any other line pairs each with the first document that holds it. What may still be deleted then is a run of
frequent lines: its document is paired with the first holder of the run that can match it, and if lines of the run stay,
with all of them, where documents that look alike by their frequent lines stand for each other.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from sieveline.sources.shared import written

#: Documents that may hold a rare line, and the words a deleted block must have.
RARE, BLOCK_WORDS = 8, 10


def common_blocks(early: list[int], late: list[int]) -> list[tuple[int, int, int]]:
    """(start in early, start in late, length) of the aligned blocks of two lists of lines, by patience diff."""
    blocks: list[tuple[int, int, int]] = []
    spans = [(0, len(early), 0, len(late))]
    while spans:
        a, a_end, b, b_end = spans.pop()
        head = 0
        while a + head < a_end and b + head < b_end and early[a + head] == late[b + head]:
            head += 1
        if head:
            blocks.append((a, b, head))
            a, b = a + head, b + head
        tail = 0
        while a_end - tail > a and b_end - tail > b and early[a_end - tail - 1] == late[b_end - tail - 1]:
            tail += 1
        if tail:
            a_end, b_end = a_end - tail, b_end - tail
            blocks.append((a_end, b_end, tail))
        if a >= a_end or b >= b_end:
            continue
        left, right = Counter(early[a:a_end]), Counter(late[b:b_end])
        place = {line: i for i, line in enumerate(early[a:a_end], a) if left[line] == 1}
        matched = [(place[line], j) for j, line in enumerate(late[b:b_end], b) if right[line] == 1 and line in place]
        if not matched:
            continue
        # The longest run of matches that ascends in both, by piles.
        tops: list[int] = []
        below: list[int] = []
        last: list[int] = []
        for n, (i, _) in enumerate(matched):
            pile = bisect_left(tops, i)
            tops[pile:pile + 1] = [i]
            last[pile:pile + 1] = [n]
            below.append(last[pile - 1] if pile else -1)
        n = last[-1]
        kept = []
        while n >= 0:
            kept.append(matched[n])
            n = below[n]
        # Between two matches the rest is aligned again; a match itself starts the span that follows it.
        starts = kept[::-1]
        spans.append((a, starts[0][0], b, starts[0][1]))
        for (i, j), (i_next, j_next) in zip(starts, [*starts[1:], (a_end, b_end)]):
            spans.append((i, i_next, j, j_next))
    merged: list[tuple[int, int, int]] = []
    for i, j, n in sorted(blocks):
        if merged and merged[-1][0] + merged[-1][2] == i and merged[-1][1] + merged[-1][2] == j:
            merged[-1] = (merged[-1][0], merged[-1][1], merged[-1][2] + n)
        else:
            merged.append((i, j, n))
    return merged


def _lines(body: Column) -> Column:
    return F.split(body, "\n", -1)


def outline(hashes: list[int], words: list[int], frequent: set[int], least: int) -> tuple[bytes, list[tuple[int, int]], list[tuple[int, int, int]]] | None:
    """(shape, roots with places, runs with places and lengths) of a document by its frequent lines, None if no run of these
    has enough words.

    Lines without a word count as frequent. The shape has a gap for any stretch of other lines: documents of one shape
    are aligned alike with every document that they share only frequent lines with. An alignment without a root in
    common (a line that is unique in both, the first line, or the last one) is empty, and a deleted block is covered by
    runs: the shortest stretches with enough words from a line on, and up to a line. In an alignment, a common root lies
    on the same side of a run in both documents.
    """
    shared = [h in frequent or not n for h, n in zip(hashes, words)]
    times = Counter(h for h, ok in zip(hashes, shared) if ok)
    shape, spans = [], set()
    at, size = 0, len(hashes)
    while at < size:
        if not shared[at]:
            if not shape or shape[-1] is not None:
                shape.append(None)
            at += 1
            continue
        start = at
        while at < size and shared[at]:
            at += 1
        shape.extend(hashes[start:at])
        end, total = start, 0
        for k in range(start, at):  # the shortest run from each line on
            while end < at and total < least:
                total += words[end]
                end += 1
            if total < least:
                break
            spans.add((k, max(end, k + 1)))
            total -= words[k] if end > k else 0
        low, total = start, 0
        for k in range(start, at):  # the shortest run up to each line
            total += words[k]
            while low < k and total - words[low] >= least:
                total -= words[low]
                low += 1
            if total >= least:
                spans.add((low, k + 1))
    if not spans:
        return None
    roots = [(h, k) for k, (h, ok) in enumerate(zip(hashes, shared)) if ok and times[h] == 1]
    roots += [(_key((1, hashes[0])), 0)] if shared[0] else []
    roots += [(_key((2, hashes[-1])), size - 1)] if shared[-1] else []
    runs = [(_key(hashes[k:end]), k, end - k) for k, end in sorted(spans)]
    return xxhash.xxh3_128_digest(repr(shape).encode()), roots, runs


def _key(parts: Iterable[int]) -> int:
    return xxhash.xxh3_64_intdigest(array("q", parts).tobytes()) - 2 ** 63


def _aligned(pairs: DataFrame, table: DataFrame, block_words: int) -> DataFrame:
    """doc, gone for the later documents of the pairs (early, late), one row for each pair that deletes lines."""
    both = (pairs.join(table.select(F.col("doc").alias("late"), F.col("hashes").alias("late_lines"), "words"), "late")
            .join(table.select(F.col("doc").alias("early"), F.col("hashes").alias("early_lines")), "early")
            .select("late.id", "late.text_hash", "early_lines", "late_lines", "words"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = []
            for early, late, words in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                gone.append([k for _, j, n in common_blocks(early, late) if sum(words[j:j + n]) >= block_words for k in range(j, j + n)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gone, pa.list_(pa.int32()))], ["id", "text_hash", "gone"])

    found = both.mapInArrow(align, "id long, text_hash long, gone array<int>").where(F.size("gone") > 0)
    return found.select(F.struct("id", "text_hash").alias("doc"), "gone")


def _merged(found: DataFrame) -> DataFrame:
    return found.groupBy("doc").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("gone")))).alias("gone"))


def _keyed(held: DataFrame, table: DataFrame, gone: DataFrame, rare: int, block_words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The outlines' keys (a run, a root, and where the root lies from the run): of the first document of each shape
    (key, early), and of documents with open runs (key, doc, at, n); and the other documents of each shape (first, early).

    A pair that shares no rare line deletes more lines of the later document only if it shares a key of an open run.
    """
    often = held.where(F.col("n") > rare).groupBy("doc").agg(F.collect_list("line").alias("frequent"))
    rows = often.join(table, "doc").select("doc.id", "doc.text_hash", "hashes", "words", "frequent")

    def outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, run = pa.struct([("root", pa.int64()), ("place", pa.int32())]), pa.struct([("run", pa.int64()), ("at", pa.int32()), ("n", pa.int32())])
        for batch in batches:
            made = [outline(h, w, set(f), block_words) for h, w, f in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))]
            have = pa.array([m is not None for m in made], pa.bool_())
            made = [m for m in made if m is not None]
            roots = [[{"root": r, "place": k} for r, k in m[1]] for m in made]
            runs = [[{"run": r, "at": k, "n": n} for r, k, n in m[2]] for m in made]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(have), batch.column(1).filter(have), pa.array([m[0] for m in made], pa.binary()),
                 pa.array(roots, pa.list_(root)), pa.array(runs, pa.list_(run))], ["id", "text_hash", "shape", "roots", "runs"])

    kinds = "shape binary, roots array<struct<root:long,place:int>>, runs array<struct<run:long,at:int,n:int>>"
    made = written(rows.mapInArrow(outlines, f"id long, text_hash long, {kinds}").select(F.struct("id", "text_hash").alias("doc"), "shape", "roots", "runs"))
    shapes = written(made.select("doc", "shape").join(made.groupBy("shape").agg(F.min("doc").alias("first")), "shape").select("doc", "first"))
    side = F.when(F.col("root.place") < F.col("run.at"), -1).otherwise(F.least(F.col("root.place") - F.col("run.at"), F.col("run.n")))
    key = F.xxhash64("run.run", "root.root", side).alias("key")
    runs = made.select("doc", "roots", F.explode("runs").alias("run"))
    open_runs = written(_still_open(runs.select("doc", "roots", "run", "run.at", "run.n"), gone))
    late = written(open_runs.select("doc", "run", "at", "n", F.explode("roots").alias("root")).select(key, "doc", "at", "n"))
    wanted = open_runs.select(F.col("run.run").alias("wanted")).distinct()
    early = runs.join(shapes.where(F.col("doc") == F.col("first")).select("doc"), "doc").join(wanted, F.col("run.run") == F.col("wanted"), "left_semi")
    early = written(early.select(F.col("doc").alias("early"), "run", F.explode("roots").alias("root")).select(key, "early").distinct())
    return early, late, shapes.where(F.col("doc") != F.col("first")).select("first", F.col("doc").alias("early"))


def _candidates(early: DataFrame, late: DataFrame) -> DataFrame:
    """The pairs (early, late) that share a key."""
    return late.select("key", F.col("doc").alias("late")).distinct().join(early, "key").where("early < late").select("early", "late").distinct()


def _still_open(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows (doc, at, n) of which a line stays."""
    here = F.sequence("at", F.col("at") + F.col("n") - 1)
    return rows.join(gone, "doc", "left").where(F.col("gone").isNull() | (F.size(F.array_except(here, "gone")) > 0)).drop("gone")


def deleted_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text", rare: int = RARE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc, text_hash, gone (the line numbers from 0 that are deleted, ascending) for each document that loses lines."""
    body = F.col(text).cast("string")
    cut = docs.select(F.struct(F.col(id_column).cast("long").alias("id"), F.xxhash64(body).alias("text_hash")).alias("doc"), _lines(body).alias("lines")).where("doc.id IS NOT NULL AND lines IS NOT NULL")
    hashes = F.transform("lines", lambda x: F.xxhash64(F.trim(x)))
    counts = F.transform("lines", lambda x: F.when(F.trim(x) == "", 0).otherwise(F.size(F.split(F.trim(x), r"\s+"))))
    # Equal rows are one document here: they lose the same lines.
    table = written(cut.select("doc", hashes.alias("hashes"), counts.alias("words")).dropDuplicates(["doc"]))
    held = table.select("doc", F.explode(F.array_distinct(F.transform(F.filter(F.arrays_zip("hashes", "words"), lambda x: x.words > 0), lambda x: x.hashes))).alias("line"))
    shared = held.groupBy("line").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1")
    held = written(held.join(shared, "line"))
    pairs = held.where(F.col("doc") != F.col("first")).select(F.col("first").alias("early"), F.col("doc").alias("late"), (F.col("n") <= rare).alias("rare"))
    few = held.where((F.col("n") <= rare) & (F.col("n") > 2)).groupBy("line").agg(F.array_sort(F.collect_list("doc")).alias("docs"))  # at most `rare` each
    few = few.select(F.posexplode("docs").alias("place", "late"), "docs").select(F.explode(F.slice("docs", 1, F.col("place"))).alias("early"), "late", F.lit(True).alias("rare"))
    pairs = written(pairs.unionByName(few).groupBy("early", "late").agg(F.max("rare").alias("rare")))
    gone = written(_merged(_aligned(pairs, table, block_words)))
    early, late, others = _keyed(held, table, gone, rare, block_words)
    # The first holder of each key leaves few runs open; for these, all other holders.
    tried = pairs.select("early", "late")
    firsts = early.groupBy("key").agg(F.min("early").alias("early"))
    new = written(_candidates(firsts, late).join(tried, ["early", "late"], "left_anti"))
    tried = tried.unionByName(new)
    gone = written(_merged(gone.unionByName(_aligned(new, table, block_words))))
    rest = written(_candidates(early, _still_open(late, gone)))
    # Documents of one shape are aligned unlike only if the first one shares a rare line with the later document.
    alike = rest.join(pairs.where("rare"), ["early", "late"], "left_semi").withColumnRenamed("early", "first").join(others, "first").where("early < late")
    new = rest.unionByName(alike.select("early", "late")).distinct().join(tried, ["early", "late"], "left_anti")
    return _merged(gone.unionByName(_aligned(written(new), table, block_words))).select("doc.id", "doc.text_hash", "gone").withColumnRenamed("id", "doc")


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text", rare: int = RARE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, text (without the deleted lines), n_lines, n_deleted for every row of `docs`.

    Of two documents the one with the larger id is the later (equal ids: the larger hash of the text). Lines are
    compared without spaces at their ends; those without a word pair nothing, but can be part of a block. Rows without an id and NULL texts stay
    as they are (a NULL text has 0 lines, an empty one 1); rows equal in id and text lose the same lines. A document
    may lose all its lines, as an exact copy does. Whole texts are read; other columns are not.
    """
    gone = written(deleted_lines(docs, id_column, text, rare, block_words))
    body = F.col(text).cast("string")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("text_hash"))
    rows = rows.join(gone.withColumnRenamed("doc", "doc_id"), ["doc_id", "text_hash"], "left")
    left = F.filter(_lines(F.col("text")), lambda _, i: ~F.array_contains("gone", i))
    return rows.select("doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text"),
                       F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines(F.col("text")))).cast("long").alias("n_lines"),
                       F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0)).cast("long").alias("n_deleted"))

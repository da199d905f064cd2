"""Records of delimited text whose quoted fields span lines, put together by as many tasks as plain lines are read by.

Whether a line starts within a quoted field depends on all lines before it, but what a block of lines does is only a map of two states
(outside, inside) onto themselves. One scan finds the map of each block; maps are composed along each file, one row per block; with the
state at its start known, each block is cut into records by itself. Only the parts of records that cross a block's
end are gathered, at most two per block.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sieveline.sources.shared import written

#: The most blocks that are broadcast as starting within a field: 32 bytes each.
BROADCAST_BLOCKS = 1_000_000
_WHOLE, _HEAD, _MIDDLE, _TAIL = range(4)
_OUT = "file long, block long, kind int, first boolean, value string"


def ends_inside(line: bytes, inside: bool, delimiter: bytes) -> bool:
    """Whether a quoted field is open behind the line. Quotes open a field at its start only; doubled quotes within it are text."""
    opening, at = delimiter + b'"', 0
    if not inside:
        if line[:1] == b'"':
            at = 1
        else:
            at = line.find(opening) + len(opening)
            if at < len(opening):
                return False
    while True:
        at = line.find(b'"', at)
        if at < 0:
            return True
        if line[at + 1:at + 2] == b'"':
            at += 2
            continue
        found = line.find(opening, at + 1)
        if found < 0:
            return False
        at = found + len(opening)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file (a hash of its path), block (where it starts) and value (bytes) of each line, in the order of each block."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.Array]]:
    """(file, block) and the lines of it that a batch holds, in order."""
    for batch in batches:
        files, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        start = 0
        for i in range(1, len(batch) + 1):
            if i == len(batch) or files[i] != files[start] or blocks[i] != blocks[start]:
                yield (files[start], blocks[start]), batch.column(2).slice(start, i - start)
                start = i


def block_maps(spark: SparkSession, path: str, delimiter: str, encoding: str) -> DataFrame:
    """file, block, from_outside, from_inside (whether a field is open behind the block's lines), crlf and old_mac (of a file's first line)."""
    mark = delimiter.encode(encoding)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, out, within, crlf, old = None, False, True, False, False

        def row() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*key, out, within, crlf, old), kinds)],
                                              ["file", "block", "from_outside", "from_inside", "crlf", "old_mac"])

        for found, lines in _pieces(batches):
            if found != key:
                if key is not None:
                    yield row()
                key, out, within = found, False, True
                head = lines[0].as_py() if key[1] == 0 else b""
                crlf, old = head.endswith(b"\r"), b"\r" in head[:-1]
            for line in lines.filter(pc.match_substring(lines, '"')):
                line = line.as_py()
                out, within = ends_inside(line, out, mark), ends_inside(line, within, mark)
        if key is not None:
            yield row()

    return _lines(spark, path).mapInArrow(scan, "file long, block long, from_outside boolean, from_inside boolean, crlf boolean, old_mac boolean")


def open_blocks(maps: DataFrame) -> DataFrame:
    """file, block of the blocks that start within a field.

    A map keeps both states, swaps them, or sends both to one. So the state at a block's start is that of the last block which does the latter
    (outside, if none does), swapped as often as blocks since then swap.
    """
    along = Window.partitionBy("file").orderBy("block")
    swaps = F.sum(F.when(F.col("from_outside") & ~F.col("from_inside"), 1).otherwise(0)).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = maps.withColumn("swaps", swaps)
    fixed = F.when(F.col("from_outside") == F.col("from_inside"), F.struct(F.col("from_outside").cast("int").alias("state"), "swaps"))
    last = F.last(fixed, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    before = F.coalesce(F.lag("swaps").over(along), F.lit(0)) - F.coalesce(F.col("last.swaps"), F.lit(0))
    return (counted.withColumn("last", last).withColumn("state", (F.coalesce(F.col("last.state"), F.lit(0)) + before) % 2)
            .where("state = 1").select("file", "block"))


def _cut(lines: DataFrame, delimiter: str, encoding: str, crlf: bool) -> DataFrame:
    """The records of blocks (file, block, value, inside), and the parts of those that cross a block's end."""
    mark = delimiter.encode(encoding)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, parts, kind, first = None, False, [], _WHOLE, False
        made: list[tuple] = []

        def put(kind: int, value: bytes) -> None:
            nonlocal first
            if kind != _WHOLE or value:
                made.append((*key, kind, first and kind in (_WHOLE, _TAIL), value.decode(encoding)))
                first = first and kind not in (_WHOLE, _TAIL)

        def out() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*made)) or [[]] * 5, kinds)], ["file", "block", "kind", "first", "value"])
            made.clear()
            return batch

        def finish() -> None:
            if key is not None and inside:
                put(_MIDDLE if kind == _HEAD else _TAIL, b"\n".join(parts))

        for batch in batches:
            starts = dict(zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), batch.column(3).to_pylist()))
            for found, lines in _pieces(iter([batch])):
                if found != key:
                    finish()
                    key, inside, parts, first = found, starts[found], [], found[1] == 0
                    kind = _HEAD if inside else _WHOLE
                for line in lines.to_pylist():
                    if crlf and line.endswith(b"\r"):
                        line = line[:-1]
                    if b'"' in line:
                        now = ends_inside(line, inside, mark)
                    elif inside:
                        parts.append(line)
                        continue
                    else:
                        put(_WHOLE, line)
                        continue
                    parts.append(line)
                    inside = now
                    if not inside:
                        put(kind, b"\n".join(parts))
                        parts, kind = [], _WHOLE
            yield out()
        finish()
        yield out()

    return lines.mapInArrow(cut, _OUT)


def records(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "utf-8") -> DataFrame | None:
    """value: the text of each record of the files of a path but the first of each file (its header), empty lines left out.

    Line ends within a record are single. None where this cannot be done by blocks: lines that end by a carriage return alone,
    an encoding in which line ends are not single bytes, or more blocks that start within a field than may be broadcast.
    """
    if "\n\",".encode(encoding) != b"\n\",":
        return None
    maps = written(block_maps(spark, path, delimiter, encoding))
    ends = maps.agg(F.bool_or("crlf").alias("crlf"), F.bool_or("old_mac").alias("old_mac")).first()
    if ends["old_mac"]:
        return None
    opened = written(open_blocks(maps).withColumn("inside", F.lit(True)))
    if opened.limit(BROADCAST_BLOCKS + 1).count() > BROADCAST_BLOCKS:
        return None
    lines = _lines(spark, path).join(F.broadcast(opened), ["file", "block"], "left").select("file", "block", "value", F.coalesce("inside", F.lit(False)).alias("inside"))
    cut = _cut(lines, delimiter, encoding, bool(ends["crlf"]))
    crossing = written(cut.where(f"kind != {_WHOLE}"))
    # A record starts with a tail; what follows in later blocks, up to the next tail, is its own.
    chain = F.last(F.when(F.col("kind") == _TAIL, F.col("block")), ignorenulls=True).over(Window.partitionBy("file").orderBy("block", "kind"))
    parts = crossing.withColumn("chain", chain).groupBy("file", "chain").agg(F.sort_array(F.collect_list(F.struct("block", "kind", "value"))).alias("parts"), F.bool_or("first").alias("first"))
    joined = parts.select("first", F.array_join(F.col("parts.value"), "\n").alias("value"))
    return cut.where(f"kind = {_WHOLE} AND NOT first").select("value").unionByName(written(joined).where("NOT first").select("value"))

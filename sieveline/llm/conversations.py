"""Repair of the structure of conversations at the least cost, by dynamic programming with square-root checkpoints.

A repaired conversation is empty, or has a system message at most, then user and assistant in turn, ending with assistant. Rows may
be kept, given another role, deleted, and empty rows inserted, at a cost each. The least cost from a row on depends on the state only
(nothing yet, after system, after user, after assistant), so it is a vector of four numbers per row. Those are worked out backward,
kept at every square root of the rows, and worked out again block by block while walking forward, where the first
edit in ASCII order that loses nothing is taken.

A conversation may be any part of the table. Rows are sorted by ranges and cut into segments of bounded size. What a segment does to a vector is
a matrix of four by four under minimum and plus, so the vectors at the ends of segments come from one pass over a conversation's
segments; so do the states in which the walk enters each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sieveline.sources.shared import written

#: The bits of the rows of a segment, at least.
SEGMENT_BITS = 13
SPACE = " \t\n\x0b\f\r"
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: The costs of ending in each state, and a cost beyond any.
END, NEVER = (0, 6, 3, 0), 1 << 50
#: Where an inserted or a renamed row leads from each state, and its role; where rows of each role lead.
_NEXT, _ROLE = (USER, USER, ASSISTANT, USER), ("user", "user", "assistant", "user")
_LEADS = ({NOTHING: SYSTEM}, {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {})
_FINE, _CUT_OFF, _GONE = range(3)

Vector = tuple[int, int, int, int]


def before(role: int, fault: int, after: Vector) -> Vector:
    """The least costs before a row (and any insertions there), given those after it. role: 0 to 2 for s, u, a, else 3."""
    w0, w1, w2, w3 = after
    b0, b1, b2, b3 = DELETE + w0, DELETE + w1, DELETE + w2, DELETE + w3
    if fault != _GONE:
        more = TRUNCATED if fault == _CUT_OFF else 0
        user, assistant = REROLE + more + w2, REROLE + more + w3
        if role == 1:
            user = more + w2
        elif role == 2:
            assistant = more + w3
        b0, b1, b2, b3 = min(b0, user), min(b1, user), min(b2, assistant), min(b3, user)
        if role == 0:
            b0 = min(b0, more + w1)
    v2, v3 = min(b2, INSERT + b3), min(b3, INSERT + b2)
    return min(b0, INSERT + v2), min(b1, INSERT + v2), v2, v3


def matrix(codes: list[tuple[int, int]]) -> list[int]:
    """What the rows (role, fault) do to a vector, as four columns: the vectors before them if only one state after them is free."""
    columns: list[Vector] = []
    for free in range(4):
        vector: Vector = tuple(0 if s == free else NEVER for s in range(4))  # type: ignore[assignment]
        for role, fault in reversed(codes):
            vector = before(role, fault, vector)
        columns.append(vector)
    return [min(c, NEVER) for column in columns for c in column]


def walk(codes: list[tuple[int, int]], after: Vector, state: int, last: bool) -> tuple[list[tuple[int, str, str | None, int]], int]:
    """(row, edit, role, cost) of the edits from a state on, and the state behind the rows. Of edits that lose nothing the first in
    ASCII order is taken. `last`: whether the conversation ends with these rows."""
    n = len(codes)
    step = isqrt(n) + 1
    marks, vector = {n: after}, after
    for i in range(n - 1, -1, -1):
        vector = before(*codes[i], vector)
        if i % step == 0:
            marks[i] = vector
    edits: list[tuple[int, str, str | None, int]] = []
    for start in range(0, n, step):
        end = min(start + step, n)
        vectors = [marks[end]]
        for i in range(end - 1, start - 1, -1):
            vectors.append(before(*codes[i], vectors[-1]))
        vectors.reverse()
        for i in range(start, end):
            (role, fault), here, there = codes[i], vectors[i - start], vectors[i - start + 1]
            more = TRUNCATED if fault == _CUT_OFF else 0
            while True:
                left, to = here[state], _NEXT[state]
                if DELETE + there[state] == left:
                    edits.append((i, "D", None, DELETE))
                elif INSERT + here[to] == left:
                    edits.append((i, "I", _ROLE[state], INSERT))
                    state = to
                    continue
                elif (kept := _LEADS[role].get(state)) is not None and more + there[kept] == left:
                    edits.append((i, "K", None, more))
                    state = kept
                else:
                    edits.append((i, "R", _ROLE[state], REROLE + more))
                    state = to
                break
    while last and END[state]:
        edits.append((n - 1, "I", _ROLE[state], INSERT))
        state = _NEXT[state]
    return edits, state


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the rows after damage by the CRC-32 of `conv_id:turn` modulo 20: 0 drops the row, 1 empties its
    text, 2 takes stops (.!?) away, 3 repeats it, 4 makes its role user. NULL roles and texts, and NULLs in the key, are one space."""
    def of(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(of("conv_id"), F.lit(":"), of("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), of("role").alias("role"), of("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.where("kind != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("time")).drop("time")


def in_order(rows: DataFrame) -> DataFrame:
    """pos, conv_id, turn, role, text, stored: pos ascends by conversation and turn (NULLs first), then role and text.

    Rows are dealt by ranges of the whole order, so a conversation may lie in several tasks. NULL roles and texts are one space. Of texts
    with the same first 256 characters the order is that of a hash.
    """
    def of(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)

    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), of("role"), of("text"))
    keys = {"k_head": F.left("text", F.lit(256)), "k_hash": F.xxhash64("text"), "k_row": F.monotonically_increasing_id()}
    order = ["conv_id", "turn", "role", *keys]
    ranged = plain.withColumns(keys).repartitionByRange(*order).sortWithinPartitions(*order)
    return written(ranged.select(F.monotonically_increasing_id().alias("pos"), "conv_id", "turn", "role", "text"))


def marked(rows: DataFrame) -> DataFrame:
    """pos, segment, conv_id, turn, role (0 to 3), initial, fault (blank, duplicate, truncated or NULL) of rows in order, stored."""
    stripped = F.rtrim("text", F.lit(SPACE))
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    light = rows.select("pos", "conv_id", "turn", F.left("role", F.lit(1)).alias("initial"), digest.alias("digest"), (stripped == "").alias("blank"),
                        (~F.right(stripped, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    # The first row of each content; positions are unique, so no key is frequent here.
    firsts = light.groupBy("conv_id", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("is_first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("is_first").isNull(), "duplicate").when(F.col("truncated"), "truncated")
    role = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    bits = max(SEGMENT_BITS, (isqrt(rows.count()) + 1).bit_length())
    return written(light.join(firsts, "pos", "left").select("pos", F.shiftright("pos", bits).alias("segment"), "conv_id", "turn", role.alias("role"), "initial", fault.alias("fault")))


def _runs_of(group: pa.Table) -> Iterator[tuple[int | None, list[int], list[tuple[int, int]], list[str], list[str | None]]]:
    """(conversation, positions, codes, initials, faults) for each conversation's rows in a segment."""
    group = group.sort_by("pos")
    convs, positions, roles, initials, faults = (group[c].to_pylist() for c in ("conv_id", "pos", "role", "initial", "fault"))
    kinds = {None: _FINE, "truncated": _CUT_OFF, "blank": _GONE, "duplicate": _GONE}
    start = 0
    for i in range(1, len(convs) + 1):
        if i == len(convs) or convs[i] != convs[start]:
            yield convs[start], positions[start:i], [(r, kinds[f]) for r, f in zip(roles[start:i], faults[start:i])], initials[start:i], faults[start:i]
            start = i


def runs(marks: DataFrame) -> DataFrame:
    """One row per conversation and segment, stored: conv_id, segment, run (its first position), counts of faults, illegal neighbours within,
    the first and last initial, and its matrix if the conversation may go on in other segments."""
    kinds = "conv_id long, segment long, run long, blank long, duplicate long, truncated long, illegal long, first string, last string, matrix array<long>"
    schema = pa.schema([(n, pa.string() if n in ("first", "last") else pa.list_(pa.int64()) if n == "matrix" else pa.int64()) for n in (k.split()[0] for k in kinds.split(", "))])

    def count(group: pa.Table) -> pa.Table:
        segment = group["segment"][0].as_py()
        found = list(_runs_of(group))
        made = []
        for number, (conv, positions, codes, initials, faults) in enumerate(found):
            illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
            made.append((conv, segment, positions[0], *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, initials[0], initials[-1],
                         matrix(codes) if number in (0, len(found) - 1) else None))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*made), schema.types)], schema=schema)

    found = marks.select("pos", "segment", "conv_id", "role", "initial", "fault").groupBy("segment").applyInArrow(count, kinds)
    in_conversation = Window.partitionBy("conv_id")
    earlier = F.lag("last").over(in_conversation.orderBy("run"))
    joint = F.when(earlier.isNotNull() & ~F.concat(earlier, F.col("first")).isin("su", "ua", "au"), 1).otherwise(0)
    return written(found.withColumn("illegal", F.col("illegal") + joint).withColumn("n_runs", F.count("*").over(in_conversation)))


def _ends(several: DataFrame) -> DataFrame:
    """segment, run, after, last for the runs of conversations with several: the vector behind each."""
    def chain(group: pa.Table) -> pa.Table:
        group = group.sort_by("run")
        after: Vector = END
        found = []
        for segment, run, columns in reversed(list(zip(*(group[c].to_pylist() for c in ("segment", "run", "matrix"))))):
            found.append((segment, run, list(after), not found))
            after = tuple(min(min(columns[4 * to + state] + after[to] for to in range(4)), NEVER) for state in range(4))  # type: ignore[assignment]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_()))], ["segment", "run", "after", "last"])

    return written(several.groupBy("conv_id").applyInArrow(chain, "segment long, run long, after array<long>, last boolean"))


def _entries(several: DataFrame, exits: DataFrame) -> DataFrame:
    """run, state in which the walk enters it, for the runs of conversations with several."""
    def chain(group: pa.Table) -> pa.Table:
        group = group.sort_by("run")
        state, found = NOTHING, []
        for to in group["exits"].to_pylist():
            found.append(state)
            state = to[state]
        return pa.table({"run": group["run"], "state": pa.array(found, pa.int32())})

    return several.join(exits, "run").select("conv_id", "run", "exits").groupBy("conv_id").applyInArrow(chain, "run long, state int")


def edits(marks: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, pos, step, edit, role, cost: the cheapest edits of each conversation, in order of pos and step.

    Edits K, R and D are of the row at pos; an I stands before it, or, with a later step, behind the conversation's last row. Ties
    between edits of one cost go to the string of edits that is least in ASCII order.
    """
    several = found.where("n_runs > 1").select("conv_id", "segment", "run", "matrix")
    ends = _ends(several)
    there = marks.select("pos", "segment", "conv_id", "role", "initial", "fault")

    def leave(key: tuple, rows: pa.Table, info: pa.Table) -> pa.Table:
        of = {r["run"]: r for r in info.to_pylist()}
        made = [(p[0], [walk(codes, tuple(of[p[0]]["after"]), state, False)[1] for state in range(4)]) for _, p, codes, _, _ in _runs_of(rows) if p[0] in of] if of else []
        return pa.table([pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.list_(pa.int32()))], ["run", "exits"])

    only = there.join(ends.select("segment").distinct(), "segment", "left_semi")
    exits = written(only.groupBy("segment").cogroup(ends.groupBy("segment")).applyInArrow(leave, "run long, exits array<int>"))
    info = written(ends.join(_entries(several, exits), "run"))
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64())

    def edit(key: tuple, rows: pa.Table, info: pa.Table) -> pa.Table:
        of = {r["run"]: r for r in info.to_pylist()}
        made = []
        for conv, positions, codes, _, _ in _runs_of(rows) if rows.num_rows else ():
            known = of.get(positions[0], {"after": END, "state": NOTHING, "last": True})
            at, step = -1, 0
            for i, name, role, cost in walk(codes, tuple(known["after"]), known["state"], known["last"])[0]:
                at, step = i, step + 1 if i == at else 0
                made.append((conv, positions[i], step, name, role, cost))
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*made)) or [[]] * 6, kinds)], ["conv_id", "pos", "step", "edit", "role", "cost"])

    return written(there.groupBy("segment").cogroup(info.groupBy("segment")).applyInArrow(edit, "conv_id long, pos long, step int, edit string, role string, cost long"))


def repaired(rows: DataFrame, made: DataFrame) -> DataFrame:
    """conv_id, pos, step, edit, cost, role, text of every edit: those but D, in order of pos and step, are the repaired rows."""
    texts = rows.select("pos", F.col("role").alias("had"), "text")
    return made.join(texts, "pos", "left").select("conv_id", "pos", "step", "edit", "cost", F.coalesce("role", "had").alias("role"),
                                                  F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"))


def digests(lines: DataFrame) -> DataFrame:
    """conv_id, cost, audit (the edits' initials), repaired_sha256 (of `role:text`, joined by line ends) of each conversation.

    A digest needs a conversation's rows one after another: they are sorted and pass through one task, but are not gathered.
    """
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 4, kinds)], ["conv_id", "cost", "audit", "repaired_sha256"])

        open_conv: int | None = None
        cost, audit, sha, any_row, begun = 0, [], hashlib.sha256(), False, False
        for batch in batches:
            ready = []
            for conv, edit, more, role, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if begun and conv != open_conv:
                    ready.append((open_conv, cost, "".join(audit), sha.hexdigest()))
                    cost, audit, sha, any_row = 0, [], hashlib.sha256(), False
                begun, open_conv = True, conv
                cost += more
                audit.append(edit)
                if edit != "D":
                    sha.update((("\n" if any_row else "") + f"{role}:{text}").encode())
                    any_row = True
            yield out(ready)
        if begun:
            yield out([(open_conv, cost, "".join(audit), sha.hexdigest())])

    dealt = lines.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "step").select("conv_id", "edit", "cost", "role", "text")
    return dealt.mapInArrow(digest, "conv_id long, cost long, audit string, repaired_sha256 string")


def report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of `conversations`, as `rows`
    (conv_id, turn, role, text) have it.

    gaps counts the turns missing between the least and the greatest, without NULLs. Each row's first fault counts: blank, a
    role and text seen earlier, an end without .!?. illegal counts neighbours whose initials are not su, ua or au. Rows
    without a conv_id are one conversation; NULL roles and texts are one space. A conversation without rows has zeros, no edits
    and the digest of an empty text. Other columns are not read.
    """
    ordered = in_order(rows)
    marks = marked(ordered)
    found = runs(marks)
    turns = marks.groupBy("conv_id", "turn").agg(F.lit(1)).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    sums = found.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for part in (turns, sums, digests(repaired(ordered, edits(marks, found)))):
        every = every.unionByName(part, allowMissingColumns=True)
    numbers = [F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.groupBy("conv_id").agg(*numbers, F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
                                        F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """The report of the conversations after `damage`."""
    return report(conversations, damage(conversations))

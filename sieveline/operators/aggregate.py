"""One-scan aggregation of many expressions, and independent jobs side by side."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

FIELDS_PER_PASS = 90


def _passes(expressions: dict[Any, str], per_pass: int) -> list[list[Any]]:
    """Keys in batches whose partial results have at most ``per_pass`` fields."""
    batches: list[list[Any]] = []
    room = 0
    for key, expression in expressions.items():
        fields = 3 if expression.startswith("stddev") else 2 if expression.startswith("avg") else 1
        if not batches or fields > room:
            batches.append([])
            room = per_pass
        batches[-1].append(key)
        room -= fields
    return batches


def aggregate_row(df: DataFrame, expressions: dict[Any, str], per_pass: int = FIELDS_PER_PASS) -> dict[Any, Any]:
    """Evaluate every aggregate over the whole table and return the single row as a dict.

    Whole-stage code generation gives up beyond 100 fields, so wide sets are cut into passes.
    Each pass reads only the columns it names.
    """
    result: dict[Any, Any] = {}
    for batch in _passes(expressions, per_pass):
        row = df.selectExpr(*[f"{expressions[key]} AS a{i}" for i, key in enumerate(batch)]).first()
        result.update({key: row[i] for i, key in enumerate(batch)})
    return result


def rows_from_aggregate(df: DataFrame, entries: list[dict[str, str]]) -> DataFrame:
    """Aggregate once, then turn the single wide row into one output row per entry. Lazy.

    Each entry maps output names to aggregate or literal expressions; all entries share the names.
    """
    names = list(entries[0])
    wide = df.selectExpr(*[f"{entry[name]} AS e{i}_{j}" for i, entry in enumerate(entries) for j, name in enumerate(names)])
    structs = ", ".join(
        "struct(" + ", ".join(f"e{i}_{j} AS {name}" for j, name in enumerate(names)) + ")" for i in range(len(entries)))
    return wide.selectExpr(f"inline(array({structs}))")


def side_by_side(spark: SparkSession, *tasks: Callable[[], Any]) -> list[Any]:
    """Results of independent tasks, each of which submits its own Spark jobs from its own thread.

    The jobs of one task fill the executors that the tail of another leaves idle.
    """
    with ThreadPoolExecutor(max_workers=max(1, len(tasks))) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(task)) for task in tasks]
        return [task.result() for task in running]

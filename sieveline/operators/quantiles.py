"""Exact quantiles of many columns without sorting or collecting a column.

Order statistics are found by narrowing. A mergeable quantile sketch proposes two values around
each wanted rank; a counting pass proves which side of them the rank lies on. What remains is an
interval that provably holds the rank, about half a percent of the column, and it shrinks by the
same factor per round. Once an interval is small, its values are counted and ranked on the
cluster and only the wanted ones are fetched. The sketch only chooses where to look, so the
result does not depend on it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions.columns import count_if, double
from sieveline.operators.aggregate import aggregate_row

SKETCH_SIZE = 4000
HALF_WIDTH = 0.0025
SMALL_INTERVAL = 2_000_000
SKETCH_GROUPS = 256
COLUMNS_PER_SKETCH = 30


@dataclass(frozen=True)
class Interval:
    """Values strictly between two bounds (None = open end), ``below`` values lie before them."""

    low: float | None
    high: float | None
    below: int
    size: int

    def cut(self, value: str) -> str:
        bounds = [f"{value} > {double(self.low)}"] if self.low is not None else []
        bounds += [f"{value} < {double(self.high)}"] if self.high is not None else []
        return f"CASE WHEN {' AND '.join(bounds)} THEN {value} END" if bounds else value


@dataclass(frozen=True)
class Quantiles:
    """Quantiles of one column: number of values, and value per probability (None if empty)."""

    n: int
    values: dict[float, float | None]


def _sketch(df: DataFrame, requests: list[tuple[str, list[float]]], weight: str) -> list[tuple[int, list[float]]]:
    """Number of values and approximate quantiles per request (expression, fractions).

    Sketches are merged in two steps, so that the last task merges a fixed number of them and
    not one per input split.
    """
    answers: list[tuple[int, list[float]]] = []
    for start in range(0, len(requests), COLUMNS_PER_SKETCH):
        batch = requests[start:start + COLUMNS_PER_SKETCH]
        slots = range(len(batch))
        partial = (
            df.selectExpr(f"spark_partition_id() % {SKETCH_GROUPS} AS g",
                          *[f"{value} AS v{i}" for i, (value, _) in enumerate(batch)], f"{weight} AS w")
            .groupBy("g").agg(*[F.expr(f"kll_sketch_agg_double(CASE WHEN w > 0 THEN v{i} END, {SKETCH_SIZE}) AS s{i}") for i in slots],
                              *[F.expr(f"sum(CASE WHEN v{i} IS NOT NULL THEN w END) AS n{i}") for i in slots])
        )
        merged = partial.selectExpr(*[f"kll_merge_agg_double(s{i}) AS s{i}" for i in slots], *[f"sum(n{i}) AS n{i}" for i in slots])
        row = merged.selectExpr(
            *[f"n{i}" for i in slots],
            *[f"CASE WHEN kll_sketch_get_n_double(s{i}) > 0 THEN "
              f"kll_sketch_get_quantile_double(s{i}, array({', '.join(map(double, fractions))})) END AS q{i}"
              for i, (_, fractions) in enumerate(batch)],
        ).first()
        answers += [(row[f"n{i}"] or 0, row[f"q{i}"] or []) for i in slots]
    return answers


def _around(fraction: float) -> list[float]:
    return [max(0.0, fraction - HALF_WIDTH), min(1.0, fraction + HALF_WIDTH)]


class _Search:
    """Narrowing state: wanted ranks per column, the interval proven to hold each, and results."""

    def __init__(self, df: DataFrame, columns: dict[str, str], weight: str, small: int):
        self.df, self.columns, self.weight, self.small = df, columns, weight, small
        self.open: dict[tuple[str, int], Interval] = {}
        self.found: dict[tuple[str, int], float] = {}

    def narrow(self, pivots: dict[tuple[str, int], tuple[float, float]]) -> None:
        """Count around the proposed values and move every rank to the part that holds it."""
        seen = aggregate_row(self.df, {
            (name, sign, bound): count_if(f"{self.columns[name]} {sign} {double(bound)}", self.weight)
            for (name, rank), proposed in pivots.items() for bound in proposed for sign in "<="
        })
        for (name, rank), (low, high) in pivots.items():
            was = self.open.pop((name, rank))
            before_low, at_low = seen[name, "<", low], seen[name, "=", low]
            before_high, at_high = seen[name, "<", high], seen[name, "=", high]
            after_low, after_high = before_low + at_low, before_high + at_high
            if before_low <= rank < after_low:
                self.found[name, rank] = low
            elif before_high <= rank < after_high:
                self.found[name, rank] = high
            elif rank < before_low:
                self.open[name, rank] = Interval(was.low, low, was.below, before_low - was.below)
            elif rank < before_high:
                self.open[name, rank] = Interval(low, high, after_low, before_high - after_low)
            else:
                self.open[name, rank] = Interval(high, was.high, after_high, was.below + was.size - after_high)

    def fetch(self) -> None:
        """Rank the distinct values of every small interval and pick the wanted ones."""
        slots: dict[tuple[str, Interval], list[int]] = {}
        for (name, rank), interval in self.open.items():
            if interval.size <= self.small:
                slots.setdefault((name, interval), []).append(rank)
        if not slots:
            return
        labels = [f"s{i}" for i in range(len(slots))]
        ranked = (
            self.df
            .selectExpr(*[f"{interval.cut(self.columns[name])} AS s{i}" for i, (name, interval) in enumerate(slots)],
                        f"{self.weight} AS w")
            .where(" OR ".join(f"{label} IS NOT NULL" for label in labels))
            .unpivot(["w"], labels, "slot", "value").where("value IS NOT NULL")
            .groupBy("slot", "value").agg(F.expr("sum(w) AS n")).where("n > 0")
            .selectExpr("slot", "value", "n", "sum(n) OVER (PARTITION BY slot ORDER BY value) AS upto")
        )
        rows = ranked.where(" OR ".join(
            f"slot = 's{i}' AND {rank - interval.below} BETWEEN upto - n AND upto - 1"
            for i, ((_, interval), ranks) in enumerate(slots.items()) for rank in ranks
        )).collect()
        for i, ((name, interval), ranks) in enumerate(slots.items()):
            for rank in ranks:
                offset = rank - interval.below
                self.found[name, rank] = next(
                    r["value"] for r in rows if r["slot"] == f"s{i}" and r["upto"] - r["n"] <= offset < r["upto"])
                del self.open[name, rank]


def _between(low: float, high: float, share: float) -> float:
    """Linear interpolation, computed from the nearer end."""
    if low == high:
        return low
    return low + (high - low) * share if share < 0.5 else high - (high - low) * (1 - share)


def quantiles(df: DataFrame, columns: dict[str, str], probabilities: tuple[float, ...],
              exact: bool = True, small: int = SMALL_INTERVAL, weight: str | None = None) -> dict[str, Quantiles]:
    """Quantiles with linear interpolation between neighbours. Columns are double; NULL is skipped.

    With a ``weight`` every row counts that many times; negative weights take away rows that
    other rows have put in.
    """
    if not columns:
        return {}
    names = list(columns)
    cells = df.selectExpr(*[f"{columns[name]} AS v{i}" for i, name in enumerate(names)], f"{weight or '1L'} AS weight")
    values = {name: f"v{i}" for i, name in enumerate(names)}
    fractions = [f for p in probabilities for f in (_around(p) if exact else [p])]
    answers = dict(zip(names, _sketch(cells, [(values[name], fractions) for name in names], "weight")))
    if not exact:
        return {name: Quantiles(n, dict(zip(probabilities, found or [None] * len(probabilities))))
                for name, (n, found) in answers.items()}

    search = _Search(cells, values, "weight", small)
    pivots = {}
    for name, (n, found) in answers.items():
        for i, p in enumerate(probabilities if n else ()):
            for rank in {math.floor(p * (n - 1)), math.ceil(p * (n - 1))}:
                search.open[name, rank] = Interval(None, None, 0, n)
                pivots[name, rank] = (found[2 * i], found[2 * i + 1])
    pivots = {key: value for key, value in pivots.items() if search.open[key].size > SKETCH_SIZE}
    while pivots:
        search.narrow(pivots)
        large = [key for key, interval in search.open.items() if interval.size > small]
        requests = [
            (search.open[name, rank].cut(values[name]),
             _around((rank - search.open[name, rank].below + 0.5) / search.open[name, rank].size))
            for name, rank in large
        ]
        proposed = _sketch(cells, requests, "weight") if requests else []
        pivots = {key: (found[0], found[-1]) for key, (_, found) in zip(large, proposed)}
    search.fetch()

    result = {}
    for name, (n, _) in answers.items():
        per_probability: dict[float, float | None] = {}
        for p in probabilities:
            position = p * (n - 1)
            per_probability[p] = None if n == 0 else _between(
                search.found[name, math.floor(position)], search.found[name, math.ceil(position)],
                position - math.floor(position))
        result[name] = Quantiles(n, per_probability)
    return result

"""Columns stored with the wrong type: numbers or dates kept as text, flags kept as integers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from sieveline.functions.columns import INTEGRAL, STRING, count_if, kinds, ref, text
from sieveline.functions.fixed import DATE_HINTS, FLAG_HINTS, FLAG_MIN_ROWS
from sieveline.functions.scalars import parse_number, parse_timestamp
from sieveline.operators.aggregate import aggregate_row
from sieveline.options import Options

NUMERIC_STRING, MIXED_NUMERIC_STRING = "numeric_string", "mixed_numeric_string"
DATE_STRING, BOOLEAN_AS_INTEGER = "date_string", "boolean_as_integer"
SUGGESTED_TYPE = {
    NUMERIC_STRING: "double", MIXED_NUMERIC_STRING: "double",
    DATE_STRING: "timestamp_ntz", BOOLEAN_AS_INTEGER: "boolean",
}


@dataclass(frozen=True)
class TypeIssue:
    column: str
    current_type: str
    issue: str
    n_values: int
    n_convertible: int
    unique_values: tuple[int, ...] = ()

    @property
    def suggested_type(self) -> str:
        return SUGGESTED_TYPE[self.issue]

    @property
    def convertible_pct(self) -> float:
        return self.n_convertible / self.n_values


def suggests(name: str, hints: tuple[str, ...]) -> bool:
    """Whether the lower-cased name contains one of the hints."""
    return any(hint in name.lower() for hint in hints)


def type_expressions(df: DataFrame, columns: list[str] | None = None) -> dict[tuple[str, str], str]:
    """Aggregates behind ``type_issues``, to share a scan with others."""
    wanted = {("", "rows"): "count(1)"}
    for name, kind in kinds(df).items():
        if columns is not None and name not in columns:
            continue
        if kind == STRING:
            wanted[name, "n"] = f"count({ref(name)})"
            wanted[name, "numbers"] = f"count({parse_number(ref(name))})"
            if suggests(name, DATE_HINTS):
                wanted[name, "dates"] = f"count({parse_timestamp(ref(name))})"
        elif kind == INTEGRAL:
            wanted[name, "n"] = f"count({ref(name)})"
            wanted[name, "zeros"] = count_if(f"{ref(name)} = 0")
            wanted[name, "ones"] = count_if(f"{ref(name)} = 1")
    return wanted


def type_issues_from(df: DataFrame, seen: dict[tuple[str, str], int], options: Options = Options()) -> list[TypeIssue]:
    rules, schema = options.type_inference, dict(df.dtypes)
    issues = []
    for name, kind in kinds(df).items():
        n = seen.get((name, "n"), 0)
        if n == 0:
            continue
        if kind == STRING:
            numbers, dates = seen[name, "numbers"], seen.get((name, "dates"), 0)
            if numbers / n >= rules.min_numeric_ratio:
                label = NUMERIC_STRING if numbers == n else MIXED_NUMERIC_STRING
                issues.append(TypeIssue(name, schema[name], label, n, numbers))
            elif suggests(name, DATE_HINTS) and dates / n >= rules.min_date_ratio:
                issues.append(TypeIssue(name, schema[name], DATE_STRING, n, dates))
        elif n == seen["", "rows"] and seen[name, "zeros"] + seen[name, "ones"] == n:
            if suggests(name, FLAG_HINTS) or n > FLAG_MIN_ROWS:
                unique = tuple(v for v, part in ((0, "zeros"), (1, "ones")) if seen[name, part])
                issues.append(TypeIssue(name, schema[name], BOOLEAN_AS_INTEGER, n, n, unique))
    return issues


def type_issues(df: DataFrame, options: Options = Options(), columns: list[str] | None = None) -> list[TypeIssue]:
    """Every mistyped column, from one scan of the string and integer columns.

    A text column is numeric when enough of its values parse as numbers, else a date when its
    name suggests one and enough values parse as dates. An integer column without missing cells
    that holds only 0 and 1 is a flag when its name says so or it has more than fifty rows.
    """
    return type_issues_from(df, aggregate_row(df, type_expressions(df, columns)), options)


def type_issue_table(df: DataFrame, issues: list[TypeIssue]) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(i.column, i.current_type, i.suggested_type, i.issue, i.convertible_pct,
          i.n_values - i.n_convertible, ",".join(map(str, i.unique_values))) for i in issues],
        "column string, current_type string, suggested_type string, issue_type string, "
        "convertible_pct double, non_convertible_count long, unique_values string",
    )


def sample_texts(df: DataFrame, column: str, n: int = 3) -> list[str]:
    """The smallest texts of a column, as examples of what it holds."""
    rows = df.selectExpr(f"{ref(column)} AS value").where("value IS NOT NULL").orderBy("value").limit(n)
    return [row[0] for row in rows.collect()]

"""Delimited text: header, missing tokens, column types and validation, as a splittable scan."""

from __future__ import annotations

import logging
import os

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from sieveline.errors import LoadError, ValidationError
from sieveline.functions.columns import count_if, ref, text
from sieveline.functions.fixed import NA_TOKENS
from sieveline.functions.scalars import parse_number
from sieveline.operators.aggregate import aggregate_row
from sieveline.sources.records import records

SUFFIXES = (".csv", ".tsv", ".txt")
_SURPLUS = "__surplus"
_INTEGER = r"^\s*[+-]?[0-9]+\s*$"
_TRUE, _FALSE = ("True", "TRUE", "true"), ("False", "FALSE", "false")

logger = logging.getLogger(__name__)


def _shape(spark: SparkSession, path: str, encoding: str) -> tuple[bool, bool, bool]:
    """One scan of the raw lines: has any line, has quotes that stay open at a line end, is badly encoded.

    A quoted field that spans lines leaves an odd number of quotes on its first line. Only then
    records must be put together from lines.
    """
    lines = spark.read.text(path)
    checks = {
        "lines": "count(1)",
        "open": count_if("length(value) % 2 <> length(replace(value, '\"', '')) % 2"),
        "invalid": count_if("NOT is_valid_utf8(value)") if encoding.lower().replace("_", "-") in ("utf-8", "utf8") else "0L",
    }
    seen = aggregate_row(lines, checks)
    return seen["lines"] > 0, seen["open"] > 0, seen["invalid"] > 0


def _unique(names: list[str | None]) -> list[str]:
    """Header names made addressable: empty ones are numbered, repeated ones get .1, .2, ..."""
    taken: set[str] = set()
    result = []
    for i, name in enumerate(names):
        base = name if name else f"Unnamed: {i}"
        candidate, n = base, 0
        while candidate in taken:
            n += 1
            candidate = f"{base}.{n}"
        taken.add(candidate)
        result.append(candidate)
    return result


def _column_types(raw: DataFrame, names: list[str]) -> tuple[int, int, dict[str, str]]:
    """Rows, rows with surplus fields, and the SQL type of every text column, from one scan.

    Types are boolean, bigint, double or string. Integers with missing cells become double, flags
    with missing cells stay text, a column without any value is double. Dates stay text.
    """
    wanted = {("", "rows"): "count(1)", ("", "surplus"): f"count({_SURPLUS})"}
    for name in names:
        column = ref(name)
        wanted[name, "n"] = f"count({column})"
        wanted[name, "flags"] = count_if(f"{column} IN ({', '.join(text(v) for v in _TRUE + _FALSE)})")
        wanted[name, "whole"] = count_if(f"{column} RLIKE {text(_INTEGER)} AND try_cast(trim({column}) AS BIGINT) IS NOT NULL")
        wanted[name, "numbers"] = f"count({parse_number(column)})"
    seen = aggregate_row(raw, wanted)
    types = {}
    for name in names:
        n, complete = seen[name, "n"], seen[name, "n"] == seen["", "rows"]
        if n == 0:
            types[name] = "double"
        elif seen[name, "flags"] == n:
            types[name] = "boolean" if complete else "string"
        elif seen[name, "whole"] == n and complete:
            types[name] = "bigint"
        else:
            types[name] = "double" if seen[name, "numbers"] == n else "string"
    return seen["", "rows"], seen["", "surplus"], types


def _headers(spark: SparkSession, path: str) -> int:
    """How many different first lines the files of a path have; only the first block of each file is read."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start").where("file_block_start = 0")
    lines = lines.select("file_path", F.regexp_replace("value", "^\ufeff|\r$", "").alias("line"), F.monotonically_increasing_id().alias("place"))
    firsts = lines.groupBy("file_path").agg(F.min_by("line", "place").alias("first"))
    return firsts.select("first").distinct().limit(2).count()


def read_csv(spark: SparkSession, path: str, encoding: str = "utf-8", delimiter: str = ",") -> DataFrame:
    """Read a headed, delimited text file (or a folder of them, all with the same header) with inferred column types."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix not in SUFFIXES:
        raise LoadError(f"unsupported file type {suffix!r}; expected one of {', '.join(SUFFIXES)}")
    try:
        any_line, open_quotes, invalid = _shape(spark, path, encoding)
    except AnalysisException as error:
        raise LoadError(f"cannot read {path}: {error.getCondition() or error}") from error
    if not any_line:
        raise LoadError(f"{path} is empty")
    if invalid:
        raise LoadError(f"{path} is not valid {encoding}; try encoding='iso-8859-1'")
    if _headers(spark, path) > 1:
        raise LoadError(f"the files of {path} differ in their headers; read them one by one and join them by name")
    reader = (
        spark.read.option("sep", delimiter).option("encoding", encoding).option("quote", '"').option("escape", '"')
        .option("multiLine", open_quotes).option("mode", "PERMISSIVE")
    )
    try:
        header = reader.csv(path).first()
    except (PySparkException, ValueError) as error:
        raise LoadError(f"cannot read the header of {path} as {encoding}: {error}") from error
    names = _unique(list(header))
    if len(names) == 1:
        logger.warning("%s has a single column; is %r the right delimiter?", path, delimiter)
    schema = ", ".join(f"{ref(n)} STRING" for n in [*names, _SURPLUS])
    spanning = records(spark, path, delimiter, encoding) if open_quotes else None
    if spanning is None:
        raw = reader.option("header", True).option("enforceSchema", True).schema(schema).csv(path)
    else:
        form = {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
        raw = spanning.select(F.from_csv("value", schema, form).alias("record")).select("record.*")
    tokens = ", ".join(text(t) for t in NA_TOKENS)
    cells = raw.selectExpr(*[f"CASE WHEN {ref(n)} NOT IN ({tokens}) THEN {ref(n)} END AS {ref(n)}" for n in names], _SURPLUS)
    n_rows, n_surplus, types = _column_types(cells, names)
    if n_surplus:
        raise LoadError(f"{path} has rows with more than the {len(names)} fields of its header; check the delimiter")
    if n_rows == 0:
        raise ValidationError(f"{path} has a header but no rows")

    def typed(name: str) -> str:
        if types[name] == "double":
            return parse_number(ref(name))
        if types[name] == "boolean":
            return f"{ref(name)} IN ({', '.join(text(v) for v in _TRUE)})"
        return f"CAST(trim({ref(name)}) AS BIGINT)" if types[name] == "bigint" else ref(name)

    return cells.selectExpr(*[f"{typed(n)} AS {ref(n)}" for n in names])

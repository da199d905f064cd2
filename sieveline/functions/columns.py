"""Column references, column kinds and the one definition of a missing value.

Expressions are built as Spark SQL text and handed over with ``selectExpr`` / ``expr``: checks
produce many expressions per column, and one text per expression is far cheaper to build from
Python than a tree of Column objects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sieveline.errors import ValidationError

INTEGRAL, FLOATING, DECIMAL = "integral", "floating", "decimal"
BOOLEAN, STRING, DATETIME, OTHER = "boolean", "string", "datetime", "other"
NUMERIC_KINDS = (INTEGRAL, FLOATING, DECIMAL)


def ref(name: str) -> str:
    """The column called exactly ``name``, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def text(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def double(value: float) -> str:
    """A double literal that keeps every bit."""
    return f"CAST('{float(value)!r}' AS DOUBLE)"


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.IntegralType):
        return INTEGRAL
    if isinstance(data_type, T.DecimalType):
        return DECIMAL
    if isinstance(data_type, T.FractionalType):
        return FLOATING
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return STRING
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    return OTHER


def kinds(df: DataFrame) -> dict[str, str]:
    """Kind of every column, in order. Names must be unique to be addressable."""
    names = [f.name for f in df.schema.fields]
    if not names:
        raise ValidationError("the table has no columns")
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValidationError(f"duplicate column names: {', '.join(repeated)}")
    return {f.name: kind_of(f.dataType) for f in df.schema.fields}


def numeric_columns(df: DataFrame) -> list[str]:
    return [name for name, kind in kinds(df).items() if kind in NUMERIC_KINDS]


def string_columns(df: DataFrame) -> list[str]:
    return [name for name, kind in kinds(df).items() if kind == STRING]


def has_map(data_type: T.DataType) -> bool:
    """Whether values of this type hold a map, which Spark can neither hash nor order."""
    if isinstance(data_type, T.MapType):
        return True
    if isinstance(data_type, T.ArrayType):
        return has_map(data_type.elementType)
    if isinstance(data_type, T.StructType):
        return any(has_map(f.dataType) for f in data_type.fields)
    return False


def is_missing(name: str, kind: str) -> str:
    """NULL for every type, and NaN too for float and double. Never NULL itself."""
    return f"({ref(name)} IS NULL OR isnan({ref(name)}))" if kind == FLOATING else f"({ref(name)} IS NULL)"


def present(name: str, kind: str) -> str:
    """The column with its own type and NaN turned into NULL."""
    return f"CASE WHEN NOT isnan({ref(name)}) THEN {ref(name)} END" if kind == FLOATING else ref(name)


def number(name: str, kind: str) -> str:
    """The column as double with NaN turned into NULL, so comparisons skip missing cells."""
    value = f"CAST({ref(name)} AS INT)" if kind == BOOLEAN else present(name, kind)
    return f"CAST({value} AS DOUBLE)"


def missing_cells(column_kinds: dict[str, str]) -> str:
    """How many of the given columns are missing in the row."""
    return "(" + " + ".join(f"CAST({is_missing(n, k)} AS INT)" for n, k in column_kinds.items()) + ")"


def count_if(condition: str, weight: str | None = None) -> str:
    """Number (or total weight) of the rows for which the condition holds, 0 on an empty table."""
    if weight is None:
        return f"count(CASE WHEN {condition} THEN 1 END)"
    return f"coalesce(sum(CASE WHEN {condition} THEN {weight} END), 0)"


def slot_name(names: list[str]) -> str:
    """Column name behind an unpivoted slot label ``v<position>``."""
    return f"element_at(array({', '.join(text(n) for n in names)}), CAST(substring(slot, 2) AS INT) + 1)"

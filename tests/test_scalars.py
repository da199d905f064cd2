import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sieveline.functions.fixed import WHITESPACE
from sieveline.functions.scalars import estimate_tokens, normalize, parse_number, parse_timestamp, short_key, strip


def evaluate(spark, expression, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string") \
        .selectExpr("i", f"{expression} AS r").orderBy("i").collect()
    return [r["r"] for r in rows]


def test_strip_removes_what_python_removes(spark):
    values = [f"{ch}a b{ch}" for ch in WHITESPACE] + ["​x​", "", " ", None]
    assert evaluate(spark, strip("s"), values) == [None if v is None else v.strip() for v in values]


def test_normalize_options(spark):
    assert evaluate(spark, normalize("s"), [" Ab "]) == ["ab"]
    assert evaluate(spark, normalize("s", case=False), [" Ab "]) == ["Ab"]
    assert evaluate(spark, normalize("s", whitespace=False), [" Ab "]) == [" ab "]


@pytest.mark.parametrize("text, value", [
    ("1", 1.0), (" 1.5\t", 1.5), ("-.5", -0.5), ("1.", 1.0), ("+3", 3.0), ("1e3", 1000.0), ("\xa07 ", 7.0),
    ("inf", math.inf), ("-Infinity", -math.inf), ("1e400", None), ("nan", None), ("1d", None), ("0x10", None),
    ("1_000", None), ("1,000", None), ("", None), ("abc", None), (None, None),
])
def test_parse_number(spark, text, value):
    assert evaluate(spark, parse_number("s"), [text]) == [value]


def test_parse_timestamp_layouts(spark):
    known = {
        "2024-01-05": "2024-01-05 00:00:00", "2024-1-5": "2024-01-05 00:00:00", " 2024-01-05 10:11:12.5 ": "2024-01-05 10:11:12.500000",
        "2024-01-05T10:11:12": "2024-01-05 10:11:12", "20240105": "2024-01-05 00:00:00", "01/05/2024": "2024-01-05 00:00:00",
        "13/05/2024": "2024-05-13 00:00:00", "05/13/2024 10:30": "2024-05-13 10:30:00", "Jan 5, 2024": "2024-01-05 00:00:00",
        "2024": "2024-01-01 00:00:00", "unknown": None, "12:30": None, "202": None, "9999-12-31": None, "2024-13-01": None,
        "31/02/2024": None, "": None,
    }
    found = evaluate(spark, parse_timestamp("s"), list(known))
    assert [None if f is None else str(f) for f in found] == list(known.values())


def test_short_key_separates_texts(spark):
    values = ["a", "a" * 64, "a" * 65, "a" * 66, "é" * 32, "é" * 33, None]
    keys = evaluate(spark, short_key("s"), values)
    assert keys[:2] == values[:2] and keys[4] == values[4] and keys[-1] is None
    assert len(set(keys)) == len(values)
    assert all(len(k) > 64 for k in (keys[2], keys[3], keys[5]))


def test_estimate_tokens(spark):
    assert evaluate(spark, estimate_tokens("s"), ["", None, "a", "a" * 7, "a" * 8, "é" * 7]) == [0, 0, 1, 2, 3, 2]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=1, max_size=20))
def test_numbers_survive_text(spark, numbers):
    assert evaluate(spark, parse_number("s"), [repr(n) for n in numbers]) == numbers

import numpy as np
import pytest

from sieveline.operators import quantiles as module
from sieveline.operators.quantiles import quantiles

PROBABILITIES = (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)


def expect(found, values):
    assert found.n == len(values)
    for p, value in found.values.items():
        assert value == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("small", [2_000_000, 50])
def test_matches_numpy_on_spread_tied_and_skewed_values(spark, small):
    rng = np.random.default_rng(3)
    n = 30_000
    spread, tied = rng.normal(size=n) * 1e6, rng.integers(0, 5, n).astype(float)
    hot = np.where(rng.random(n) < 0.4, 7.0, rng.exponential(size=n) * 100)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(spread, tied, hot)], "spread double, tied double, hot double").repartition(7)
    found = quantiles(df, {"spread": "spread", "tied": "tied", "hot": "hot"}, PROBABILITIES, small=small)
    for name, values in (("spread", spread), ("tied", tied), ("hot", hot)):
        expect(found[name], values)


def test_result_does_not_depend_on_the_sketch(spark, monkeypatch):
    """Useless proposals only cost rounds: the counts still narrow to the right value."""
    values = [float(v) for v in np.random.default_rng(5).permutation(20_000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    honest = module._sketch
    calls = []

    def misleading(table, requests, weight):
        answers = honest(table, requests, weight)
        calls.append(1)
        return [(n, [19_990.0] * len(q)) for n, q in answers] if len(calls) == 1 else answers

    monkeypatch.setattr(module, "_sketch", misleading)
    expect(quantiles(df, {"v": "v"}, (0.25, 0.5), small=100)["v"], values)
    assert len(calls) > 1


def test_empty_single_and_infinite(spark):
    df = spark.createDataFrame([(None, 3.0, float("inf")), (None, None, 1.0), (None, None, 2.0)], "a double, b double, c double")
    found = quantiles(df, {"a": "a", "b": "b", "c": "c"}, (0.25, 0.5))
    assert found["a"].n == 0 and found["a"].values == {0.25: None, 0.5: None}
    assert found["b"].values == {0.25: 3.0, 0.5: 3.0}
    assert found["c"].values[0.5] == 2.0


def test_weights_take_rows_away(spark):
    values = [float(v % 97) for v in range(12_000)]
    removed = [5.0] * 60 + [40.0] * 30
    df = spark.createDataFrame([(v, 1) for v in values] + [(5.0, -60), (40.0, -30)], "v double, w long")
    left = list(values)
    for v in removed:
        left.remove(v)
    for small in (2_000_000, 10):
        expect(quantiles(df, {"v": "v"}, PROBABILITIES, weight="w", small=small)["v"], left)


def test_approximate_option(spark):
    df = spark.range(10_000).selectExpr("CAST(id AS DOUBLE) AS v")
    assert quantiles(df, {"v": "v"}, (0.5,), exact=False)["v"].values[0.5] == pytest.approx(5000, abs=100)

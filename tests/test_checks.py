import os

import pytest

from helpers import rows
from sieveline import Options, profile, register_check, unregister_check
from sieveline.errors import ValidationError
from sieveline.operators import cardinality, categories, duplicates, missing, outliers, suspicious, types
from sieveline.plans.profile import CheckResult
from sieveline.sources.shared import written

NAN = float("nan")


def options(**sections):
    return Options.from_dict(sections)


# --- missing ---

def test_missing_counts_null_and_nan(spark):
    df = spark.createDataFrame([(1.0, "a", None), (NAN, None, None), (None, "", 5)], "x double, s string, i int")
    assert rows(missing.missing_by_column(df)) == [("i", 2, 2 / 3), ("s", 1, 1 / 3), ("x", 2, 2 / 3)]
    assert rows(missing.missing_totals(df)) == [(5, 5 / 9, 3)]
    assert rows(missing.sparse_rows(df)) == [(3, 1)]


def test_missing_actions_and_thresholds(spark):
    df = spark.createDataFrame([(float(i) if i else None, None if i < 9 else "x", i) for i in range(10)], "x double, s string, i int")
    assert rows(missing.missing_column_actions(df)) == [("s", 9, 0.9, "drop_column"), ("x", 1, 0.1, "impute_median")]
    relaxed = options(missing_values={"drop_column_threshold": 0.95, "categorical_imputation": "none", "numeric_imputation": "mean"})
    assert rows(missing.missing_column_actions(df, relaxed)) == [("s", 9, 0.9, "impute_none"), ("x", 1, 0.1, "impute_mean")]


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, None), (None, "b")], "`a.b` int, `it's ``x``` string")
    assert rows(missing.missing_by_column(df)) == [("it's `x`", 1, 0.5), ("a.b", 1, 0.5)]


# --- duplicates ---

def with_copies(spark):
    return spark.createDataFrame(
        [(1, "a", 0.0), (2, "a", -0.0), (3, "b", NAN), (4, "b", NAN), (5, None, None), (6, None, None), (7, "c", 1.0), (8, "a", 0.0)],
        "id int, s string, x double")


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_duplicate_counts(spark, limit):
    df, opts = with_copies(spark).drop("id"), options(scale={"broadcast_rows": limit})
    assert duplicates.count_duplicates(df, "first", opts) == 4
    assert duplicates.count_duplicates(df, "last", opts) == 4
    assert duplicates.count_duplicates(df, "none", opts) == 7
    assert duplicates.count_duplicates(df.limit(0), "first", opts) == 0


@pytest.mark.parametrize("keep, ids", [("first", [2, 4, 6, 8]), ("last", [1, 2, 3, 5]), ("none", [1, 2, 3, 4, 5, 6, 8])])
def test_duplicate_samples(spark, keep, ids):
    assert [r[0] for r in duplicates.duplicate_samples(with_copies(spark), "id", keep).collect()] == ids


def test_hot_duplicate_group_gives_the_ten_smallest(spark):
    df = spark.range(5000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE CAST(id AS STRING) END AS s")
    assert [r[0] for r in duplicates.duplicate_samples(df, "id").collect()] == [3 * i for i in range(1, 11)]
    assert [r[0] for r in duplicates.duplicate_samples(df, "id", "last").collect()] == [3 * i for i in range(10)]
    assert duplicates.count_duplicates(df.drop("id")) == 1666


def test_map_and_nested_columns(spark):
    df = spark.sql("SELECT * FROM VALUES (map('a', 1), array(1)), (map('a', 1), array(1)), (map('a', 2), array(1)) AS t(m, a)")
    assert duplicates.count_duplicates(df) == 1


# --- types ---

def issues(df, **sections):
    return {i.column: (i.issue, i.n_convertible) for i in types.type_issues(df, options(**sections))}


def test_numeric_strings(spark):
    df = spark.createDataFrame([(str(i), "x" if i == 0 else f" {i}.5 ", "x" if i < 2 else "1") for i in range(20)], "a string, b string, c string")
    assert issues(df) == {"a": ("numeric_string", 20), "b": ("mixed_numeric_string", 19)}
    assert "c" in issues(df, type_inference={"min_numeric_ratio": 0.9})


def test_dates_need_name_and_content(spark):
    df = spark.createDataFrame([("2024-01-01", "2024-01-01", "soon")] * 5 + [("soon", None, "soon")], "created string, text string, on_date string")
    assert issues(df) == {"created": ("date_string", 5)}


def test_flags_need_a_complete_column(spark):
    df = spark.createDataFrame([(i % 2, None if i == 3 else i % 2, i % 2, i) for i in range(40)], "is_new int, is_old int, other int, id int")
    assert issues(df) == {"is_new": ("boolean_as_integer", 40)}
    assert "other" in issues(df.union(df))


# --- outliers ---

def test_iqr_zscore_and_both(spark):
    df = spark.createDataFrame([(10.0 + i % 5, 5.0) for i in range(40)] + [(1000.0, 5.0), (None, 5.0), (NAN, 5.0)], "x double, same double")
    found = outliers.outliers(df)
    assert list(found) == ["x"] and found["x"].n_outliers == 1 and (found["x"].lower_fence, found["x"].upper_fence) == (8.0, 16.0)
    by_z = outliers.outliers(df, options(outliers={"method": "zscore"}))
    assert by_z["x"].n_outliers == 1 and by_z["x"].lower_fence is None and by_z["x"].max_zscore > 3
    assert outliers.outliers(df, options(outliers={"method": "both"}))["x"].n_outliers == 1


def test_zero_spread_flags_all_other_values(spark):
    df = spark.createDataFrame([(1.0,)] * 20 + [(2.0,), (3.0,)], "x double")
    assert outliers.outliers(df)["x"].n_outliers == 2


def test_few_values_and_infinities_are_left_alone(spark):
    df = spark.createDataFrame([(1.0, float("inf")), (2.0, float("inf")), (99.0, 1.0), (None, 2.0)], "x double, y double")
    assert outliers.outliers(df, options(outliers={"method": "both"})) == {}


def test_examples_with_and_without_row_id(spark):
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(50)] + [(60 - i, 1000.0 + i % 4) for i in range(8)], "id int, x double")
    found = outliers.outliers(df, columns=["x"])
    assert [r["value"] for r in outliers.outlier_examples(df, found).orderBy("nth").collect()] == [1000.0, 1001.0, 1002.0, 1003.0]
    assert [r["value"] for r in outliers.outlier_examples(df, found, row_id="id").orderBy("nth").collect()] == [1003.0, 1002.0, 1001.0, 1000.0, 1003.0]


# --- cardinality ---

def test_cardinality_classes(spark):
    df = spark.createDataFrame([(i, "v1", "yes" if i else "no", None, i % 2, "long " * 30 + str(i % 3)) for i in range(100)],
                               "id int, version string, answer string, nothing string, half int, words string")
    found = cardinality.cardinality_issues(df)
    assert (found.constant, found.near_constant, found.high_cardinality) == (("version",), ("answer",), ("id",))
    assert found.counts["words"].n_distinct == 3 and found.counts["nothing"].n_distinct == 0
    assert rows(cardinality.near_constant_table(df, found)) == [("answer", "yes", 99, 0.99, 2)]
    assert cardinality.constant_columns(df) == {"version": "v1"}
    assert rows(cardinality.top_values(df, ["half"])) == [("half", 1, "0", 50), ("half", 2, "1", 50)]
    approximate = cardinality.distinct_counts(df, options(scale={"exact_distinct": False}))
    assert 90 <= approximate["id"].n_distinct <= 110
    sketched = cardinality.cardinality_issues(df, options(scale={"exact_distinct": False}))
    assert (sketched.constant, sketched.near_constant) == (found.constant, found.near_constant)
    assert rows(cardinality.near_constant_table(df, sketched)) == rows(cardinality.near_constant_table(df, found))
    lower = options(scale={"exact_distinct": False}, cardinality={"near_constant_threshold": 0.5})
    assert cardinality.cardinality_issues(df, lower).near_constant == ("answer", "half")


def test_unique_columns_need_no_counting(spark):
    df = spark.createDataFrame([(i, f"name {i:03d}", float(i) if i else None) for i in range(50)], "id int, name string, x double")
    names = ["id", "name", "x"]
    assert rows(cardinality.smallest_values(df, names)) == rows(cardinality.top_values(df, names))
    counts = cardinality.distinct_counts(df)
    assert cardinality.has_unique_column(counts, 50) and not cardinality.has_unique_column({"x": counts["x"]}, 50)
    found = profile(df)
    assert found.copies.hashes is None and found.n_duplicates == 0
    assert found.results["cardinality"].details["high_cardinality_columns"]["name"]["top_3_values"] == ["name 000", "name 001", "name 002"]


def test_zero_signs_and_nan_are_one_value(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (NAN,), (None,)], "x double")
    assert cardinality.distinct_counts(df)["x"].n_distinct == 1
    assert cardinality.constant_columns(df) == {"x": "0.0"}


# --- categories ---

def test_clusters(spark):
    long = "Word " * 20
    df = spark.createDataFrame([("Male", long), ("male", long.upper()), (" MALE\t", "b"), ("x", "b"), (None, None)], "g string, t string")
    assert rows(categories.category_counts(df)) == [("g", 4, 2, 2), ("t", 3, 2, 1)]
    assert [r[2:4] for r in rows(categories.category_clusters(df, ["g"]))] == [(" MALE\t", 3), ("Male", 3), ("male", 3)]
    kept = options(categories={"normalize_case": False})
    assert rows(categories.category_counts(df.select("g"), kept)) == [("g", 4, 4, 0)]
    off = options(categories={"normalize_case": False, "strip_whitespace": False})
    assert rows(categories.category_counts(df, off)) == []


def test_long_and_short_spellings_meet(spark):
    """A value just below the key length and its longer, padded spelling are one category."""
    df = spark.createDataFrame([("a" * 64,), ("A" * 64 + "  ",), ("a" * 63 + "B",)], "s string")
    assert rows(categories.category_counts(df)) == [("s", 3, 2, 1)]


# --- suspicious values ---

def test_negative_sentinel_extreme(spark):
    df = spark.createDataFrame([(10.0 + i % 7, float(i % 5) - 2, 3.0) for i in range(60)] + [(-999.0, 0.0, 3.0), (-999.0, 0.0, 3.0), (88000.0, 0.0, 99.0)],
                               "price double, delta double, level double")
    found = {(r["column"], r["finding_type"], r["value"]): r["n"] for r in suspicious.suspicious_values(df).collect()}
    assert found == {("price", suspicious.NEGATIVE, -999.0): 2, ("price", suspicious.EXTREME, 88000.0): 1,
                     ("level", suspicious.SENTINEL, 99.0): 1}
    assert rows(suspicious.suspicious_totals(suspicious.suspicious_values(df))) == [(4, 2)]


def test_sentinel_without_variation_is_flagged(spark):
    df = spark.createDataFrame([(-1.0,), (-1.0,)], "delta double")
    assert [(r["finding_type"], r["n"]) for r in suspicious.suspicious_values(df).collect()] == [(suspicious.SENTINEL, 2)]


def test_sample_ids_of_a_hot_value(spark):
    df = spark.range(1000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN -5D ELSE 10D END AS price")
    (row,) = suspicious.suspicious_values(df, columns=["price"], types=(suspicious.NEGATIVE,), row_id="id").collect()
    assert row["n"] == 334 and row["sample_ids"] == [str(3 * i) for i in range(10)]


# --- whole profile ---

def test_profile_of_the_shop(shop):
    found = profile(shop)
    severities = {n: r.severity for n, r in found.results.items()}
    assert severities == {"missing_values": "critical", "duplicates": "warning", "type_inference": "warning", "outliers": "warning",
                          "cardinality": "critical", "category_consistency": "warning", "suspicious_values": "warning"}
    assert found.results["missing_values"].details["total_missing_cells"] == 16
    assert [i.column for i in found.type_issues] == ["joined_on", "code", "is_member"]
    assert found.results["cardinality"].details["constant_columns"] == ["comment", "source"]
    assert found.check_summary().count() == 7
    (table,) = found.table_profile().collect()
    assert (table["n_rows"], table["n_cols"], table["duplicate_rows"]) == (11, 9, 1)
    found.release()


def test_result_does_not_depend_on_partitioning(shop):
    first, second = profile(shop), profile(shop.repartition(5, "price"))
    assert {n: r.details for n, r in first.results.items()} == {n: r.details for n, r in second.results.items()}
    assert rows(first.findings()) == rows(second.findings())


def test_clean_table_has_no_issues(spark):
    df = spark.createDataFrame([(i % 10 + 20, ["ann", "bob", "cleo"][i % 3], i % 2 == 0, i % 4) for i in range(12)], "age int, name string, on boolean, k int")
    assert [n for n, r in profile(df).results.items() if r.issues_found] == []


def test_empty_and_ambiguous_tables_are_refused(spark, shop):
    with pytest.raises(ValidationError):
        profile(shop.where("false"))
    with pytest.raises(ValidationError):
        profile(shop.selectExpr("id", "city AS id"))
    with pytest.raises(ValidationError):
        profile(shop, row_id="nothing")


def test_failing_check_does_not_stop_the_others(shop, monkeypatch):
    def broken(*_, **__):
        raise ValueError("broken")

    monkeypatch.setattr(categories, "inconsistent_columns", broken)
    found = profile(shop)
    assert found.results["category_consistency"].severity == "warning"
    assert found.results["category_consistency"].details["error"] == "broken"
    assert found.results["duplicates"].issues_found
    assert found.findings().where("finding_type = 'error'").count() == 1


def test_own_check(shop):
    register_check("many_rows", lambda p: CheckResult("many_rows", p.n_rows > 5, "info", ["id"], "many"))
    try:
        found = profile(shop)
        assert found.results["many_rows"].issues_found and found.findings().where("check = 'many_rows'").count() == 1
    finally:
        unregister_check("many_rows")
    with pytest.raises(ValidationError):
        register_check("outliers", lambda p: None)


def test_release_deletes_what_was_stored(spark):
    df = spark.range(100).selectExpr("id % 90 AS a", "'x' AS b")
    copies = duplicates.find_copies(df)
    folders = [f.rpartition("/")[0].removeprefix("file:") for t in copies.stored for f in t.inputFiles()]
    assert copies.count() == 10 and folders and all(os.path.isdir(f) for f in folders)
    copies.release()
    assert not any(os.path.exists(f) for f in folders)
    kept_table = written(df)  # a table of one's own stays
    duplicates.find_copies(kept_table, Options.from_dict({"scale": {"broadcast_rows": 0}})).release()
    assert kept_table.count() == 100

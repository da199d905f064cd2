import pytest

from helpers import rows
from sieveline import CleaningPlan, Options, clean, register_fix, unregister_fix
from sieveline.errors import PlanError
from sieveline.operators import duplicates, fixes
from sieveline.plans import fit as fitting
from sieveline.plans import standalone
from sieveline.plans.run import rank_issues
from sieveline.sources.sinks import write_plan


def options(**sections):
    return Options.from_dict(sections)


def by_id(df):
    return {r["id"]: r for r in df.collect()}


# --- the whole run on the shop: 11 rows, 9 columns ---

def test_default_run(shop):
    run = clean(shop)
    steps = {s.name: (s.rows_before, s.rows_after, s.cols_before, s.cols_after) for s in run.steps}
    assert steps == {
        "drop_duplicates": (11, 10, 9, 9), "constant_columns": (10, 10, 9, 7), "type_caster": (10, 10, 7, 7),
        "category_normalizer": (10, 10, 7, 7), "missing_values": (10, 10, 7, 7), "outlier_handler": (10, 10, 7, 8),
    }
    cleaned = run.cleaned
    assert dict(cleaned.dtypes) == {
        "id": "bigint", "city": "string", "price": "double", "joined_on": "timestamp_ntz", "code": "double",
        "is_member": "boolean", "score": "double", "price_is_outlier": "boolean"}
    found = by_id(cleaned)
    assert len(found) == 10
    # median of the eight distinct-row prices: -999 10 11 12 12 13 14 60000
    assert found[3]["price"] == 12.0 and found[8]["price"] == 12.0
    assert found[5]["city"] == "oslo" and found[8]["city"] == "oslo"
    # median of the eight scores 5 6 7 5 6 7 5 6
    assert found[2]["score"] == 6.0
    assert str(found[2]["joined_on"]) == "2024-01-17 00:00:00" and str(found[3]["joined_on"]) == "2024-02-11 00:00:00"
    assert sorted(i for i, r in found.items() if r["price_is_outlier"]) == [6, 10]
    run.release()


def test_operations_count_what_was_done(shop):
    run = clean(shop)
    done = {(r["type"], r["column"]): r["n_cells"] for r in run.operations_table().collect()}
    assert done == {
        ("drop_rows", None): 1, ("drop_column", "comment"): None, ("drop_column", "source"): None, ("cast_column", "joined_on"): 10,
        ("cast_column", "code"): 10, ("cast_column", "is_member"): 10, ("normalize_category", "city"): 8,
        ("impute_column", "city"): 2, ("impute_column", "price"): 2, ("impute_column", "score"): 2, ("flag_outlier", "price"): 2}
    (stats,) = run.run_stats().collect()
    assert stats.asDict() == {"rows_original": 11, "rows_final": 10, "rows_removed": 1, "cols_original": 9, "cols_final": 8,
                              "cols_removed": 1, "issues_found": 7, "cleaners_applied": 6, "cleaners_skipped": 0}
    (gate,) = run.quality_gate().collect()
    assert gate["has_critical_issues"] and gate["n_critical"] == 2 and gate["n_warning"] == 5


@pytest.mark.parametrize("action, keep, method", [("cap", "none", "both"), ("drop", "last", "zscore")])
def test_audit_agrees_with_the_cleaned_table(shop, action, keep, method):
    run = clean(shop, options(outliers={"action": action, "method": method, "zscore_threshold": 1.5}, duplicates={"keep": keep},
                              missing_values={"numeric_imputation": "mean", "drop_column_threshold": 0.95}))
    assert run.shape_after == (run.cleaned.count(), len(run.cleaned.columns))
    for before, after in zip(run.steps, run.steps[1:]):
        assert (before.rows_after, before.cols_after) == (after.rows_before, after.cols_before)


@pytest.mark.parametrize("keep, numeric", [("first", "median"), ("none", "mean"), ("first", "mode")])
def test_weighted_fit_equals_fit_on_the_materialized_table(shop, keep, numeric):
    """Few copies are taken away by weight, many are removed for real: the plans must agree."""
    many = shop.union(shop.where("id < 6")).union(shop.where("id = 4"))
    rules = {"duplicates": {"keep": keep}, "missing_values": {"numeric_imputation": numeric}}
    few = clean(many, options(**rules))
    plenty = clean(many, options(**rules, scale={"broadcast_rows": 0}))
    assert few.profile.copies.few and not plenty.profile.copies.few
    few.plan.options = plenty.plan.options = {}
    assert few.plan == plenty.plan
    assert [(s.rows_after, s.operations) for s in few.steps] == [(s.rows_after, s.operations) for s in plenty.steps]
    assert rows(few.cleaned) == rows(plenty.cleaned)


def test_dry_run_previews_each_step_on_the_raw_table(shop):
    run = clean(shop, dry_run=True)
    assert all(s.rows_before == 11 and s.cols_before == 9 for s in run.steps)
    assert rows(run.cleaned) == rows(shop) and run.shape_after == (11, 9)
    assert run.steps_table().where("summary LIKE '[dry run]%'").count() == 6


def test_cleaning_twice_keeps_the_rows(shop):
    once = clean(shop).cleaned
    assert clean(once).cleaned.count() == once.count()


def test_row_ids_are_not_data(shop):
    table = shop.selectExpr("monotonically_increasing_id() AS row", "*")
    run = clean(table, row_id="row")
    assert run.profile.n_duplicates == 1 and "row" in run.cleaned.columns and run.cleaned.count() == 10
    assert run.cleaned.where("row IS NULL").count() == 0
    ids = run.profile.results["duplicates"].details["sample_duplicate_ids"]
    assert ids and ids[0] not in [r["row"] for r in run.cleaned.collect()]


def test_own_fix(shop):
    register_fix("short", lambda df: df.where("id < 5"))
    try:
        assert clean(shop).cleaned.count() == 4
    finally:
        unregister_fix("short")
    with pytest.raises(PlanError):
        register_fix("missing_values", lambda df: df)


def test_own_fix_is_a_step_of_the_plan(shop):
    register_fix("short", lambda df: df.where("id < 5").drop("price"))
    try:
        run = clean(shop)
        plan = CleaningPlan.from_json(run.plan.to_json())
        assert run.steps[-1].name == "short" and run.steps[-1].applied
        assert run.shape_after == (run.cleaned.count(), len(run.cleaned.columns))
        assert run.run_stats().first()["rows_final"] == 4
        assert rows(plan.apply(shop)) == rows(run.cleaned)
        dry = clean(shop, dry_run=True)
        assert dry.cleaned.count() == shop.count() and dry.shape_after == dry.shape_before and dry.steps[-1].name == "short"
    finally:
        unregister_fix("short")
    with pytest.raises(PlanError):
        plan.apply(shop)


def test_dry_run_plan_is_not_stored(shop, spark, tmp_path):
    with pytest.raises(PlanError):
        write_plan(clean(shop, dry_run=True).plan, spark, str(tmp_path / "plan"))


# --- plans ---

def test_plan_survives_json_and_keeps_its_constants(shop):
    run = clean(shop)
    plan = CleaningPlan.from_json(run.plan.to_json())
    assert plan == run.plan and plan.fitted_options() == run.profile.options
    assert rows(plan.apply(shop)) == rows(run.cleaned)
    later = shop.where("id IN (3, 10)")
    found = by_id(plan.apply(later))
    assert found[3]["price"] == 12.0 and found[10]["price_is_outlier"]


def test_plan_refuses_other_tables(shop):
    plan = clean(shop).plan
    with pytest.raises(PlanError):
        plan.apply(shop.drop("price"))
    with pytest.raises(PlanError):
        plan.apply(shop.selectExpr("* EXCEPT (price)", "CAST(price AS STRING) AS price"))
    for text in ("{", "{}", '{"format": 99}'):
        with pytest.raises(PlanError):
            CleaningPlan.from_json(text)


# --- single fixes ---

@pytest.mark.parametrize("few", [True, False])
def test_drop_duplicates(spark, few):
    df = spark.createDataFrame([(1, None, 0.0), (1, None, -0.0), (2, "a", 1.0), (3, "b", float("nan")), (3, "b", float("nan"))], "i int, s string, x double")
    copies = duplicates.find_copies(df, options(scale={"broadcast_rows": 100 if few else 0}))
    assert [r[0] for r in rows(fixes.drop_duplicates(df, "first", copies))] == [1, 2, 3]
    assert [r[0] for r in rows(fixes.drop_duplicates(df, "none", copies))] == [2]
    with pytest.raises(PlanError):
        fixes.drop_duplicates(df, "some")


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("keep, ids", [("first", [1, 3]), ("last", [2, 3]), ("none", [3])])
def test_drop_duplicates_by_row_id(spark, few, keep, ids):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, s string")
    copies = duplicates.find_copies(df, options(scale={"broadcast_rows": 100 if few else 0}), "id")
    assert [r[0] for r in rows(fixes.drop_duplicates(df, keep, copies, "id"))] == ids


def test_hash_collisions_lose_nothing(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(duplicates, "row_hash", lambda df, content: F.lit(1).cast("long"))
    df = spark.createDataFrame([(1,), (1,), (2,), (3,)], "i int")
    copies = duplicates.find_copies(df)
    assert copies.count() == 1 and rows(fixes.drop_duplicates(df, "first", copies)) == [(1,), (2,), (3,)]
    assert rows(fixes.drop_duplicates(df, "none", copies)) == [(2,), (3,)]


def test_casts_make_failures_missing(spark):
    df = spark.createDataFrame([("1", "2024-01-05", 1), ("x", "soon", 0), (None, None, 1)], "a string, b string, c int")
    done = fixes.cast_columns(df, {"a": "mixed_numeric_string", "b": "date_string", "c": "boolean_as_integer"})
    assert done.dtypes == [("a", "double"), ("b", "timestamp_ntz"), ("c", "boolean")]
    assert [r[0] for r in done.collect()] == [1.0, None, None]
    with pytest.raises(PlanError):
        fixes.cast_columns(df, {"a": "magic"})


def test_failed_cast_is_recorded_and_skipped(shop, monkeypatch):
    original = fixes.cast_expression
    monkeypatch.setattr(fixes, "cast_expression", lambda c, issue: "no_such_function(1)" if c == "code" else original(c, issue))
    run = clean(shop)
    assert [(o.type, o.column) for o in run.steps[2].operations][0] == ("cast_column_failed", "code")
    assert dict(run.cleaned.dtypes)["code"] == "string" and dict(run.cleaned.dtypes)["is_member"] == "boolean"


def test_row_threshold_is_clamped(spark):
    df = spark.createDataFrame([(1, 1, 1, 1), (1, 1, 1, None), (1, 1, None, None), (None,) * 4], "a int, b int, c int, d int")
    for threshold, kept in ((0.5, 2), (0.0, 1), (1.0, 3), (0.25, 1)):
        assert fixes.drop_sparse_rows(df, fixes.min_present(4, threshold)).count() == kept


def test_costly_columns_do_not_change_the_row_rule(spark):
    df = spark.sql("SELECT if(id % 2 = 0, id, null) AS a, if(id % 3 = 0, id, null) AS b, if(id % 5 = 0, id, null) AS c FROM range(60)")
    for needed in (1, 2, 3):
        plain = fixes.drop_sparse_rows(df, needed).count()
        for costly in (["a"], ["a", "b"], ["a", "b", "c"]):
            assert fixes.drop_sparse_rows(df, needed, costly=costly).count() == plain


def filled(df, **rules):
    return [tuple(r) for r in standalone.impute(df, options(missing_values=rules)).collect()]


def test_imputation_strategies(spark):
    df = spark.createDataFrame([(1, "b", True), (None, None, None), (4, "a", False), (4, "b", True), (1, "a", True)], "n int, s string, f boolean")
    assert filled(df)[1] == (2.5, "a", 1.0)
    assert filled(df, numeric_imputation="mean")[1] == (2.5, "a", 0.75)
    assert filled(df, numeric_imputation="mode")[1] == filled(df, numeric_imputation="none")[1] == (1, "a", True)
    assert filled(df, numeric_imputation="zero", categorical_imputation="constant")[1] == (0, "UNKNOWN", False)
    assert filled(df, numeric_imputation="constant", constant_fill_value="1")[1] == (1, "a", True)
    with pytest.raises(PlanError):
        filled(df, numeric_imputation="constant")


def test_nan_is_filled_and_empty_columns_are_not(spark):
    df = spark.createDataFrame([(float("nan"), None), (2.0, None), (4.0, None)], "x double, y double")
    assert filled(df)[0] == (3.0, None)


def test_dates_take_the_most_frequent_value(spark):
    df = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ '2024-01-02 03:04:05.678'), (TIMESTAMP_NTZ '2024-01-02 03:04:05.678'), "
                   "(TIMESTAMP_NTZ '2020-01-01 00:00:00'), (null) AS t(ts)")
    assert str(filled(df)[3][0]) == "2024-01-02 03:04:05.678000"


def test_instants_mean_the_same_in_another_time_zone(spark):
    df = spark.sql("SELECT * FROM VALUES (TIMESTAMP '2024-07-02 03:04:05Z'), (TIMESTAMP '2024-07-02 03:04:05Z'), (null) AS t(ts)")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Oslo")
        (fill,) = fitting.fit_fills(df, {"ts": "mode"}, Options())
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert fixes.fill_missing(df, [fill]).selectExpr("unix_seconds(ts) AS s").distinct().count() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_outlier_actions_leave_missing_cells_alone(spark):
    df = spark.createDataFrame([(1, -5.0), (2, 999.0), (3, None), (4, float("nan")), (5, 10.0)], "i int, x double")
    fences = [fixes.Fence("x", -1.0, 55.0)]
    assert [r["x_is_outlier"] for r in fixes.flag_outliers(df, fences).orderBy("i").collect()] == [True, True, False, False, False]
    capped = [r["x"] for r in fixes.cap_outliers(df, fences).orderBy("i").collect()]
    assert capped[:3] == [-1.0, 55.0, None] and capped[4] == 10.0
    assert [r["i"] for r in fixes.drop_outliers(df, fences).orderBy("i").collect()] == [3, 4, 5]


def test_caps_on_integers_and_flags(spark):
    df = spark.createDataFrame([(1, True), (90, False)], "n int, f boolean")
    done = fixes.cap_outliers(df, [fixes.Fence("n", 0.0, 50.0), fixes.Fence("f", 1.0, 1.0)])
    assert done.dtypes == [("n", "int"), ("f", "boolean")] and rows(done) == [(1, True), (50, False)]
    assert rows(fixes.cap_outliers(df.select("n"), [fixes.Fence("n", 0.0, 50.5)])) == [(1.0,), (50.5,)]


def test_standalone_cleaners(shop):
    assert "comment" not in standalone.drop_constant_columns(shop).columns
    assert standalone.drop_sparse_columns(shop).columns == [c for c in shop.columns if c != "comment"]
    assert standalone.drop_duplicate_rows(shop).count() == 10
    assert {r["city"] for r in standalone.normalize_all_categories(shop).collect()} == {"oslo", "bergen", "voss", None}
    assert standalone.handle_missing(shop).where("price IS NULL OR city IS NULL").count() == 0
    assert standalone.handle_outliers(shop, options(outliers={"action": "drop"}), ["price"]).count() == 9


def test_all_missing_columns_are_dropped_alone_only(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "a int, b string")
    assert standalone.drop_constant_columns(df).columns == ["a"]
    plan = clean(df, options(missing_values={"drop_column_threshold": 1.0, "drop_row_threshold": 1.0})).plan
    assert plan.constant_columns == [] and plan.sparse_columns == ["b"]


def test_rank_issues(spark, shop):
    summary = clean(shop).profile.check_summary().selectExpr("'shop' AS dataset", "monotonically_increasing_id() AS check_no", "*")
    ranked = [(r["check"], r["severity"]) for r in rank_issues(summary, most=3).orderBy("rank").collect()]
    assert ranked == [("missing_values", "critical"), ("cardinality", "critical"), ("duplicates", "warning")]


def test_every_step_of_the_plan_but_duplicates_needs_no_shuffle(shop):
    plan = clean(shop).plan
    text = plan.apply_to_rows(shop)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Python" not in text


def test_plentiful_copies_are_grouped_once_in_the_shared_folder(shop):
    copies = duplicates.find_copies(shop, options(scale={"broadcast_rows": 0}), store=True)
    assert not copies.few and copies.count() == 1
    assert "FileScan parquet" in copies.groups._jdf.queryExecution().executedPlan().toString()


def test_mean_after_keep_none_does_not_depend_on_the_size_of_copies(spark):
    """Copies that are taken away leave no trace in a mean, however large they are and however they are joined."""
    for big in (1e18, float("inf")):
        df = spark.createDataFrame([(i, float(i)) for i in range(1, 11)] + [(99, big), (99, big), (50, None)], "id long, x double")
        for limit in (0, 1_000_000):
            run = clean(df, options(duplicates={"keep": "none"}, missing_values={"numeric_imputation": "mean", "drop_row_threshold": 1.0}, scale={"broadcast_rows": limit}))
            assert run.cleaned.where("id = 50").first().x == 5.5


@pytest.mark.parametrize("few", [True, False])
def test_replay_shuffles_no_whole_row_without_a_copy(spark, few):
    """Later data of unknown contents: rows are told apart by hashes first; the plan that is left has no shuffle."""
    df = spark.range(500).selectExpr("id", "concat('text ', id) AS s", "id % 7 AS k")
    df = df.unionByName(df.where("id % 50 = 0"))
    plan = clean(df, options(scale={"broadcast_rows": 100 if few else 0})).plan
    later = spark.range(1000).selectExpr("id", "concat('later ', id) AS s", "id % 7 AS k")
    later = later.unionByName(later.where("id % 100 = 0"))
    replayed = plan.apply(later)
    assert plan.keep == "first" and replayed.count() == 1000
    if few:
        assert "hashpartitioning" not in replayed._jdf.queryExecution().executedPlan().toString()

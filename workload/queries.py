"""One query per operator. Each takes (spark, folder of the tables) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sieveline import CleaningPlan, Options, clean, profile
from sieveline.functions.columns import string_columns
from sieveline.functions.scalars import estimate_tokens as token_estimate
from sieveline.operators import (
    cardinality, categories, duplicates, fixes, missing, outliers, replies, suspicious, types,
)
from sieveline.plans import standalone
from sieveline.plans.run import rank_issues
from sieveline.sources.csv import read_csv
from sieveline.sources.shared import shared_folder
from sieveline.sources.sinks import read_plan, write_plan, write_table
from sieveline.streaming.replay import clean_stream, read_clean_stream, write_clean_stream
from workload.views import table, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CACHE_NOW = "2024-01-02 12:00:00"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _work_folder(spark: SparkSession) -> str:
    """A new folder below the shared one the cluster names."""
    return shared_folder(spark)


def _options(**sections) -> Options:
    return Options.from_dict(sections)


# --- missing values -----------------------------------------------------------------------------

@query
def missing_by_column(spark, sf_dir):
    return missing.missing_by_column(view(spark, sf_dir, "dirty_orders"))


@query
def missing_column_actions(spark, sf_dir):
    return missing.missing_column_actions(view(spark, sf_dir, "dirty_customer"))


@query
def sparse_rows(spark, sf_dir):
    return missing.sparse_rows(view(spark, sf_dir, "dirty_orders"))


@query
def missing_totals(spark, sf_dir):
    return missing.missing_totals(view(spark, sf_dir, "dirty_orders"))


# --- duplicates ---------------------------------------------------------------------------------

@query
def duplicate_count_first(spark, sf_dir):
    return duplicates.duplicate_summary(view(spark, sf_dir, "dirty_lineitem"))


@query
def duplicate_count_none(spark, sf_dir):
    return duplicates.duplicate_summary(view(spark, sf_dir, "dirty_lineitem"), "none")


@query
def duplicate_samples(spark, sf_dir):
    return duplicates.duplicate_samples(table(spark, sf_dir, "documents"), "doc_id")


# --- types --------------------------------------------------------------------------------------

def _type_issues(df: DataFrame, *issues: str) -> DataFrame:
    found = [i for i in types.type_issues(df) if i.issue in issues]
    return types.type_issue_table(df, found)


@query
def numeric_string_columns(spark, sf_dir):
    return _type_issues(view(spark, sf_dir, "dirty_customer"), types.NUMERIC_STRING, types.MIXED_NUMERIC_STRING) \
        .select("column", "issue_type", "convertible_pct", "non_convertible_count")


@query
def date_string_columns(spark, sf_dir):
    return _type_issues(view(spark, sf_dir, "dirty_orders"), types.DATE_STRING) \
        .select("column", "issue_type", "convertible_pct", "non_convertible_count")


@query
def boolean_like_columns(spark, sf_dir):
    return _type_issues(table(spark, sf_dir, "labels"), types.BOOLEAN_AS_INTEGER).select("column", "unique_values")


# --- outliers -----------------------------------------------------------------------------------

@query
def numeric_column_stats(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return outliers.stats_table(df, outliers.numeric_stats(df), digits=6)


@query
def outlier_iqr_fences(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    rows = [(n, round(s.q1, 4), round(s.q3, 4), *[round(f, 4) for f in s.fences(1.5)])
            for n, s in outliers.numeric_stats(df).items()]
    return spark.createDataFrame(rows, "column string, q1 double, q3 double, lower_fence double, upper_fence double")


@query
def outlier_iqr_counts(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return outliers.outlier_table(df, outliers.outliers(df)).select("column", "n_values", "n_outliers", "lower_fence", "upper_fence")


@query
def outlier_zscore(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return outliers.outlier_table(df, outliers.outliers(df, _options(outliers={"method": "zscore"}))) \
        .select("column", "n_values", "n_outliers", "max_zscore")


@query
def outlier_both(spark, sf_dir):
    df = view(spark, sf_dir, "dirty_orders")
    return outliers.outlier_table(df, outliers.outliers(df, _options(outliers={"method": "both"}))) \
        .select("column", "n_values", "n_outliers", "lower_fence", "upper_fence")


@query
def outlier_examples(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return outliers.outlier_examples(df, outliers.outliers(df), row_id="event_id")


# --- cardinality --------------------------------------------------------------------------------

@query
def distinct_counts(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    rows = [(d.column, d.n_distinct, d.n_values, d.top_count) for d in cardinality.distinct_counts(df).values()]
    return spark.createDataFrame(rows, "column string, n_distinct long, n_values long, top_count long")


@query
def distinct_texts(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    rows = [(d.column, d.n_distinct, d.top_count) for d in cardinality.distinct_counts(df).values()]
    return spark.createDataFrame(rows, "column string, n_distinct long, top_count long")


@query
def value_counts(spark, sf_dir):
    return cardinality.value_counts(table(spark, sf_dir, "lineitem"))


@query
def constant_columns(spark, sf_dir):
    rows = list(cardinality.constant_columns(view(spark, sf_dir, "dirty_customer")).items())
    return spark.createDataFrame(rows, "column string, constant_value string")


@query
def near_constant_columns(spark, sf_dir):
    df = view(spark, sf_dir, "skewed_orders")
    return cardinality.near_constant_table(df, cardinality.cardinality_issues(df))


@query
def high_cardinality_columns(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return cardinality.high_cardinality_table(df, cardinality.cardinality_issues(df)).drop("data_type")


@query
def top_values(spark, sf_dir):
    return cardinality.top_values(table(spark, sf_dir, "lineitem"))


# --- categories ---------------------------------------------------------------------------------

@query
def category_counts(spark, sf_dir):
    return categories.category_counts(view(spark, sf_dir, "dirty_customer"))


@query
def category_inconsistent_columns(spark, sf_dir):
    found = categories.inconsistent_columns(view(spark, sf_dir, "dirty_customer"))
    return spark.createDataFrame([(c.column, c.raw, c.normalized, c.inconsistencies) for c in found],
                                 "column string, raw_unique_count long, normalized_unique_count long, inconsistency_count long")


@query
def category_clusters(spark, sf_dir):
    df = view(spark, sf_dir, "dirty_customer")
    return categories.category_clusters(df, string_columns(df))


# --- suspicious values --------------------------------------------------------------------------

def _suspicious(df: DataFrame, *kinds_of: str) -> DataFrame:
    return suspicious.suspicious_values(df, types=kinds_of)


@query
def negative_domain_values(spark, sf_dir):
    return _suspicious(view(spark, sf_dir, "dirty_customer"), suspicious.NEGATIVE).select("column", "finding_type", "value", "n")


@query
def sentinel_values(spark, sf_dir):
    return _suspicious(view(spark, sf_dir, "dirty_customer"), suspicious.SENTINEL).select("column", "finding_type", "value", "n")


@query
def extreme_magnitudes(spark, sf_dir):
    return _suspicious(view(spark, sf_dir, "dirty_orders"), suspicious.EXTREME) \
        .select("column", "finding_type", "value", "n", "column_median")


@query
def suspicious_totals(spark, sf_dir):
    return suspicious.suspicious_totals(suspicious.suspicious_values(view(spark, sf_dir, "dirty_customer")))


@query
def suspicious_samples(spark, sf_dir):
    df = view(spark, sf_dir, "dirty_customer")
    found = suspicious.suspicious_values(df, row_id="id")
    return found.selectExpr("column", "finding_type", "value", "n", "array_join(sample_ids, ',') AS sample_ids")


# --- single cleaners ----------------------------------------------------------------------------

@query
def drop_duplicates(spark, sf_dir):
    return standalone.drop_duplicate_rows(view(spark, sf_dir, "dirty_lineitem"))


@query
def drop_all_duplicates(spark, sf_dir):
    return standalone.drop_duplicate_rows(view(spark, sf_dir, "dirty_lineitem"), _options(duplicates={"keep": "none"}))


@query
def drop_duplicates_by_row_id(spark, sf_dir):
    return fixes.drop_duplicates(table(spark, sf_dir, "documents"), "last", row_id="doc_id")


@query
def drop_constant_columns(spark, sf_dir):
    return standalone.drop_constant_columns(view(spark, sf_dir, "dirty_customer"))


@query
def cast_numeric_strings(spark, sf_dir):
    return standalone.cast_mistyped_columns(
        view(spark, sf_dir, "dirty_customer"), issues=(types.NUMERIC_STRING, types.MIXED_NUMERIC_STRING))


@query
def cast_date_strings(spark, sf_dir):
    return standalone.cast_mistyped_columns(view(spark, sf_dir, "dirty_orders"), issues=(types.DATE_STRING,))


@query
def cast_boolean_flags(spark, sf_dir):
    return standalone.cast_mistyped_columns(table(spark, sf_dir, "labels"), issues=(types.BOOLEAN_AS_INTEGER,))


@query
def normalize_categories(spark, sf_dir):
    return standalone.normalize_all_categories(view(spark, sf_dir, "dirty_customer"))


@query
def drop_sparse_columns(spark, sf_dir):
    return standalone.drop_sparse_columns(view(spark, sf_dir, "dirty_customer"))


@query
def drop_sparse_rows(spark, sf_dir):
    return standalone.drop_sparse_rows(view(spark, sf_dir, "dirty_orders"))


def _imputed(spark, sf_dir, **rules) -> DataFrame:
    return standalone.impute(view(spark, sf_dir, "dirty_orders"), _options(missing_values=rules))


@query
def impute_median(spark, sf_dir):
    return _imputed(spark, sf_dir)


@query
def impute_mean(spark, sf_dir):
    return _imputed(spark, sf_dir, numeric_imputation="mean").selectExpr(
        "id", "order_date", "round(price, 4) AS price", "status", "priority", "round(qty, 6) AS qty")


@query
def impute_mode(spark, sf_dir):
    return _imputed(spark, sf_dir, numeric_imputation="mode")


@query
def impute_constant(spark, sf_dir):
    return _imputed(spark, sf_dir, categorical_imputation="constant")


@query
def impute_zero(spark, sf_dir):
    return _imputed(spark, sf_dir, numeric_imputation="zero")


@query
def handle_missing(spark, sf_dir):
    return standalone.handle_missing(view(spark, sf_dir, "dirty_orders"))


def _outliers_handled(spark, sf_dir, action: str) -> DataFrame:
    return standalone.handle_outliers(table(spark, sf_dir, "events"), _options(outliers={"action": action}))


@query
def outlier_flag(spark, sf_dir):
    return _outliers_handled(spark, sf_dir, "flag")


@query
def outlier_cap(spark, sf_dir):
    return _outliers_handled(spark, sf_dir, "cap")


@query
def outlier_drop(spark, sf_dir):
    return _outliers_handled(spark, sf_dir, "drop")


# --- whole runs ---------------------------------------------------------------------------------

@query
def table_profile(spark, sf_dir):
    return profile(view(spark, sf_dir, "dirty_customer")).table_profile().selectExpr(
        "n_rows", "n_cols", "missing_cells", "duplicate_rows", "array_join(numeric_columns, ',') AS numeric_columns",
        "array_join(categorical_columns, ',') AS categorical_columns", "array_join(datetime_columns, ',') AS datetime_columns")


@query
def column_profile(spark, sf_dir):
    return profile(view(spark, sf_dir, "dirty_customer")).column_profile().selectExpr(
        "column", "data_type", "kind", "n_rows", "n_missing", "missing_pct", "n_distinct", "round(mean, 4) AS mean",
        "round(std_samp, 4) AS std_samp", "min", "max", "round(q1, 4) AS q1", "round(median, 4) AS median", "round(q3, 4) AS q3")


@query
def check_summary(spark, sf_dir):
    return profile(view(spark, sf_dir, "dirty_customer")).check_summary().selectExpr(
        "check", "issues_found", "severity", "array_join(affected_columns, ',') AS affected_columns")


@query
def findings(spark, sf_dir):
    return profile(view(spark, sf_dir, "dirty_customer")).findings().selectExpr(
        "check", "column", "finding_type", "value", "n", "severity")


@query
def finding_samples(spark, sf_dir):
    """The findings that carry examples and the ids of rows."""
    found = profile(view(spark, sf_dir, "dirty_customer"), row_id="id").findings().where("check IN ('duplicates', 'outliers')")
    return found.selectExpr("check", "column", "n", "array_join(sample_ids, ',') AS sample_ids",
                            "array_join(from_json(details['outlier_examples'], 'array<double>'), ',') AS examples")


@query
def clean_customer(spark, sf_dir):
    return clean(view(spark, sf_dir, "dirty_customer")).cleaned


@query
def clean_orders_cap(spark, sf_dir):
    return clean(view(spark, sf_dir, "dirty_orders"), _options(outliers={"action": "cap"})).cleaned


@query
def clean_orders_drop(spark, sf_dir):
    return clean(view(spark, sf_dir, "dirty_orders"), _options(outliers={"action": "drop", "method": "zscore"})).cleaned


@query
def clean_steps(spark, sf_dir):
    return clean(view(spark, sf_dir, "dirty_customer")).steps_table().drop("summary")


@query
def clean_operations(spark, sf_dir):
    return clean(view(spark, sf_dir, "dirty_customer")).operations_table().drop("details")


@query
def run_stats(spark, sf_dir):
    return clean(view(spark, sf_dir, "dirty_customer")).run_stats()


@query
def dry_run_steps(spark, sf_dir):
    return clean(view(spark, sf_dir, "dirty_customer"), dry_run=True).steps_table().drop("summary")


@query
def quality_gate(spark, sf_dir):
    return clean(view(spark, sf_dir, "dirty_customer")).quality_gate()


@query
def run_summary(spark, sf_dir):
    return clean(view(spark, sf_dir, "dirty_customer")).run_summary("dirty_customer").selectExpr(
        "source", "dry_run", "original_rows", "original_cols", "final_rows", "final_cols", "rows_removed", "cols_removed",
        "issues_found", "cleaners_applied", "cleaners_skipped", "has_critical_issues",
        "size(from_json(get_json_object(document, '$.cleaning'), 'array<string>')) AS n_cleaning",
        "size(from_json(get_json_object(document, '$.analysis'), 'array<string>')) AS n_analysis")


@query
def issue_ranking(spark, sf_dir):
    summaries = None
    for name in ("dirty_customer", "skewed_orders"):
        part = profile(view(spark, sf_dir, name)).check_summary().selectExpr(
            f"'{name}' AS dataset", "monotonically_increasing_id() AS check_no", "*")
        summaries = part if summaries is None else summaries.unionByName(part)
    return rank_issues(summaries, most=3).selectExpr(
        "dataset", "CAST(rank AS INT) AS rank", "check", "severity", "array_join(affected_columns, ',') AS affected_columns")


@query
def plan_replay(spark, sf_dir):
    """Fit on one batch of orders, store the plan, and replay it on the whole table."""
    df = view(spark, sf_dir, "dirty_orders")
    folder = _work_folder(spark)
    write_plan(clean(df.where("id % 2 = 0")).plan, spark, f"{folder}/plan")
    return read_plan(spark, f"{folder}/plan").apply(df)


@query
def csv_round_trip(spark, sf_dir):
    """Write the dirty table as CSV, scan it back with inferred types."""
    folder = f"{_work_folder(spark)}/orders.csv"
    write_table(view(spark, sf_dir, "dirty_orders"), folder)
    return read_csv(spark, folder)


def _streamed(spark, sf_dir) -> tuple[CleaningPlan, DataFrame, str]:
    """A plan fitted on the events so far, the same events arriving as a stream of four batches that each reach over all times, and a folder."""
    batch = view(spark, sf_dir, "dirty_events")
    plan: CleaningPlan = clean(batch).plan
    folder = _work_folder(spark)
    batch.repartition(max(8, batch.rdd.getNumPartitions())).write.parquet(f"{folder}/events")
    files = len(spark.read.parquet(f"{folder}/events").inputFiles())
    return plan, spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", -(-files // 4)).parquet(f"{folder}/events"), folder


@query
def stream_replay(spark, sf_dir):
    """The plan on a stream as a DataFrame, with a short delay: no row is too late, and copies are found by keys in the state."""
    plan, stream, folder = _streamed(spark, sf_dir)
    cleaned = clean_stream(plan, stream, "ts", "1 minute")
    running = cleaned.writeStream.format("parquet").option("path", f"{folder}/clean").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(cleaned.schema).parquet(f"{folder}/clean")


@query
def stream_replay_files(spark, sf_dir):
    """The same by batches in files, where kept rows are looked up instead of keys."""
    plan, stream, folder = _streamed(spark, sf_dir)
    running = write_clean_stream(plan, stream, f"{folder}/clean", "ts", "hour").trigger(availableNow=True).start()
    running.awaitTermination()
    return read_clean_stream(spark, f"{folder}/clean")


# --- prompts and replies ------------------------------------------------------------------------

@query
def estimate_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{token_estimate('text')} AS estimated_tokens")


@query
def token_budget_prefix(spark, sf_dir):
    return replies.token_budget(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 500) \
        .select("conv_id", "turn", "estimated_tokens", "used_before", "affordable")


@query
def token_budget_one_run(spark, sf_dir):
    """All documents as one run, cut into ranges so that no task sees the whole run."""
    df = table(spark, sf_dir, "documents").selectExpr("'all' AS run", "doc_id", "text")
    return replies.token_budget(df, "run", "doc_id", "text", 100_000, hot_rows=50) \
        .select("doc_id", "estimated_tokens", "used_before", "affordable")


def _prompts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return replies.with_prompt_key(view(spark, sf_dir, "prompts"), "text"), view(spark, sf_dir, "reply_cache")


@query
def reply_cache_hits(spark, sf_dir):
    return replies.cache_hits(*_prompts(spark, sf_dir), CACHE_NOW).select("conv_id", "turn", "prompt_key", "response", "cached_at")


@query
def reply_cache_misses(spark, sf_dir):
    return replies.cache_misses(*_prompts(spark, sf_dir), CACHE_NOW).select("conv_id", "turn", "prompt_key")


@query
def reply_cache_refresh(spark, sf_dir):
    """Store the cache, take old entries away, answer what is missed then, store the answers, and look all prompts up again."""
    prompts, cache = _prompts(spark, sf_dir)
    folder = f"{_work_folder(spark)}/cache"
    replies.store_replies(cache, folder)
    replies.expire_replies(spark, folder, CACHE_NOW, 24)
    missed = replies.cache_misses(prompts, replies.read_cache(spark, folder), CACHE_NOW)
    answers = missed.selectExpr("prompt_key", "concat('new reply ', length(prompt_key), ' ', substring(prompt_key, 1, 8)) AS response",
                                f"TIMESTAMP '{CACHE_NOW}' - INTERVAL '1' HOUR AS cached_at")
    replies.store_replies(answers, folder)
    return replies.cache_hits(prompts, replies.read_cache(spark, folder), CACHE_NOW).selectExpr(
        "conv_id", "turn", "prompt_key", "response", "unix_micros(cached_at) AS cached_at_us")


@query
def parse_replies(spark, sf_dir):
    return replies.parse_replies(view(spark, sf_dir, "replies"), "reply").selectExpr(
        "reply_id", "valid", "overall_summary", "data_quality_score", "score_rationale", "cleaning_assessment",
        "size(column_insights) AS n_insights", "array_join(recommendations, '|') AS recommendations")

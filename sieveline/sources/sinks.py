"""Where runs are written: cleaned data, findings, audit and plan, each as a folder of a run."""

from __future__ import annotations

import json
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from sieveline.errors import OptionsError, PlanError
from sieveline.options import Options
from sieveline.plans.plan import CleaningPlan
from sieveline.plans.profile import Profile
from sieveline.plans.run import CleaningRun


def write_table(df: DataFrame, path: str, form: str = "csv", encoding: str = "utf-8", delimiter: str = ",",
                mode: str = "errorifexists") -> None:
    """Write a table as a folder of CSV (with header), JSON or parquet files."""
    writer = df.write.mode(mode).format(form)
    if form == "csv":
        # The writer trims text unless told not to.
        writer = (
            writer.option("header", True).option("encoding", encoding).option("sep", delimiter).option("escape", '"')
            .option("emptyValue", '""').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        )
    writer.save(path)


def write_cleaned(run: CleaningRun, path: str, form: str = "csv", mode: str = "errorifexists") -> None:
    """The cleaned table of a real run."""
    if run.dry_run:
        raise PlanError("a dry run has no cleaned table to save")
    dataset = run.profile.options.dataset
    write_table(run.cleaned, path, form, dataset.encoding, dataset.delimiter, mode)


def _write_document(spark: SparkSession, document: str, path: str, mode: str) -> None:
    """One JSON document on one line, through Spark, so that any file system of the cluster works."""
    line = json.dumps(json.loads(document), ensure_ascii=False)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode(mode).text(path)


def write_analysis(profile: Profile, path: str, source: str = "unknown", mode: str = "errorifexists", findings: str | None = None) -> None:
    """The check results as one JSON document: source, table size and the list of results with details.

    What has a row per value (spellings, suspicious values, examples) goes to the folder ``findings``, if one is given: every single
    finding as JSON lines, a subfolder per check.
    """
    document = {
        "source_file": source, "dataset": {"rows": profile.n_rows, "columns": len(profile.kinds)},
        "results": [{"analyzer": r.name, "display_name": r.display_name, "issues_found": r.issues_found,
                     "severity": r.severity, "affected_columns": r.affected_columns, "details": r.details,
                     "summary": r.summary, "recommendation": r.recommendation} for r in profile.results.values()],
    }
    if findings:
        document["findings"] = findings
        profile.findings().write.partitionBy("check").mode(mode).json(findings)
    _write_document(profile.df.sparkSession, json.dumps(document, default=str), path, mode)


def write_plan(plan: CleaningPlan, spark: SparkSession, path: str, mode: str = "errorifexists") -> None:
    """The plan, and with it the options it was fitted with. A dry run's is refused: its steps were each fitted on the raw table."""
    if plan.dry_run:
        raise PlanError("a dry run's plan is a preview and is not stored")
    _write_document(spark, plan.to_json(), path, mode)


def read_plan(spark: SparkSession, path: str) -> CleaningPlan:
    return CleaningPlan.from_json(spark.read.text(path).first()[0])


def write_options(options: Options, spark: SparkSession, path: str, mode: str = "errorifexists") -> None:
    """The options as JSON on any file system of the cluster, apart from a plan."""
    _write_document(spark, json.dumps(options.to_dict()), path, mode)


def read_options(spark: SparkSession, path: str, overrides: dict[str, dict[str, Any]] | None = None) -> Options:
    """Defaults, then the JSON document (of one line or many) at a path that Spark reads, then ``overrides``."""
    try:
        found = spark.read.text(path, wholetext=True).limit(2).collect()
    except AnalysisException as error:
        raise OptionsError(f"cannot read options at {path}: {error.getCondition() or error}") from error
    if len(found) != 1:
        raise OptionsError(f"{path} must hold one document of options")
    try:
        return Options().merge(json.loads(found[0][0]), overrides or {})
    except json.JSONDecodeError as error:
        raise OptionsError(f"the options at {path} are not valid JSON: {error}") from error


def save_run(run: CleaningRun, folder: str, source: str = "unknown", form: str = "csv", mode: str = "errorifexists") -> dict[str, str]:
    """Write everything a run produced below one folder and return the path of each part."""
    spark, folder = run.cleaned.sparkSession, folder.rstrip("/")
    paths = {part: f"{folder}/{part}" for part in ("data", "findings", "steps", "operations", "plan", "summary")}
    write_cleaned(run, paths["data"], form, mode)
    write_table(run.profile.findings(), paths["findings"], "json", mode=mode)
    write_table(run.steps_table(), paths["steps"], "json", mode=mode)
    write_table(run.operations_table(), paths["operations"], "json", mode=mode)
    write_plan(run.plan, spark, paths["plan"], mode)
    document = json.dumps(run.summary_document(source, paths), default=str, ensure_ascii=False)
    _write_document(spark, document, paths["summary"], mode)
    return paths

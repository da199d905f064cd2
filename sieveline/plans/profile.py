"""The read-only half: run the seven checks on a table and describe what they found."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from sieveline.errors import ValidationError
from sieveline.functions import fixed
from sieveline.functions.columns import NUMERIC_KINDS, count_if, is_missing, kinds
from sieveline.operators import cardinality, categories, duplicates, missing, outliers, suspicious, types
from sieveline.operators.aggregate import aggregate_row, side_by_side
from sieveline.options import Options

CHECKS = {
    "missing_values": "Missing Values",
    "duplicates": "Duplicate Rows",
    "type_inference": "Data Type Issues",
    "outliers": "Outliers",
    "cardinality": "Cardinality",
    "category_consistency": "Category Consistency",
    "suspicious_values": "Suspicious Values",
}
FINDINGS = (
    "check string, column string, finding_type string, value string, n long, pct double, lower double, upper double, "
    "severity string, details map<string,string>, sample_ids array<string>"
)
SUMMARY = (
    "check string, display_name string, issues_found boolean, severity string, affected_columns array<string>, "
    "summary string, recommendation string"
)


@dataclass
class CheckResult:
    """Outcome of one check. Details hold at most a few entries per column."""

    name: str
    issues_found: bool = False
    severity: str = "ok"
    affected_columns: list[str] = field(default_factory=list)
    summary: str = "nothing found"
    recommendation: str = "nothing to do"
    details: dict[str, Any] = field(default_factory=dict)

    @property
    def display_name(self) -> str:
        return CHECKS.get(self.name, self.name)


@dataclass
class MissingFacts:
    counts: dict[str, int]
    sparse_rows: int
    drop: list[str]
    impute: dict[str, str]


# --- user-defined checks ------------------------------------------------------------------------

_EXTRA_CHECKS: dict[str, Callable[["Profile"], CheckResult]] = {}


def register_check(name: str, check: Callable[["Profile"], CheckResult]) -> None:
    """Run ``check(profile)`` after the seven built-in checks of every profile."""
    if name in CHECKS:
        raise ValidationError(f"{name!r} is the name of a built-in check")
    _EXTRA_CHECKS[name] = check


def unregister_check(name: str) -> None:
    _EXTRA_CHECKS.pop(name, None)


# --- the profile --------------------------------------------------------------------------------

class Profile:
    """Facts about one table and the check results drawn from them.

    Everything kept here is bounded by the number of columns. Findings that grow with the data
    (suspicious values, category spellings) stay lazy tables.
    """

    def __init__(self, df: DataFrame, options: Options = Options(), row_id: str | None = None):
        if row_id is not None and row_id not in df.columns:
            raise ValidationError(f"no column {row_id!r} to identify rows by")
        self.table = df
        self.df = self.table.drop(row_id) if row_id else self.table
        self.options, self.row_id = options, row_id
        self.kinds = kinds(self.df)
        self.n_rows = 0
        self.missing: MissingFacts | None = None
        self.copies: duplicates.Copies | None = None
        self.n_duplicates = 0
        self.type_issues: list[types.TypeIssue] = []
        self.stats: dict[str, outliers.NumericStats] = {}
        self.outliers: dict[str, outliers.ColumnOutliers] = {}
        self.cardinality: cardinality.CardinalityIssues | None = None
        self.categories: list[categories.CategoryCounts] = []
        self.suspicious: DataFrame | None = None
        self.results: dict[str, CheckResult] = {}

    def release(self) -> None:
        """Delete what was stored for it. Tables of findings and runs must not be computed afterwards."""
        if self.copies is not None:
            self.copies.release()

    def run(self) -> "Profile":
        """Gather the facts in independent jobs, then draw the results from them."""
        facts: dict[str, Any] = {}

        def gather(check: str, step: Callable[[], Any]) -> Callable[[], None]:
            return lambda: facts.update({check: self._guarded(check, step)})

        def count_values_then_find_copies() -> None:
            gather("cardinality", lambda: cardinality.distinct_counts(self.df, self.options))()
            if cardinality.has_unique_column(facts["cardinality"] or {}, self.df.count()):
                facts["duplicates"] = duplicates.no_copies(self.table, self.row_id)
            else:
                gather("duplicates", lambda: duplicates.find_copies(self.table, self.options, self.row_id, store=True))()

        spark, numeric = self.df.sparkSession, [n for n, k in self.kinds.items() if k in NUMERIC_KINDS]
        side_by_side(
            spark, self._scan,
            gather("outliers", lambda: outliers.column_quantiles(self.df, numeric, outliers.QUARTILES, self.options)),
            count_values_then_find_copies,
            gather("category_consistency", lambda: categories.inconsistent_columns(self.df, self.options)),
        )
        self.copies, self.categories = facts["duplicates"], facts["category_consistency"] or []
        if self.n_rows == 0:
            self.release()
            raise ValidationError("the table is empty")
        if facts["outliers"] is not None:
            self.stats = outliers.with_quartiles(self.stats, facts["outliers"])
        if facts["cardinality"] is not None:
            self.cardinality = cardinality.cardinality_issues(
                self.df, self.options, n_rows=self.n_rows, counts=facts["cardinality"])

        def draw(*checks: tuple[str, Callable[[], CheckResult]]) -> Callable[[], None]:
            def run_checks() -> None:
                for name, check in checks:
                    if name not in self.results:
                        self.results[name] = self._guarded(name, check) or self.results[name]
            return run_checks

        side_by_side(
            spark, draw(("missing_values", self._missing), ("type_inference", self._types),
                        ("category_consistency", self._categories)),
            draw(("outliers", self._outliers)), draw(("suspicious_values", self._suspicious)),
            draw(("duplicates", self._duplicates)), draw(("cardinality", self._cardinality)),
        )
        self.results = {name: self.results[name] for name in CHECKS}
        for name, extra in _EXTRA_CHECKS.items():
            self.results[name] = self._guarded(name, lambda extra=extra: extra(self)) or self.results[name]
        return self

    def _guarded(self, name: str, step: Callable[[], Any]) -> Any:
        """A failing check becomes a warning and does not stop the others."""
        try:
            return step()
        except (PySparkException, ArithmeticError, LookupError, TypeError, ValueError) as error:
            self.results[name] = CheckResult(
                name, False, "warning", summary=f"the check failed: {type(error).__name__}",
                recommendation="look at the error and run the check again", details={"error": str(error)})
            return None

    def _scan(self) -> None:
        """Everything that plain aggregates can tell, in one pass: rows, missing cells, parse rates, moments."""
        rules = self.options.missing_values
        wanted = {
            **types.type_expressions(self.df),
            ("", "sparse"): count_if(missing.sparse_row(self.kinds, rules.drop_row_threshold)),
            **{(n, "missing"): count_if(is_missing(n, k)) for n, k in self.kinds.items()},
            **outliers.moment_expressions(self.df),
        }
        position = {"": -1, **{n: i for i, n in enumerate(self.kinds)}}
        by_column = {key: wanted[key] for key in sorted(wanted, key=lambda key: position[key[0]])}
        seen = aggregate_row(self.df, by_column, self.options.scale.fields_per_pass)
        self.n_rows = seen["", "rows"]
        counts = {n: seen[n, "missing"] for n in self.kinds}
        affected = {n: c for n, c in counts.items() if c > 0}
        drop = [n for n, c in affected.items() if c / self.n_rows >= rules.drop_column_threshold]
        impute = {n: missing.strategy_for(self.kinds[n], rules) for n in affected if n not in drop}
        self.missing = MissingFacts(counts, seen["", "sparse"], drop, {n: s for n, s in impute.items() if s != "none"})
        self.type_issues = types.type_issues_from(self.df, seen, self.options)
        self.stats = outliers.moments_from(seen)

    def _missing(self) -> CheckResult:
        facts, rules = self.missing, self.options.missing_values
        total = sum(facts.counts.values())
        if total == 0:
            return CheckResult("missing_values")
        share = round(total / (self.n_rows * len(self.kinds)), 4)
        if facts.drop or facts.sparse_rows > self.n_rows * fixed.SPARSE_ROWS_CRITICAL_SHARE:
            severity = "critical"
        else:
            severity = "warning" if share > fixed.MISSING_WARNING_SHARE else "info"
        affected = [n for n, c in facts.counts.items() if c]
        per_column = {
            n: {"missing_count": facts.counts[n], "missing_pct": round(facts.counts[n] / self.n_rows, 4),
                "recommended_action": "drop_column" if n in facts.drop
                else "impute_" + missing.strategy_for(self.kinds[n], rules)}
            for n in affected
        }
        return CheckResult(
            "missing_values", True, severity, affected,
            f"{total} cells ({share:.1%}) are missing in {len(affected)} columns",
            f"drop {len(facts.drop)} columns and {facts.sparse_rows} rows, impute {len(facts.impute)} columns",
            {"per_column": per_column, "columns_to_drop": facts.drop, "columns_to_impute": facts.impute,
             "rows_to_drop_count": facts.sparse_rows, "total_missing_cells": total, "total_missing_pct": share})

    def _duplicates(self) -> CheckResult:
        keep = self.options.duplicates.keep
        self.n_duplicates = self.copies.count(keep)
        if self.n_duplicates == 0:
            return CheckResult("duplicates")
        share, left = round(self.n_duplicates / self.n_rows, 4), self.n_rows - self.n_duplicates
        return CheckResult(
            "duplicates", True, "critical" if share > fixed.DUPLICATE_CRITICAL_SHARE else "warning", [],
            f"{self.n_duplicates} rows ({share:.1%}) are exact duplicates", f"drop them (keep={keep}); {left} rows remain",
            {"duplicate_count": self.n_duplicates, "duplicate_pct": share, "keep_strategy": keep,
             "rows_that_would_remain": left,
             **({"sample_duplicate_ids": [r[0] for r in duplicates.duplicate_samples(
                 self.table, self.row_id, keep, self.options, self.copies).collect()]} if self.row_id else {})})

    def _types(self) -> CheckResult:
        if not self.type_issues:
            return CheckResult("type_inference")
        return CheckResult(
            "type_inference", True, "warning", [i.column for i in self.type_issues],
            f"{len(self.type_issues)} columns are stored with the wrong type", "cast them to the suggested types",
            {"type_issues": {
                i.column: {"current_type": i.current_type, "suggested_type": i.suggested_type, "issue_type": i.issue,
                           "convertible_pct": round(i.convertible_pct, 4),
                           "non_convertible_count": i.n_values - i.n_convertible,
                           **({"unique_values": list(i.unique_values)} if i.unique_values else {}),
                           **({"sample_values": types.sample_texts(self.df, i.column)} if i.issue == types.DATE_STRING else {})}
                for i in self.type_issues}})

    def _outliers(self) -> CheckResult:
        rules = self.options.outliers
        self.outliers = outliers.outliers(self.df, self.options, self.stats)
        if not self.outliers:
            return CheckResult("outliers")
        n_numeric, total = len(self.stats), sum(o.n_outliers for o in self.outliers.values())
        critical = len(self.outliers) / n_numeric > fixed.OUTLIER_CRITICAL_SHARE

        def numbers(o: outliers.ColumnOutliers) -> dict[str, Any]:
            entry = {"method": rules.method, "n_outliers": o.n_outliers, "outlier_pct": round(o.outlier_pct, 4)}
            if o.lower_fence is not None:
                entry |= {"lower_fence": round(o.lower_fence, 4), "upper_fence": round(o.upper_fence, 4),
                          "q1": round(o.stats.q1, 4), "q3": round(o.stats.q3, 4), "iqr": round(o.stats.q3 - o.stats.q1, 4)}
            if o.max_zscore is not None:
                entry |= {"max_zscore": round(o.max_zscore, 4), "zscore_threshold": rules.zscore_threshold}
            std = o.stats.std
            return entry | {"min_value": o.stats.minimum, "max_value": o.stats.maximum,
                            "mean_value": round(o.stats.mean, 4), "std_value": None if std is None else round(std, 4)}

        return CheckResult(
            "outliers", True, "critical" if critical else "warning", list(self.outliers),
            f"{total} outliers in {len(self.outliers)} of {n_numeric} numeric columns ({rules.method})",
            f"review the columns; the configured action is {rules.action}",
            {"per_column": {n: numbers(o) for n, o in self.outliers.items()}, "total_outlier_cells": total,
             "method_used": rules.method})

    def _cardinality(self) -> CheckResult:
        found = self.cardinality
        affected = [*found.constant, *found.near_constant, *found.high_cardinality]
        if not affected:
            return CheckResult("cardinality")
        types_of = dict(self.df.dtypes)
        top: dict[str, list[str]] = {}
        unique = [n for n in affected if found.counts[n].top_count == 1 and n not in found.constant]
        repeated = [n for n in affected if n not in unique]
        rows = [
            row for names, values in ((unique, cardinality.smallest_values), (repeated, cardinality.top_values)) if names
            for row in values(self.df, names).collect()]
        for row in sorted(rows, key=lambda r: r["nth"]):
            top.setdefault(row["column"], []).append(row["value"])
        return CheckResult(
            "cardinality", True, "critical" if found.constant else "warning", affected,
            f"{len(found.constant)} constant, {len(found.near_constant)} near-constant and "
            f"{len(found.high_cardinality)} high-cardinality columns",
            "drop constant columns; review the others before encoding",
            {"constant_columns": list(found.constant), "constant_values": {n: top[n][0] for n in found.constant},
             "near_constant_columns": {
                 n: {"dominant_value": top[n][0], "dominant_count": found.counts[n].top_count,
                     "dominant_pct": round(found.counts[n].top_count / self.n_rows, 4),
                     "unique_count": found.counts[n].n_distinct} for n in found.near_constant},
             "high_cardinality_columns": {
                 n: {"unique_count": found.counts[n].n_distinct,
                     "unique_ratio": round(found.counts[n].n_distinct / self.n_rows, 4),
                     "top_3_values": top[n], "dtype": types_of[n]} for n in found.high_cardinality}})

    def _categories(self) -> CheckResult:
        if not self.categories:
            return CheckResult("category_consistency")
        total = sum(c.inconsistencies for c in self.categories)
        return CheckResult(
            "category_consistency", True, "warning", [c.column for c in self.categories],
            f"{total} surplus spellings in {len(self.categories)} text columns", "normalize case and whitespace",
            {"per_column": {c.column: {"raw_unique_count": c.raw, "normalized_unique_count": c.normalized,
                                       "inconsistency_count": c.inconsistencies} for c in self.categories}})

    def _suspicious(self) -> CheckResult:
        found = suspicious.suspicious_values(self.table, self.options, self.stats, columns=list(self.stats), row_id=self.row_id)
        totals = suspicious.suspicious_counts(self.table, self.options, self.stats, list(self.stats))
        self.suspicious = found
        if not totals:
            return CheckResult("suspicious_values")
        affected = [n for n in self.kinds if n in totals]
        return CheckResult(
            "suspicious_values", True, "warning", affected,
            f"{sum(totals.values())} implausible values in {len(affected)} columns", "inspect them at the source",
            {"total_suspicious_cells": sum(totals.values()), "per_column": {n: totals[n] for n in affected}})

    # --- tables ---------------------------------------------------------------------------------

    def check_summary(self) -> DataFrame:
        """One row per check, in the order they ran."""
        return self.df.sparkSession.createDataFrame(
            [(r.name, r.display_name, r.issues_found, r.severity, r.affected_columns, r.summary, r.recommendation)
             for r in self.results.values()], SUMMARY)

    def table_profile(self) -> DataFrame:
        """One row: rows, columns, missing cells, duplicate rows, and columns by class."""
        classes = [[n for n, k in self.kinds.items() if k in group] for group in (NUMERIC_KINDS, ("string",), ("datetime",))]
        return self.df.sparkSession.createDataFrame(
            [(self.n_rows, len(self.kinds), sum(self.missing.counts.values()), self.n_duplicates, *classes)],
            "n_rows long, n_cols int, missing_cells long, duplicate_rows long, numeric_columns array<string>, "
            "categorical_columns array<string>, datetime_columns array<string>")

    def column_profile(self) -> DataFrame:
        """One row per column: type, kind, missing and distinct values, and moments of numbers."""
        types_of, counts = dict(self.df.dtypes), self.cardinality.counts if self.cardinality else {}
        rows = []
        for name, kind in self.kinds.items():
            stats, absent = self.stats.get(name), self.missing.counts[name]
            rows.append((name, types_of[name], kind, self.n_rows, absent, absent / self.n_rows,
                         counts[name].n_distinct if name in counts else None,
                         *([getattr(stats, part) for part in
                            ("mean", "std", "std_pop", "minimum", "maximum", "q1", "median", "q3")] if stats else [None] * 8)))
        return self.df.sparkSession.createDataFrame(
            rows, "column string, data_type string, kind string, n_rows long, n_missing long, missing_pct double, "
            "n_distinct long, mean double, std_samp double, std_pop double, min double, max double, q1 double, "
            "median double, q3 double")

    def findings(self) -> DataFrame:
        """Every single finding. Values and spellings come as lazy tables, the rest is column-sized.

        Outliers come with the values of up to five examples; these and duplicates with row ids, where the table has them.
        """
        rows, spark = [], self.df.sparkSession
        examples: dict[str, list] = {}
        if self.outliers:
            for r in outliers.outlier_examples(self.table, self.outliers, self.options, self.row_id, with_ids=True).orderBy("column", "nth").collect():
                examples.setdefault(r["column"], []).append(r)

        def add(check, column, kind, value=None, n=None, pct=None, lower=None, upper=None, ids=None, **details):
            rows.append((check, column, kind, value, n, pct, lower, upper, self.results[check].severity,
                         {k: v if isinstance(v, str) else json.dumps(v, default=str) for k, v in details.items()},
                         [str(i) for i in ids] if ids else None))

        for check, result in self.results.items():
            details = result.details
            if "error" in details:
                add(check, None, "error", error=details["error"])
            elif check == "missing_values" and result.issues_found:
                for column, entry in details["per_column"].items():
                    add(check, column, entry["recommended_action"], None, entry["missing_count"], entry["missing_pct"])
                if details["rows_to_drop_count"]:
                    add(check, None, "sparse_rows", None, details["rows_to_drop_count"])
            elif check == "duplicates" and result.issues_found:
                add(check, None, "duplicate_rows", None, details["duplicate_count"], details["duplicate_pct"],
                    keep=details["keep_strategy"], ids=details.get("sample_duplicate_ids"))
            elif check == "type_inference":
                for column, entry in details.get("type_issues", {}).items():
                    add(check, column, entry["issue_type"], entry["suggested_type"], entry["non_convertible_count"],
                        entry["convertible_pct"], **{k: entry[k] for k in ("current_type", "unique_values", "sample_values")
                                                     if k in entry})
            elif check == "outliers":
                for column, entry in details.get("per_column", {}).items():
                    add(check, column, entry["method"], None, entry["n_outliers"], entry["outlier_pct"],
                        entry.get("lower_fence"), entry.get("upper_fence"),
                        ids=[r.row_id for r in examples.get(column, []) if r.row_id is not None],
                        outlier_examples=[r.value for r in examples.get(column, [])],
                        **{k: v for k, v in entry.items() if k in ("min_value", "max_value", "mean_value", "std_value",
                                                                   "q1", "q3", "iqr", "max_zscore")})
            elif check == "cardinality":
                for column in details.get("constant_columns", []):
                    add(check, column, "constant", None, 1)
                for column, entry in details.get("near_constant_columns", {}).items():
                    add(check, column, "near_constant", entry["dominant_value"], entry["dominant_count"],
                        entry["dominant_pct"], unique_count=entry["unique_count"])
                for column, entry in details.get("high_cardinality_columns", {}).items():
                    add(check, column, "high_cardinality", None, entry["unique_count"], entry["unique_ratio"],
                        top_3_values=entry["top_3_values"], dtype=entry["dtype"])
            elif check in _EXTRA_CHECKS and result.issues_found:
                for column in result.affected_columns or [None]:
                    add(check, column, check, **details)
        parts = [spark.createDataFrame(rows, FINDINGS)]
        if self.categories:
            clusters = categories.category_clusters(self.df, [c.column for c in self.categories], self.options)
            parts.append(clusters.selectExpr(
                "'category_consistency' AS check", "column", "'category_spelling' AS finding_type", "raw_value AS value", "n",
                f"n / {self.n_rows}L AS pct", "CAST(NULL AS DOUBLE) AS lower", "CAST(NULL AS DOUBLE) AS upper",
                "'warning' AS severity", "map('normalized', normalized, 'variants', CAST(variants AS STRING)) AS details",
                "CAST(NULL AS ARRAY<STRING>) AS sample_ids"))
        if self.suspicious is not None:
            parts.append(self.suspicious.selectExpr(
                "'suspicious_values' AS check", "column", "finding_type", "CAST(value AS STRING) AS value", "n",
                f"n / {self.n_rows}L AS pct", "CAST(NULL AS DOUBLE) AS lower", "CAST(NULL AS DOUBLE) AS upper",
                "'warning' AS severity",
                "map_filter(map('magnitude_ratio', CAST(magnitude_ratio AS STRING), "
                "'column_median', CAST(column_median AS STRING)), (k, v) -> v IS NOT NULL) AS details", "sample_ids"))
        return reduce(DataFrame.unionByName, parts)


def profile(df: DataFrame, options: Options = Options(), row_id: str | None = None) -> Profile:
    """Run all checks on a table."""
    return Profile(df, options, row_id).run()

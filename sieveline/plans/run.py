"""Profile, fit and clean in one call, with the audit tables and the gate for automation."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame

from sieveline.functions.fixed import SEVERITIES
from sieveline.options import Options
from sieveline.plans.fit import Operation, Step, fit
from sieveline.plans.plan import CleaningPlan, apply_fix, register_fix, registered_fixes, unregister_fix  # noqa: F401
from sieveline.plans.profile import Profile, profile

@dataclass
class CleaningRun:
    """Everything one run produced. ``cleaned`` is lazy; the audit is known without computing it."""

    profile: Profile
    plan: CleaningPlan
    steps: list[Step]
    cleaned: DataFrame
    dry_run: bool

    @property
    def shape_before(self) -> tuple[int, int]:
        return self.profile.n_rows, len(self.profile.kinds)

    @property
    def shape_after(self) -> tuple[int, int]:
        return self.shape_before if self.dry_run else (self.steps[-1].rows_after, self.steps[-1].cols_after)

    def _table(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.cleaned.sparkSession.createDataFrame(rows, schema)

    def steps_table(self) -> DataFrame:
        """One row per step with the table size before and after it."""
        prefix = "[dry run] " if self.dry_run else ""
        return self._table(
            [(i, s.name, s.applied, s.rows_before, s.rows_after, s.rows_before - s.rows_after, s.cols_before, s.cols_after,
              prefix + s.summary) for i, s in enumerate(self.steps, 1)],
            "step_no int, step string, applied boolean, rows_before long, rows_after long, rows_removed long, "
            "cols_before int, cols_after int, summary string")

    def operations_table(self) -> DataFrame:
        """One row per operation, in order."""
        return self._table(
            [(i, o.type, o.column, o.strategy, o.fill_value, o.n_cells, o.lower, o.upper,
              json.dumps(o.details, default=str, ensure_ascii=False)) for i, s in enumerate(self.steps, 1) for o in s.operations],
            "step_no int, type string, column string, strategy string, fill_value string, n_cells long, lower double, "
            "upper double, details string")

    def run_stats(self) -> DataFrame:
        """One row: sizes before and after, issues found, steps applied and skipped."""
        (rows, cols), (rows_after, cols_after) = self.shape_before, self.shape_after
        applied = sum(s.applied for s in self.steps)
        issues = sum(r.issues_found for r in self.profile.results.values())
        return self._table(
            [(rows, rows_after, rows - rows_after, cols, cols_after, cols - cols_after, issues, applied,
              len(self.steps) - applied)],
            "rows_original long, rows_final long, rows_removed long, cols_original int, cols_final int, cols_removed int, "
            "issues_found int, cleaners_applied int, cleaners_skipped int")

    def has_critical_issues(self) -> bool:
        return any(r.severity == "critical" for r in self.profile.results.values())

    def quality_gate(self) -> DataFrame:
        """One flat row to stop a build on: critical issues, and counts per severity."""
        severities = [r.severity for r in self.profile.results.values()]
        return self._table(
            [(self.has_critical_issues(), sum(r.issues_found for r in self.profile.results.values()),
              *[severities.count(s) for s in SEVERITIES])],
            "has_critical_issues boolean, issues_found int, " + ", ".join(f"n_{s} int" for s in SEVERITIES))

    def summary_document(self, source: str = "unknown", output_files: dict[str, str] | None = None) -> dict:
        """The machine-readable summary of the run."""
        (rows, cols), (rows_after, cols_after) = self.shape_before, self.shape_after
        applied = sum(s.applied for s in self.steps)
        return {
            "meta": {"schema_version": 1, "source_file": source, "dry_run": self.dry_run},
            "dataset": {"original_rows": rows, "original_cols": cols, "final_rows": rows_after, "final_cols": cols_after,
                        "rows_removed": rows - rows_after, "cols_removed": cols - cols_after},
            "summary": {"issues_found": sum(r.issues_found for r in self.profile.results.values()),
                        "cleaners_applied": applied, "cleaners_skipped": len(self.steps) - applied,
                        "has_critical_issues": self.has_critical_issues()},
            "analysis": [
                {"analyzer_name": r.name, "display_name": r.display_name, "issues_found": r.issues_found,
                 "severity": r.severity, "affected_columns": r.affected_columns, "summary": r.summary,
                 "recommendation": r.recommendation} for r in self.profile.results.values()],
            "cleaning": [
                {"cleaner_name": s.name, "applied": s.applied, "rows_before": s.rows_before, "rows_after": s.rows_after,
                 "rows_removed": s.rows_before - s.rows_after, "cols_before": s.cols_before, "cols_after": s.cols_after,
                 "cols_removed": s.cols_before - s.cols_after, "summary": s.summary,
                 "operations": [{k: v for k, v in o.__dict__.items() if v not in (None, {})} for o in s.operations]}
                for s in self.steps],
            "output_files": output_files or {},
        }

    def run_summary(self, source: str = "unknown") -> DataFrame:
        """The summary as one row: flat headline columns and the full document as JSON text."""
        document = self.summary_document(source)
        return self._table(
            [(source, self.dry_run, *document["dataset"].values(), *document["summary"].values(),
              json.dumps(document, default=str, ensure_ascii=False))],
            "source string, dry_run boolean, original_rows long, original_cols int, final_rows long, final_cols int, "
            "rows_removed long, cols_removed int, issues_found int, cleaners_applied int, cleaners_skipped int, "
            "has_critical_issues boolean, document string")

    def release(self) -> None:
        """Delete what was stored for the run; ``cleaned`` must not be computed afterwards."""
        self.profile.release()


def clean(df: DataFrame, options: Options = Options(), dry_run: bool = False, row_id: str | None = None) -> CleaningRun:
    """Run the seven checks, fit the six steps and return the lazily cleaned table with its audit.

    A dry run previews every step on the raw table and returns that table unchanged. Fixes of one's own are steps like
    the others; the rows each leaves are counted by a job of their own.
    """
    facts = profile(df, options, row_id)
    fitted = fit(facts, dry_run)
    cleaned, last = fitted.cleaned, fitted.steps[-1]
    rows, columns = (facts.n_rows, len(facts.kinds)) if dry_run else (last.rows_after, last.cols_after)
    for name in registered_fixes():
        changed = apply_fix(name, cleaned)
        after = changed.count(), len([c for c in changed.columns if c != row_id])
        fitted.steps.append(Step(name, rows, after[0], columns, after[1], (Operation("own_fix", strategy=name),)))
        fitted.plan.extra_fixes.append(name)
        if not dry_run:
            cleaned, (rows, columns) = changed, after
    return CleaningRun(facts, fitted.plan, fitted.steps, cleaned, dry_run)


def rank_issues(summaries: DataFrame, dataset: str = "dataset", most: int = 6, most_columns: int = 5) -> DataFrame:
    """The worst checks of each profiled table, from ``check_summary`` rows tagged with the table's name.

    Order is severity, then the order the checks ran in (column ``check_no``); each row lists the
    first affected columns.
    """
    severity = "array_position(array(" + ", ".join(f"'{s}'" for s in SEVERITIES) + "), severity)"
    return (
        summaries.selectExpr("*", f"row_number() OVER (PARTITION BY {dataset} ORDER BY {severity}, check_no) AS rank")
        .where(f"rank <= {most}")
        .selectExpr(dataset, "rank", "check", "severity", f"slice(affected_columns, 1, {most_columns}) AS affected_columns",
                    "summary")
    )

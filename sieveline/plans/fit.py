"""From a profile to a cleaning plan: learn the constants of every step and record what it does.

What to do is decided on the raw table. The constants that depend on earlier steps (fills,
recomputed fences) and the counts of the audit are aggregated on the table as it reaches the
step, with at most a few scans of the columns concerned and no intermediate table.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.errors import PlanError
from sieveline.functions.columns import (
    BOOLEAN, DATETIME, NUMERIC_KINDS, OTHER, STRING, count_if, is_missing, kinds, number, ref, text,
)
from sieveline.operators import cardinality, fixes, outliers
from sieveline.operators.aggregate import aggregate_row, side_by_side
from sieveline.operators.types import TypeIssue
from sieveline.options import Options
from sieveline.plans.plan import STEPS, CleaningPlan
from sieveline.plans.profile import Profile


@dataclass(frozen=True)
class Operation:
    """One entry of the audit: what was done to which column, with which constants, to how many cells or rows."""

    type: str
    column: str | None = None
    strategy: str | None = None
    fill_value: str | None = None
    n_cells: int | None = None
    lower: float | None = None
    upper: float | None = None
    details: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Step:
    """One cleaner of the run: table size before and after, and its operations. Not applied = no operations."""

    name: str
    rows_before: int
    rows_after: int
    cols_before: int
    cols_after: int
    operations: tuple[Operation, ...] = ()

    @property
    def applied(self) -> bool:
        return bool(self.operations)

    @property
    def summary(self) -> str:
        if not self.applied:
            return "nothing to change"
        kinds_of = [o.type for o in self.operations]
        return ", ".join(f"{kinds_of.count(k)} x {k}" for k in dict.fromkeys(kinds_of))


@dataclass
class Fitted:
    plan: CleaningPlan
    steps: list[Step]
    cleaned: DataFrame


WEIGHT, RAW = "__weight", "__raw_"


def _without_copies(profile: Profile) -> tuple[DataFrame, str | None]:
    """A table that aggregates like the one without duplicates, and the weight column to aggregate by.

    Where a mean is to be learned, it is the rows that stay. Else, few copies are taken away by weight: the raw table counts 1 per row, and each repeated row
    follows once with the negative number of its surplus copies. Aggregates then read only their
    own columns of the raw table, with no join and no shuffle of rows. Plentiful copies have been
    grouped already, in a table in the shared folder.
    """
    keep = profile.options.duplicates.keep
    if not profile.copies.few:
        return profile.copies.kept(keep).select(*[ref(n) for n in profile.df.columns]), None
    if profile.copies.n_hashes and profile.options.missing_values.numeric_imputation == "mean":
        # Sums must not add what they take away again: large values would cancel the others.
        return profile.copies.outside(profile.df).unionByName(
            profile.copies.kept(keep).select(*[ref(n) for n in profile.df.columns])), None
    rows = profile.df.selectExpr("*", f"1L AS {WEIGHT}")
    return rows.unionByName(profile.copies.surplus(keep).withColumnRenamed("__surplus", WEIGHT)
                            .withColumn(WEIGHT, -F.col(WEIGHT))), WEIGHT


def _castable(df: DataFrame, issues: list[TypeIssue]) -> tuple[dict[str, str], list[Operation]]:
    """Casts that Spark accepts for their column; the others become failed operations."""
    casts, failed = {}, []
    for issue in issues:
        try:
            fixes.cast_columns(df, {issue.column: issue.issue}).schema
            casts[issue.column] = issue.issue
        except (PySparkException, PlanError) as error:
            failed.append(Operation("cast_column_failed", issue.column, details={"error": str(error)}))
    return casts, failed


def fit(profile: Profile, dry_run: bool = False) -> Fitted:
    """Learn the constants of the six steps and count what each does.

    In a dry run every step sees the raw table. Otherwise each sees what the ones before leave.
    """
    options, found = profile.options, lambda check: profile.results[check].issues_found
    rules = options.missing_values
    plan = CleaningPlan(
        columns=dict(profile.table.dtypes), row_id=profile.row_id, normalize_case=options.categories.normalize_case,
        strip_whitespace=options.categories.strip_whitespace, action=options.outliers.action, options=options.to_dict(),
        dry_run=dry_run,
    )
    n_rows, raw_columns = profile.n_rows, list(profile.kinds)
    sizes: list[tuple[int, int, int, int]] = []
    operations: list[list[Operation]] = [[] for _ in STEPS]

    # 1. duplicates
    table, weight = profile.df, None
    rows, columns = n_rows, list(raw_columns)
    if found("duplicates"):
        plan.keep = options.duplicates.keep
        operations[0].append(Operation("drop_rows", strategy=plan.keep, n_cells=profile.n_duplicates))
        sizes.append((n_rows, n_rows - profile.n_duplicates, len(columns), len(columns)))
        if not dry_run:
            rows -= profile.n_duplicates
            table, weight = _without_copies(profile)
    else:
        sizes.append((rows, rows, len(columns), len(columns)))

    # 2. constant columns
    if found("cardinality"):
        plan.constant_columns = list(profile.cardinality.constant)
        values = profile.results["cardinality"].details["constant_values"]
        operations[1] += [Operation("drop_column", n, details={"constant_value": values[n]}) for n in plan.constant_columns]
    left = [n for n in columns if n not in plan.constant_columns]
    sizes.append((rows, rows, len(columns), len(left)))
    columns = columns if dry_run else left

    # 3. types and 4. categories: pure projections, counted together with step 5
    plan.casts, failed = _castable(table, [i for i in profile.type_issues if i.column in columns])
    text_columns = [c for c in profile.categories if c.column in columns and (dry_run or c.column not in plan.casts)]
    plan.categories = [c.column for c in text_columns]
    sizes += [(rows, rows, len(columns), len(columns))] * 2
    hidden = [f"{ref(n)} AS {RAW}{i}" for i, n in enumerate(plan.categories)]
    with_raw = table.selectExpr(*[ref(n) for n in columns], *([weight] if weight else []), *hidden)
    shaped = fixes.normalize_categories(
        fixes.cast_columns(with_raw, {n: issue for n, issue in plan.casts.items() if n not in plan.categories}),
        plan.categories, plan.normalize_case, plan.strip_whitespace)
    changes = {
        **{(n, "cast"): count_if(f"{fixes.cast_expression(n, issue)} IS NOT NULL" if n in plan.categories
                                 else f"{ref(n)} IS NOT NULL", weight) for n, issue in plan.casts.items()},
        **{(n, "changed"): count_if(f"{RAW}{i} <> {ref(n)}", weight) for i, n in enumerate(plan.categories)},
    }

    # 5. missing values
    working = with_raw if dry_run else shaped
    impute: dict[str, str] = {}
    gaps: dict[tuple[str, str], str] = {}
    dense = "true"
    if found("missing_values"):
        plan.sparse_columns = [n for n in profile.missing.drop if n in columns]
        left = [n for n in columns if n not in plan.sparse_columns]
        plan.min_present = fixes.min_present(len(left), rules.drop_row_threshold)
        working = working.select(*[ref(n) for n in left], *([weight] if weight else []))
        present_kinds = {n: k for n, k in kinds(working).items() if n != weight}
        dense = fixes.dense_row(present_kinds, plan.min_present, list(plan.casts))
        impute = {n: s for n, s in profile.missing.impute.items() if n in left}
        gaps = {("", "rows"): count_if(dense, weight),
                **{(n, "missing"): count_if(f"{dense} AND {is_missing(n, present_kinds[n])}", weight) for n in impute}}
    else:
        left = columns
        working = working.select(*[ref(n) for n in left], *([weight] if weight else []))
    if dry_run:
        seen = {**(aggregate_row(shaped, changes) if changes else {}), **(aggregate_row(working, gaps) if gaps else {})}
    else:
        seen = aggregate_row(shaped, {**changes, **gaps}) if changes or gaps else {}
    operations[2] = failed + [
        Operation("cast_column", i.column, strategy=i.issue, n_cells=seen[i.column, "cast"],
                  details={"from_type": i.current_type, "to_type": i.suggested_type})
        for i in profile.type_issues if i.column in plan.casts]
    operations[3] = [
        Operation("normalize_category", c.column, n_cells=seen[c.column, "changed"],
                  details={"raw_unique_count": c.raw, "normalized_unique_count": c.normalized}) for c in text_columns]
    rows_kept = seen.get(("", "rows"), rows)
    if found("missing_values"):
        operations[4] += [Operation("drop_column", n, strategy="above_drop_threshold") for n in plan.sparse_columns]
        if rows_kept < rows:
            operations[4].append(Operation("drop_rows", n_cells=rows - rows_kept, details={
                "threshold": rules.drop_row_threshold, "min_present": plan.min_present}))
        working = working.where(dense)
        fillable = {n: s for n, s in impute.items() if 0 < seen[n, "missing"] < rows_kept}
        plan.fills = fit_fills(working, fillable, options, weight)
        operations[4] += [
            Operation("impute_column", f.column, f.strategy, f.value, seen[f.column, "missing"]) for f in plan.fills]
        working = fixes.fill_missing(working, plan.fills)
    sizes.append((rows, rows_kept, len(columns), len(left)))
    if dry_run:
        working, left = profile.df, raw_columns
    else:
        rows = rows_kept

    # 6. outliers
    plan.fences = _fit_fences(working, profile, weight)
    dropped, added = 0, 0
    if plan.fences:
        operations[5], dropped = _count_outliers(working, plan.fences, plan.action, weight)
        added = sum(f"{f.column}_is_outlier" not in left for f in plan.fences) if plan.action == "flag" else 0
    sizes.append((rows, rows - dropped, len(left), len(left) + added))

    steps = [Step(name, *size, tuple(done)) for name, size, done in zip(STEPS, sizes, operations)]
    cleaned = profile.table if dry_run else plan.apply(profile.table, profile.copies)
    return Fitted(plan, steps, cleaned)


def _fit_fences(df: DataFrame, profile: Profile, weight: str | None) -> list[fixes.Fence]:
    """Fences to act on: those of the raw table, rounded to four digits, or new ones where it has none."""
    found = profile.outliers
    known = [fixes.Fence(n, round(o.lower_fence, 4), round(o.upper_fence, 4))
             for n, o in found.items() if o.lower_fence is not None]
    known = fixes.usable_fences(df, known)
    recompute = [n for n, o in found.items() if o.lower_fence is None and n in df.columns]
    quartiles = outliers.column_quantiles(df, recompute, (0.25, 0.75), profile.options, weight)
    for name, q in quartiles.items():
        if q.values[0.25] is not None:
            spread = profile.options.outliers.iqr_multiplier * (q.values[0.75] - q.values[0.25])
            known.append(fixes.Fence(name, q.values[0.25] - spread, q.values[0.75] + spread))
    return known


def _count_outliers(df: DataFrame, fences: list[fixes.Fence], action: str, weight: str | None) -> tuple[list[Operation], int]:
    """Operations of the outlier action, and the rows it drops."""
    column_kinds = kinds(df)
    outside = {f.column: f.outside(column_kinds[f.column]) for f in fences}
    seen = aggregate_row(df, {
        **{(n, "n"): count_if(condition, weight) for n, condition in outside.items()},
        ("", "any"): count_if(" OR ".join(outside.values()), weight),
    })
    label = {"flag": "flag_outlier", "cap": "cap_outlier", "drop": "mark_for_drop_outlier"}[action]
    operations = [
        Operation(label, f.column, action, n_cells=seen[f.column, "n"], lower=f.lower, upper=f.upper,
                  details={"flag_column": f"{f.column}_is_outlier"} if action == "flag" else {})
        for f in fences if action != "cap" or column_kinds[f.column] != BOOLEAN]
    dropped = seen["", "any"] if action == "drop" else 0
    if dropped:
        operations.append(Operation("drop_rows", n_cells=dropped))
    return operations, dropped


def fit_fills(df: DataFrame, strategies: dict[str, str], options: Options, weight: str | None = None) -> list[fixes.Fill]:
    """Fill values for columns with gaps, learned from their present values.

    Median and mean apply to numbers and flags and yield double; for other columns they mean the
    most frequent value, as does an unknown strategy. Ties go to the smallest value.
    """
    column_kinds, types = kinds(df), dict(df.dtypes)
    plain: dict[str, str] = {}
    for name, strategy in strategies.items():
        numeric = column_kinds[name] in (*NUMERIC_KINDS, BOOLEAN)
        if strategy in ("median", "mean") and not numeric or strategy not in ("median", "mean", "zero", "constant"):
            strategy = "mode"
        if column_kinds[name] != OTHER:
            plain[name] = strategy
    factor = weight or "1L"

    def medians() -> dict[str, float | None]:
        found = outliers.column_quantiles(df, [n for n, s in plain.items() if s == "median"], (0.5,), options, weight)
        return {n: q.values[0.5] for n, q in found.items()}

    def means() -> dict[str, float | None]:
        sums = {n: number(n, column_kinds[n]) for n, s in plain.items() if s == "mean"}
        return aggregate_row(df, {
            n: f"sum({value} * {factor}) / sum(CASE WHEN {value} IS NOT NULL THEN {factor} END)" for n, value in sums.items()})

    def modes() -> dict[str, str]:
        names = [n for n, s in plain.items() if s == "mode"]
        return {r["column"]: r["value"] for r in cardinality.top_values(df, names, 1, weight).collect()} if names else {}

    learned = dict(zip(("median", "mean", "mode"), side_by_side(df.sparkSession, medians, means, modes)))
    fills = []
    for name, strategy in plain.items():
        if strategy in ("median", "mean"):
            value, data_type = learned[strategy][name], "double"
        elif strategy == "mode":
            value, data_type = learned[strategy].get(name), types[name]
            if data_type == "timestamp" and value is not None:
                # An instant, printed in the time zone of this session; a replay may run in another.
                value = f"{value} {df.sparkSession.conf.get('spark.sql.session.timeZone')}"
        else:
            value = "0" if strategy == "zero" else options.missing_values.constant_fill_value
            value, data_type = str(value), types[name]
            _check_fill(df, name, value, data_type, column_kinds[name])
        if value is not None:
            fills.append(fixes.Fill(name, strategy, value if isinstance(value, str) else repr(value), data_type))
    return fills


def _check_fill(df: DataFrame, name: str, value: str, data_type: str, kind: str) -> None:
    """Columns are typed, so a constant must convert to the type of the column."""
    if kind == STRING:
        return
    fits = df.sparkSession.sql(f"SELECT try_cast({text(value)} AS {data_type}) IS NOT NULL").first()[0]
    if not fits or kind == DATETIME and value == "0":
        raise PlanError(f"cannot fill {data_type} column {name!r} with {value!r}")

"""For every query the SQL that DuckDB runs on the same tables to check it."""

from __future__ import annotations

from workload.queries import CACHE_NOW
from workload.views import duckdb_sql

CUSTOMER = ["id", "balance", "segment", "nation_code", "notes", "version", "is_active", "age"]
ORDERS = ["id", "order_date", "price", "status", "priority", "qty"]
LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
            "l_returnflag", "l_linestatus", "l_shipdate"]
LINEITEM_NUMBERS = LINEITEM[:8]

ORACLES: dict[str, str] = {}


def over(view: str, body: str) -> str:
    """The body with the dirty view available as ``v``."""
    return f"WITH v AS ({duckdb_sql(view)}) {body}"


def per_column(columns: list[str], template: str) -> str:
    """One SELECT per column, put together; ``{c}`` is the column."""
    return " UNION ALL ".join(template.replace("{c}", c) for c in columns)


def is_number(column: str) -> str:
    return f"regexp_full_match(trim({column}), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')"


def to_number(column: str) -> str:
    return f"CASE WHEN {is_number(column)} THEN CAST(trim({column}) AS DOUBLE) END"


def rounded(expression: str) -> str:
    """Four digits, rounded from the exact binary value as Python does."""
    return f"CAST(format('{{:.4f}}', {expression}) AS DOUBLE)"


def to_date(column: str) -> str:
    return (f"coalesce(try_strptime({column}, '%Y-%m-%d'), try_strptime({column}, '%m/%d/%Y'), try_strptime({column}, '%Y%m%d'))")


def mode_of(column: str, source: str) -> str:
    """Most frequent present value, the smallest on ties."""
    return (f"(SELECT {column} FROM {source} WHERE {column} IS NOT NULL GROUP BY {column} "
            f"ORDER BY count(*) DESC, {column} LIMIT 1)")


# --- missing values
ORACLES["missing_by_column"] = over("dirty_orders", "SELECT * FROM (" + per_column(
    ORDERS, "SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS missing_count, "
    "count(*) FILTER ({c} IS NULL) / count(*) AS missing_pct FROM v") + ") WHERE missing_count > 0")
ORACLES["missing_column_actions"] = over("dirty_customer", """
SELECT *, CASE WHEN missing_pct >= 0.8 THEN 'drop_column' WHEN "column" IN ('id', 'balance', 'is_active', 'age') THEN 'impute_median'
          ELSE 'impute_mode' END AS recommended_action
FROM (""" + per_column(
    CUSTOMER, "SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS missing_count, "
    "count(*) FILTER ({c} IS NULL) / count(*) AS missing_pct FROM v") + ") WHERE missing_count > 0")
_ORDER_GAPS = " + ".join(f"CAST({c} IS NULL AS INT)" for c in ORDERS)
ORACLES["sparse_rows"] = over("dirty_orders", f"SELECT count(*) AS n_rows, count(*) FILTER (({_ORDER_GAPS}) / 6 >= 0.5) AS sparse_rows FROM v")
ORACLES["missing_totals"] = over("dirty_orders", f"""
SELECT CAST(sum({_ORDER_GAPS}) AS BIGINT) AS total_missing_cells, CAST(sum({_ORDER_GAPS}) AS BIGINT) / (count(*) * 6) AS total_missing_pct,
       {' + '.join(f'CAST(count(*) > count({c}) AS BIGINT)' for c in ORDERS)} AS affected_columns FROM v""")

# --- duplicates
for _name, _extra in (("duplicate_count_first", "n - 1"), ("duplicate_count_none", "CASE WHEN n > 1 THEN n ELSE 0 END")):
    ORACLES[_name] = over("dirty_lineitem", f"""
SELECT n_rows, duplicate_count, duplicate_count / n_rows AS duplicate_pct, n_rows - duplicate_count AS rows_that_would_remain
FROM (SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum({_extra}) AS BIGINT) AS duplicate_count
      FROM (SELECT count(*) AS n FROM v GROUP BY {', '.join(LINEITEM)}))""")
ORACLES["duplicate_samples"] = """
SELECT doc_id AS row_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text, lang, source, n_chars ORDER BY doc_id) AS nth FROM documents)
WHERE nth > 1 ORDER BY doc_id LIMIT 10"""

# --- types
ORACLES["numeric_string_columns"] = over("dirty_customer", "SELECT \"column\", CASE WHEN good = n THEN 'numeric_string' "
    "ELSE 'mixed_numeric_string' END AS issue_type, good / n AS convertible_pct, n - good AS non_convertible_count FROM (" + per_column(
    ["segment", "nation_code", "notes", "version"],
    "SELECT '{c}' AS \"column\", count({c}) AS n, count(" + to_number("{c}") + ") AS good FROM v") + ") WHERE good / n >= 0.95")
ORACLES["date_string_columns"] = over("dirty_orders", f"""
SELECT 'order_date' AS "column", 'date_string' AS issue_type, count({to_date('order_date')}) / count(order_date) AS convertible_pct,
       count(order_date) - count({to_date('order_date')}) AS non_convertible_count FROM v""")
ORACLES["boolean_like_columns"] = per_column(
    ["quality", "toxic"], "SELECT '{c}' AS \"column\", '0,1' AS unique_values FROM labels HAVING min({c}) = 0 AND max({c}) = 1 AND count(*) > 50")

# --- outliers
ORACLES["numeric_column_stats"] = per_column(LINEITEM_NUMBERS, """
SELECT '{c}' AS "column", count({c}) AS n_values, round(CAST(min({c}) AS DOUBLE), 6) AS min_value,
       round(CAST(max({c}) AS DOUBLE), 6) AS max_value, round(avg({c}), 6) AS mean_value, round(stddev_samp({c}), 6) AS std_value,
       round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q1, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS median,
       round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q3 FROM lineitem""")
ORACLES["outlier_iqr_fences"] = per_column(LINEITEM_NUMBERS, f"""
SELECT '{{c}}' AS "column", {rounded('q1')} AS q1, {rounded('q3')} AS q3, {rounded('q1 - 1.5 * (q3 - q1)')} AS lower_fence,
       {rounded('q3 + 1.5 * (q3 - q1)')} AS upper_fence
FROM (SELECT quantile_cont(CAST({{c}} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({{c}} AS DOUBLE), 0.75) AS q3 FROM lineitem)""")
EVENT_NUMBERS = ["event_id", "user_id", "value"]


def event_fences(column: str) -> str:
    return (f"(SELECT q1 - CAST(1.5 AS DOUBLE) * (q3 - q1) AS low, q3 + CAST(1.5 AS DOUBLE) * (q3 - q1) AS high FROM (SELECT "
            f"quantile_cont(CAST({column} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({column} AS DOUBLE), 0.75) AS q3 FROM events))")


ORACLES["outlier_iqr_counts"] = "SELECT * FROM (" + per_column(EVENT_NUMBERS, f"""
SELECT '{{c}}' AS "column", count({{c}}) AS n_values, count(*) FILTER ({{c}} < low OR {{c}} > high) AS n_outliers,
       {rounded('any_value(low)')} AS lower_fence, {rounded('any_value(high)')} AS upper_fence
FROM events, {event_fences('{c}')}""") + ") WHERE n_outliers > 0"
ORACLES["outlier_zscore"] = "SELECT * FROM (" + per_column(EVENT_NUMBERS, f"""
SELECT '{{c}}' AS "column", count({{c}}) AS n_values, count(*) FILTER (abs({{c}} - m) / s > 3) AS n_outliers,
       {rounded('max(abs({c} - m) / s)')} AS max_zscore
FROM events, (SELECT avg({{c}}) AS m, stddev_pop({{c}}) AS s FROM events)""") + ") WHERE n_outliers > 0"
ORACLES["outlier_both"] = over("dirty_orders", "SELECT * FROM (" + per_column(["id", "price", "qty"], f"""
SELECT '{{c}}' AS "column", count({{c}}) AS n_values,
       count(*) FILTER ({{c}} < low OR {{c}} > high OR abs({{c}} - m) / s > 3) AS n_outliers,
       {rounded('any_value(low)')} AS lower_fence, {rounded('any_value(high)')} AS upper_fence FROM v, (
  SELECT q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high, m, s FROM (
    SELECT quantile_cont(CAST({{c}} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({{c}} AS DOUBLE), 0.75) AS q3, avg({{c}}) AS m, stddev_pop({{c}}) AS s FROM v))""")
    + ") WHERE n_outliers > 0")
ORACLES["outlier_examples"] = per_column(EVENT_NUMBERS, f"""
SELECT * FROM (SELECT '{{c}}' AS "column", CAST(row_number() OVER (ORDER BY event_id) AS INT) AS nth, CAST({{c}} AS DOUBLE) AS value
FROM events, {event_fences('{c}')} WHERE {{c}} < low OR {{c}} > high) WHERE nth <= 5""")

# --- cardinality
ORACLES["distinct_counts"] = per_column(LINEITEM, """
SELECT '{c}' AS "column", count(*) AS n_distinct, CAST(sum(n) AS BIGINT) AS n_values, max(n) AS top_count
FROM (SELECT count(*) AS n FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c})""")
ORACLES["distinct_texts"] = per_column(["doc_id", "text", "lang", "source", "n_chars"], """
SELECT '{c}' AS "column", count(*) AS n_distinct, max(n) AS top_count
FROM (SELECT count(*) AS n FROM documents WHERE {c} IS NOT NULL GROUP BY {c})""")
ORACLES["value_counts"] = per_column(
    LINEITEM, "SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c}")
ORACLES["constant_columns"] = over("dirty_customer", per_column(
    CUSTOMER, "SELECT '{c}' AS \"column\", CAST(min({c}) AS VARCHAR) AS constant_value FROM v HAVING min({c}) = max({c})"))
ORACLES["near_constant_columns"] = over("skewed_orders", """
SELECT "column", dominant_value, dominant_count, dominant_count / n_rows AS dominant_pct, unique_count FROM (
""" + per_column(["channel", "rate", "status"], """
SELECT '{c}' AS "column", first(value ORDER BY n DESC, value) AS dominant_value, max(n) AS dominant_count, count(*) AS unique_count,
       (SELECT count(*) FROM v) AS n_rows
FROM (SELECT CAST({c} AS VARCHAR) AS value, count(*) AS n FROM v WHERE {c} IS NOT NULL GROUP BY {c})""") + """
) WHERE unique_count > 1 AND dominant_count / n_rows >= 0.99""")
ORACLES["high_cardinality_columns"] = "SELECT \"column\", unique_count, unique_count / n AS unique_ratio FROM (" + per_column(
    ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS unique_count, count(*) AS n FROM orders") + ") WHERE unique_count / n >= 0.95"
ORACLES["top_values"] = per_column(LINEITEM, """
SELECT * FROM (SELECT '{c}' AS "column", CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INT) AS nth,
       CAST({c} AS VARCHAR) AS value, count(*) AS n FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c}) WHERE nth <= 3""")

# --- categories (the whitespace put in is plain spaces)
_CATEGORY = per_column(["segment", "nation_code", "notes", "version"], """
SELECT '{c}' AS "column", count(DISTINCT {c}) AS raw_unique_count, count(DISTINCT lower(trim({c}))) AS normalized_unique_count,
       count(DISTINCT {c}) - count(DISTINCT lower(trim({c}))) AS inconsistency_count FROM v""")
ORACLES["category_counts"] = over("dirty_customer", _CATEGORY)
ORACLES["category_inconsistent_columns"] = over("dirty_customer", f"SELECT * FROM ({_CATEGORY}) WHERE inconsistency_count > 0")
ORACLES["category_clusters"] = over("dirty_customer", per_column(["segment", "nation_code", "notes", "version"], """
SELECT '{c}' AS "column", normalized, raw_value, variants, n FROM (
  SELECT lower(trim({c})) AS normalized, {c} AS raw_value, count(*) AS n,
         count(*) OVER (PARTITION BY lower(trim({c}))) AS variants
  FROM v WHERE {c} IS NOT NULL GROUP BY {c}) WHERE variants > 1"""))

# --- suspicious values
ORACLES["negative_domain_values"] = over("dirty_customer", """
SELECT 'age' AS "column", 'negative_in_positive_domain' AS finding_type, age AS value, count(*) AS n FROM v WHERE age < 0 GROUP BY age""")
_SENTINELS = "(-1, -99, -999, -9999, -99999, 99, 999, 9999, 99999, 999999)"
ORACLES["sentinel_values"] = over("dirty_customer", per_column(["id", "balance", "is_active", "age"], """
SELECT '{c}' AS "column", 'common_placeholder_sentinel' AS finding_type, CAST({c} AS DOUBLE) AS value, count(*) AS n
FROM v, (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) AS m, stddev_samp({c}) AS s FROM v)
WHERE {c} IN """ + _SENTINELS + " AND abs({c} - m) / s >= 2.5 GROUP BY {c}"))
ORACLES["extreme_magnitudes"] = over("dirty_orders", per_column(["id", "price", "qty"], """
SELECT '{c}' AS "column", 'extreme_magnitude' AS finding_type, CAST({c} AS DOUBLE) AS value, count(*) AS n, round(any_value(m), 4) AS column_median
FROM v, (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) AS m FROM v)
WHERE abs(CAST({c} AS DOUBLE)) / abs(m) > 1000 AND {c} NOT IN """ + _SENTINELS + " GROUP BY {c}"))
_SUSPICIOUS = per_column(["id", "balance", "is_active", "age"], """
SELECT '{c}' AS "column", count(*) FILTER ('{c}' = 'age' AND {c} < 0)
       + count(*) FILTER ({c} IN """ + _SENTINELS + """ AND abs({c} - m) / s >= 2.5)
       + count(*) FILTER (m <> 0 AND abs({c}) / abs(m) > 1000 AND {c} NOT IN """ + _SENTINELS + """) AS n
FROM v, (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) AS m, stddev_samp({c}) AS s FROM v)""")
ORACLES["suspicious_totals"] = over("dirty_customer", f"""
SELECT CAST(sum(n) AS BIGINT) AS total_suspicious_cells, count(*) FILTER (n > 0) AS affected_columns FROM ({_SUSPICIOUS})""")
ORACLES["suspicious_samples"] = over("dirty_customer", """
SELECT "column", finding_type, value, max(total) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (nth <= 10) AS sample_ids
FROM (SELECT *, row_number() OVER (PARTITION BY "column", finding_type, value ORDER BY id) AS nth, count(*) OVER (PARTITION BY "column", finding_type, value) AS total FROM (
""" + per_column(["id", "balance", "is_active", "age"], """
SELECT id, '{c}' AS "column", CAST({c} AS DOUBLE) AS value, unnest(list_filter([CASE WHEN '{c}' = 'age' AND {c} < 0 THEN 'negative_in_positive_domain' END,
       CASE WHEN {c} IN """ + _SENTINELS + """ AND abs({c} - m) / s >= 2.5 THEN 'common_placeholder_sentinel' END,
       CASE WHEN m <> 0 AND abs({c}) / abs(m) > 1000 AND {c} NOT IN """ + _SENTINELS + """ THEN 'extreme_magnitude' END], lambda t: t IS NOT NULL)) AS finding_type
FROM v, (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) AS m, stddev_samp({c}) AS s FROM v)""") + ")) GROUP BY \"column\", finding_type, value")

# --- single cleaners
ORACLES["drop_duplicates"] = over("dirty_lineitem", "SELECT DISTINCT * FROM v")
ORACLES["drop_all_duplicates"] = over("dirty_lineitem", f"SELECT {', '.join(LINEITEM)} FROM v GROUP BY {', '.join(LINEITEM)} HAVING count(*) = 1")
ORACLES["drop_duplicates_by_row_id"] = "SELECT max(doc_id) AS doc_id, text, lang, source, n_chars FROM documents GROUP BY text, lang, source, n_chars"
ORACLES["drop_constant_columns"] = over("dirty_customer", "SELECT * EXCLUDE (version) FROM v")
ORACLES["cast_numeric_strings"] = over("dirty_customer", f"SELECT * REPLACE ({to_number('nation_code')} AS nation_code) FROM v")
ORACLES["cast_date_strings"] = over("dirty_orders", f"SELECT * REPLACE ({to_date('order_date')} AS order_date) FROM v")
ORACLES["cast_boolean_flags"] = "SELECT doc_id, quality = 1 AS quality, toxic = 1 AS toxic FROM labels"
ORACLES["normalize_categories"] = over("dirty_customer", """
SELECT id, balance, lower(trim(segment)) AS segment, lower(trim(nation_code)) AS nation_code, lower(trim(notes)) AS notes,
       lower(trim(version)) AS version, is_active, age FROM v""")
ORACLES["drop_sparse_columns"] = over("dirty_customer", "SELECT * EXCLUDE (notes) FROM v")
ORACLES["drop_sparse_rows"] = over("dirty_orders", f"SELECT * FROM v WHERE 6 - ({_ORDER_GAPS}) >= 4")


def _filled(numbers: str, texts: str = "mode", source: str = "v", digits: tuple[int, int] | None = None) -> str:
    """price and qty filled by a statistic, status and priority by their mode or a constant."""
    def number(column: str, place: int) -> str:
        fill = {"median": f"(SELECT quantile_cont(CAST({column} AS DOUBLE), 0.5) FROM {source})", "mean": f"(SELECT avg({column}) FROM {source})",
                "mode": mode_of(column, source), "zero": "0"}[numbers]
        whole = column if numbers in ("mode", "zero") else f"CAST({column} AS DOUBLE)"
        filled = f"coalesce({whole}, {fill})"
        return f"{f'round({filled}, {digits[place]})' if digits else filled} AS {column}"

    def content(column: str) -> str:
        return f"coalesce({column}, {mode_of(column, source) if texts == 'mode' else chr(39) + texts + chr(39)}) AS {column}"

    return f"SELECT id, order_date, {number('price', 0)}, {content('status')}, {content('priority')}, {number('qty', 1)} FROM {source}"


ORACLES["impute_median"] = over("dirty_orders", _filled("median"))
ORACLES["impute_mean"] = over("dirty_orders", _filled("mean", digits=(4, 6)))
ORACLES["impute_mode"] = over("dirty_orders", _filled("mode"))
ORACLES["impute_constant"] = over("dirty_orders", _filled("median", "UNKNOWN"))
ORACLES["impute_zero"] = over("dirty_orders", _filled("zero"))
ORACLES["handle_missing"] = over("dirty_orders", f", kept AS (SELECT * FROM v WHERE 6 - ({_ORDER_GAPS}) >= 4) " + _filled("median", source="kept"))
_OUT = "coalesce({c} < {c}_low OR {c} > {c}_high, false)"
_ALL_FENCES = ", ".join(f"(SELECT low AS {c}_low, high AS {c}_high FROM {event_fences(c)})" for c in EVENT_NUMBERS)
_OUTLYING = ["value"]  # the columns that have outliers; the check of the counts shows which
ORACLES["outlier_flag"] = f"SELECT events.*, {', '.join(_OUT.replace('{c}', c) + f' AS {c}_is_outlier' for c in _OUTLYING)} FROM events, {_ALL_FENCES}"
ORACLES["outlier_cap"] = "SELECT * EXCLUDE (value_low, value_high) REPLACE (" + ", ".join(
    f"CASE WHEN {c} < {c}_low THEN {c}_low WHEN {c} > {c}_high THEN {c}_high ELSE {c} END AS {c}" for c in _OUTLYING) + f") FROM (SELECT events.*, low AS value_low, high AS value_high FROM events, {event_fences('value')})"
ORACLES["outlier_drop"] = f"SELECT events.* FROM events, {_ALL_FENCES} WHERE NOT (" + " OR ".join(_OUT.replace("{c}", c) for c in EVENT_NUMBERS) + ")"

# --- whole runs on the dirty customers
_KINDS = {"id": ("bigint", "integral"), "balance": ("double", "floating"), "segment": ("string", "string"),
          "nation_code": ("string", "string"), "notes": ("string", "string"), "version": ("string", "string"),
          "is_active": ("int", "integral"), "age": ("double", "floating")}
_GAPS = " + ".join(f"CAST({c} IS NULL AS INT)" for c in CUSTOMER)
ORACLES["table_profile"] = over("dirty_customer", f"""
SELECT count(*) AS n_rows, CAST(8 AS INT) AS n_cols, CAST(sum({_GAPS}) AS BIGINT) AS missing_cells,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM v)) AS duplicate_rows, 'id,balance,is_active,age' AS numeric_columns,
       'segment,nation_code,notes,version' AS categorical_columns, '' AS datetime_columns FROM v""")


def _column_profile(name: str) -> str:
    data_type, kind = _KINDS[name]
    numbers = kind != "string"

    def number(expression: str) -> str:
        return expression.replace("{c}", f"CAST({name} AS DOUBLE)") if numbers else "CAST(NULL AS DOUBLE)"

    return f"""SELECT '{name}' AS "column", '{data_type}' AS data_type, '{kind}' AS kind, count(*) AS n_rows,
count(*) - count({name}) AS n_missing, (count(*) - count({name})) / count(*) AS missing_pct, count(DISTINCT {name}) AS n_distinct,
{number('round(avg({c}), 4)')} AS mean, {number('round(stddev_samp({c}), 4)')} AS std_samp, {number('min({c})')} AS min,
{number('max({c})')} AS max, {number('round(quantile_cont({c}, 0.25), 4)')} AS q1, {number('round(quantile_cont({c}, 0.5), 4)')} AS median,
{number('round(quantile_cont({c}, 0.75), 4)')} AS q3 FROM v"""


ORACLES["column_profile"] = over("dirty_customer", " UNION ALL ".join(_column_profile(c) for c in CUSTOMER))


def _fences(column: str) -> str:
    return (f"(SELECT q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM (SELECT quantile_cont({column}, 0.25) AS q1, "
            f"quantile_cont({column}, 0.75) AS q3 FROM v))")


# Facts about the raw view that several runs need: one row.
_FACTS = f""", facts AS (
  SELECT count(*) AS n, CAST(sum({_GAPS}) AS BIGINT) AS gaps, count(*) FILTER (({_GAPS}) / 8 >= 0.5) AS sparse,
         count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM v)) AS dups,
         count(*) FILTER (age < (SELECT low FROM {_fences('age')}) OR age > (SELECT high FROM {_fences('age')})) AS age_out,
         count(*) FILTER (balance < (SELECT low FROM {_fences('balance')}) OR balance > (SELECT high FROM {_fences('balance')})) AS balance_out
  FROM v)"""
def _column_facts(place: int, name: str, kind: str) -> str:
    """What the checks look at in one column of ``v``, as one row."""
    text, flag = kind == "text", kind == "integer"
    outliers = "CAST(0 AS BIGINT)" if text else f"(SELECT count(*) FROM v, {_fences(f'CAST({name} AS DOUBLE)')} WHERE {name} < low OR {name} > high)"
    odd = "CAST(0 AS BIGINT)" if text else f"""(SELECT count(*) FILTER ('{name}' = 'age' AND {name} < 0) + count(*) FILTER ({name} IN {_SENTINELS} AND abs({name} - m) / s >= 2.5)
            + count(*) FILTER (m <> 0 AND abs({name}) / abs(m) > 1000 AND {name} NOT IN {_SENTINELS})
            FROM v, (SELECT quantile_cont(CAST({name} AS DOUBLE), 0.5) AS m, stddev_samp({name}) AS s FROM v))"""
    return f"""SELECT {place} AS place, '{name}' AS name, '{kind}' AS kind, count(*) AS n, count({name}) AS present, count(DISTINCT {name}) AS n_distinct,
       (SELECT max(k) FROM (SELECT count(*) AS k FROM v WHERE {name} IS NOT NULL GROUP BY {name})) AS top,
       {f"greatest(count({to_number(name)}), count({to_date(name)})) / count({name}) >= 0.95" if text else f"min({name}) = 0 AND max({name}) = 1 AND count(DISTINCT {name}) = 2 AND count({name}) > 50" if flag else "false"} AS mistyped,
       {f"count(DISTINCT {name}) - count(DISTINCT lower(trim({name})))" if text else "0"} AS spellings, {outliers} AS outliers, {odd} AS odd FROM v"""


def _summary(columns: dict[str, str]) -> str:
    """``s``: check_no, check, issues_found, severity and affected (a list) of each check on ``v``."""
    gaps = " + ".join(f"CAST({c} IS NULL AS INT)" for c in columns)
    named = "coalesce(list(name ORDER BY {0}place) FILTER ({1}), [])"
    hits = {"type_inference": "mistyped", "category_consistency": "spellings > 0", "suspicious_values": "odd > 0"}
    wide = "CASE WHEN n_distinct = 1 THEN 0 WHEN top / n >= 0.99 THEN 1 WHEN n_distinct / n >= 0.95 THEN 2 END"
    return ", col AS (" + " UNION ALL ".join(_column_facts(i, c, k) for i, (c, k) in enumerate(columns.items())) + f"""),
whole AS (SELECT count(*) AS n, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM v)) AS dups, count(*) FILTER (({gaps}) / {len(columns)} >= 0.5) AS sparse FROM v),
s AS (SELECT check_no, "check", severity <> 'ok' AS issues_found, severity, affected FROM (
SELECT 0 AS check_no, 'missing_values' AS "check", CASE WHEN sum(n - present) = 0 THEN 'ok' WHEN bool_or((n - present) / n >= 0.8) OR (SELECT sparse / n > 0.1 FROM whole) THEN 'critical'
       WHEN sum(n - present) / sum(n) > 0.05 THEN 'warning' ELSE 'info' END AS severity, {named.format('', 'present < n')} AS affected FROM col
UNION ALL SELECT 1, 'duplicates', CASE WHEN dups = 0 THEN 'ok' WHEN dups / n > 0.1 THEN 'critical' ELSE 'warning' END, [] FROM whole
UNION ALL SELECT 3, 'outliers', CASE WHEN count(*) FILTER (outliers > 0) = 0 THEN 'ok' WHEN count(*) FILTER (outliers > 0) / count(*) > 0.5 THEN 'critical' ELSE 'warning' END,
       {named.format('', 'outliers > 0')} FROM col WHERE kind <> 'text'
UNION ALL SELECT 4, 'cardinality', CASE WHEN bool_or(n_distinct = 1) THEN 'critical' WHEN count({wide}) > 0 THEN 'warning' ELSE 'ok' END,
       {named.format(f'{wide}, ', f'{wide} IS NOT NULL')} FROM col
""" + "".join(f"UNION ALL SELECT {i}, '{check}', CASE WHEN bool_or({hit}) THEN 'warning' ELSE 'ok' END, {named.format('', hit)} FROM col\n"
              for i, (check, hit) in zip((2, 5, 6), hits.items())) + "))"


_CUSTOMER_KINDS = {"id": "integer", "balance": "float", "segment": "text", "nation_code": "text", "notes": "text", "version": "text", "is_active": "integer", "age": "float"}
_SKEWED_KINDS = {"id": "integer", "channel": "text", "rate": "float", "status": "text"}
ORACLES["check_summary"] = over("dirty_customer", _summary(_CUSTOMER_KINDS) + """
SELECT "check", issues_found, severity, array_to_string(affected, ',') AS affected_columns FROM s""")

_DEDUP = ", d AS (SELECT DISTINCT * FROM v)"
_CAST = f""", c AS (SELECT id, balance, lower(trim(segment)) AS segment, {to_number('nation_code')} AS nation_code, is_active = 1 AS is_active, age FROM d)"""
_KEPT = """, k AS (SELECT * FROM c WHERE 6 - (CAST(balance IS NULL AS INT) + CAST(segment IS NULL AS INT) + CAST(nation_code IS NULL AS INT)) >= 4)"""
_FILLED = f""", f AS (SELECT id, coalesce(balance, (SELECT quantile_cont(balance, 0.5) FROM k)) AS balance,
       coalesce(segment, {mode_of('segment', 'k')}) AS segment, nation_code, is_active, age FROM k)"""
ORACLES["clean_customer"] = over("dirty_customer", _DEDUP + _CAST + _KEPT + _FILLED + f"""
SELECT f.*, age < {rounded('low')} OR age > {rounded('high')} AS age_is_outlier FROM f, {_fences('age')}""")
_RUN = _DEDUP + _CAST + _KEPT + _FACTS + """, r AS (
  SELECT n, dups, n - dups AS n1, (SELECT count(*) FROM k) AS n2, (SELECT count(*) FROM d) AS n_d FROM facts)"""
ORACLES["clean_steps"] = over("dirty_customer", _RUN + """
SELECT CAST(step_no AS INT) AS step_no, step, true AS applied, rows_before, rows_after, rows_before - rows_after AS rows_removed,
       CAST(cols_before AS INT) AS cols_before, CAST(cols_after AS INT) AS cols_after FROM (
SELECT 1 AS step_no, 'drop_duplicates' AS step, n AS rows_before, n1 AS rows_after, 8 AS cols_before, 8 AS cols_after FROM r
UNION ALL SELECT 2, 'constant_columns', n1, n1, 8, 7 FROM r UNION ALL SELECT 3, 'type_caster', n1, n1, 7, 7 FROM r
UNION ALL SELECT 4, 'category_normalizer', n1, n1, 7, 7 FROM r UNION ALL SELECT 5, 'missing_values', n1, n2, 7, 6 FROM r
UNION ALL SELECT 6, 'outlier_handler', n2, n2, 6, 7 FROM r)""")
ORACLES["dry_run_steps"] = over("dirty_customer", _FACTS + """, r AS (
  SELECT n, dups, (SELECT count(*) FROM v WHERE 7 - (CAST(balance IS NULL AS INT) + CAST(segment IS NULL AS INT)) >= 4) AS dense FROM facts)
SELECT CAST(step_no AS INT) AS step_no, step, true AS applied, rows_before, rows_after, rows_before - rows_after AS rows_removed,
       CAST(cols_before AS INT) AS cols_before, CAST(cols_after AS INT) AS cols_after FROM (
SELECT 1 AS step_no, 'drop_duplicates' AS step, n AS rows_before, n - dups AS rows_after, 8 AS cols_before, 8 AS cols_after FROM r
UNION ALL SELECT 2, 'constant_columns', n, n, 8, 7 FROM r UNION ALL SELECT 3, 'type_caster', n, n, 8, 8 FROM r
UNION ALL SELECT 4, 'category_normalizer', n, n, 8, 8 FROM r UNION ALL SELECT 5, 'missing_values', n, dense, 8, 7 FROM r
UNION ALL SELECT 6, 'outlier_handler', n, n, 8, 9 FROM r)""")
#: Columns: constant ones and those with 80 % missing cells go, each with outliers gets a flag. Issues as the checks find them.
_RUN_FACTS = _RUN + _summary(_CUSTOMER_KINDS) + """, g AS (SELECT CAST(count(*) AS INT) AS c0, CAST(count(*) - count(*) FILTER (n_distinct = 1 OR (n - present) / n >= 0.8) + count(*) FILTER (outliers > 0) AS INT) AS c1 FROM col),
  i AS (SELECT CAST(count(*) FILTER (issues_found) AS INT) AS issues, bool_or(severity = 'critical') AS bad FROM s)"""
ORACLES["run_stats"] = over("dirty_customer", _RUN_FACTS + """
SELECT n AS rows_original, n2 AS rows_final, n - n2 AS rows_removed, c0 AS cols_original, c1 AS cols_final,
       c0 - c1 AS cols_removed, issues AS issues_found, CAST(6 AS INT) AS cleaners_applied, CAST(0 AS INT) AS cleaners_skipped FROM r, g, i""")
ORACLES["run_summary"] = over("dirty_customer", _RUN_FACTS + """
SELECT 'dirty_customer' AS source, false AS dry_run, n AS original_rows, c0 AS original_cols, n2 AS final_rows,
       c1 AS final_cols, n - n2 AS rows_removed, c0 - c1 AS cols_removed, issues AS issues_found,
       CAST(6 AS INT) AS cleaners_applied, CAST(0 AS INT) AS cleaners_skipped, bad AS has_critical_issues,
       CAST(6 AS INT) AS n_cleaning, CAST((SELECT count(*) FROM s) AS INT) AS n_analysis FROM r, g, i""")
ORACLES["quality_gate"] = over("dirty_customer", _summary(_CUSTOMER_KINDS) + """
SELECT bool_or(severity = 'critical') AS has_critical_issues, CAST(count(*) FILTER (issues_found) AS INT) AS issues_found, """ + ", ".join(
    f"CAST(count(*) FILTER (severity = '{k}') AS INT) AS n_{k}" for k in ("critical", "warning", "info", "ok")) + " FROM s")
ORACLES["clean_operations"] = over("dirty_customer", _DEDUP + _CAST + _KEPT + _FACTS + f""", o AS (
SELECT 1 AS step_no, 'drop_rows' AS type, NULL AS "column", 'first' AS strategy, NULL AS fill_value, dups AS n_cells, NULL AS lower, NULL AS upper FROM facts
UNION ALL SELECT 2, 'drop_column', 'version', NULL, NULL, NULL, NULL, NULL
UNION ALL SELECT 3, 'cast_column', 'nation_code', 'mixed_numeric_string', NULL, (SELECT count(nation_code) FROM c), NULL, NULL
UNION ALL SELECT 3, 'cast_column', 'is_active', 'boolean_as_integer', NULL, (SELECT count(is_active) FROM c), NULL, NULL
UNION ALL SELECT 4, 'normalize_category', 'segment', NULL, NULL, (SELECT count(*) FROM d WHERE segment <> lower(trim(segment))), NULL, NULL
UNION ALL SELECT 5, 'drop_column', 'notes', 'above_drop_threshold', NULL, NULL, NULL, NULL
UNION ALL SELECT 5, 'drop_rows', NULL, NULL, NULL, (SELECT count(*) FROM c) - (SELECT count(*) FROM k), NULL, NULL
          WHERE (SELECT count(*) FROM c) > (SELECT count(*) FROM k)
UNION ALL SELECT 5, 'impute_column', 'balance', 'median', CAST(quantile_cont(balance, 0.5) AS VARCHAR), count(*) - count(balance), NULL, NULL FROM k
UNION ALL SELECT 5, 'impute_column', 'segment', 'mode', {mode_of('segment', 'k')}, (SELECT count(*) - count(segment) FROM k), NULL, NULL
UNION ALL SELECT 6, 'flag_outlier', 'age', 'flag', NULL, (SELECT count(*) FROM k, {_fences('age')} WHERE age < low OR age > high),
                 (SELECT {rounded('low')} FROM {_fences('age')}), (SELECT {rounded('high')} FROM {_fences('age')}))
SELECT CAST(step_no AS INT) AS step_no, type, CAST("column" AS VARCHAR) AS "column", CAST(strategy AS VARCHAR) AS strategy,
       CAST(fill_value AS VARCHAR) AS fill_value, CAST(n_cells AS BIGINT) AS n_cells, CAST(lower AS DOUBLE) AS lower, CAST(upper AS DOUBLE) AS upper FROM o""")
ORACLES["findings"] = over("dirty_customer", _FACTS + f"""
SELECT CAST("check" AS VARCHAR) AS "check", CAST("column" AS VARCHAR) AS "column", finding_type, CAST(value AS VARCHAR) AS value,
       CAST(n AS BIGINT) AS n, severity FROM (
SELECT 'missing_values' AS "check", 'balance' AS "column", 'impute_median' AS finding_type, NULL AS value, count(*) - count(balance) AS n, 'critical' AS severity FROM v
UNION ALL SELECT 'missing_values', 'segment', 'impute_mode', NULL, count(*) - count(segment), 'critical' FROM v
UNION ALL SELECT 'missing_values', 'notes', 'drop_column', NULL, count(*) - count(notes), 'critical' FROM v
UNION ALL SELECT 'missing_values', NULL, 'sparse_rows', NULL, sparse, 'critical' FROM facts WHERE sparse > 0
UNION ALL SELECT 'duplicates', NULL, 'duplicate_rows', NULL, dups, 'warning' FROM facts
UNION ALL SELECT 'type_inference', 'nation_code', 'mixed_numeric_string', 'double', count(nation_code) - count({to_number('nation_code')}), 'warning' FROM v
UNION ALL SELECT 'type_inference', 'is_active', 'boolean_as_integer', 'boolean', 0, 'warning'
UNION ALL SELECT 'outliers', 'age', 'iqr', NULL, age_out, 'warning' FROM facts
UNION ALL SELECT 'cardinality', 'version', 'constant', NULL, 1, 'critical'
UNION ALL SELECT 'cardinality', 'id', 'high_cardinality', NULL, count(DISTINCT id), 'critical' FROM v
UNION ALL SELECT 'category_consistency', 'segment', 'category_spelling', raw_value, n, 'warning' FROM (
  SELECT segment AS raw_value, count(*) AS n, count(*) OVER (PARTITION BY lower(trim(segment))) AS variants FROM v WHERE segment IS NOT NULL GROUP BY segment)
  WHERE variants > 1
UNION ALL SELECT 'suspicious_values', 'age', t, '-999.0', count(*), 'warning' FROM v,
  (SELECT unnest(['negative_in_positive_domain', 'common_placeholder_sentinel']) AS t) WHERE age < 0 GROUP BY t
UNION ALL SELECT 'suspicious_values', 'id', 'common_placeholder_sentinel', CAST(CAST(id AS DOUBLE) AS VARCHAR), count(*), 'warning'
  FROM v, (SELECT quantile_cont(id, 0.5) AS m, stddev_samp(id) AS s FROM v) WHERE id IN {_SENTINELS} AND abs(id - m) / s >= 2.5 GROUP BY id
UNION ALL SELECT 'suspicious_values', 'balance', 'extreme_magnitude', 'never', 0, 'warning' WHERE false)""")
ORACLES["finding_samples"] = over("dirty_customer", """
, d AS (SELECT id, row_number() OVER (PARTITION BY balance, segment, nation_code, notes, version, is_active, age ORDER BY id) AS nth FROM v)
SELECT 'duplicates' AS "check", CAST(NULL AS VARCHAR) AS "column", (SELECT count(*) FROM d WHERE nth > 1) AS n,
       string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS sample_ids, CAST(NULL AS VARCHAR) AS examples
FROM (SELECT id FROM d WHERE nth > 1 ORDER BY id LIMIT 10) HAVING count(*) > 0 UNION ALL """ + per_column(["balance", "age"], """
SELECT * FROM (SELECT 'outliers', '{c}', max(n) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY nth), string_agg(CAST({c} AS VARCHAR), ',' ORDER BY nth) FROM (
  SELECT id, {c}, row_number() OVER (ORDER BY id) AS nth, count(*) OVER () AS n FROM v, """ + _fences("{c}") + """ WHERE {c} < low OR {c} > high) WHERE nth <= 5)
WHERE n > 0"""))


def _ranked(view: str, kinds: dict[str, str]) -> str:
    return f"""SELECT * FROM (SELECT '{view}' AS dataset, CAST(row_number() OVER (ORDER BY list_position(['critical', 'warning', 'info', 'ok'], severity), check_no) AS INT) AS rank,
  "check", severity, array_to_string(affected[1:5], ',') AS affected_columns FROM ({over(view, _summary(kinds) + ' SELECT * FROM s')})) WHERE rank <= 3"""


ORACLES["issue_ranking"] = _ranked("dirty_customer", _CUSTOMER_KINDS) + " UNION ALL " + _ranked("skewed_orders", _SKEWED_KINDS)


# --- whole runs on the dirty orders
def _orders_run(source: str) -> str:
    """Raw fences from ``source``; duplicates: none; casts: order_date; sparse rows; fills."""
    return f""", c AS (SELECT id, {to_date('order_date')} AS order_date, price, status, priority, qty FROM v)
, k AS (SELECT * FROM c WHERE 6 - (CAST(order_date IS NULL AS INT) + CAST(price IS NULL AS INT) + CAST(status IS NULL AS INT)
        + CAST(priority IS NULL AS INT) + CAST(qty IS NULL AS INT)) >= 4)
, learn AS ({source})
, f AS (SELECT id, order_date, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM learn)) AS price,
       coalesce(status, {mode_of('status', 'learn')}) AS status, coalesce(priority, {mode_of('priority', 'learn')}) AS priority,
       coalesce(CAST(qty AS DOUBLE), (SELECT quantile_cont(CAST(qty AS DOUBLE), 0.5) FROM learn)) AS qty FROM k)"""


ORACLES["clean_orders_cap"] = over("dirty_orders", _orders_run("SELECT * FROM k") + f"""
SELECT id, order_date, CASE WHEN price < {rounded('low')} THEN {rounded('low')} WHEN price > {rounded('high')} THEN {rounded('high')} ELSE price END AS price,
       status, priority, qty FROM f, {_fences('price')}""")
ORACLES["clean_orders_drop"] = over("dirty_orders", _orders_run("SELECT * FROM k") + f"""
SELECT f.* FROM f, (SELECT q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM (
  SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM f)) WHERE price BETWEEN low AND high""")
ORACLES["plan_replay"] = over("dirty_orders", _orders_run("SELECT * FROM k WHERE id % 2 = 0") + f"""
SELECT f.*, price < {rounded('low')} OR price > {rounded('high')} AS price_is_outlier FROM f,
  {_fences('price').replace('FROM v)', 'FROM v WHERE id % 2 = 0)')}""")
ORACLES["csv_round_trip"] = over("dirty_orders", "SELECT id, order_date, price, status, priority, CAST(qty AS DOUBLE) AS qty FROM v")
ORACLES["stream_replay"] = over("dirty_events", f""", d AS (SELECT DISTINCT * FROM v), n AS (
  SELECT event_id, ts, user_id, lower(event_type) AS event_type, value FROM d)
SELECT event_id, ts, user_id, event_type, coalesce(value, (SELECT quantile_cont(value, 0.5) FROM n)) AS value,
       coalesce(value, (SELECT quantile_cont(value, 0.5) FROM n)) < {rounded('low')}
       OR coalesce(value, (SELECT quantile_cont(value, 0.5) FROM n)) > {rounded('high')} AS value_is_outlier FROM n, {_fences('value')}""")

ORACLES["stream_replay_files"] = ORACLES["stream_replay"]

# --- prompts and replies
_TOKENS = "CAST(ceil(length(text) / 3.5) AS BIGINT)"
ORACLES["estimate_tokens"] = f"SELECT doc_id, {_TOKENS} AS estimated_tokens FROM documents"


def _budget(table: str, run: str, seq: str, shown: str, limit: int) -> str:
    return f"""
SELECT {shown}, estimated_tokens, used_before, estimated_tokens <= greatest({limit} - used_before, 0) AS affordable FROM (
  SELECT *, CAST(coalesce(sum(estimated_tokens) OVER (PARTITION BY {run} ORDER BY {seq} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used_before
  FROM (SELECT *, {_TOKENS} AS estimated_tokens FROM {table}))"""


ORACLES["token_budget_prefix"] = _budget("conversations", "conv_id", "turn", "conv_id, turn", 500)
ORACLES["token_budget_one_run"] = _budget("documents", "1", "doc_id", "doc_id", 100_000)
_CACHE = f"""WITH p AS ({duckdb_sql('prompts')}), c AS ({duckdb_sql('reply_cache')}), live AS (
  SELECT prompt_key, last(response ORDER BY cached_at, response) AS response, max(cached_at) AS cached_at FROM c GROUP BY prompt_key
  HAVING epoch_us(TIMESTAMP '{CACHE_NOW}') - epoch_us(max(cached_at)) <= CAST(86400000000 AS BIGINT))"""
ORACLES["reply_cache_hits"] = _CACHE + "SELECT conv_id, turn, prompt_key, response, cached_at FROM p JOIN live ON sha256(p.text) = prompt_key"
ORACLES["reply_cache_misses"] = _CACHE + """
SELECT conv_id, turn, sha256(text) AS prompt_key FROM p WHERE sha256(text) NOT IN (SELECT prompt_key FROM live)"""
ORACLES["reply_cache_refresh"] = _CACHE + f"""
SELECT conv_id, turn, sha256(p.text) AS prompt_key, coalesce(response, 'new reply 64 ' || substr(sha256(p.text), 1, 8)) AS response,
       epoch_us(coalesce(cached_at, TIMESTAMP '{CACHE_NOW}' - INTERVAL 1 HOUR)) AS cached_at_us
FROM p LEFT JOIN live ON sha256(p.text) = prompt_key"""
_TRY = "CASE WHEN json_valid({0}) AND json_type({0}) = 'OBJECT' THEN {0} END"
_CANDIDATES = ", ".join(_TRY.format(c) for c in (
    "trim(reply)", r"regexp_extract(reply, '(?s)```(?:json)?\s*(\{.*?\})\s*```', 1)", r"regexp_extract(reply, '(?s)(\{.*\})', 1)"))
ORACLES["parse_replies"] = over("replies", f""", j AS (SELECT reply_id, CAST(coalesce({_CANDIDATES}) AS JSON) AS o FROM v),
t AS (SELECT reply_id, o, coalesce(json_type(o, '$.overall_summary') = 'VARCHAR' AND json_type(o, '$.score_rationale') = 'VARCHAR'
      AND TRY_CAST(o ->> '$.data_quality_score' AS DOUBLE) IS NOT NULL, false) AS valid FROM j)
SELECT reply_id, valid, CASE WHEN valid THEN o ->> '$.overall_summary' END AS overall_summary,
       CASE WHEN valid THEN CAST(greatest(0, least(100, trunc(CAST(o ->> '$.data_quality_score' AS DOUBLE)))) AS INT) END AS data_quality_score,
       CASE WHEN valid THEN o ->> '$.score_rationale' END AS score_rationale, CASE WHEN valid THEN '' END AS cleaning_assessment,
       CASE WHEN valid THEN CAST(0 AS INT) END AS n_insights,
       CASE WHEN valid THEN array_to_string(list_filter(CAST(o -> '$.recommendations' AS VARCHAR[]), lambda r: trim(r) <> ''), '|') END AS recommendations
FROM t""")

"""Dirty views over the given tables, as SQL text for both engines.

The tables are clean, so missing cells, copies, mixed spellings, mistyped columns and sentinels are
put in by key arithmetic. ``render`` fills in the few functions whose names differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_CUSTOMER = """
SELECT c_custkey AS id,
       CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS balance,
       CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 4 = 0 THEN lower(c_mktsegment)
            WHEN c_custkey % 4 = 1 THEN concat(' ', c_mktsegment, ' ') ELSE c_mktsegment END AS segment,
       CASE WHEN c_custkey % 40 = 0 THEN 'n.a.' ELSE CAST(c_nationkey AS STRING) END AS nation_code,
       CASE WHEN c_custkey % 10 = 0 THEN c_name END AS notes,
       'v1' AS version,
       CAST(c_custkey % 2 AS INT) AS is_active,
       CAST(CASE WHEN c_custkey % 500 = 0 THEN -999 ELSE 20 + c_custkey % 50 END AS DOUBLE) AS age
FROM {customer}"""

VIEWS = {
    # 2 % copies, 14 % / 9 % / 90 % missing cells, four spellings, numbers and flags in the wrong type
    "dirty_customer": f"{_CUSTOMER} UNION ALL {_CUSTOMER} WHERE c_custkey % 50 = 0",
    # dates as text in three layouts, rows with half of their cells missing, extreme prices
    "dirty_orders": """
SELECT o_orderkey AS id,
       CASE WHEN o_orderkey % 97 = 0 THEN 'unknown' WHEN o_orderkey % 3 = 0 THEN {iso_date}
            WHEN o_orderkey % 3 = 1 THEN {us_date} ELSE {compact_date} END AS order_date,
       CASE WHEN o_orderkey % 101 = 0 THEN NULL WHEN o_orderkey % 251 = 0 THEN o_totalprice * 5000
            ELSE o_totalprice END AS price,
       CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE o_orderstatus END AS status,
       CASE WHEN o_orderkey % 101 = 0 OR o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS priority,
       CAST(CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE 1 + o_orderkey % 7 END AS INT) AS qty
FROM {orders}""",
    # the largest table, with copies of 2 % of its rows and one row that makes up a third of it
    "dirty_lineitem": """
SELECT * FROM {lineitem} UNION ALL SELECT * FROM {lineitem} WHERE l_orderkey % 50 = 0
UNION ALL
SELECT l_orderkey * 0 + 1, l_partkey * 0 + 1, l_suppkey * 0 + 1, CAST(l_linenumber * 0 + 1 AS INT), l_quantity * 0 + 1,
       l_extendedprice * 0 + 1, l_discount * 0, l_tax * 0, 'N', 'O', {hot_date}
FROM {lineitem} WHERE l_orderkey % 2 = 0""",
    # a stream source with copies, gaps, spellings and a constant
    "dirty_events": """
SELECT event_id, ts, user_id, CASE WHEN event_id % 5 = 0 THEN upper(event_type) ELSE event_type END AS event_type,
       CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value, 'web' AS channel
FROM {events}
UNION ALL
SELECT event_id, ts, user_id, CASE WHEN event_id % 5 = 0 THEN upper(event_type) ELSE event_type END AS event_type,
       CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value, 'web' AS channel
FROM {events} WHERE event_id % 20 = 0""",
    # one value in 99.5 % of the rows
    "skewed_orders": """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 200 = 0 THEN 'manual' ELSE 'auto' END AS channel,
       CASE WHEN o_orderkey % 200 = 1 THEN 0.5 ELSE 1.0 END AS rate, o_orderstatus AS status
FROM {orders}""",
    # model replies: plain, fenced, wrapped in prose, and several kinds of broken ones
    "replies": """
SELECT doc_id AS reply_id, CASE doc_id % 8
    WHEN 0 THEN body
    WHEN 1 THEN concat('```json', chr(10), body, chr(10), '```')
    WHEN 2 THEN concat('Here is the assessment: ', body, ' I hope it helps.')
    WHEN 3 THEN replace(body, '"score_rationale"', '"reason"')
    WHEN 4 THEN concat('[', body, ']')
    WHEN 5 THEN replace(body, '"data_quality_score":', '"data_quality_score":"n/a","score":')
    WHEN 6 THEN concat('  ', replace(body, '"data_quality_score":', '"data_quality_score":-'))
    ELSE 'no answer' END AS reply
FROM (SELECT doc_id, concat('{{"overall_summary":"', lang, ' text from ', source, '","data_quality_score":',
             CAST(n_chars % 150 AS STRING), ',"score_rationale":"', CAST(n_chars AS STRING),
             ' characters","recommendations":["trim","","check ', lang, '"]}}') AS body FROM {documents}) AS bodies""",
    # prompts and the cache of earlier replies to some of them
    "prompts": "SELECT conv_id, turn, text FROM {conversations} WHERE role = 'user'",
    "reply_cache": """
SELECT {sha256} AS prompt_key, concat('reply ', CAST(conv_id AS STRING)) AS response,
       {cache_start} + {cache_hours} AS cached_at
FROM {conversations} WHERE role = 'user' AND conv_id % 3 <> 0""",
}

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)
_SPARK = {
    "iso_date": "date_format(o_orderdate, 'yyyy-MM-dd')", "us_date": "date_format(o_orderdate, 'MM/dd/yyyy')",
    "compact_date": "date_format(o_orderdate, 'yyyyMMdd')", "sha256": "sha2(text, 256)",
    "cache_start": "TIMESTAMP_NTZ '2024-01-01 00:00:00'", "hot_date": "TIMESTAMP_NTZ '1998-01-01 00:00:00'", "cache_hours": "(conv_id % 48) * INTERVAL '1' HOUR",
}
_DUCKDB = {
    "iso_date": "strftime(o_orderdate, '%Y-%m-%d')", "us_date": "strftime(o_orderdate, '%m/%d/%Y')",
    "compact_date": "strftime(o_orderdate, '%Y%m%d')", "sha256": "sha256(text)",
    "cache_start": "TIMESTAMP '2024-01-01 00:00:00'", "hot_date": "TIMESTAMP '1998-01-01 00:00:00'", "cache_hours": "to_hours(conv_id % 48)",
}


def duckdb_sql(name: str) -> str:
    """The view as DuckDB SQL over the registered tables."""
    return VIEWS[name].format(**_DUCKDB, **{t: t for t in TABLES})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, **replaced: DataFrame) -> DataFrame:
    """The view on Spark; a table can be replaced, e.g. by a stream."""
    used = {t: replaced.get(t) or table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in VIEWS[name]}
    for t, df in used.items():
        df.createOrReplaceTempView(f"given_{t}")
    return spark.sql(VIEWS[name].format(**_SPARK, **{t: f"given_{t}" for t in TABLES}))

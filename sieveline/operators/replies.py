"""Tables of prompts and model replies: token budget, reply cache, reply parsing."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.columns import ref, text
from sieveline.functions.scalars import estimate_tokens, parse_number, prompt_key
from sieveline.sources.shared import written

HOT_ROWS = 1_000_000
#: Buckets of a stored cache: by so many hexadecimal digits of the key. Keys of another form make other buckets; beyond MOST_BUCKETS all are read.
BUCKET, BUCKET_DIGITS, MOST_BUCKETS = "bucket", 2, 256
_CACHE_SCHEMA = "prompt_key string, response string, cached_at timestamp"
#: The most bytes of replies that are broadcast.
BROADCAST_BYTES = 32 << 20


# --- token budget -------------------------------------------------------------------------------

def running_total(df: DataFrame, run: str, seq: str, cost: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds ``used_before``: the cost of all earlier rows of the same run, by ascending ``seq``.

    Where a run has more than ``hot_rows`` rows, the table is dealt once by ranges of run and seq, which follow the data, and
    stored. Costs are summed per run and range, one row each; their own running total is put before the rows of each
    range, which are then accumulated within it. A NULL run is a run. ``seq`` is unique within a run.
    """
    shown = [ref(n) for n in df.columns]
    sizes = df.groupBy(ref(run)).agg(F.expr("count(1) AS __n")).agg(F.expr("sum(__n) AS n"), F.expr("max(__n) AS most")).first()
    if (sizes.most or 0) <= hot_rows:
        return df.selectExpr(*shown, f"{_earlier(cost, ref(run), ref(seq))} AS used_before")
    ranges = -(-sizes.n // hot_rows) + 1
    ranged = written(df.repartitionByRange(ranges, ref(run), ref(seq)).withColumns({"__range": F.spark_partition_id(), "__row": F.lit(1)}))
    sums = ranged.groupBy(ref(run), "__range").agg(F.expr(f"sum({ref(cost)}) AS __sum"))
    before = sums.selectExpr(ref(run), "__range", "0 AS __row", f"{_earlier('__sum', ref(run), '__range')} AS {ref(cost)}")
    every = ranged.unionByName(before, allowMissingColumns=True)
    return (every.selectExpr(*shown, "__row", f"{_earlier(cost, f'{ref(run)}, __range', f'__row, {ref(seq)}')} AS used_before")
            .where("__row = 1").drop("__row"))


def _earlier(cost: str, by: str, order: str) -> str:
    return (f"coalesce(sum({ref(cost)}) OVER (PARTITION BY {by} ORDER BY {order} "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")


def token_budget(df: DataFrame, run: str, seq: str, prompt: str, max_tokens: int, expected_output: int = 0,
                 hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds estimated_tokens, used_before and affordable to every prompt of a run.

    A prompt is affordable while its estimate plus the expected output fits in what the earlier
    prompts of the run have left of the budget. Every earlier prompt counts as used, so the
    affordable ones come first.
    """
    priced = df.withColumn("estimated_tokens", F.expr(f"{estimate_tokens(ref(prompt))} + {int(expected_output)}"))
    return running_total(priced, run, seq, "estimated_tokens", hot_rows).withColumn(
        "affordable", F.expr(f"estimated_tokens <= greatest({int(max_tokens)} - used_before, 0)"))


# --- reply cache --------------------------------------------------------------------------------

def with_prompt_key(df: DataFrame, prompt: str) -> DataFrame:
    return df.withColumn("prompt_key", F.expr(prompt_key(ref(prompt))))


def _age_hours(now: str) -> str:
    return f"(unix_micros(CAST({text(now)} AS TIMESTAMP)) - unix_micros(CAST(cached_at AS TIMESTAMP))) / 3600e6"


def latest_replies(cache: DataFrame) -> DataFrame:
    """The latest entry per key of a cache table (prompt_key, response, cached_at). Partial aggregation applies."""
    return cache.groupBy("prompt_key").agg(
        F.expr("max_by(response, struct(cached_at, response)) AS response"), F.expr("max(cached_at) AS cached_at"))


def lookup_replies(prompts: DataFrame, cache: DataFrame, now: str, ttl_hours: float = 24, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds response and cached_at to every prompt with a live cache entry; both NULL otherwise.

    ``prompts`` carries prompt_key. An entry is live while its age is at most ``ttl_hours`` at
    ``now`` (a timestamp literal); 0 never expires. Prompts whose key occurs more than
    ``hot_rows`` times are joined with their own entries by broadcast if the size of these, which is
    summed first, allows it; beyond it all are joined by shuffle, where Spark splits skewed keys.
    """
    live = latest_replies(cache)
    if ttl_hours > 0:
        live = live.where(f"{_age_hours(now)} <= {float(ttl_hours)}D")
    hot = prompts.groupBy("prompt_key").agg(F.expr("count(1) AS n")).where(f"n > {hot_rows}").select("prompt_key")
    if hot.isEmpty():
        return prompts.join(live, "prompt_key", "left")
    entries = live.join(hot, "prompt_key", "left_semi")
    size = entries.agg(F.expr("sum(coalesce(octet_length(response), 0) + octet_length(prompt_key) + 64)")).first()[0]
    if (size or 0) > BROADCAST_BYTES:
        return prompts.join(live, "prompt_key", "left")
    usual = prompts.join(hot, "prompt_key", "left_anti").join(live, "prompt_key", "left")
    frequent = prompts.join(hot, "prompt_key", "left_semi").join(
        F.broadcast(entries), "prompt_key", "left")
    return usual.unionByName(frequent)


def cache_hits(prompts: DataFrame, cache: DataFrame, now: str, ttl_hours: float = 24, hot_rows: int = HOT_ROWS) -> DataFrame:
    return lookup_replies(prompts, cache, now, ttl_hours, hot_rows).where("cached_at IS NOT NULL")


def cache_misses(prompts: DataFrame, cache: DataFrame, now: str, ttl_hours: float = 24, hot_rows: int = HOT_ROWS) -> DataFrame:
    return lookup_replies(prompts, cache, now, ttl_hours, hot_rows).where("cached_at IS NULL").drop("response", "cached_at")


def read_cache(spark: SparkSession, folder: str) -> DataFrame:
    """The entries (prompt_key, response, cached_at) of a cache folder, one per key; none where nothing is stored yet."""
    try:
        return spark.read.schema(f"{_CACHE_SCHEMA}, {BUCKET} string").parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{_CACHE_SCHEMA}, {BUCKET} string")


def _put(entries: DataFrame, folder: str, mode: str) -> None:
    kept = written(entries.select("prompt_key", "response", "cached_at", BUCKET))  # what is read is not what is replaced
    # One task per bucket, so that a bucket is one file.
    (kept.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(BUCKET).parquet(folder))


def store_replies(entries: DataFrame, folder: str) -> None:
    """Set or refresh entries (prompt_key, response, cached_at): of each key the latest stays, in the folder and among the new ones.

    The folder is cut into buckets by the start of the key. Only buckets with new keys are read, joined with the new entries by
    one aggregation, and replaced, each as a whole; a run that fails in between is repeated with the same result. Entries without a
    key or a time are left out: they can never be looked up. There is one writer at a time.
    """
    new = entries.where("prompt_key IS NOT NULL AND cached_at IS NOT NULL").selectExpr(
        "prompt_key", "response", "CAST(cached_at AS TIMESTAMP) AS cached_at", f"lower(substring(prompt_key, 1, {BUCKET_DIGITS})) AS {BUCKET}")
    new = written(new)
    touched = [r[0] for r in new.select(BUCKET).distinct().limit(MOST_BUCKETS + 1).collect()]
    old = read_cache(new.sparkSession, folder)
    if len(touched) <= MOST_BUCKETS:
        old = old.where(F.col(BUCKET).isin(touched))
    both = old.unionByName(new.select(*old.columns))
    _put(latest_replies(both).withColumn(BUCKET, F.expr(f"lower(substring(prompt_key, 1, {BUCKET_DIGITS}))")), folder, "dynamic")


def expire_replies(spark: SparkSession, folder: str, now: str, ttl_hours: float) -> None:
    """Take the entries away whose age at ``now`` is above ``ttl_hours``; 0 keeps all. Buckets without such entries are not written."""
    if ttl_hours <= 0:
        return
    cache = read_cache(spark, folder)
    old = f"{_age_hours(now)} > {float(ttl_hours)}D"
    stale = cache.where(old).select(BUCKET).distinct()
    left = written(cache.join(F.broadcast(stale), BUCKET, "left_semi").where(f"NOT ({old})"))
    emptied = stale.join(left.select(BUCKET).distinct(), BUCKET, "left_anti")
    if emptied.isEmpty():
        _put(left, folder, "dynamic")
    else:  # a bucket without entries can only be left out when all are written
        _put(cache.where(f"NOT ({old})"), folder, "static")


def clear_replies(spark: SparkSession, folder: str) -> int:
    """Take all entries away; how many there were."""
    cache = read_cache(spark, folder)
    n = cache.count()
    if n:
        _put(cache.limit(0), folder, "static")
    return n


# --- reply parsing ------------------------------------------------------------------------------

_FENCED = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"
_BRACES = r"(?s)(\{.*\})"


def _object(candidate: str) -> str:
    """The candidate text as a JSON object, or NULL."""
    parsed = f"try_parse_json({candidate})"
    return f"CASE WHEN schema_of_variant({parsed}) LIKE 'OBJECT%' THEN {parsed} END"


def parse_replies(df: DataFrame, reply: str) -> DataFrame:
    """Adds the validated fields of each reply, and ``valid``; fields of invalid replies are NULL.

    The JSON object is the whole text, else the first fenced block, else the text from the first
    to the last brace. Summary and rationale must be strings, the score a number or numeric text;
    it is cut to a whole number and clamped to 0..100. Missing lists are empty; list entries of
    the wrong shape are left out.
    """
    body = ref(reply)
    found = df.withColumn("__json", F.expr(
        f"coalesce({_object(f'trim({body})')}, {_object(f'regexp_extract({body}, {text(_FENCED)}, 1)')}, "
        f"{_object(f'regexp_extract({body}, {text(_BRACES)}, 1)')})"))

    def field(name: str) -> str:
        return f"variant_get(__json, '$.{name}')"

    def kind(name: str) -> str:
        return f"coalesce(schema_of_variant({field(name)}), 'ABSENT')"

    def as_text(name: str) -> str:
        return f"CASE WHEN {kind(name)} = 'STRING' THEN try_variant_get(__json, '$.{name}', 'string') END"

    score = (f"CASE WHEN {kind('data_quality_score')} = 'STRING' "
             f"THEN {parse_number("try_variant_get(__json, '$.data_quality_score', 'string')")} "
             f"WHEN {kind('data_quality_score')} RLIKE '^(BIGINT|DOUBLE|FLOAT|DECIMAL|BOOLEAN)' "
             "THEN try_variant_get(__json, '$.data_quality_score', 'double') END")
    typed = found.selectExpr(
        *[ref(n) for n in df.columns], "__json",
        f"{as_text('overall_summary')} AS overall_summary",
        f"{score} AS __score",
        f"{as_text('score_rationale')} AS score_rationale",
        f"coalesce({as_text('cleaning_assessment')}, '') AS cleaning_assessment",
        "coalesce(try_variant_get(__json, '$.column_insights', 'array<variant>'), array()) AS __insights",
        "coalesce(try_variant_get(__json, '$.recommendations', 'array<variant>'), array()) AS __recommendations",
    ).withColumn("valid", F.expr(
        "overall_summary IS NOT NULL AND score_rationale IS NOT NULL AND __score IS NOT NULL AND NOT isnan(__score)"))
    insights = (
        "transform(filter(__insights, i -> schema_of_variant(i) LIKE 'OBJECT%' AND variant_get(i, '$.column') IS NOT NULL "
        "AND variant_get(i, '$.insight') IS NOT NULL), i -> struct("
        "try_variant_get(i, '$.column', 'string') AS column, try_variant_get(i, '$.insight', 'string') AS insight))")
    recommendations = (
        "filter(transform(__recommendations, r -> try_variant_get(r, '$', 'string')), r -> r IS NOT NULL AND trim(r) <> '')")

    def if_valid(expression: str, name: str) -> str:
        return f"CASE WHEN valid THEN {expression} END AS {name}"

    return typed.selectExpr(
        *[ref(n) for n in df.columns], "valid",
        if_valid("overall_summary", "overall_summary"),
        if_valid("CAST(greatest(0, least(100, CAST(greatest(-1D, least(101D, __score)) AS INT))) AS INT)", "data_quality_score"),
        if_valid("score_rationale", "score_rationale"),
        if_valid("cleaning_assessment", "cleaning_assessment"),
        if_valid(insights, "column_insights"),
        if_valid(recommendations, "recommendations"),
    )

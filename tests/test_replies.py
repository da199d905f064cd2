import hashlib

import pytest

from helpers import rows
from sieveline.operators import replies


@pytest.mark.parametrize("hot_rows", [1_000_000, 60])
def test_running_total_is_the_same_when_runs_are_cut(spark, hot_rows):
    df = spark.sql("SELECT if(id % 3 = 0, 'hot', CAST(id % 11 AS STRING)) AS run, id * id * id AS seq, CAST(1 + id % 5 AS BIGINT) AS cost FROM range(300)")
    expected, used = [], {}
    for r in sorted(df.collect(), key=lambda r: r["seq"]):
        expected.append((r["run"], r["seq"], r["cost"], used.get(r["run"], 0)))
        used[r["run"]] = used.get(r["run"], 0) + r["cost"]
    assert rows(replies.running_total(df, "run", "seq", "cost", hot_rows)) == sorted(expected, key=str)


def test_budget_admits_a_prefix(spark):
    df = spark.createDataFrame([("r", i, "x" * 35) for i in range(5)] + [("q", 0, "")], "run string, i int, text string")
    found = [(r["run"], r["i"], r["estimated_tokens"], r["used_before"], r["affordable"])
             for r in replies.token_budget(df, "run", "i", "text", 35, expected_output=5).orderBy("run", "i").collect()]
    assert found == [("q", 0, 5, 0, True), ("r", 0, 15, 0, True), ("r", 1, 15, 15, True), ("r", 2, 15, 30, False),
                     ("r", 3, 15, 45, False), ("r", 4, 15, 60, False)]


@pytest.mark.parametrize("hot_rows", [1_000_000, 3])
def test_cache_lookup(spark, hot_rows):
    prompts = replies.with_prompt_key(
        spark.createDataFrame([(i, "hot" if i < 6 else t) for i, t in enumerate(["hot"] * 6 + ["old", "new", "none"])], "i int, text string"), "text")
    key = {t: hashlib.sha256(t.encode()).hexdigest() for t in ("hot", "old", "new", "none")}
    assert {r["text"]: r["prompt_key"] for r in prompts.collect()} == key
    cache = spark.sql(f"""SELECT * FROM VALUES
        ('{key["hot"]}', 'h1', TIMESTAMP '2024-01-01 00:00:00'), ('{key["hot"]}', 'h2', TIMESTAMP '2024-01-02 00:00:00'),
        ('{key["old"]}', 'o', TIMESTAMP '2024-01-01 11:59:59'), ('{key["new"]}', 'n', TIMESTAMP '2024-01-01 12:00:00')
        AS c(prompt_key, response, cached_at)""")
    now = "2024-01-02 12:00:00"
    hits = {r["i"]: r["response"] for r in replies.cache_hits(prompts, cache, now, 24, hot_rows).collect()}
    assert hits == {**{i: "h2" for i in range(6)}, 7: "n"}
    assert sorted(r["i"] for r in replies.cache_misses(prompts, cache, now, 24, hot_rows).collect()) == [6, 8]
    assert replies.cache_hits(prompts, cache, now, 0, hot_rows).count() == 8


def body(score="85", extra=""):
    return '{"overall_summary":"s","data_quality_score":%s,"score_rationale":"r"%s}' % (score, extra)


@pytest.mark.parametrize("reply, score", [
    (body(), 85), ("  " + body('"91.5"') + "\n", 91), ("```json\n" + body("150") + "\n```", 100), ("```\n" + body("-3") + "\n``` bye", 0),
    ("Sure: " + body("7.9") + " done.", 7), (body("true"), 1), (body('"abc"'), None), (body("null"), None), ("[" + body() + "]", 85),
    ("[1]", None), ("", None), (None, None), ('{"overall_summary":1,"data_quality_score":3,"score_rationale":"r"}', None),
    ('{"overall_summary":"s","score_rationale":"r"}', None), ("no json", None), (body()[:-1], None),
])
def test_reply_scores(spark, reply, score):
    (row,) = replies.parse_replies(spark.createDataFrame([(reply,)], "reply string"), "reply").collect()
    assert row["data_quality_score"] == score and row["valid"] == (score is not None)
    if score is None:
        assert row["overall_summary"] is None and row["recommendations"] is None


def test_reply_lists_are_cleaned(spark):
    extra = ',"column_insights":[{"column":"a","insight":"b"},{"column":"c"},3],"recommendations":["x","  ",null,4],"cleaning_assessment":"fine"'
    df = spark.createDataFrame([(body(extra=extra),), (body(extra=',"column_insights":"x","recommendations":{}'),)], "reply string")
    first, second = replies.parse_replies(df, "reply").collect()
    assert [tuple(i) for i in first["column_insights"]] == [("a", "b")] and first["recommendations"] == ["x", "4"]
    assert first["cleaning_assessment"] == "fine"
    assert second["column_insights"] == [] and second["recommendations"] == [] and second["cleaning_assessment"] == ""


def test_scores_are_plain_numbers(spark):
    def reply(score):
        return '{"overall_summary": "s", "score_rationale": "r", "data_quality_score": %s}' % score

    wanted = {'"85d"': None, '"85f"': None, '" 85 "': 85, "85.9": 85, '"85.9"': 85, '"1e400"': None, "null": None}
    df = spark.createDataFrame([(k, reply(k)) for k in wanted], "k string, reply string")
    assert {r.k: r.data_quality_score for r in replies.parse_replies(df, "reply").collect()} == wanted


def test_stored_cache(spark, tmp_path):
    """Set, refresh, expire and clear; untouched buckets keep their files."""
    folder = str(tmp_path / "cache")
    assert replies.read_cache(spark, folder).count() == 0 and replies.clear_replies(spark, folder) == 0

    def entries(*found):
        return spark.createDataFrame(found, "prompt_key string, response string, cached_at string").selectExpr("prompt_key", "response", "CAST(cached_at AS TIMESTAMP) AS cached_at")

    def stored():
        return {r.prompt_key: r.response for r in replies.read_cache(spark, folder).collect()}

    replies.store_replies(entries(("aa1", "one", "2024-01-01 10:00:00"), ("aa2", "two", "2024-01-01 10:00:00"), ("bb1", "three", "2024-01-01 10:00:00"),
                                  ("bb1", "older", "2024-01-01 09:00:00"), (None, "lost", "2024-01-01 10:00:00"), ("cc1", "lost", None)), folder)
    assert stored() == {"aa1": "one", "aa2": "two", "bb1": "three"}
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "cache" / "bucket=bb").iterdir()}
    replies.store_replies(entries(("aa1", "newer", "2024-01-02 10:00:00"), ("aa2", "late", "2024-01-01 08:00:00"), ("dd1", None, "2024-01-02 11:00:00")), folder)
    assert stored() == {"aa1": "newer", "aa2": "two", "bb1": "three", "dd1": None}
    assert files == {p: p.stat().st_mtime_ns for p in (tmp_path / "cache" / "bucket=bb").iterdir()}
    replies.expire_replies(spark, folder, "2024-01-02 12:00:00", 0)
    assert len(stored()) == 4
    replies.expire_replies(spark, folder, "2024-01-02 12:00:00", 24)
    assert stored() == {"aa1": "newer", "dd1": None}
    replies.store_replies(entries(("aa1", "old", "2023-01-01 10:00:00"), ("x", "short", "2024-01-02 11:00:00"), ("", "empty", "2024-01-02 11:00:00")), folder)
    assert stored() == {"aa1": "newer", "dd1": None, "x": "short", "": "empty"}
    assert replies.clear_replies(spark, folder) == 4 and stored() == {}
    replies.store_replies(entries(("aa1", "again", "2024-01-01 10:00:00")), folder)
    assert stored() == {"aa1": "again"}


def test_running_total_follows_the_data(spark):
    """Clustered positions, a run that holds most rows, a NULL run, and costs of 0; one shuffle after the stored ranges."""
    draw = "if(id % 10 < 7, 'hot', if(id % 10 = 7, null, concat('r', id % 3))) AS run, if(id < 50, id * 1000000000, 50000000000 + id) AS seq, id % 13 AS cost, id AS other"
    df = spark.sql(f"SELECT {draw} FROM range(2000)")
    plain = rows(replies.running_total(df, "run", "seq", "cost", 10_000))
    found = replies.running_total(df, "run", "seq", "cost", 100)
    assert rows(found) == plain and len(plain) == 2000
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "__range" in text and text.count("rangepartitioning") == 0 and "Join" not in text

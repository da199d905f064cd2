import pytest

from helpers import rows
from sieveline import CleaningPlan, Options, clean
from sieveline.errors import PlanError
from sieveline.streaming.replay import clean_stream, read_clean_stream, write_clean_stream


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("events") / "in")
    df = spark.range(400).selectExpr(
        "id", "TIMESTAMP_NTZ '2024-01-01 00:00:00' + id * INTERVAL '1' MINUTE AS ts", "if(id % 4 = 0, 'A ', 'a') AS kind",
        "if(id % 9 = 0, null, if(id = 100, 9000D, CAST(id % 10 AS DOUBLE))) AS size")
    df.union(df.where("id % 20 = 0")).write.parquet(folder)
    return folder


def run_stream(spark, frame, folder):
    query = frame.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state") \
        .trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{folder}/out")


def test_stream_equals_batch(spark, events, tmp_path):
    batch = spark.read.parquet(events)
    plan = clean(batch).plan
    assert plan.keep == "first" and plan.categories == ["kind"]
    stream = spark.readStream.schema(batch.schema).parquet(events)
    streamed = run_stream(spark, clean_stream(plan, stream, "ts", "1 day"), str(tmp_path))
    assert rows(streamed) == rows(plan.apply(batch)) and streamed.count() == 400


def test_without_duplicates_no_state_is_kept(spark, events, tmp_path):
    batch = spark.read.parquet(events)
    plan = clean(batch).plan
    plan.keep = None
    frame = clean_stream(plan, spark.readStream.schema(batch.schema).parquet(events))
    assert "Deduplicate" not in frame._jdf.queryExecution().analyzed().toString()
    assert run_stream(spark, frame, str(tmp_path)).count() == 420


def test_refusals(spark, events):
    batch = spark.read.parquet(events)
    stream = spark.readStream.schema(batch.schema).parquet(events)
    plan = CleaningPlan(columns=dict(batch.dtypes), keep="first", options=Options().to_dict())
    with pytest.raises(PlanError):
        clean_stream(plan, stream)
    with pytest.raises(PlanError):
        clean_stream(plan, batch, "ts", "1 day")
    plan.keep = "none"
    with pytest.raises(PlanError):
        clean_stream(plan, stream, "ts", "1 day")
    plan.columns = {"other": "int"}
    with pytest.raises(PlanError):
        clean_stream(plan, stream, "ts", "1 day")


def test_late_rows_and_rows_without_a_time(spark, tmp_path):
    """Several files, the later ones hours back in time, with copies within and across files, NULL times and NULL values."""
    draw = "id, if(id % 10 = 3, null, TIMESTAMP_NTZ '2024-01-01 00:00:00' + id * INTERVAL '1' MINUTE) AS ts, if(id % 4 = 0, 'A ', 'a') AS kind, if(id % 9 = 0 AND id % 10 != 3, null, CAST(id % 10 AS DOUBLE)) AS size"
    everything = spark.sql(f"SELECT {draw} FROM range(400)")
    for part in ("id >= 300", "id < 150 OR id > 390", "id BETWEEN 100 AND 320", "id % 10 = 3 OR id % 20 = 0"):
        everything.where(part).union(everything.where(f"({part}) AND id % 7 = 0")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    batch = spark.read.parquet(f"{tmp_path}/in")
    plan = clean(batch).plan
    assert plan.keep == "first"
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    write_clean_stream(plan, stream, f"{tmp_path}/clean", "ts", "hour").trigger(availableNow=True).start().awaitTermination()
    found = read_clean_stream(spark, f"{tmp_path}/clean")
    assert rows(found) == rows(plan.apply(batch)) and found.count() == 400
    untimed = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").where("ts IS NULL")
    streamed = run_stream(spark, clean_stream(plan, untimed, "ts", "1 hour"), f"{tmp_path}/untimed")
    assert rows(streamed) == rows(plan.apply(batch.where("ts IS NULL"))) and streamed.count() == 40


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_clean_stream_leaves_no_row_out(spark, tmp_path, kind):
    """A short delay, files hours back in time, NULL times, copies within and across files, values that differ by NULLs alone."""
    draw = (f"id, CAST(if(id % 10 = 3, null, TIMESTAMP_NTZ '2024-01-01 00:00:00' + id * INTERVAL '1' MINUTE) AS {kind}) AS ts, if(id % 4 = 0, 'A ', 'a') AS kind, "
            "if(id % 9 = 0 AND id % 10 != 3, null, CAST(id % 10 AS DOUBLE)) AS size, if(id % 5 = 1, null, 1) AS one, if(id % 5 = 2, null, 1) AS two")
    everything = spark.sql(f"SELECT {draw} FROM range(400)")
    for part in ("id >= 300", "id < 150 OR id > 390", "id BETWEEN 100 AND 320", "id % 10 = 3 OR id % 20 = 0"):
        everything.where(part).union(everything.where(f"({part}) AND id % 7 = 0")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    batch = spark.read.parquet(f"{tmp_path}/in")
    plan = clean(batch).plan
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = run_stream(spark, clean_stream(plan, stream, "ts", "1 minute"), str(tmp_path))
    assert plan.keep == "first" and rows(found) == rows(plan.apply(batch)) and found.count() == 400

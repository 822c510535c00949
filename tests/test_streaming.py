import datetime as dt

from pyspark.sql import functions as F

from pagelens.functions import validate
from pagelens.operators import limiter
from pagelens.streaming import events


def event(i, **changed):
    out = {
        "event_id": f"e{i}", "ts": "2024-01-01T00:00:00Z", "store_id": "s", "requester": ("agent", None, False), "request": ("https://x.example/", {}, None, None),
        "response": ("markdown", None, 1.5, None, "sourced", None, None, None), "outcome": None,
    }
    return tuple((out | changed).values())


def test_sink_routes_problems_and_drops_repeats(spark, tmp_path):
    rows = [event(1), event(1), event(2, store_id=None), event(3, requester=("robot", None, True)), event(4, outcome=(None, 5, None, None)), event(5, response=("markdown", None, float("nan"), None, None, None, None, None))]
    spark.createDataFrame(rows, validate.SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    query = events.write_events(stream, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "cp"), availableNow=True)
    query.awaitTermination(120)
    assert [r.event_id for r in spark.read.parquet(str(tmp_path / "good")).collect()] == ["e1"]
    problems = {r.event_id: r.problem for r in spark.read.parquet(str(tmp_path / "bad")).collect()}
    assert problems["e2"] == "missing required field 'store_id'" and "kind" in problems["e3"] and "minor units" in problems["e4"] and "finite" in problems["e5"]


def test_stream_limits_as_the_batch_does(spark, tmp_path):
    rows = [(i, f"u{i % 3}", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=17 * i)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, subject string, at timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = events.limit_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 2, 180)
    query = stream.writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.id: r.allowed for r in spark.table("limited").collect()}
    want = {r.id: r.allowed for r in limiter.limit_requests(df, 2, 180, "id", "subject", "at").collect()}
    assert got == want and not all(got.values())


def test_rollup_by_event_time(spark, tmp_path):
    df = spark.range(10).select((F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(mins=F.col("id").cast("int") * 20)).alias("at"), F.lit("agent").alias("kind"))
    df.write.parquet(str(tmp_path / "in"))
    out = events.rollup(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    query = out.writeStream.format("memory").queryName("rolled").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.events for r in spark.table("rolled").collect()) == [1, 3, 3, 3]

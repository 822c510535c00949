from pyspark.sql import functions as F

from pagelens.functions import events, requests

DETECTION = "struct<kind: string, platform: string, verified: boolean>"


def detections(spark, rows):
    return spark.createDataFrame([(i, tuple(r[:3]), *r[3:]) for i, r in enumerate(rows)], f"i int, d {DETECTION}, v boolean, p string")


def test_a_verdict_fills_only_unknown_platforms(spark):
    rows = detections(spark, [("agent", None, False, True, "claude"), ("agent", "unknown", False, True, "claude"), ("agent", "openai", False, True, "claude"), ("agent", None, False, False, "claude"), ("agent", "unknown", False, True, None)])
    got = [r.x for r in sorted(rows.select("i", requests.apply_verification(F.col("d"), F.col("v"), F.col("p")).alias("x")).collect())]
    assert [(x.platform, x.verified) for x in got] == [("claude", True), ("claude", True), ("openai", True), (None, False), ("unknown", True)]


def test_urls_of_requests(spark):
    rows = spark.createDataFrame([("x.example", None, "/a"), ("x.example", "HTTP , https", "/a"), (None, "https,http", "/"), ("x.example:8080", "ftp", "/?q")], "h string, p string, t string")
    assert [r.u for r in rows.select(requests.absolute_url(F.col("h"), F.col("p"), F.col("t")).alias("u")).collect()] == ["https://x.example/a", "http://x.example/a", "https://localhost/", "https://x.example:8080/?q"]


def test_events_leave_unknown_platforms_out(spark):
    rows = detections(spark, [("agent", "unknown", False, None, None), ("agent", "claude", True, None, None), ("human", None, False, None, None)])
    lit = lambda x: F.lit(x).cast("string")
    event = events.build_event(lit("e1"), lit("2024-01-01T00:00:00Z"), lit("s"), F.col("d"), lit("https://x.example/a?utm_source=z&page=2#t"), F.create_map(lit("k"), lit("v")), lit("*/*"), lit(None), lit("markdown"), F.lit(1.5), lit("product"), lit(None))
    got = [r.e for r in sorted(rows.select("i", event.alias("e")).collect())]
    assert [(x.requester.kind, x.requester.platform, x.requester.verified) for x in got] == [("agent", None, False), ("agent", "claude", True), ("human", None, False)]
    assert got[0].request.url == "https://x.example/a?page=2" and got[0].response.path == "markdown" and got[0].response.coverage is None and got[0].event_id == "e1"

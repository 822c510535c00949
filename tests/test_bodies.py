import pytest
from pyspark.sql import functions as F

from pagelens.sources.bodies import capped, charset, fit_prefix, read_bodies

TEXT = "aé日😀b" * 3


def test_every_cut(spark):
    for most in range(len(TEXT.encode()) + 2):
        want = max((TEXT[:i] for i in range(len(TEXT) + 1) if len(TEXT[:i].encode()) <= most), key=len)
        assert spark.range(1).select(fit_prefix(F.lit(TEXT), most).alias("t")).first().t == want


@pytest.mark.parametrize("label, raw, text", [("utf-8", b"\xef\xbb\xbfa\xffb\xe6\x97", "a�b�"), ("iso-8859-1", b"\xe9\x41", "éA"), ("utf-16le", "aé😀".encode("utf-16-le") + b"x", "aé😀"), ("nonsense", "é".encode(), "é")])
def test_charsets(spark, label, raw, text):
    r = spark.createDataFrame([(bytearray(raw), label)], "b binary, l string").select(capped(F.col("b"), F.col("l"), 50).alias("c")).first().c
    assert tuple(r) == (text, len(text.encode()), False)


def test_limits(spark):
    rows = spark.createDataFrame([(None,), (bytearray(b""),), (bytearray(b"x" * 10),), (bytearray(b"x" * 11),), (bytearray(b"\xef\xbb\xbf" * 20),)], "b binary").select(capped(F.col("b"), F.lit("utf-8"), 10).alias("c")).collect()
    assert [(r.c.bytes, r.c.truncated) for r in rows] == [(0, False), (0, False), (10, False), (10, True), (9, True)]
    types = ["text/html", 'a; charset="UTF-8"; x', "a;CHARSET = Latin1", None, "a; charset="]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(types)], "i int, t string").select("i", charset(F.col("t")).alias("c")).collect()
    assert [r.c for r in sorted(got)] == ["utf-8", "utf-8", "latin1", "utf-8", "utf-8"]


def test_files(spark, tmp_path):
    (tmp_path / "a.html").write_bytes("é".encode() * 10)
    (tmp_path / "b.html").write_bytes(b"<p>x")
    got = {r.path[-6:]: (r.text, r.truncated) for r in read_bodies(spark, f"file://{tmp_path}", most=7).collect()}
    assert got == {"a.html": ("ééé", True), "b.html": ("<p>x", False)}

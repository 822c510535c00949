"""Response bodies: bytes to text by charset, under a cap that cuts between characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 2 * 1024 * 1024
RAW_FACTOR = 4  # raw bytes that are read for one of the cap

# Charsets that are decoded apart from UTF-8, by their labels.
CHARSETS = {"ISO-8859-1": ["iso-8859-1", "latin1", "us-ascii", "ascii"], "UTF-16LE": ["utf-16", "utf-16le"], "UTF-16BE": ["utf-16be"]}


def charset(content_type: Column) -> Column:
    """The charset parameter of a content type in lower case, utf-8 without one."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(content_type, r"(?i);\s*charset\s*=\s*\"?([^\";\s]+)\"?", 1)), F.lit("")), F.lit("utf-8"))


def decoded(body: Column, label: Column) -> Column:
    """Text of bytes; what is not valid becomes U+FFFD, a byte order mark goes, and an unknown charset is read as UTF-8."""
    whole = F.substring(body, F.lit(1), F.octet_length(body) - F.octet_length(body) % 2)
    other = F.coalesce(*[F.when(label.isin(labels), F.decode(whole if name.startswith("UTF-16") else body, name)) for name, labels in CHARSETS.items()])
    return F.regexp_replace(F.coalesce(other, F.make_valid_utf8(body.cast("string"))), r"^\x{feff}", "")


def fit_prefix(text: Column, most: int) -> Column:
    """The longest prefix of whole characters within so many UTF-8 bytes."""
    raw = text.cast("binary")
    inside = lambda at: F.hex(F.substring(raw, at + 1, 1)).rlike("^[89AB]")  # noqa: E731  the byte after the cut goes on with a character
    cut = F.coalesce(*[F.when(~inside(most - j), most - j) for j in range(4) if most >= j], F.lit(0))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.substring(raw, F.lit(1), cut).cast("string"))


def capped(body: Column, label: Column, most: int = MAX_BYTES) -> Column:
    """STRUCT<text, bytes, truncated> of a body: its text up to `most` UTF-8 bytes, of RAW_FACTOR times as many raw bytes. A null body is empty."""
    whole = F.coalesce(body, F.lit(b"").cast("binary"))
    text = decoded(F.when(F.octet_length(whole) >= RAW_FACTOR * most, F.substring(whole, 1, RAW_FACTOR * most)).otherwise(whole), label)
    kept = fit_prefix(text, most)
    return F.struct(kept.alias("text"), F.octet_length(kept).cast("long").alias("bytes"), ((F.octet_length(text) > most) | (F.octet_length(whole) >= RAW_FACTOR * most)).alias("truncated"))


def read_bodies(spark: SparkSession, path: str, content_type: str = "text/html", most: int = MAX_BYTES) -> DataFrame:
    """path, text, bytes, truncated of the files of a folder, read as binary files."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select("path", capped(F.col("content"), charset(F.lit(content_type)), most).alias("b")).select("path", "b.*")

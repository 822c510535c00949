"""Queries about response bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.sources.bodies import capped, charset
from pagelens.sources.shared import read_table

CAP = 120
TYPES = ["text/html", "text/html; charset=utf-8", 'text/html;Charset="ISO-8859-1"', "text/plain; charset=unknown"]


def capped_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as bytes under a small cap, in which many a cut would fall within a character; every third has a byte order mark."""
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("doc_id") % len(TYPES) + 1).cast("int"))
    mark = F.when((F.col("doc_id") % 3 == 0) & (F.col("doc_id") % len(TYPES) != 2), F.unhex(F.lit("EFBBBF"))).otherwise(F.unhex(F.lit("")))
    body = F.concat(mark, F.coalesce("text", F.lit("")).cast("binary"))
    rows = read_table(spark, sf_dir, "documents").select("doc_id", capped(body, charset(kind), CAP).alias("b"))
    return rows.select("doc_id", "b.bytes", "b.truncated", F.md5(F.col("b.text").cast("binary")).alias("text_md5"))


# The bytes of a text read as ISO 8859-1 are 128 characters of one byte, and 128 of two. Raw bytes beyond four times the cap are not read.
_LATIN = "array_to_string(list_transform(range(least({0}, octet_length(encode(text)))), lambda i: chr(('0x' || substr(hex(encode(text)), (2 * i + 1)::BIGINT, 2))::INT)), '')"
_SQL = f"""WITH t AS (SELECT doc_id, doc_id % 4 AS k, CASE WHEN doc_id % 3 = 0 AND doc_id % 4 <> 2 THEN 3 ELSE 0 END AS mark, text FROM documents),
d AS (SELECT doc_id, mark + octet_length(encode(text)) AS raw, CASE WHEN k = 2 THEN {_LATIN.format(4 * CAP)} ELSE text END AS decoded FROM t),
c AS (SELECT *, left(decoded, list_max(list_filter(range({CAP + 1}), lambda i: octet_length(encode(left(decoded, i))) <= {CAP}))) AS cut FROM d)
SELECT doc_id, octet_length(encode(cut)) AS bytes, octet_length(encode(decoded)) > {CAP} OR raw >= {4 * CAP} AS truncated, md5(cut) AS text_md5 FROM c"""
QUERIES = {"capped_bodies": (capped_bodies, _SQL)}

"""Queries about what texts state: quantities, labels, tables, sizes; sanitised and framed text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions import text
from pagelens.plans.literal import table, values
from pagelens.sources.shared import read_table

SAMPLES = [
    ("Price: $1,499.00 or € 12 and 20% off, 20 % off",), ("- Returns: 60 days\n- **Weight:** 2.5 kg\nplain line\nUpdated 2024-05-06",), ("| a | b |\n|---|:-:|\n| 1 | 2 |\n | 3 | 4 | \n|x|",),
    ("12 m and 12m and 12 months",), ("",), ("no numbers: here",), ("Open 9 hours: daily\n+ Size: 42 cm",),
]
QUANTITY_BANDS = [(12, 4), (6, 3), (3, 2), (1, 1)]
DEFINITION_BANDS = [(6, 2), (2, 1)]
COMPARISON_BANDS = [(3, 2), (2, 1)]


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    own = table(spark, "doc_id long, text string", [(-1 - i, s[0]) for i, s in enumerate(SAMPLES)])
    return docs.unionByName(own)


def evidence_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    rows = _texts(spark, sf_dir).select("doc_id", text.distinct_quantities(t).alias("quantities"), text.labelled_lines(t).alias("definitions"), text.comparison_rows(t).alias("comparisons"))
    points = text.at_least(F.col("quantities"), QUANTITY_BANDS) + text.at_least(F.col("definitions"), DEFINITION_BANDS) + text.at_least(F.col("comparisons"), COMPARISON_BANDS)
    return rows.withColumn("points", points)


def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _texts(spark, sf_dir).select("doc_id", F.octet_length(t).cast("long").alias("bytes"), text.tokens_by_bytes(t).alias("by_bytes"), text.tokens_rounded(t).alias("rounded"), text.tokens_ceiling(t).alias("ceiling"))


DIRTY = ["plain", "a\u001b[31mred\u001b[0m b", "tab\tkept\nline", "bell\u0007 nul\u0001", "zero​width ‮right⁦", "tag\U000e0041\U000e007f end", "﻿bom", "c1\u0085\u009b x"]


def sanitized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sanitised turns with a nonce: the first 16 hex digits of a digest of role and text."""
    turns = read_table(spark, sf_dir, "conversations").select("role", "text").unionByName(table(spark, "role string, text string", [("dirty", d) for d in DIRTY]))
    clean = turns.select("role", text.sanitized(F.col("text")).alias("clean"))
    return clean.select("role", "clean", F.substring(F.sha2(F.concat_ws("\n", "role", "clean"), 256), 1, 16).alias("nonce"))


TYPES = ["text/html; charset=utf-8", "TEXT/HTML", "application/xhtml+xml", "text/markdown", "text/x-markdown;v=1", "application/ld+json", "application/json", "text/plain", "image/png", "", "text/css ; x"]


def media_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("page_id") % len(TYPES) + 1).cast("int"))
    return read_table(spark, sf_dir, "pages").select(text.media_class(kind).alias("class"), F.octet_length("html").alias("b")).groupBy("class").agg(F.count("*").alias("pages"), F.sum("b").cast("long").alias("bytes"))


def _at_least(value: str, pairs: list[tuple[int, int]]) -> str:
    return "CASE " + " ".join(f"WHEN {value} >= {t} THEN {p}" for t, p in pairs) + " ELSE 0 END"


_TEXTS = values("own", "doc_id, text", [(-1 - i, s[0]) for i, s in enumerate(SAMPLES)]) + ", texts AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, text FROM own)"
_DENSITY = f"""WITH {_TEXTS}, counted AS (SELECT doc_id,
  len(list_distinct(list_transform(regexp_extract_all(text, '{text.QUANTITY}'), lambda x: regexp_replace(lower(x), '{text.SPACE}', '', 'g')))) AS quantities,
  len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{text.LABELLED.replace("'", "''")}'))) AS definitions,
  greatest(len(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: starts_with(x, '|') AND ends_with(x, '|') AND NOT regexp_matches(x, '^\\|[\\s:|-]+\\|$') AND len(string_split(x, '|')) >= 4)) - 1, 0) AS comparisons
  FROM texts)
SELECT *, {_at_least("quantities", QUANTITY_BANDS)} + {_at_least("definitions", DEFINITION_BANDS)} + {_at_least("comparisons", COMPARISON_BANDS)} AS points FROM counted"""
_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(text, '\x{1b}\[[0-9;?]*[ -/]*[@-~]', '', 'g'), '[\x{00}-\x{08}\x{0b}-\x{1f}\x{7f}-\x{9f}]', '', 'g'), '[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2069}\x{feff}\x{e0000}-\x{e007f}]', '', 'g')"""
_KIND = f"lower(trim(string_split([{', '.join(chr(39) + t + chr(39) for t in TYPES)}][(page_id % {len(TYPES)} + 1)::INT], ';')[1]))"
QUERIES = {
    "evidence_density": (evidence_density, _DENSITY),
    "token_estimates": (token_estimates, f"WITH {_TEXTS} SELECT doc_id, octet_length(encode(text)) AS bytes, octet_length(encode(text)) // 4 AS by_bytes, (length(text) + 2) // 4 AS rounded, (length(text) + 3) // 4 AS ceiling FROM texts"),
    "sanitized_texts": (sanitized_texts, f"WITH {values('dirty', 'role, text', [('dirty', d) for d in DIRTY])}, c AS (SELECT role, {_CLEAN} AS clean FROM (SELECT role, text FROM conversations UNION ALL SELECT role, text FROM dirty)) SELECT role, clean, left(sha256(role || chr(10) || clean), 16) AS nonce FROM c"),
    "media_classes": (
        media_classes,
        f"SELECT CASE WHEN k IN ('text/html', 'application/xhtml+xml') THEN 'html' WHEN k IN ('text/markdown', 'text/x-markdown') THEN 'markdown' WHEN k = 'application/json' OR ends_with(k, '+json') THEN 'json' WHEN k = 'text/plain' THEN 'text' ELSE 'other' END AS class, count(*) AS pages, sum(b)::BIGINT AS bytes FROM (SELECT {_KIND} AS k, octet_length(encode(html)) AS b FROM pages) GROUP BY 1",
    ),
}

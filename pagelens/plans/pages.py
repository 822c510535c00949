"""Queries over pages as relations of elements and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.operators import pages
from pagelens.sources.shared import read_table


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.tokenize(read_table(spark, sf_dir, "pages").select("page_id", "html"))


def page_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.outline(_nodes(spark, sf_dir))


def visible_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of a page, of its visible text, and what the text costs in estimated tokens."""
    text = pages.visible_text(_nodes(spark, sf_dir))
    sizes = read_table(spark, sf_dir, "pages").select("page_id", F.octet_length("html").cast("long").alias("bytes"))
    own = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return sizes.join(text, "page_id", "left").select("page_id", "bytes", own.alias("text_bytes"), F.floor(own / 4).alias("tokens"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).where("type = 'element'").groupBy("tag").agg(F.count("*").alias("elements"), F.count_distinct("page_id").alias("pages"))


_DECODE = "replace(replace(replace(replace(replace(replace(replace({0}, '&copy;', '©'), '&middot;', '·'), '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&')"
_BARE = r"regexp_replace(regexp_replace(regexp_replace(html, '<script>.*?</script>', ' ', 'gs'), '<style>.*?</style>', ' ', 'gs'), '<!--.*?-->|</?[a-zA-Z!][^>]*>', ' ', 'gs')"
_VISIBLE = f"trim(regexp_replace({_DECODE.format(_BARE)}, '[\\s]+', ' ', 'g'))"
QUERIES = {
    "page_outline": (
        page_outline,
        f"""WITH p AS (SELECT page_id, html, regexp_replace(html, '<script>.*?</script>', '<script></script>', 'gs') AS bare FROM pages)
        SELECT page_id, trim(regexp_replace({_DECODE.format("regexp_extract(html, '<title>(.*?)</title>', 1)")}, '\\s+', ' ', 'g')) AS title, trim(regexp_replace({_DECODE.format("regexp_extract(html, '<h1>(.*?)</h1>', 1)")}, '\\s+', ' ', 'g')) AS h1,
        len(regexp_extract_all(bare, '<a href=')) AS links, len(regexp_extract_all(bare, '<p>')) AS paragraphs, len(regexp_extract_all(bare, '<(script|style)>')) AS opaque, len(regexp_extract_all(regexp_replace(bare, '<!--.*?-->|<!DOCTYPE', '', 'gs'), '<[a-zA-Z]')) AS elements FROM p""",
    ),
    "visible_sizes": (visible_sizes, f"SELECT page_id, octet_length(encode(html)) AS bytes, octet_length(encode({_VISIBLE})) AS text_bytes, octet_length(encode({_VISIBLE})) // 4 AS tokens, md5({_VISIBLE}) AS text_md5 FROM pages"),
    "tag_counts": (tag_counts, "SELECT tag, count(*) AS elements, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(html, '<script>.*?</script>', '<script></script>', 'gs'), '<!--.*?-->|<!DOCTYPE', '', 'gs'), '<([a-zA-Z][^ />]*)', 1)) AS tag FROM pages) GROUP BY 1"),
}

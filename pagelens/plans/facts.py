"""Queries over facts derived from line items: page l_orderkey % 997, agent and browser sides by return flag."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions import text
from pagelens.operators import facts, recommend
from pagelens.plans.literal import values
from pagelens.sources.shared import read_table

KINDS = ["price", "currency", "availability", "title", "phone", "hours", "rating"]
CORE, EXTENDED = ["price", "currency", "availability", "title"], ["phone", "hours"]
DENSITY = [(200, 100), (100, 85), (50, 70), (20, 50), (5, 30), (0, 15)]
COST = [(100, 6), (200, 5), (500, 3), (1500, 1)]
FIRST_OFFSET = [(512, 5), (2048, 4), (8192, 2), (32768, 1)]
WINDOW = [(90, 5), (70, 4), (50, 3), (25, 1)]
REFERENCE_BYTES = 900


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("l_partkey") + F.col("l_linenumber")
    return read_table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 997).alias("page"),
        F.element_at(F.array(*map(F.lit, KINDS)), (key % len(KINDS) + 1).cast("int")).alias("kind"),
        F.concat(F.lit("v"), (F.col("l_quantity").cast("long") % 5).cast("string")).alias("normalized"),
        F.element_at(F.array(*map(F.lit, facts.SOURCES)), (F.col("l_suppkey") % len(facts.SOURCES) + 1).cast("int")).alias("source"),
        (F.col("l_partkey") * 7 % 40000).alias("offset"),
        (F.col("l_linestatus") == "O").alias("qualified"),
        (F.col("l_returnflag") == "N").alias("agent"),
    )


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _facts(spark, sf_dir)
    return rows.where("agent").drop("agent"), rows.where("not agent").drop("agent")


def fact_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.merge_facts(*_sides(spark, sf_dir)).withColumn("sources", F.array_join("sources", ","))


def fact_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.divergence(*_sides(spark, sf_dir))


def missing_core_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    agent, _ = _sides(spark, sf_dir)
    profile = _facts(spark, sf_dir).select("page").distinct().select("page", F.explode(F.array(*map(F.lit, CORE))).alias("kind"))
    return facts.missing_facts(agent, profile)


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    agent, browser = _sides(spark, sf_dir)
    pages = _facts(spark, sf_dir).groupBy("page").agg((F.sum("offset") / 100 + F.lit(1)).cast("long").alias("bytes"))
    return facts.coverage(facts.merge_facts(agent, browser), pages, CORE, EXTENDED).join(pages, "page")


def coverage_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points for core facts (14) and context cost (6), in whole numbers."""
    rows = _coverage(spark, sf_dir).withColumn("density_pct", text.at_least(F.col("facts_per_kib"), DENSITY)).withColumn("ratio", F.expr(f"100 * bytes div {REFERENCE_BYTES}"))
    return rows.select("page", "core_found", "extended_found", "coverage_pct", "density_pct", F.expr("(14 * coverage_pct * density_pct + 5000) div 10000").alias("core_points"), text.at_most(F.col("ratio"), COST).alias("cost_points"))


def position_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points for the first core fact's offset, and for the share of core facts in the front window."""
    agent, browser = _sides(spark, sf_dir)
    pages = _facts(spark, sf_dir).groupBy("page").agg(F.max("offset").alias("bytes"))
    core = facts.merge_facts(agent, browser).where(F.col("kind").isin(CORE)).join(pages, "page")
    rows = core.groupBy("page").agg(F.min("offset").alias("first_offset"), F.count_if(F.col("offset") < F.greatest(F.lit(2048), F.expr("bytes div 5"))).alias("front"), F.count("*").alias("n"))
    return rows.select("page", "first_offset", text.at_most(F.col("first_offset"), FIRST_OFFSET).alias("offset_points"), text.at_least(F.expr("100 * front div n"), WINDOW).alias("window_points"))


# Checks with their dimension, weight and basis, and the grade bands.
CHECKS = [
    ("retrievability.reachable", "retrievability", 11, "measured"), ("retrievability.robots-policy", "retrievability", 10, "measured"), ("retrievability.render-independence", "retrievability", 7, "heuristic"),
    ("machine-representation.negotiated-response", "machine-representation", 9, "measured"), ("machine-representation.declared-alternates", "machine-representation", 3, "measured"),
    ("machine-representation.vary-accept", "machine-representation", 3, "measured"), ("machine-representation.substance-parity", "machine-representation", 3, "heuristic"),
    ("fact-coverage.core-facts", "fact-coverage", 14, "heuristic"), ("fact-coverage.context-cost", "fact-coverage", 6, "measured"),
    ("fact-position.first-core-fact-offset", "fact-position", 5, "heuristic"), ("fact-position.front-window", "fact-position", 5, "heuristic"),
    ("structured-data.present", "structured-data", 2, "measured"), ("structured-data.required-properties", "structured-data", 3, "measured"), ("structured-data.text-agreement", "structured-data", 1, "heuristic"),
    ("contract-discovery.canonical", "contract-discovery", 4, "measured"), ("contract-discovery.cache-validators", "contract-discovery", 2, "measured"), ("contract-discovery.llms-txt", "contract-discovery", 1, "measured"),
    ("contract-discovery.sitemap", "contract-discovery", 1, "measured"), ("contract-discovery.machine-endpoint", "contract-discovery", 2, "measured"),
    ("evidence-density.quantities", "evidence-density", 4, "measured"), ("evidence-density.definitions", "evidence-density", 2, "heuristic"), ("evidence-density.comparisons", "evidence-density", 2, "measured"),
]
BANDS = [(90, "A"), (75, "B"), (60, "C"), (40, "D"), (0, "F")]
_CHECK_ROWS = [(i, *c) for i, c in enumerate(CHECKS)]


def _check_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """22 check rows for each document; points earned follow from its length and id."""
    checks = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("check"), F.lit(d).alias("dimension"), F.lit(w).alias("weight"), F.lit(b).alias("basis")) for i, c, d, w, b in _CHECK_ROWS]))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars", checks.alias("c")).select("doc_id", "n_chars", "c.*")
    earned = F.col("weight") - F.expr("(doc_id * 7 + i * n_chars) % (weight + 1) * (doc_id % 4) div 3")
    return docs.withColumn("earned", F.greatest(earned, F.lit(0)).cast("long"))


def dimension_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _check_rows(spark, sf_dir).groupBy("doc_id", "dimension").agg(F.sum("earned").alias("earned"), F.sum("weight").cast("long").alias("weight"), F.bool_or(F.col("basis") == "heuristic").alias("heuristic"))


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    grade = F.coalesce(*[F.when(F.col("score") >= t, F.lit(g)) for t, g in BANDS])
    return _check_rows(spark, sf_dir).groupBy("doc_id").agg(F.sum("earned").alias("score")).withColumn("grade", grade)


def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals(spark, sf_dir)


def threshold_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a hundred documents: how many miss grade C, and the worst exit."""
    rows = _totals(spark, sf_dir).withColumn("run", F.expr("doc_id div 100")).withColumn("met", F.col("grade").isin("A", "B", "C"))
    return rows.groupBy("run").agg(F.count_if(~F.col("met")).alias("missed"), F.max_by("grade", F.struct(-F.col("score"), "doc_id")).alias("worst_grade"), F.when(F.bool_and("met"), "ok").otherwise("threshold").alias("exit"))


def ranked_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fixes of each document's checks, in order of the points they could bring, each lost point counted once."""
    return recommend.recommend(_check_rows(spark, sf_dir), "doc_id")


def _list(names: list[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def _in(names: list[str]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _band(value: str, op: str, pairs: list[tuple]) -> str:
    return "CASE " + " ".join(f"WHEN {value} {op} {t} THEN " + (f"'{p}'" if isinstance(p, str) else str(p)) for t, p in pairs) + " ELSE 0 END" if not isinstance(pairs[0][1], str) else "CASE " + " ".join(f"WHEN {value} {op} {t} THEN '{p}'" for t, p in pairs) + " END"


_FACTS = f"""facts AS (SELECT l_orderkey % 997 AS page, {_list(KINDS)}[((l_partkey + l_linenumber) % {len(KINDS)} + 1)::INT] AS kind, 'v' || (l_quantity::BIGINT % 5)::VARCHAR AS normalized,
  {_list(facts.SOURCES)}[(l_suppkey % {len(facts.SOURCES)} + 1)::INT] AS source, l_partkey * 7 % 40000 AS "offset", l_linestatus = 'O' AS qualified, l_returnflag = 'N' AS agent FROM lineitem)"""
_MERGED = f"""{_FACTS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY page, kind ORDER BY "offset", list_position({_list(facts.SOURCES)}, source), normalized, qualified) AS r FROM facts WHERE agent),
stated AS (SELECT page, kind, normalized, list_sort(list(DISTINCT source)) AS sources FROM facts GROUP BY 1, 2, 3),
merged AS (SELECT page, kind, normalized, source, "offset", qualified, sources, len(sources) >= 2 AS corroborated FROM ranked JOIN stated USING (page, kind, normalized) WHERE r = 1)"""
_VIEW = """SELECT page, kind, arg_min(normalized, struct_pack(o := "offset", n := normalized)) AS representative, list_sort(list(DISTINCT normalized)) AS observed FROM facts WHERE NOT qualified AND {0} GROUP BY 1, 2"""
_COVERAGE = f"""{_MERGED}, pages_ AS (SELECT page, (sum("offset") / 100 + 1) AS raw FROM facts GROUP BY 1), sized AS (SELECT page, floor(raw)::BIGINT AS bytes FROM pages_),
counted AS (SELECT s.page, bytes, coalesce(sum(CASE WHEN kind IN {_in(CORE)} THEN CASE WHEN corroborated THEN 4 ELSE 2 END WHEN kind IN {_in(EXTENDED)} AND corroborated THEN 1 ELSE 0 END), 0)::BIGINT AS units,
  count(*) FILTER (kind IN {_in(CORE)}) AS core_found, count(*) FILTER (kind IN {_in(EXTENDED)}) AS extended_found FROM sized s LEFT JOIN merged m ON m.page = s.page GROUP BY 1, 2),
measured AS (SELECT page, bytes, core_found, extended_found, least(100, (100 * units + {2 * len(CORE)}) // {4 * len(CORE)}) AS coverage_pct, ((core_found * 100 + extended_found * 25) * 1024) // greatest(1, bytes) AS facts_per_kib FROM counted),
banded AS (SELECT *, {_band("facts_per_kib", ">=", DENSITY)} AS density_pct FROM measured)"""
_CHECKED = f"""{values("checks", 'i, "check", dimension, weight, basis', _CHECK_ROWS)}, rows AS (SELECT doc_id, i, "check", dimension, weight, basis,
  greatest(weight - ((doc_id * 7 + i * n_chars) % (weight + 1) * (doc_id % 4)) // 3, 0)::BIGINT AS earned FROM documents CROSS JOIN checks), totals AS (SELECT doc_id, sum(earned)::BIGINT AS score FROM rows GROUP BY 1), graded AS (SELECT doc_id, score, {_band("score", ">=", BANDS)} AS grade FROM totals)"""
QUERIES = {
    "fact_merge": (fact_merge, f"""WITH {_MERGED} SELECT page, kind, normalized, source, "offset", qualified, array_to_string(sources, ',') AS sources, corroborated FROM merged"""),
    "fact_divergence": (fact_divergence, f"""WITH {_FACTS}, a AS ({_VIEW.format("agent")}), b AS ({_VIEW.format("NOT agent")}) SELECT page, kind, a.representative AS claim, array_to_string(b.observed, ' | ') AS stated, NOT list_contains(b.observed, a.representative) AS divergent FROM a JOIN b USING (page, kind)"""),
    "missing_core_facts": (missing_core_facts, f"WITH {_FACTS} SELECT page, kind FROM (SELECT DISTINCT page FROM facts) CROSS JOIN (SELECT unnest({_list(CORE)}) AS kind) EXCEPT SELECT page, kind FROM facts WHERE agent"),
    "coverage_scores": (coverage_scores, f"WITH {_COVERAGE} SELECT page, core_found, extended_found, coverage_pct, density_pct, (14 * coverage_pct * density_pct + 5000) // 10000 AS core_points, {_band(f'100 * bytes // {REFERENCE_BYTES}', '<=', COST)} AS cost_points FROM banded"),
    "position_scores": (
        position_scores,
        f"""WITH {_MERGED}, sized AS (SELECT page, max("offset") AS bytes FROM facts GROUP BY 1), counted AS (SELECT page, min("offset") AS first_offset, count(*) FILTER ("offset" < greatest(2048, bytes // 5)) AS front, count(*) AS n FROM merged JOIN sized USING (page) WHERE kind IN {_in(CORE)} GROUP BY 1)
        SELECT page, first_offset, {_band("first_offset", "<=", FIRST_OFFSET)} AS offset_points, {_band("100 * front // n", ">=", WINDOW)} AS window_points FROM counted""",
    ),
    "dimension_scores": (dimension_scores, f"WITH {_CHECKED} SELECT doc_id, dimension, sum(earned)::BIGINT AS earned, sum(weight)::BIGINT AS weight, bool_or(basis = 'heuristic') AS heuristic FROM rows GROUP BY 1, 2"),
    "grades": (grades, f"WITH {_CHECKED} SELECT doc_id, score, grade FROM graded"),
    "threshold_gate": (threshold_gate, f"WITH {_CHECKED} SELECT doc_id // 100 AS run, count(*) FILTER (grade NOT IN ('A', 'B', 'C')) AS missed, arg_max(grade, struct_pack(s := -score, d := doc_id)) AS worst_grade, CASE WHEN bool_and(grade IN ('A', 'B', 'C')) THEN 'ok' ELSE 'threshold' END AS exit FROM graded GROUP BY 1"),
    "ranked_fixes": (
        ranked_fixes,
        f"""WITH {_CHECKED}, {values("rules", 'place, fix, effort, "check", closes, zero', [(p, f, e, c, k, "|".join(z)) for p, f, e, c, k, z in recommend.ROWS])},
        gaps AS (SELECT doc_id, "check", greatest(weight - earned, 0) AS gap FROM rows), nothing AS (SELECT doc_id, list("check") AS unearned FROM rows WHERE earned = 0 GROUP BY 1),
        able AS (SELECT g.*, place, fix, effort, closes FROM gaps g JOIN rules USING ("check") LEFT JOIN nothing n ON n.doc_id = g.doc_id WHERE zero = '' OR list_has_all(coalesce(unearned, []), string_split(zero, '|'))),
        valued AS (SELECT *, sum(CASE WHEN closes THEN gap ELSE 0 END) OVER (PARTITION BY doc_id, place) AS own, sum(gap) OVER (PARTITION BY doc_id, place) AS raw FROM able),
        ranked AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY raw DESC, effort, place) AS o FROM valued WHERE own > 0 AND gap > 0),
        claimed AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY doc_id, "check" ORDER BY o) = 1)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o)::INT AS rank, fix, {_list(recommend.EFFORTS)}[effort + 1] AS effort, sum(gap)::BIGINT AS points,
          coalesce(string_agg("check", ',' ORDER BY "check") FILTER (closes), '') AS closes, coalesce(string_agg("check", ',' ORDER BY "check") FILTER (NOT closes), '') AS opens FROM claimed GROUP BY doc_id, o, fix, effort""",
    ),
}

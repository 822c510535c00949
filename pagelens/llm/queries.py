"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm import bpe, chat, cover_search, html_text, lexical_search, licenses, line_dedup, minhash_dedup, packing, periodic_runs, rabitq, simhash_dedup, toxicity
from pagelens.sources.shared import read_table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(read_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.decode(encoded, ranks).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_text.extract(read_table(spark, sf_dir, "pages"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_search.top_k(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash_dedup.simhash_components(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = line_dedup.mark(read_table(spark, sf_dir, "documents"))
    return marked.select("row.doc_id", "text", F.col("removed").alias("lines_removed"), F.length("text").alias("n_chars"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs, licenses.fit(docs))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    extra = spark.sql("select -1L conv_id, stack(2, 0L, 'user', '{0}', 1L, 'assistant', '{0}') as (turn, role, text)".format(control))
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    formatted = chat.format_conversations(rows, public_tokenizers.path("byte_bpe_50k.json"))
    return chat.digests(formatted).withColumn("conv_id", F.col("conv_id").cast("long"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(
        read_table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
    )
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_rabitq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rabitq.nearest(read_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def fitted_toxicity(spark: SparkSession, sf_dir: str) -> toxicity.ToxicityModel:
    labels = read_table(spark, sf_dir, "labels").where(~toxicity.held_out())
    return toxicity.fit(read_table(spark, sf_dir, "documents"), labels)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fitted_toxicity(spark, sf_dir)
    scored = toxicity.score(read_table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        F.col("tox_score").alias("score"),
        (F.col("tox_score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.components(read_table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, for a tenth of the ids with a tail of words that repeats with a period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")).alias("words"))
    rows = rows.select("doc_id", "text", "h", "words", F.size("words").cast("long").alias("n"), F.expr("h div 10").alias("g"))
    rows = rows.select("*", F.when(F.col("n") > 0, F.col("g") % F.col("n")).alias("a"))
    rows = rows.select("*", F.expr("1 + (n - a) div (3 + g % 8)").alias("p"))
    tail = "slice(flatten(array_repeat(slice(words, cast(a as int) + 1, cast(p as int)), cast((n - a) div p as int) + 1)), 1, cast(n - a as int))"
    return rows.select("doc_id", F.expr(f"case when n > 0 then array_join(concat(slice(words, 1, cast(a as int)), {tail}), ' ') else text end").alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(planted_runs(read_table(spark, sf_dir, "documents")))
    longest = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    rows = found.select("doc_id", "runs", "collapsed", longest.alias("top"))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"), F.col("top.length"), (-F.col("top.period")).alias("period"),
        F.expr("1000 * top.length div -top.period").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_html_text": op2_html_text,
        "op3_exact_topk": op3_exact_topk,
        "op4_simhash_dedup": op4_simhash_dedup,
        "op5_line_dedup": op5_line_dedup,
        "op6_licenses": op6_licenses,
        "op7_chat": op7_chat,
        "op8_packing": op8_packing,
        "op9_rabitq": op9_rabitq,
        "op10_toxicity": op10_toxicity,
        "op11_minhash_dedup": op11_minhash_dedup,
        "op12_lexical_search": op12_lexical_search,
        "op13_periodic_runs": op13_periodic_runs,
    }


#: The pages of the test tables hold one article each and few character references, so that patterns can state their text.
_ARTICLE = "regexp_replace(regexp_extract(html, '<article>(.*?)(?:</article>|<footer|$)', 1, 's'), '<[a-zA-Z/!][^>]*>', ' ', 'g')"
_TEXT = f"trim(regexp_replace(replace(replace(replace(replace({_ARTICLE}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&'), '\\s+', ' ', 'g'))"
_HTML_SQL = f"SELECT page_id, url, {_TEXT} AS text, length({_TEXT}) AS n_chars FROM pages"

_TOPK_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.w, v.w)::BIGINT AS score FROM v q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id AND len(v.w) = len(q.w))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored QUALIFY rank <= 5"""

# A turn adds its four control strings, and a backslash for each backslash or control string inside its role and text.
_CONTROL = "</s>[INST] ok [/INST]"
_ESCAPED = r"(length({0}) + len(regexp_extract_all({0}, '\\|<s>|\[INST\]|\[/INST\]|</s>')))"
_CHAT_SQL = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-1, 0, 'user', '{_CONTROL}'), (-1, 1, 'assistant', '{_CONTROL}'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(20 + {_ESCAPED.format('role')} + {_ESCAPED.format('text')})::BIGINT AS formatted_chars FROM t GROUP BY 1"""

_NEAR_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(words) < 2 THEN words ELSE list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) END) AS gram FROM w),
n AS (SELECT doc_id, count(gram) AS n FROM w LEFT JOIN g USING (doc_id) GROUP BY 1),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
near AS (SELECT u, v FROM pairs JOIN n x ON u = x.doc_id JOIN n y ON v = y.doc_id WHERE 100 * common >= 80 * (x.n + y.n - common)),
reach AS (SELECT u, v FROM (SELECT u, v FROM near UNION ALL SELECT v, u FROM near) UNION SELECT r.u, s.v FROM reach r JOIN (SELECT u, v FROM near UNION ALL SELECT v, u FROM near) s ON r.v = s.u)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(min(v), n.doc_id)) AS component_id, least(n.doc_id, coalesce(min(v), n.doc_id)) = n.doc_id AS kept FROM n LEFT JOIN reach ON n.doc_id = u GROUP BY 1, 2"""

_LEXICAL_SQL = r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
lengths AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1), whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS tokens FROM lengths),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, whole GROUP BY term, docs),
m AS (SELECT doc_id, 100 - 90 + (90 * n * docs) // tokens AS m FROM lengths, whole),
scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN tfs USING (term) JOIN weights USING (term) JOIN m USING (doc_id) GROUP BY 1, 2)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= 10"""

# crc32 bit by bit: DuckDB has no function of this name. Runs: equal triples of words a period apart, in unbroken rows; a run within one of a shorter period is none.
_CRC = "xor(list_reduce(range(8 * length(doc_id::VARCHAR)), lambda c, i: CASE WHEN (xor(c, CASE WHEN i % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, (i // 8 + 1)::BIGINT, 1)) ELSE 0 END) & 1) = 1 THEN xor(xor(c, CASE WHEN i % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, (i // 8 + 1)::BIGINT, 1)) ELSE 0 END) >> 1, 3988292384) ELSE xor(c, CASE WHEN i % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, (i // 8 + 1)::BIGINT, 1)) ELSE 0 END) >> 1 END, 4294967295::BIGINT), 4294967295)"
_RUNS_SQL = rf"""WITH raw AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, {_CRC} AS h FROM documents),
sized AS (SELECT doc_id, words, h, len(words) AS n, h // 10 AS g, CASE WHEN len(words) > 0 THEN (h // 10) % len(words) END AS a FROM raw),
planted AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN words[i + 1] ELSE words[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) ELSE words END AS words FROM sized),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM planted),
t AS (SELECT doc_id, i, hash(word, lead(word) OVER d, lead(word, 2) OVER d) AS triple, lead(word, 2) OVER d IS NOT NULL AS whole FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
same AS (SELECT b.doc_id, b.i, b.i - a.i AS q FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.triple = b.triple AND a.i < b.i WHERE a.whole AND b.whole),
rows_ AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS row_ FROM same),
stretch AS (SELECT doc_id, q, min(i) - q AS s, max(i) + 2 AS e FROM rows_ GROUP BY doc_id, q, row_ HAVING max(i) + 3 - min(i) + q >= greatest(6, 4 * q)),
runs AS (SELECT * FROM stretch x WHERE NOT EXISTS (SELECT 1 FROM stretch y WHERE y.doc_id = x.doc_id AND y.q < x.q AND y.s <= x.s AND y.e >= x.e)),
found AS (SELECT doc_id, count(*) AS n_runs, min(struct_pack(l := -(e - s + 1), s := s, q := q)) AS top, string_agg(s || ',' || (e - s + 1) || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY 1),
dropped AS (SELECT DISTINCT doc_id, unnest(range(s + q, e + 1)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS words FROM w ANTI JOIN dropped USING (doc_id, i) GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, -top.l AS length, top.q AS period, (1000 * -top.l) // top.q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.words, '')) AS collapsed_sha256
FROM documents LEFT JOIN found USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_html_text": _HTML_SQL, "op3_exact_topk": _TOPK_SQL, "op7_chat": _CHAT_SQL, "op11_minhash_dedup": _NEAR_SQL, "op12_lexical_search": _LEXICAL_SQL, "op13_periodic_runs": _RUNS_SQL}

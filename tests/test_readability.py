from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from pagelens.functions import addresses, documents, events, links, normalize
from pagelens.operators import page_types, robots
from pagelens.plans import readability as r


def values(spark, column, items):
    """What a column function gives for texts."""
    rows = spark.createDataFrame(list(enumerate(items)), "i int, x string").select("i", column(F.col("x")).alias("y")).collect()
    return [row.y for row in sorted(rows)]


def test_normal_forms(spark):
    assert values(spark, normalize.title, [" A  b | C", "x — y · z", "| a", "A :: b"]) == ["a b", "x", "| a", "a"]
    assert values(spark, normalize.title, ["Blue\u00a0 Lamp\u00a0| Shop", "\u3000x\u2003— y"]) == ["blue lamp", "x"]
    assert values(spark, normalize.date, ["2024-03-09T1", "2024/03/09", "9 March 2024", "Mar 19, 2024", "9 Foo 2024", "x"]) == ["2024-03-09", "2024-03-09", "2024-03-09", "2024-03-19", None, None]
    assert values(spark, normalize.availability, ["https://schema.org/InStock", "Sold Out!", "later"]) == ["instock", "outofstock", None]
    assert values(spark, normalize.phone, ["+1 (415) 555-0142", "tel:+493012345", "123", "415 555 0142"]) == ["+14155550142", "+493012345", None, "4155550142"]
    assert values(spark, normalize.duration, ["PT1H30M", "P1D", "45 mins", "2 Hours", "0 min", "P", "x"]) == ["90", "1440", "45", "120", None, None, None]
    assert values(spark, normalize.opening_hours, ["Open Mon to Fri 9:00", "monday by 7 pm", "Mondays closed", "at 9:00"]) == [True, True, False, False]
    assert values(spark, lambda x: normalize.in_lexicon(x, ["buy", "book now"]), ["Buy", "buy this", "buyer", " Book  now!", "book now here"]) == [True, True, False, False, True]
    assert values(spark, normalize.is_iso_date, ["2024-02-29", "2023-02-29", "2024-01-01T10:00:00Z", "2024-1-1"]) == [True, False, True, False]


def test_links_resolve_as_browsers_do(spark):
    base = "https://x.example/a/b/c.html?z=1"
    hrefs = [h for h in r.HREFS if h and not h.startswith(("HTTPS", "mailto", "#", "a b", "https://z"))]
    got = values(spark, lambda x: links.absolute(x, F.lit(base)), hrefs)
    assert got == [u if u.count("/") > 2 else u + "/" for u in (urljoin(base, h) for h in hrefs)]
    odd = {"a b.html?q=x y#t`": "https://x.example/a/b/a%20b.html?q=x%20y#t%60", "/é?ö='": "https://x.example/%C3%A9?%C3%B6=%27", "HTTP://Y.example:80/a/../%20b": "http://y.example/%20b", "\\\\cdn.x\\y": "https://cdn.x/y", "  d\te\n ": "https://x.example/a/b/de", "https://q.example:8443": "https://q.example:8443/"}
    assert values(spark, lambda x: links.absolute(x, F.lit(base.replace("example/", "example:443/"))), list(odd)) == list(odd.values())
    assert values(spark, lambda x: links.absolute(x, F.lit(base)), ["HTTPS://Y.example", "mailto:a@b", "#t", "../../../../g"]) == ["https://y.example/", "mailto:a@b", "https://x.example/a/b/c.html?z=1#t", "https://x.example/g"]


def test_link_headers_and_markdown(spark):
    [row] = values(spark, links.header_links, ['</a,b>; rel="alternate canonical"; type="Text/Markdown", <https://x.example/>; REL=next; title="a, <b>", <>; rel=x'])
    assert [(x.url, x.rel, x.type) for x in row] == [("/a,b", ["alternate", "canonical"], "text/markdown"), ("https://x.example/", ["next"], None)]
    assert values(spark, links.header_tokens, ["Accept, accept-encoding  x,"]) == [["accept", "accept-encoding", "x"]]
    assert values(spark, lambda x: links.markdown_link(F.lit("a [b]\n c"), x), ["https://x.example/(1)", "javascript:x", "mailto:a@b"]) == ["[a \\[b\\] c](https://x.example/%281%29)", "a \\[b\\] c", "[a \\[b\\] c](mailto:a@b)"]
    assert values(spark, lambda x: links.without_prefix(x, F.lit("/apps/")), ["/apps", "/apps/x", "/appsx"]) == ["/", "/x", "/appsx"]
    assert values(spark, lambda x: links.markdown_page(x, F.lit("GET")), ["/index.md", "/a/b.md", "/.md", "/a/.md", "/a"]) == ["/", "/a/b", None, None, None]


def test_addresses(spark):
    texts = ["::", "::1", "::ffff:10.0.0.1", "::10.0.0.1", "64:ff9b::8.8.8.8", "2002:0a00:0001::", "100::1", "2001:db8::1", "fd00::1", "fe80::1%eth0", "[ff02::1]", "2a00::1", "1:2:3", "1::2::3", "10.1.2.3", "8.8.8.8", "1.2.3", "x"]
    got = values(spark, addresses.address, texts)
    assert [g and (g.family, g.reserved) for g in got] == [(6, True), (6, True), (6, True), (6, True), (6, False), (6, True), (6, True), (6, True), (6, True), (6, True), (6, True), (6, False), (6, True), (6, True), (4, True), (4, False), (4, True), None]
    assert got[2].label == "IPv4-mapped → private (10.0.0.0/8)"
    refused = values(spark, addresses.refusal, ["https://x.example.com/a", "http://x.com", "https://u@x.com", "https://x.com:8443/", "https://localhost", "https://127.0.0.1", "https://[::1]/", "https://db.internal", "https://host", "nonsense"])
    assert [x is None for x in refused] == [True] + [False] * 9


@pytest.mark.parametrize("pattern,path,want", [("/a*b$", "/axxb", True), ("/a*b$", "/axxbc", False), ("/a*b", "/axxbc", True), ("", "/", False), ("/a$", "/a", True), ("/a$", "/ab", False), ("/*/x*y", "/1/x2y3", True), ("/a*a$", "/a", False), ("*", "/q", True), ("/a**b", "/ab", True)])
def test_robots_patterns(spark, pattern, path, want):
    assert spark.range(1).select(robots.path_matches(F.lit(pattern), F.lit(path)).alias("m")).first().m is want


def test_json_ld(spark):
    node = {"@type": "Product", "offers": [{"price": 3.0}, {"price": 4}], "brand": {"@type": "Brand", "name": " X "}}
    assert [page_types.types_of(x) for x in page_types.typed([node])] == [["Product"], ["Brand"]]
    assert page_types.read_path(node, "offers.price") == "3" and page_types.read_path(node, "brand") == "X" and page_types.read_path(node, "sku") is None
    rows = page_types.json_ld_nodes(spark.createDataFrame([(1, 5, '{"@type":"Store","name":"n"}'), (1, 9, "{bad"), (2, 0, "[]")], "page_id long, offset long, text string"))
    got = sorted((x.page_id, x.block, -9 if x.node is None else x.node, x.types) for x in rows.collect())
    assert got == [(1, 5, 0, ["Store"]), (1, 9, -9, None), (2, 0, -1, None)]
    assert rows.where("node = 0").select(page_types.paths_udf(["headline", "name"])("value").alias("n")).first().n == "n"


def test_documents(spark):
    assert values(spark, documents.canonical_json, ['{"b": 1, "a": [null, "é"]}', "{"]) == ['{"a":[null,"é"],"b":1}', None]
    assert values(spark, documents.canonical_json, ['{"b":1.0,"a":[100000.0,1e-06,1e-7,1.5e300,123456789012345678901,1e21,-0.0,0.1,12345.678,1e999]}', '{"\U0001F600":1,"\uffff":2,"z":true}', "[NaN]"]) == [
        '{"a":[100000,0.000001,1e-7,1.5e+300,123456789012345680000,1e+21,0,0.1,12345.678,null],"b":1}', '{"z":true,"\U0001F600":1,"\uffff":2}', None,
    ]
    assert values(spark, documents.etag, ["", "a"]) == ['W/"cbf29ce484222325-0"', 'W/"af63dc4c8601ec8c-1"']
    section = F.array(F.struct(F.lit("## S").alias("heading"), F.array(F.lit("- one"), F.lit("- two")).alias("items")))
    whole, cut, none = (spark.range(1).select(documents.within_budget(F.array(F.lit("# T")), section, n).alias("d")).first().d for n in (100, 76, 60))
    assert whole == "# T\n\n## S\n\n- one\n- two"
    big = F.array(F.struct(F.lit("## S").alias("heading"), F.array(F.lit("- one"), F.lit("- " + "x" * 90)).alias("items")))
    assert spark.range(1).select(documents.within_budget(F.array(F.lit("# T")), big, 90).alias("d")).first().d == f"# T\n\n## S\n\n- one\n\n{documents.NOTE}"
    front = lambda *a: spark.range(1).select(documents.front_matter(*map(F.lit, a)).alias("d")).first().d
    assert front("Blue: lamp", "true", "https://x.example/", "2024-01-01") == '---\ntitle: "Blue: lamp"\ndescription: "true"\ncanonical_url: https://x.example/\nlast_updated: "2024-01-01"\n---\n'
    assert front("T", "d" * 3000, "ftp://x", " ") == "---\ntitle: T\n---\n" and front(" ", "", "", "") == ""


def test_signals_survive_headers(spark):
    rows = spark.createDataFrame([("mcp.search_catalog", "blue lamp & more", 3, "succeeded"), ("bad tool!", "x", -1, None), ("ucp.checkout", "a@b.example", 0, "failed")], "tool string, query string, n int, status string")
    none = F.lit(None).cast("string")
    said = rows.withColumn("s", events.protocol_signals(F.col("tool"), F.col("query"), F.col("n"), none, none, F.col("status")))
    back = said.withColumn("h", events.stamp_headers(F.create_map(F.lit("x-intent-tool"), F.lit("forged"), F.lit("accept"), F.lit("*/*")), F.col("s"))).withColumn("b", events.read_headers(F.col("h")))
    got = back.collect()
    assert got[0].b == got[0].s and got[0].s.requested == "catalog.search" and got[0].s.status is None
    assert got[1].b.tool is None and got[1].h == {"accept": "*/*", "x-intent-query": "x"}
    assert got[2].b.query is None and got[2].b.status == "failed" and got[2].b.result_count == 0


def test_snapshots(spark):
    good = ("catalog.search", "verified", "https://x.co/a", "2024-01-01T00:00:00.000Z", "probe")
    cases = [[good], [good, good], [("catalog.search", "verified", None, None, "probe")], [("checkout.create", *good[1:])], [("x", *good[1:])], [(good[0], "declared", "http://x.co", None, "merchant")], [(*good[:3], "2024-03-01T00:00:00.000Z", "event")], []]
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, c array<struct<id:string,status:string,endpoint:string,checked_at:string,evidence_source:string>>")
    got = rows.select("i", events.is_snapshot(F.lit(1), F.lit("x.co"), F.lit("2024-02-01T00:00:00.000Z"), F.col("c")).alias("ok")).collect()
    assert [x.ok for x in sorted(got)] == [True, False, False, False, False, False, False, True]


def test_link_blocks(spark):
    from pagelens.operators import pages

    html = "<nav><ul>" + "".join(f"<li><a href=/n{i}>n</a>" for i in range(9)) + "</ul></nav><ul id=x>" + "".join(f"<li><a href=/{i % 4}>t</a>" for i in range(6)) + "</ul><p><a href=/z>z</a></p>"
    nodes = pages.tokenize(spark.createDataFrame([(1, html), (2, "<p><a href=/a>a</a></p>")], "page_id long, html string"))
    own = nodes.where("tag = 'a'").select("page_id", "node", "parent", F.col("attrs")["href"].alias("target"), F.lit(True).alias("own"))
    got = page_types.link_blocks(nodes, own).collect()
    assert [(x.page_id, x.links, x.same_origin) for x in got] == [(1, 4, True)]

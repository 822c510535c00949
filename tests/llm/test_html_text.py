from unittest import mock

from pagelens.llm import html_text as h

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{{}}</style><script>var a="</p>";</script></head><body class="page menu-open"><div class="cookie-notice">We use cookies</div>
<nav><ul><li><a href="/">Home</a><li><a href="/b">B</a></ul></nav><div class=ad>Buy now</div><aside>Side</aside>
<article><header><h1>Title&nbsp;{0}</h1></header><p><b>First   {0}<br>line<p>Second &lt;b&gt; a&eacute;<i>b</i>c</p><form><input value=x><button>Send</button></form><div id="comments"><p>Nice one!</p></div></article><footer>&copy; x</footer>"""


def test_article_text():
    assert h.main_text(PAGE.format(1), ()) == "Title 1 First 1 line Second <b> aébc"


def test_odd_sources():
    assert h.main_text(None, ()) == h.main_text("", ()) == h.main_text("<script>x", ()) == ""
    assert h.main_text("plain < 3 &amp; text", ()) == "plain < 3 & text"
    assert h.main_text("<p>a<p>b</b></i><div>c", ()) == "a b c"
    assert h.main_text('<article><p title="a>b" hidden>gone</p>kept<!-- no --> too</article>', ()) == "kept too"
    assert h.main_text("<article>" + "<div>" * 3000 + "deep", ()) == "deep"
    assert h.main_text('<a href="unclosed>x</a> y', ()) in ("x y", "")


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, host string, main long")


STORY = "Story {0} is told here at some length, so that it holds most text of the page."


def story(i, layout="story", title="T"):
    return f"<html><title>{title}</title><body><div class=top>Menu of the site</div><div class={layout}><h2>Summary</h2><p>{STORY.format(i)}</p><div class='side-effects'>Nausea {i}</div></div><div class=more>Share this page</div></body></html>"


def told(i):
    return f"Summary {STORY.format(i)} Nausea {i}"


def test_template_tells_the_main_slot_of_a_host_without_articles(spark):
    """One title for all pages, a heading that all repeat and a class name with an aside word: all of the slot stays."""
    rows = [(i, "https://a.example/x", story(i)) for i in range(8)] + [(50, "https://b.example/", "<p>only page</p>"), (51, None, "<p>no host</p>"), (52, "https://a.example/y", None), (50, "https://b.example/", "<p>only page</p>")]
    got = [(r.page_id, r.text) for r in h.extract(pages(spark, rows)).collect()]
    assert len(got) == len(rows)
    assert all((i, told(i)) in got for i in range(8))
    assert (50, "only page") in got and (51, "no host") in got and (52, "") in got


def test_each_layout_of_a_host_has_its_slot(spark):
    rows = [(i, "https://a.example/x", story(i, "story" if i % 2 else "report")) for i in range(16)]
    assert {r.page_id: r.text for r in h.extract(pages(spark, rows)).collect()} == {i: told(i) for i in range(16)}


def test_no_number_of_layouts_takes_a_slot_from_the_main_one(spark):
    small = [(1000 * k + i, "https://a.example/x", story(1000 * k + i, f"small{k}")) for k in range(70) for i in range(5)]
    rows = small + [(i, "https://a.example/x", story(i)) for i in range(40)]
    for inline in (h.INLINE, 9):  # with the host's row, and by a join on tokens
        with mock.patch.object(h, "INLINE", inline):
            got = {r.page_id: r.text for r in h.extract(pages(spark, rows)).collect()}
        assert got == {i: told(i) for i, *_ in rows}


def test_long_and_deeply_repeated_pages(spark):
    long_page = "<article>" + "<p>word word</p>" * 20_000 + "</article>"
    rows = [(1, "https://a.example/", long_page), (2, "https://a.example/", "<div>" * 2000 + "deep"), (2, "https://a.example/", "<div>" * 2000 + "deep")]
    got = sorted((r.page_id, len(r.text)) for r in h.extract(pages(spark, rows)).collect())
    assert got == [(1, 20_000 * 10 - 1), (2, 4), (2, 4)]


def test_copies_do_not_become_template(spark):
    rows = [(i, "https://a.example/", PAGE.format(7)) for i in range(30)]
    assert {r.text for r in h.extract(pages(spark, rows)).collect()} == {"Title 7 First 7 line Second <b> aébc"}


def test_empty_table(spark):
    assert h.extract(pages(spark, [])).count() == 0

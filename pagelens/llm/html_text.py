"""Main text of pages by equivalence-class template deduction.

Each page is read once as a run of blocks, in small Arrow batches. Its structure
tokens (an element under its parent, each with its first class) and its text
blocks are counted for each host. Tokens whose occurrence vectors over the host's
distinct pages are equal form an equivalence class; the vectors are compared
by a hash sum, so a host's pages never meet in one task, however many it has.
A class needs MIN_PAGES pages, so each layout of a host has classes of its own.
A class is valid if its tokens keep one order on all pages. Valid classes nest by the
pages that have them and by where they begin and end. A class's main slot is its deepest
once-only element, no mere part of a text, that holds most of the text of its pages; a page takes the
slot of the innermost class whose slot it has, widened or narrowed to the article or main element
round or in it, and where no class has a slot, that element alone. Outside any
slot the host's own texts, which are template, go. Pages of the same blocks
count once, so groups of copies do not turn their own text into a template.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pagelens.sources.shared import long_rows, materialize, quoted

SUPPORT = 0.9  # share of a host's distinct pages on which a text of its own occurs
MIN_PAGES = 5  # distinct pages of a host that a class of its template has, at least
MASS = 0.5  # share of a host's text that its main slot holds
INLINE = 1024  # slots of a host up to which they travel with its row; those of larger hosts meet their pages in a join on tokens
DEPTH = 256  # elements within each other that have tokens; what is deeper belongs to the last of them

# Element names of HTML, by how they are read here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
IN_TEXT = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ASIDE_TAGS = frozenset("head nav footer aside form button select option svg canvas object audio video dialog template menu datalist fieldset".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored sponsors promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer masthead topbar cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup popup modal overlay comment comments discussion respond disqus "
    "replies share sharing social related recommended popular trending read viewed teaser teasers outbrain taboola widget widgets toolbar pagination pager login".split()
)
#: Words that may stand beside an aside word in a class name or id, which must consist of such words as a whole.
NEUTRAL_WORDS = frozenset("side reader readers user users thread threads story stories article articles news most more now manager label site main left right top bottom primary secondary global header bar box block wrapper wrap container section area list item items link links inner outer post posts articles content text slot unit form buttons".split())
MAIN_TAGS = frozenset(("article", "main"))
LEAF_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd ul ol dl pre blockquote figure figcaption tr td th caption summary address".split())  # parts of a text, no slots

_NAMED = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"""[>"']""")
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_NAME = re.compile(r"[a-z]+|[0-9]+")


class _Element:
    __slots__ = ("name", "token", "aside", "main", "tokens", "named", "around")

    def __init__(self, name: str, token: str, aside: bool, main: int, tokens: tuple[int, ...], named: tuple[int, ...] = (), around: tuple[int, ...] = ()):
        self.name, self.token, self.aside, self.main, self.tokens = name, token, aside, main, tokens
        self.named, self.around = named, around  # elements above with an aside name; those of them in which the main slot began


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63


def _is_aside(name: str, attrs: dict[str, str], inside_main: bool) -> bool:
    if name in ASIDE_TAGS or (name == "header" and not inside_main):
        return True
    if attrs.get("role", "").lower() in ASIDE_ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    if "display:none" in attrs.get("style", "").lower().replace(" ", ""):
        return True
    return False


def _is_named_aside(name: str, attrs: dict[str, str]) -> bool:
    """Whether a whole class name or id says aside: 'cookie-banner', but not 'has-sidebar' or 'side-by-side'."""
    if name in ("body", "html") or name in MAIN_TAGS:
        return False
    for whole in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split():
        parts = [w for w in _NAME.findall(whole) if not w.isdigit()]
        if any(w in ASIDE_WORDS for w in parts) and all(w in ASIDE_WORDS or w in NEUTRAL_WORDS for w in parts):
            return True
    return False


class Page:
    """Blocks (text, aside, main, tokens of the open elements) and element tokens with their positions.

    main is the number of the outermost article or main element round a block, 0 for none; main elements have numbers below 0.
    """

    def __init__(self, source: str):
        self.blocks: list[tuple[str, bool, int, tuple[int, ...]]] = []
        self.elements: list[int] = []
        self.leaves: set[int] = set()
        self.title = ""
        self._stack = [_Element("", "", False, 0, ())]
        self._parts: list[str] = []
        self._found: list[tuple[str, _Element]] = []
        self._named = self._mains = 0
        self._counts: dict[str, int] = {}
        self._read(source)
        self._settle()

    def _flush(self) -> None:
        if self._parts:
            text = " ".join(entities.unescape("".join(self._parts)).split())
            self._parts = []
            top = self._stack[-1]
            if text:
                self._found.append((text, top))

    def _settle(self) -> None:
        """Drop what lies in elements with an aside name, unless one holds most of the page's text or of its main slots."""
        total, slots = 0, 0
        held: dict[int, int] = {}
        within: dict[int, int] = {}
        for text, e in self._found:
            if e.aside:
                continue
            total += len(text)
            slots += len(text) if e.main else 0
            for i in e.named:
                held[i] = held.get(i, 0) + len(text)
            for i in e.around:
                within[i] = within.get(i, 0) + len(text)
        kept = {i for i, n in held.items() if n >= MASS * total or slots and within.get(i, 0) >= MASS * slots}
        self.blocks = [(text, e.aside or any(i not in kept for i in e.named), e.main, e.tokens) for text, e in self._found]

    def _open(self, name: str, rest: str) -> None:
        if name not in IN_TEXT:
            self._flush()
        if name in VOID:
            return
        if name in CLOSES_P:
            self._close("p", CLOSES_P - {"p"})
        elif name == "li":
            self._close("li", frozenset(("ul", "ol", "menu")))
        attrs: dict[str, str] = {}
        for m in _ATTR.finditer(rest):
            attrs.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
        for word in re.sub(r"""=\s*("[^"]*"|'[^']*'|[^\s>]+)""", "", rest).split():
            attrs.setdefault(word.lower().rstrip("/"), "")
        top = self._stack[-1]
        if name in IN_TEXT:
            aside = top.aside or _is_aside(name, attrs, bool(top.main))
            named = self._names(top, name, attrs)
            if aside and not top.aside or named != top.named:
                self._flush()
            self._push(_Element(name, top.token, aside, top.main, top.tokens, named, top.around))
            return
        own = f"{name}.{(attrs.get('class') or '').split(' ')[0]}"
        token = _hash(f"{top.token}>{own}")
        self.elements.append(token)
        if name in LEAF_TAGS:
            self.leaves.add(token)
        main = top.main
        if not main and (name in MAIN_TAGS or attrs.get("role", "").lower() == "main"):
            self._mains += 1
            main = self._mains if name == "article" else -self._mains
        named = self._names(top, name, attrs)
        around = top.around if top.main or not main else named
        tokens = (*top.tokens, token) if len(top.tokens) < DEPTH else top.tokens
        self._push(_Element(name, own, top.aside or _is_aside(name, attrs, bool(main)), main, tokens, named, around))

    def _push(self, element: _Element) -> None:
        self._stack.append(element)
        self._counts[element.name] = self._counts.get(element.name, 0) + 1

    def _names(self, top: _Element, name: str, attrs: dict[str, str]) -> tuple[int, ...]:
        if not _is_named_aside(name, attrs):
            return top.named
        self._named += 1
        return (*top.named, self._named)

    def _close(self, name: str, edge: frozenset = frozenset()) -> None:
        if not self._counts.get(name):
            return
        for i in range(len(self._stack) - 1, 0, -1):
            own = self._stack[i].name
            if own == name:
                if name not in IN_TEXT or (self._stack[i].aside, self._stack[i].named) != (self._stack[i - 1].aside, self._stack[i - 1].named):
                    self._flush()
                for e in self._stack[i:]:
                    self._counts[e.name] -= 1
                del self._stack[i:]
                return
            if own in edge:
                return

    def _tag_end(self, source: str, at: int) -> int:
        """Place of the > that ends a tag, -1 if none does. Quoted values may hold one; from the first quote on that nothing closes, quotes count as any character, so that no part is read again for each tag."""
        start = at
        while not self._loose:
            m = _STOP.search(source, at)
            if not m:
                break
            if m[0] == ">":
                return m.start()
            at = source.find(m[0], m.end()) + 1
            if not at:
                break
        self._loose = True
        return source.find(">", start)

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        self._last, self._loose = source.rfind(">"), False
        while at < n:
            lt = source.find("<", at)
            if lt < 0:
                self._parts.append(source[at:])
                break
            if lt > at:
                self._parts.append(source[at:lt])
            if source.startswith("<!--", lt):
                end = source.find("-->", lt + 4)
                at = n if end < 0 else end + 3
                continue
            if source.startswith(("<!", "<?"), lt):
                end = source.find(">", lt)
                at = n if end < 0 else end + 1
                continue
            m = _NAMED.match(source, lt) if lt < self._last else None
            end = self._tag_end(source, m.end()) if m else -1
            if end < 0:
                self._parts.append("<")
                at = lt + 1
                continue
            at, name, rest = end + 1, m[2].lower(), source[m.end() : end]
            if m[1]:
                if name in RAW:
                    continue
                if name not in IN_TEXT:
                    self._flush()
                self._close(name)
                continue
            if name in RAW:
                self._flush()
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
                if name == "title" and not self.title:
                    self.title = " ".join(entities.unescape(source[at : end.start() if end else n]).split())
                close = source.find(">", end.end()) if end else -1
                at = n if close < 0 else close + 1
                continue
            self._open(name, rest)
        self._flush()


def host_of(url: Column) -> Column:
    """The lower-case host of an absolute URL, empty if there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def _occurrences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each token of each page: host, source (a hash of its html), token, page (a hash of its blocks), count, place (0 to 1), characters, depth, whether it is text."""
    for pdf in batches:
        out: list[tuple] = []
        for host, name_of, source in zip(pdf["host"], pdf["source"], pdf["html"]):
            page = Page(source or "")
            name = _hash("\n".join([page.title, *(b[0] for b in page.blocks)]))
            n = max(1, len(page.elements))
            total = sum(len(b[0]) for b in page.blocks if not b[1])
            seen: dict[int, list] = {}
            for i, token in enumerate(page.elements):
                seen.setdefault(token, [0, i / n, 0, 0])[0] += 1
            for text, aside, _, tokens in page.blocks:
                own = seen.setdefault(_hash(f"text:{text}"), [0, 1.0, -1, 0])
                own[0] += 1
                if not aside:
                    for depth, token in enumerate(tokens):
                        seen[token][2] += 0 if token in page.leaves else len(text)
                        seen[token][3] = max(seen[token][3], depth)
            out += [(host, name_of, token, name, c, place, max(0, mass), total, depth, mass < 0) for token, (c, place, mass, depth) in seen.items()]
        yield pd.DataFrame(out, columns=["host", "source", "token", "page", "count", "place", "mass", "total", "depth", "is_text"])


def templates(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the template of each host says of pages (host, source, html): host, own_texts (tokens of blocks that it repeats), slots (tokens of main slots, innermost first, null if there are over INLINE), many; and, for pages of such hosts, host, source and slot.

    Only texts that most pages of a host repeat are gathered for it, no more than a page holds.
    """
    rows = pages.mapInPandas(_occurrences, "host string, source long, token long, page long, count int, place double, mass long, total long, depth int, is_text boolean")
    once = rows.groupBy("host", "token", "page").agg(F.max("count").alias("count"), F.avg("place").alias("place"), F.max("mass").alias("mass"), F.max("total").alias("total"), F.max("depth").alias("depth"), F.max("is_text").alias("is_text"))
    vectors = once.groupBy("host", "token").agg(
        F.count("*").alias("pages"), F.bit_xor(F.xxhash64("page", "count")).alias("vector"), F.max("count").alias("most"),
        F.min("place").alias("lowest"), F.avg("place").alias("middle"), F.max("place").alias("highest"),
        F.sum("mass").alias("mass"), F.sum("total").alias("total"), F.max("depth").alias("depth"), F.max("is_text").alias("is_text"),
    )
    # A token on fewer pages is no template: without this, all texts of a host would meet below.
    vectors = materialize(vectors.where(F.col("pages") >= MIN_PAGES), "token-vectors")
    totals = vectors.where(~F.col("is_text")).groupBy("host").agg(F.max("pages").alias("all_pages"))  # what is on every page: html, body
    own = vectors.where("is_text").join(totals, "host").where(F.col("pages") >= SUPPORT * F.col("all_pages")).groupBy("host").agg(F.collect_set("token").alias("own_texts"))
    token = F.struct("middle", "lowest", "highest", "token", "most", "mass", "total", "depth")
    classes = vectors.where(~F.col("is_text")).groupBy("host", "vector", "pages").agg(F.array_sort(F.collect_list(token)).alias("tokens"))
    by = lambda name: F.transform(F.array_sort(F.transform("tokens", lambda t: F.struct(t[name].alias("at"), t["middle"].alias("middle"), t["token"].alias("token")))), lambda t: t["token"])
    inner = F.transform("tokens", lambda t: t["token"])
    valid = classes.where((by("lowest") == inner) & (by("highest") == inner))
    held = F.filter("tokens", lambda t: (t["most"] == 1) & (t["mass"] >= MASS * t["total"]))
    deepest = F.array_max(F.transform(held, lambda t: F.struct(t["depth"].alias("depth"), t["token"].alias("token"))))
    # A class on fewer pages lies within those on more; within equal ones the deeper slot is the inner one.
    slot = F.struct("pages", (-deepest["depth"]).alias("depth"), deepest["token"].alias("token"))
    slots = valid.select("host", slot.alias("slot")).where("slot.token is not null").groupBy("host", F.col("slot.token").alias("token")).agg(F.min("slot").alias("slot"))
    counted = slots.groupBy("host").agg(F.count("*").alias("n"))
    slots = materialize(slots.join(counted, "host").withColumn("many", F.col("n") > INLINE), "slots")
    listed = slots.where("not many").groupBy("host").agg(F.transform(F.array_sort(F.collect_list("slot")), lambda t: t["token"]).alias("slots"))
    learned = totals.join(own, "host", "left").join(listed, "host", "left").join(slots.where("many").select("host", "many").distinct(), "host", "left")
    held_by = rows.where("mass > 0").select("host", "source", "token").join(slots.where("many").select("host", "token", "slot"), ["host", "token"])
    chosen = held_by.groupBy("host", "source").agg(F.min("slot")["token"].alias("slot"))
    return learned.select("host", "own_texts", "slots", F.coalesce("many", F.lit(False)).alias("many")), chosen


def main_text(source: str | None, own_texts, slots=()) -> str:
    """The text of a page's main slot, the first of slots that it has; blocks joined by a space. Without any, its text without the host's own texts.

    Articles or main elements round or in the slot take its place; of those the main elements, if there are some.
    """
    page = Page(source or "")
    blocks = [b for b in page.blocks if not b[1]]
    held = {t for b in blocks for t in b[3]}
    slot = next((x for x in (() if slots is None else slots) if x in held), None)
    within = [b for b in blocks if slot in b[3]]
    slotted = bool(within)
    within = within or blocks
    mains = {b[2] for b in within if b[2]}
    mains = {x for x in mains if x < 0} or mains
    if mains:
        return " ".join(b[0] for b in blocks if b[2] in mains)
    if not slotted and own_texts is not None and len(own_texts):
        own = set(own_texts)
        within = [b for b in within if _hash(f"text:{b[0]}") not in own]
    return " ".join(b[0] for b in within)


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", out_col: str = "text") -> DataFrame:
    """pages with the main text added as out_col (empty if there is none); every row stays.

    A null html counts as empty; pages without a host share the empty host.
    Repeated rows get equal texts. Texts have their character references decoded,
    white space within a block turned into one space, and blocks joined in page
    order by one space. An empty table gives an empty result. out_col replaces a
    column of its name; other columns stay.
    """
    long_rows(pages.sparkSession)
    host, source = host_of(quoted(url_col)), F.xxhash64(quoted(html_col))
    learned, chosen = templates(pages.select(host.alias("host"), source.alias("source"), quoted(html_col).alias("html")))
    learned = materialize(learned, "templates")
    run = _text_udf()
    keep = [quoted(c) for c in pages.columns if c != out_col]
    rows = pages.select(F.struct(*keep).alias("row"), host.alias("host"), source.alias("source"), quoted(html_col).alias("html")).join(learned, "host", "left")
    found = rows.where(~F.coalesce("many", F.lit(False)))
    if not learned.where("many").isEmpty():
        large = rows.where("many").join(materialize(chosen, "chosen-slots"), ["host", "source"], "left")
        found = found.unionByName(large.withColumn("slots", F.when(F.col("slot").isNotNull(), F.array("slot"))).select(*found.columns))
    return found.select("row", run("html", "own_texts", "slots").alias(out_col)).select("row.*", out_col)


def _text_udf():
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for source, own_texts, slots in parts:
            yield pd.Series([main_text(*x) for x in zip(source, own_texts, slots)], dtype=object)

    run.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, StringType())

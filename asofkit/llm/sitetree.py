"""Main text of web pages by site style trees.

The pages of a host are merged into one tree, whose nodes are paths of block elements with their classes. For each node are
known: how many pages have it, the presentation styles (sequences of child blocks) it comes in, and the texts it directly holds
with the number of pages for each. From these follow, with logarithms to the base of the number of pages,

    presentation importance   the entropy of the styles
    content importance        1 - the mean entropy of the texts over the pages that hold them
    composite importance      of an inner node (1 - g**l) * presentation + g**l * the mean over its children (g = DAMPING, l children);
                              of a leaf its content importance

A branch whose nodes all have low importance is the same all over the site: it is cut from each page. Besides, for sites too small for
statistics, three kinds of elements are cut:

    never part of an article   scripts, navigation, footers, asides and the like, by element or role, and what is hidden; headers outside articles
    comments                   by class or id, unless the page has no other text
    doubtful                   forms, and what a class or id names as a notice, an advert, a menu ...: only if no article or main element and
                               no more than half of the page's text stands inside

What remains inside of article or main elements, where there are any, is the text; where there are none, all that remains. Counts are aggregated
by (host, node, text), so that a host with a great many pages is no hot group; a host's nodes that LEAST_PAGES pages or more have in common meet
in one group, forty bytes each, and what reaches the pages is each host's list of cut nodes.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.llm.common import bounded_batches, fresh, releasing, saved, small, tidy, without

#: A site needs so many pages with a node before it is judged.
LEAST_PAGES = 8
#: Branches below this importance are cut.
LOW = 0.12
DAMPING = 0.9
#: Cut nodes of all sites are broadcast up to so many, and joined to the pages by a shuffle beyond.
BROADCAST_NODES = 100_000

BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
CUT_TAGS = frozenset("head nav footer aside button select option svg canvas audio video object dialog menu map datalist math".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary dialog alert alertdialog menu menubar toolbar tablist".split())
DOUBTFUL_ROLES = frozenset("search form".split())
COMMENT_WORDS = frozenset("comment comments commentlist respond reply replies disqus".split())
DOUBTFUL_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs footer header masthead topbar toolbar widget widgets pagination pager login search copyright disclaimer skip".split()
)
#: Why an element is cut, or may be.
NEVER, COMMENTS, DOUBTFUL = 3, 2, 1
#: An opening tag of the first kind ends an open element of the second kind.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("table ul ol dl td th body html article section main".split())

_tag = re.compile(r"""<(?:!--(?P<note>.*?)(?:-->|\Z)|(?P<odd>[!?][^>]*>?)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:"[^"]*"|'[^']*'|[^'">])*)>?)""", re.S)
_attribute = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_words = re.compile(r"[a-z]+|[A-Z][a-z]*")
_hidden = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_white = re.compile(r"\s+")
_digits = re.compile(r"\d+")


class _Element:
    __slots__ = ("tag", "path", "parent", "why", "main", "children", "holds", "size", "cut")

    def __init__(self, tag: str, path: str, parent, why: int, main: bool):
        self.tag, self.path, self.parent, self.why, self.main = tag, path, parent, why, main
        self.children: list[str] = []
        self.holds = False  # whether an article or main element is inside
        self.size = 0  # characters of the text inside that may be an article's
        self.cut = 0


def _why(tag: str, attrs: dict[str, str], in_main: bool) -> int:
    """Why an element may be no part of an article: NEVER, COMMENTS, DOUBTFUL, or 0."""
    if tag in CUT_TAGS or tag == "header" and not in_main:
        return NEVER
    if not attrs or tag in ("html", "body"):
        return DOUBTFUL if tag == "form" else 0
    role = attrs.get("role", "").lower()
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or role in CUT_ROLES or _hidden.search(attrs.get("style", "")):
        return NEVER
    if tag == "main":
        return 0
    words = {w for name in ("class", "id") if (v := attrs.get(name)) for w in [w.lower() for w in _words.findall(v)] + re.split(r"[\W_]+", v.lower())}
    if words & COMMENT_WORDS:
        return COMMENTS
    return DOUBTFUL if tag == "form" or role in DOUBTFUL_ROLES or words & DOUBTFUL_WORDS else 0


class Page:
    """A page's blocks of text in order, each with its element, and its block elements."""

    def __init__(self, source: str | None):
        self.blocks: list[tuple[_Element, str]] = []
        self.elements: list[_Element] = []
        self._all: list[_Element] = []  # inline ones too, parents before their children
        self._parse(source or "")
        self._judge()

    def _judge(self) -> None:
        """Sets what is cut of each element."""
        for e in self._all:
            e.cut = max(e.parent.cut, e.why if e.why >= COMMENTS else 0)
        total = 0
        for e, text in self.blocks:
            if not e.cut:
                total += len(text)
                while e is not None:
                    e.size += len(text)
                    e = e.parent
        for e in self._all:
            doubtful = e.why == DOUBTFUL and not e.holds and 2 * e.size <= total
            e.cut = max(e.parent.cut, e.why if e.why >= COMMENTS or doubtful else 0)

    def _parse(self, source: str) -> None:
        root = _Element("", "", None, 0, False)
        stack, held, at, n = [root], [], 0, len(source)

        def flush() -> None:
            if held:
                text = _white.sub(" ", _html.unescape("".join(held))).strip()
                held.clear()
                if text:
                    self.blocks.append((block_of(stack), text))

        def block_of(stack: list[_Element]) -> _Element:
            return stack[-1]

        while at < n:
            m = _tag.search(source, at)
            if not m:
                held.append(source[at:])
                break
            if m.start() > at:
                held.append(source[at : m.start()])
            at = m.end()
            tag = m["name"]
            if not tag:
                continue
            tag = tag.lower()
            if m["end"]:
                if tag in VOID:
                    held.append(" " if tag == "br" else "")
                    continue
                place = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
                if place:
                    gone = stack[place:]
                    if any(e.tag in BLOCKS or e.why for e in gone):
                        flush()
                    del stack[place:]
                continue
            if tag == "br":
                held.append(" ")
                continue
            if tag in RAW:
                shut = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
                if not m[0].endswith("/>"):
                    stop = source.find(">", shut.end()) if shut else -1
                    at = stop + 1 if stop >= 0 else n
                held.append(" ")
                continue
            if tag in VOID and tag != "hr":
                continue
            rest = m["rest"]
            attrs = {}
            if rest and rest != "/":
                attrs = {k.lower(): _html.unescape(a or b or c) if "&" in (a or b or c) else a or b or c for k, a, b, c in _attribute.findall(rest)}
            if tag in BLOCKS:
                flush()
                while stack[-1].tag == "p" or any(e.tag == "p" for e in stack[-4:]) and stack[-1].tag not in BLOCKS:
                    stack.pop()
                if tag in CLOSES:
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i].tag in CLOSES[tag]:
                            del stack[i:]
                            break
                        if stack[i].tag in SCOPES and not (tag == "tr" and stack[i].tag in ("td", "th")):
                            break
                if tag == "hr":
                    continue
            above = stack[-1]
            why = _why(tag, attrs, above.main)
            if tag in BLOCKS:
                name = tag + ("." + _digits.sub("#", c.split()[0]) if (c := attrs.get("class", "").strip()) else "")
                path = f"{above.path}/{name}"
            else:
                path = above.path
            core = tag in ("article", "main") and why < COMMENTS
            e = _Element(tag, path, above, why, above.main or core)
            self._all.append(e)
            if core and not any(x.why >= COMMENTS for x in stack):
                for x in stack:
                    x.holds = True
                e.holds = True
            if tag in BLOCKS:
                above.children.append(name)
                self.elements.append(e)
            elif why:
                flush()
            if not m[0].endswith("/>") or tag in BLOCKS:
                stack.append(e)
        flush()

    def text(self, low: frozenset[int] = frozenset()) -> str:
        """The main text: blocks that aren't cut nor in a branch of *low* nodes.

        Where *low* nodes take all that article or main elements hold, their text stays: a site of copies of one page is no boilerplate.
        """
        kept = [(e, t) for e, t in self.blocks if not e.cut] or [(e, t) for e, t in self.blocks if e.cut < NEVER]
        core = [(e, t) for e, t in kept if e.main]
        rest = [(e, t) for e, t in core or kept if node_hash(e.path) not in low] if low else core or kept
        return "\n".join(t for _, t in rest or core)


def node_hash(path: str) -> int:
    return xxhash.xxh3_64_intdigest(path) - (1 << 63)


def _features(page: Page) -> set[tuple[int, int, int, int]]:
    """(node, parent, kind, feature): kind 0 that the page has the node, 1 a presentation style, 2 a text."""
    out = set()
    for e in page.elements:
        node, parent = node_hash(e.path), node_hash(e.parent.path)
        out.add((node, parent, 0, 0))
        out.add((node, parent, 1, node_hash("|".join(e.children)) if e.children else 0))
    for e, text in page.blocks:
        top = e
        while top.tag and top.tag not in BLOCKS:
            top = top.parent
        if top.tag:
            out.add((node_hash(top.path), node_hash(top.parent.path), 2, node_hash(text)))
    return out


def _composite(nodes: pd.DataFrame) -> dict[int, float]:
    """Composite importance by node of one site; columns node, parent, pages, style, content (null without text)."""
    children: dict[int, list[int]] = {}
    for node, parent in zip(nodes["node"], nodes["parent"]):
        children.setdefault(parent, []).append(node)
    own = {r.node: r for r in nodes.itertuples(index=False)}
    found: dict[int, float] = {}
    order, queue = {}, [n for n in own if own[n].parent not in own]
    while queue:
        order[n := queue.pop()] = True
        queue += [c for c in children.get(n, []) if c not in order]
    for n in reversed(list(order)):
        below = [found[c] for c in children.get(n, []) if c in found]
        content = None if pd.isna(own[n].content) else own[n].content
        if below:
            share = DAMPING ** len(below)
            found[n] = (1 - share) * own[n].style + share * float(np.mean(below + ([content] if content is not None else [])))
        else:
            found[n] = content if content is not None else 1.0
    return found


def low_nodes(pages: DataFrame) -> DataFrame:
    """host, low array<bigint>: the nodes in branches of low importance, of hosts that have any. *pages* has host and html."""

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hosts, rows = [], []
            for host, source in zip(batch["host"], batch["html"]):
                found = _features(Page(source))
                hosts += [host] * len(found)
                rows += found
            if rows:
                out = pd.DataFrame(rows, columns=["node", "parent", "kind", "feature"])
                out.insert(0, "host", hosts)
                yield out

    rows = pages.mapInPandas(releasing(features), "host string, node bigint, parent bigint, kind int, feature bigint")
    counts = rows.groupBy("host", "node", "parent", "kind", "feature").agg(F.count(F.lit(1)).alias("c"))
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    logs = F.col("c") * F.log("c")
    sums = counts.groupBy("host", "node", "parent").agg(of(0, F.col("c")).alias("pages"), of(1, F.col("c")).alias("s"), of(1, logs).alias("sl"), of(2, F.log("c")).alias("tl"), of(2, F.lit(1)).alias("t"))
    judged = sums.filter(F.col("pages") >= LEAST_PAGES).select(
        "host", "node", "parent", "pages", ((F.log("s") - F.col("sl") / F.col("s")) / F.log("pages")).alias("style"), (1 - F.col("tl") / F.col("t") / F.log("pages")).alias("content")
    )

    def cut(site: pd.DataFrame) -> pd.DataFrame:
        importance = _composite(site)
        parent = dict(zip(site["node"], site["parent"]))
        low = {n for n, v in importance.items() if v < LOW}
        high = set(importance) - low
        for n in list(high):  # a branch with anything of importance stays
            while (n := parent.get(n)) in low:
                low.discard(n)
        return pd.DataFrame({"host": [site["host"].iloc[0]], "low": [sorted(low)]}) if low else pd.DataFrame({"host": pd.Series(dtype=object), "low": pd.Series(dtype=object)})

    return judged.groupBy("host").applyInPandas(cut, "host string, low array<bigint>")


@tidy
def extract_text(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """*pages* with text (main text of the whole html, "" if there is none) and n_chars (its code points).

    Blocks are joined by line feeds in page order; white space inside one, line breaks too, becomes one space. A null html is empty. A
    null url belongs to the host "". Input columns named text and n_chars are replaced; rows are judged one by one, so repeated rows are
    too. An empty table gives an empty table.
    """
    bounded_batches(pages.sparkSession)
    pages = without(pages, "text", "n_chars")
    host, site, low = fresh(pages, "_host"), fresh(pages, "_site"), fresh(pages, "_low")
    placed = pages.withColumn(host, F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))))
    sites = saved(low_nodes(placed.select(F.col(host).alias("host"), F.col(html).alias("html"))), "low_nodes").select(F.col("host").alias(site), F.col("low").alias(low))
    few = small(sites.select(F.explode(low)), BROADCAST_NODES)
    joined = placed.join(F.broadcast(sites) if few else sites, F.col(host) == F.col(site), "left").drop(host, site)

    @F.pandas_udf("string")
    def main_text(sources: pd.Series, lows: pd.Series) -> pd.Series:
        return pd.Series([Page(s).text(frozenset(n.tolist()) if n is not None else frozenset()) for s, n in zip(sources, lows)], dtype=object)

    out = joined.withColumn("text", main_text(F.col(html), F.col(low))).drop(low)
    return out.withColumn("n_chars", F.char_length("text").cast("bigint"))

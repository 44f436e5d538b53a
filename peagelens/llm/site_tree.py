"""Main text of web pages by the style tree of their site.

The DOMs of a host's pages are merged into one tree: elements with the same path of tags, classes and
ids are one node. A node's presentation importance is the entropy of the child sequences that pages
give it; its content importance is one minus the mean entropy of its texts over the pages, so a text that
every page repeats counts nothing and a text of one page counts fully. A branch is noise if it and all
branches below it have a low composite of the two, and is removed from every page.

Conventions of markup come first, since a host of few pages has no statistics: elements made for
menus, headers, forms, adverts or comments are left out, and where a page marks its article, only that is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peagelens.llm.wordscan import ascii_lower, pieces
from peagelens.session import settle

#: A node is judged if at least so many pages of its host have it.
MIN_PAGES = 5
#: Branches with a composite importance below this are noise.
THRESHOLD = 0.25
#: How much a branch's children count against its own presentation: DECAY ** (number of child sequences).
DECAY = 0.9
#: Deeper elements are read as part of their ancestor, as browsers limit depth too.
DEPTH = 256
#: A host with over 1 / HOT of all pages is dealt to SALTS tasks; there are fewer than HOT such hosts.
HOT, SALTS = 1000, 64
#: Nodes whose ancestors a task remembers to have sent.
KNOWN = 200_000

# Tags and names of markup.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("textarea title xmp iframe noembed noframes".split())
_SILENT = frozenset("script style".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element of the first kind ends where one of the others begins.
_SIBLINGS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "option": {"option", "optgroup"},
    "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"},
    "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"},
}
_NEVER = frozenset(
    "script style textarea title xmp iframe noembed noframes noscript template head nav footer aside form button select "
    "option datalist dialog menu search object embed applet audio video canvas svg map".split()
)
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
_NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored sponsors promo promos "
    "promotion promoted banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription "
    "signup nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar sidebars aside widget widgets "
    "footer masthead toolbar share sharing social related recommended recommendations comment comments commentlist respond "
    "reply replies disqus discussion login search form copyright disclaimer alert alerts paywall teaser teasers".split()
)
_MAIN_NAMES = frozenset(
    "articlebody article-body article-content article-text post-body post-content entry-content story-body main-content "
    "page-content content-body".split()
)
_HEADER_NAMES = frozenset(["header"])
#: A name is not that of a part if it only says that the page has, or lacks, one.
_ABOUT = re.compile(r"^(?:has|have|no|not|with|without|is)\b[-_]?")

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>\"']++|\"[^\"]{0,9999}+\"|'[^']{0,9999}+')*+|[^>]*+)>"
    r"|<[!?/][^>]*+>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_DIGITS = re.compile(r"\d+")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@lru_cache(65_536)
def _label(tag: str, attributes: str) -> tuple[str, bool, int, bool]:
    """(tag with its names, made for noise, rank as the main text: 2 article, 1 main, a header) of an element."""
    found = {k.lower(): unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
    names = sorted({_DIGITS.sub("", n) for n in found.get("class", "").split()} - {""})
    ident = _DIGITS.sub("", found.get("id", "").strip())
    role = found.get("role", "").strip().lower()
    label = f"{tag}.{'.'.join(names)}#{ident}"
    if tag in _NEVER:
        return label, True, 0, False
    parts = {
        part.lower() for n in (*names, ident) if not _ABOUT.match(n.lower()) for part in _NAME_PARTS.findall(n)
    }
    plain = {n.lower() for n in (*names, ident)}
    if tag in ("html", "body", "main"):
        return label, False, int(tag == "main"), False
    noise = role in _NOISE_ROLES or bool((plain if tag == "article" else parts) & _NOISE_NAMES)
    article = tag == "article" or role == "article" or found.get("itemprop", "").lower() == "articlebody" or plain & _MAIN_NAMES
    rank = 0 if noise else 2 if article else int(role == "main")
    return label, noise, rank, tag == "header" or (bool(parts & _HEADER_NAMES) and tag not in _HEADINGS)


@dataclass
class Page:
    """Elements of one page in order, and its blocks of text: (element, text)."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: [""])
    node: list[int] = field(default_factory=lambda: [0])
    depth: list[int] = field(default_factory=lambda: [0])
    noise: list[bool] = field(default_factory=lambda: [False])
    main: list[int] = field(default_factory=lambda: [0])
    header: list[bool] = field(default_factory=lambda: [False])
    blocks: list[tuple[int, str]] = field(default_factory=list)

    def add(self, parent: int, tag: str, attributes: str) -> int:
        label, noise, main, header = _label(tag, attributes)
        self.parent.append(parent)
        self.tag.append(tag)
        self.node.append(xxhash.xxh64_intdigest(label, self.node[parent]))
        self.depth.append(self.depth[parent] + 1)
        self.noise.append(noise)
        self.main.append(main)
        self.header.append(header)
        return len(self.tag) - 1


def parse(html: str) -> Page:
    """Elements and blocks of a page. Inline tags and line breaks do not end a block, all other tags do.

    Missing end tags are supplied as in browsers: an unclosed paragraph, list item or cell ends where
    the next begins, everything else where an outer element ends.
    """
    page, stack = Page(), [0]
    open_tags: dict[str, int] = {}
    text: list[str] = []

    def end_block() -> None:
        if text:
            words = unescape("".join(text)).split()
            text.clear()
            if words:
                page.blocks.append((stack[-1], " ".join(words)))

    def pop() -> None:
        open_tags[page.tag[stack.pop()]] -= 1

    def past(tag: str, at: int) -> int:
        """Where the markup goes on behind an element that holds no elements."""
        close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
        end = html.find(">", close.end()) if close else -1
        return end + 1 if end >= 0 else len(html)

    at, last = 0, html.rfind(">") + 1
    while at < last:
        m = _TOKEN.search(html, at, last)
        if m is None:
            break
        if m.start() > at:
            text.append(html[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m[0].startswith("<!--") and not m[0].endswith(">"):
                at = len(html)  # a comment without an end
            continue
        tag, attributes = tag.lower(), m["attributes"] or ""
        if tag in _INLINE and not open_tags.get(tag) and (m["close"] or tag in _VOID or not _label(tag, attributes)[1]):
            if tag == "br":
                text.append("\n")
            continue
        if tag in _SILENT and not m["close"]:
            at = past(tag, at)
            continue
        end_block()
        if m["close"]:
            if open_tags.get(tag):
                while page.tag[stack[-1]] != tag:
                    pop()
                pop()
            continue
        if tag in _ENDS_P and open_tags.get("p"):
            above = next(k for k in range(len(stack) - 1, -1, -1) if page.tag[stack[k]] not in _INLINE)
            if page.tag[stack[above]] == "p":
                while len(stack) > above:
                    pop()
        while page.tag[stack[-1]] in _SIBLINGS and tag in _SIBLINGS[page.tag[stack[-1]]]:
            pop()
        if tag in _RAW:
            at = past(tag, at)
            continue
        if tag in _VOID or page.depth[stack[-1]] >= DEPTH:
            continue
        stack.append(page.add(stack[-1], tag, attributes))
        open_tags[tag] = open_tags.get(tag, 0) + 1
    rest = html[at:]
    # A tag that the end of the page cuts off is markup.
    cut = re.search(r"<[a-zA-Z/!?][^>]*\Z", rest)
    text.append(rest[: cut.start()] if cut else rest)
    end_block()
    return page


def main_text(page: Page, low: frozenset[int] = frozenset()) -> str:
    """The blocks of a page's article, joined by spaces, without noise and without the nodes ``low``.

    Read in this order until something is found: the outermost articles, the main elements, the whole page;
    each first without and, if nothing is left so, with the nodes ``low``. Where every article lies within
    noise, a form around a whole page for one, that noise is passed over.
    """
    n, parent, tag = len(page.tag), page.parent, page.tag

    def inherited(own) -> list[bool]:
        out = [False] * n
        for e in range(1, n):
            out[e] = out[parent[e]] or own(e)
        return out

    noise = inherited(lambda e: page.noise[e])

    def read(roots: set[int], noise: list[bool], low: frozenset[int]) -> str:
        holders = set(roots)
        for e in roots:
            while e > 0:
                e = parent[e]
                holders.add(e)
        inside = inherited(lambda e: e in roots) if roots else [True] * n
        dropped = inherited(
            lambda e: e not in holders and page.node[e] in low and tag[e] not in _HEADINGS and tag[e] not in ("html", "body")
        )
        header = inherited(lambda e: page.header[e] and e not in holders)
        heading = inherited(lambda e: tag[e] in _HEADINGS)
        return " ".join(
            text for e, text in page.blocks
            if inside[e] and not noise[e] and not dropped[e] and not (header[e] and not (roots and heading[e]))
        )

    for rank in (2, 1):
        roots = {e for e in range(n) if page.main[e] == rank and not noise[e]}
        passed = noise
        if not roots and any(r == rank for r in page.main):
            roots = {e for e in range(n) if page.main[e] == rank}
            within = inherited(lambda e: e in roots)
            passed = inherited(lambda e: within[e] and page.noise[e])
        if roots:
            found = read(roots, passed, low) or read(roots, passed, frozenset())
            if found:
                return found
    return read(set(), noise, low) or read(set(), noise, frozenset())


def host_of(url: Column) -> Column:
    """What lies between the first :// and the next /, ?, # or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def _feature(text: str) -> int:
    return xxhash.xxh64_intdigest(_DIGITS.sub("0", text.lower()))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _counts(page: Page, known: set[int]) -> Iterator[tuple[int, int, int, int]]:
    """(node, kind, key, times in the page): kind 0 the node itself, 1 a text, 2 a sequence of children.

    Kind 3 has the node's ancestors as keys, for nodes that are not among those ``known``.
    """
    children: list[list[int]] = [[] for _ in page.tag]
    for e in range(1, len(page.tag)):
        below = children[page.parent[e]]
        if not below or below[-1] != page.node[e]:
            below.append(page.node[e])  # equal neighbours count as one
    times: dict[tuple[int, int, int], int] = {}
    for e, below in enumerate(children):
        node = page.node[e]
        times[node, 0, 0] = 1
        if below:
            key = node, 2, xxhash.xxh64_intdigest(repr(below))
            times[key] = times.get(key, 0) + 1
        if node not in known:
            known.add(node)
            while e > 0:
                e = page.parent[e]
                times[node, 3, page.node[e]] = 1
    for e, text in page.blocks:
        key = page.node[e], 1, _feature(text)
        times[key] = times.get(key, 0) + 1
    for (node, kind, key), c in times.items():
        yield _signed(node), kind, _signed(key), c


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The merged tree of each host: a row (host, node, up, pages, ...) for each node with what its importance needs.

    Pages become counts in their tasks; counts of one text or child sequence are summed before
    those of one node, so a host with a third of all pages is no task's work alone. Pages without a host are left out.
    """
    types = [pa.string(), pa.int64(), pa.int8(), pa.int64(), pa.int64()]
    names = ["host", "node", "kind", "key", "c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, set[int]] = {}
        for batch in batches:
            for part in pieces(batch, 1):
                if sum(map(len, known.values())) > KNOWN:
                    known.clear()
                rows = [
                    (host, *row)
                    for host, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist())
                    for row in _counts(parse((html or b"").decode(errors="replace")), known.setdefault(host, set()))
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    texts = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("binary").alias("html"))
    raw = texts.where(F.col("host") != "").mapInArrow(run, "host string, node long, kind byte, key long, c long")
    log = F.col("c") * F.log("c")
    once = raw.groupBy("host", "node", "kind", "key").agg(F.sum("c").alias("c"), F.sum(log).alias("cl"))
    text, style = F.col("kind") == 1, F.col("kind") == 2
    return once.groupBy("host", "node").agg(
        F.collect_list(F.when(F.col("kind") == 3, F.col("key"))).alias("up"),
        F.sum(F.when(F.col("kind") == 0, F.col("c"))).alias("pages"),
        F.count(F.when(text, 1)).alias("texts"),
        F.coalesce(F.sum(F.when(text, F.log("c") - F.col("cl") / F.col("c"))), F.lit(0.0)).alias("text_entropy"),
        F.count(F.when(style, 1)).alias("styles"),
        F.coalesce(F.sum(F.when(style, F.col("c"))), F.lit(0)).alias("style_count"),
        F.coalesce(F.sum(F.when(style, log)), F.lit(0.0)).alias("style_log"),
    )


def importance(tree: DataFrame) -> DataFrame:
    """(host, node, pages, composite, branch): a node's own composite importance, and the largest in its branch.

    The texts of a branch are pooled instead of averaged child by child, which needs no pass over
    the levels of the tree: two groupings over (node, ancestor) rows do.
    """
    size = F.log(F.col("pages").cast("double"))
    many = F.col("pages") > 1
    content = F.col("texts") - F.when(many, F.col("text_entropy") / size).otherwise(0.0)
    shape = F.when(F.col("styles") == 0, 0.0).when(
        many, F.least((F.log("style_count") - F.col("style_log") / F.col("style_count")) / size, F.lit(1.0))
    ).otherwise(1.0)
    nodes = tree.select("host", "node", "up", "pages", "texts", "styles", content.alias("content"), shape.alias("shape"))

    def branches(rows: DataFrame) -> DataFrame:
        return rows.withColumn("top", F.explode(F.concat(F.array("node"), "up")))

    own = F.col("node") == F.col("top")
    pooled = branches(nodes).groupBy("host", "top").agg(
        F.sum("content").alias("content"), F.sum("texts").alias("texts"), F.max(F.when(own, F.col("shape"))).alias("shape"),
        F.max(F.when(own, F.col("styles"))).alias("styles"), F.max(F.when(own, F.col("pages"))).alias("pages"),
        F.first(F.when(own, F.col("up")), ignorenulls=True).alias("up"),
    )
    share = F.pow(F.lit(DECAY), F.col("styles"))
    below = F.when(F.col("texts") > 0, F.col("content") / F.col("texts")).otherwise(0.0)
    composite = F.when(F.col("styles") > 0, (1.0 - share) * F.col("shape") + share * below).otherwise(below)
    composed = pooled.select("host", F.col("top").alias("node"), "up", "pages", composite.alias("composite"))
    return branches(composed).groupBy("host", F.col("top").alias("node")).agg(
        F.max(F.when(F.col("node") == F.col("top"), F.col("pages"))).alias("pages"),
        F.max(F.when(F.col("node") == F.col("top"), F.col("composite"))).alias("composite"),
        F.max("composite").alias("branch"),
    )


def low_nodes(tree: DataFrame, min_pages: int = MIN_PAGES, threshold: float = THRESHOLD) -> DataFrame:
    """(host, low): the nodes of a host whose branch is of low importance on at least ``min_pages`` pages."""
    noise = (F.col("pages") >= min_pages) & (F.col("branch") < threshold) & (F.col("node") != 0)
    return importance(tree).where(noise).groupBy("host").agg(F.collect_list("node").alias("low"))


def extract(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_pages: int = MIN_PAGES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages; text is empty if a page has none.

    Null and empty html gives an empty text. A page whose url is null or has no host belongs to no
    site and is read by the conventions of markup alone. Repeated rows and ids give a row each, and repeated
    pages count each as a page of their site; where all pages of a site are equal, or low statistics would leave nothing
    of a page's article, they are passed over. Whole pages of any length are read. Other columns are not looked at.
    """
    tree = settle(style_tree(pages, url_col, html_col), "style-tree")
    sizes = tree.where(F.col("node") == 0)
    total = sizes.agg(F.sum("pages")).first()[0] or 0
    hot = [r.host for r in sizes.where(F.col("pages") * HOT > total).select("host").collect()]  # fewer than HOT
    lows = low_nodes(tree, min_pages, threshold)
    copies = F.when(F.col("host").isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    lows = settle(lows.withColumn("salt", F.explode(copies)), "low-nodes").withColumnRenamed("host", "_host")
    salt = F.when(F.col("_h").isin(hot), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0).cast("int")
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("binary").alias("html"),
        host_of(F.col(url_col)).alias("_h"),
    ).withColumn("_salt", salt)
    joined = rows.join(lows, (F.col("_h") == F.col("_host")) & (F.col("_salt") == F.col("salt")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 3):
                texts = []
                for low, html in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    page = parse((html or b"").decode(errors="replace"))
                    texts.append(main_text(page, frozenset(x & ((1 << 64) - 1) for x in low or ())))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    kind = pages.schema[id_col].dataType.simpleString()
    return joined.select("page_id", "url", "low", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")

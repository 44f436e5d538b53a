"""HTML extraction: conventions of markup, the site's tree, odd pages, and the importances by brute force."""

import math
from collections import Counter, defaultdict

import pytest
from cases import table

from peagelens.llm import site_tree

BODY = "<html><head><title>no</title><style>x{}</style></head><body>"


def text_of(html, low=frozenset()):
    return site_tree.main_text(site_tree.parse(html), low)


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", ""),
        ("just text", "just text"),
        ("a &amp; b&nbsp;&#8364; &lt;c&gt; &copy 2 &unknown; &am", "a & b € <c> © 2 &unknown; &am"),
        ("<p>one<b>two</b><i> three</i><br>four<p>five<li>six<li>seven", "onetwo three four five six seven"),
        ("<article><h1>T</h1><p><b>open <br><p>next</article><footer>f</footer>", "T open next"),
        ("<nav>m<article><p>kept</p></article>", "kept"),
        ("<form action=x><article><p>kept</p><div class='ad'>x</div></article><input></form>", "kept"),
        ("<header>site</header><main><p>m</p><aside>x</aside></main><p>out</p>", "m"),
        ("<main><p>intro</p><article><p>a</p></article></main>", "a"),
        ("<article><header><h2>Head</h2><span>by x</span></header><p>t</p><footer>f</footer></article>", "Head t"),
        ("<article><p>t</p><div id=comments><article class=comment>c</article></div></article>", "t"),
        ("<article><p>t <span class=ad>buy <span>now</span> x</span> u</p><section class='reader-comments'>c</section>", "t u"),
        ("<div class='cookie-notice'>c</div><div class='has-sidebar'><p>t</p></div><div class='post-related'>r</div>", "t"),
        ("<p>a<script>var t='</p><p>no';</script>b<!-- <p>no</p> -->c<style>p{}</style>d</p>", "abcd"),
        ("<p>a<!-- never ended <p>b</p>", "a"),
        ("<p>a<!-->b<!--->c", "abc"),
        ("<p title='a > b' data-x=\"<i>\">t</p>", "t"),
        ("<p>cut off <a href=", "cut off"),
        ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
        ("<script>never ended <p>x</p>", ""),
        ("<nav>only</nav><div class=ads>x</div>", ""),
        ("<svg><text>x</text></svg><button>b</button><noscript>n</noscript><p>t", "t"),
        ("</p></div></article>t", "t"),
        ("<DIV CLASS=Ad>x</DIV><P>T</P>", "T"),
    ],
)
def test_markup(html, want):
    assert text_of(html) == want
    assert text_of(BODY + html) == want


def test_deep_and_long_pages():
    assert text_of("<div>" * 100_000 + "t") == "t"
    assert text_of("<a" * 300_000) == ""
    assert text_of("<a \"" * 100_000 + ">t") == "t"
    long = "<p>word &amp; " * 300_000
    assert text_of(long) == " ".join(["word &"] * 300_000)


def site_page(k):
    unique = " ".join(f"w{chr(97 + k % 26)}{chr(97 + i)}{'x' * k}" for i in range(9))
    return (
        f"{BODY}<div class='top'>Our site, the best</div><div class='box'><ul><li>Home</li><li>About</li></ul></div>"
        f"<div class='text'><h2>Summary</h2><p>{unique}</p><p>Read {k} more</p><div class='tip'>Follow us today</div></div></body>"
    ), unique


def site(spark, n=12, url="http://Site.example/{k}"):
    rows = [(k, url.format(k=k), site_page(k)[0], "clash", "clash") for k in range(n)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string, low string")


def test_repeated_branches_go(spark):
    rows = {r.page_id: r for r in site_tree.extract(site(spark)).collect()}
    assert len(rows) == 12
    for k, r in rows.items():
        assert r.text == f"Summary {site_page(k)[1]} Read {k} more"
        assert r.n_chars == len(r.text)
    few = site_tree.extract(site(spark, site_tree.MIN_PAGES - 1)).collect()
    assert all(r.text.startswith("Our site, the best Home About Summary") for r in few)
    apart = site_tree.extract(site(spark, url="http://h{k}.example/")).collect()
    assert all(r.text.startswith("Our site") for r in apart)


def test_equal_pages_stay_whole(spark):
    html = f"{BODY}<nav>m</nav><article><p>one text</p><p>for all</p></article>"
    rows = [(1, "http://a.example/1", html)] * 9
    got = site_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r.text for r in got] == ["one text for all"] * 9


def test_odd_pages(spark):
    schema = "page_id long, url string, html string, host string"
    rows = [
        (1, None, "<p>t</p>", "x"), (None, "http://a.b/", None, "x"), (2, "no scheme", "", "x"), (2, "no scheme", "", "x"),
        (3, "http://a.b/", "<p>" + "long " * 200_000, "x"), (4, "", "\x00 <p>퟿\U0001f600 x", "x"),
    ]
    got = site_tree.extract(spark.createDataFrame(rows, schema)).collect()
    want = [(1, "t"), (None, ""), (2, ""), (2, ""), (3, " ".join(["long"] * 200_000)), (4, "\x00 ퟿\U0001f600 x")]
    assert sorted([(r.page_id, r.text) for r in got], key=repr) == sorted(want, key=repr)
    assert all(r.n_chars == len(r.text) for r in got)
    assert site_tree.extract(spark.createDataFrame([], schema)).collect() == []


def plain_importance(pages):
    """host -> node -> (pages, composite, branch), straight from the definitions."""
    hosts = defaultdict(list)
    for url, html in pages:
        hosts[url.split("://")[1].split("/")[0].lower()].append(site_tree.parse(html))
    out = {}
    for host, parsed in hosts.items():
        ups, texts, styles, seen = {}, defaultdict(lambda: defaultdict(Counter)), defaultdict(Counter), defaultdict(set)
        for k, page in enumerate(parsed):
            kids = defaultdict(list)
            for e in range(len(page.tag)):
                seen[page.node[e]].add(k)
                chain, at = [], e
                while at > 0:
                    at = page.parent[at]
                    chain.append(page.node[at])
                ups[page.node[e]] = chain
                if e and (not kids[page.parent[e]] or kids[page.parent[e]][-1] != page.node[e]):
                    kids[page.parent[e]].append(page.node[e])
            for e, below in kids.items():
                if below:
                    styles[page.node[e]][tuple(below)] += 1
            for e, text in page.blocks:
                texts[page.node[e]][site_tree._feature(text)][k] += 1
        composite = {}
        for node in ups:
            m = len(seen[node])
            content, n = 0.0, 0
            for below, chain in ups.items():
                if node == below or node in chain:
                    size = len(seen[below])
                    for counts in texts[below].values():
                        total = sum(counts.values())
                        h = -sum(c / total * math.log(c / total) for c in counts.values())
                        content += 1 - (h / math.log(size) if size > 1 else 0)
                        n += 1
            value = content / n if n else 0.0
            if styles[node]:
                total = sum(styles[node].values())
                h = -sum(c / total * math.log(c / total) for c in styles[node].values())
                shape = min(h / math.log(m), 1.0) if m > 1 else 1.0
                share = site_tree.DECAY ** len(styles[node])
                value = (1 - share) * shape + share * value
            composite[node] = value
        out[host] = {
            node: (len(seen[node]), composite[node], max(v for b, v in composite.items() if b == node or node in ups[b]))
            for node in ups
        }
    return out


def test_importance_by_definition(spark, data_dir):
    given = table(spark, data_dir, "pages").select("page_id", "url", "html")
    pages = given.union(site(spark).select("page_id", "url", "html"))
    want = plain_importance([(r.url, r.html) for r in pages.collect()])
    got = site_tree.importance(site_tree.style_tree(pages)).collect()
    assert len(got) == sum(map(len, want.values()))
    for r in got:
        m, composite, branch = want[r.host][r.node % (1 << 64)]
        assert r.pages == m
        assert math.isclose(r.composite, composite, abs_tol=1e-9)
        assert math.isclose(r.branch, branch, abs_tol=1e-9)


def test_given_pages_by_the_standard_parser(spark, data_dir):
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.blocks = 0, [""]

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"
            self.blocks[-1] += "\n" if tag == "br" else ""
            if tag not in ("b", "br"):
                self.blocks.append("")

        def handle_endtag(self, tag):
            self.inside -= tag == "article"
            if tag != "b":
                self.blocks.append("")

        def handle_data(self, data):
            if self.inside:
                self.blocks[-1] += data

    pages = table(spark, data_dir, "pages")
    got = {r.page_id: r.text for r in site_tree.extract(pages).collect()}
    for r in pages.collect():
        parser = Article()
        parser.feed(r.html)
        parser.close()
        assert got[r.page_id] == " ".join(" ".join(b.split()) for b in parser.blocks if b.split())

"""Main texts against a plain parser, on the small tables and on made-up sites."""

import math
import re
from collections import Counter, defaultdict
from html import unescape
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest
from pyspark.sql import types as T

from renewlake.llm import page_blocks, queries, site_tree

COLUMNS = T.StructType([T.StructField("page_id", T.LongType())] + [
    T.StructField(c, T.StringType()) for c in ("url", "html", "host", "path", "keys", "above", "kind")])


@pytest.fixture
def texts(spark):
    def run(rows):
        full = [(i, url, html, "h", "p", None, "a", "k") for i, url, html in rows]
        return site_tree.main_texts(spark.createDataFrame(full, COLUMNS))

    return run


class Article(HTMLParser):
    """The words inside <article>, with the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.found = 0, []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag not in page_blocks.INLINE:
            self.found.append(" ")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag not in page_blocks.INLINE:
            self.found.append(" ")

    def handle_data(self, data):
        if self.inside:
            self.found.append(data)


def test_query_against_plain_parser(spark):
    """Every page of the table: its article, as the standard library reads it."""
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    want = {}
    for p in pages:
        parser = Article()
        parser.feed(p["html"])
        parser.close()
        want[p["page_id"]] = " ".join("".join(parser.found).split())
    got = queries.op11_html_extraction(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(pages) and {r.page_id: r.url for r in got} == {p["page_id"]: p["url"] for p in pages}
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def site(i, main, extra=""):
    return f"""<html><head><title>No {i}</title></head><body><div class="x1"><div class="x2">Fresh every day since 1999
        <ul><li><a href=/a{i}>Topic {i}</a><li><a href=/b>Home</a></ul></div></div>
        <div class="c{i}"><h2>Story {i}</h2>{main}</div>{extra}<div class="x3"><p>All rights <b>reserved</b>.</p></div></body></html>"""


def test_what_a_host_shares_goes(texts):
    """No roles to go by: the branches that all pages have alike go, what differs stays."""
    rows = [(i, f"https://Shop.example.com/{i}", site(i, f"<p>Text number {i} on thing {i * i}.<p>And more {i}.")) for i in range(8)]
    rows += [(100 + i, "http://other.example.org", site(i, "<p>Alone")) for i in range(2)]  # too few pages to judge by
    got = {r.page_id: r.text for r in texts(rows).collect()}
    for i in range(8):
        assert got[i] == f"Story {i} Text number {i} on thing {i * i}. And more {i}."
    assert got[100] == "Fresh every day since 1999 Story 0 Alone All rights reserved."
    # copies of one page are one page
    copies = [(i, "http://copy.example.com/", site(1, "<p>One <i>t</i>ext.")) for i in range(9)]
    assert {r.text for r in texts(copies).collect()} == {"Fresh every day since 1999 Story 1 One text. All rights reserved."}


@pytest.mark.parametrize("html, want", [
    (None, ""), ("", ""), (" \n ", ""), ("plain &amp; simple", "plain & simple"), ("a < b and 3 <4", "a < b and 3 <4"),
    ("<p>one<p>two", "one two"), ("fo<b>o</b>b<i>ar", "foobar"), ("a<br>b<br/>c", "a b c"), ("<p>x&nbsp;\n y</p>z", "x y z"),
    ("<script>var a='<p>no</p>';</script><p>yes<style>p{}</style>", "yes"), ("<SCRIPT>x</SCRIPT ><P>up</P>", "up"),
    ("<script>never closed <p>x", ""), ("<!-- <p>no</p> --><p>yes", "yes"), ("<p>cut <a href='x", "cut"), ("<!doctype html>x", "x"),
    ("<nav>menu</nav><p>text", "text"), ("<header>top</header>text<footer>end</footer>", "text"),
    ("<aside>side</aside><form>f<input value=x><textarea>t</textarea></form><p>text", "text"),
    ("<div class='ad-slot'>buy</div><div id=cookieNotice>ok?</div><div class='has-sidebar'>text</div>", "text"),
    ("<div role=banner>b</div><div role=navigation>n</div><div role=main>text</div>", "text"),
    ("<div class=intro>before</div><article>text</article><div class=z>after</div>", "text"),
    ("<article><header><h1>T</h1></header>x<footer>y</footer><section id=comments><article>c</article></section></article>", "T x"),
    ("<article>main</article><div class='comments'><article class='comment'>c</article></div>", "main"),
    ("<aside><article>teaser</article></aside><div>text</div>", "text"), ("<nav><a href=/>m</a><article>text</article>", "text"),
    ("<form action=/><div>all</div><article>text</article></form>", "text"), ("<div hidden>h</div><p style='display:none'>n</p>t", "t"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"), ("<ul><li>one<li>two<ul><li>deep</ul><li>three</ul>", "one two deep three"),
    ("<p>x&am y&quo;z&#233;&#x41;", "x&am y&quo;zéA"), ("<article><p><b>open<p>next</article>rest", "open next"),
    ("<select><option>a<option>b</select><button>go</button>t", "t"), ("<p title='a>b' class=\"q\">t", "t"), ("<i b='\"><p>t", "t"),
    ("<ul><li><a href=1>one</a><li><a href=2>two</a></ul><p>text", "text"), ("</p></div>t</b>", "t"), ("<title>no</title>t", "t"),
])
def test_one_page(texts, html, want):
    page = page_blocks.Page(html, page_blocks.Elements())
    kept = [b for b in page.blocks if not b.dropped and not (b.linked and b.linked > 0.7 * len("".join(b.text.split())))]
    if any(b.article for b in kept):
        kept = [b for b in kept if b.article]
    assert " ".join(b.text for b in kept) == want


def test_rows(texts):
    """Nulls, pages without a host, repeated rows, a very long page, columns named like internals, an empty table."""
    long = "<article>" + "".join(f"<p>Block {i} of many" for i in range(30_000)) + "</article>"
    rows = [(1, None, "<p>a"), (None, "not a url", "<p>b"), (2, "http://u@h.example.com:80/x", None), (2, "", ""), (3, None, "<p>a"),
            (4, "http://h.example.com", long), (5, "http://h.example.com", "<nav>x</nav>")] + [(6, "http://r.example.com", "<p>r")] * 3
    got = Counter((r.page_id, r.url, r.text) for r in texts(rows).collect())
    say = {4: " ".join(f"Block {i} of many" for i in range(30_000)), 5: ""}
    assert got == Counter((i, u, say.get(i, (h or "").replace("<p>", ""))) for i, u, h in rows)
    assert texts([]).collect() == []


def test_split_hosts(texts, monkeypatch):
    """The way for side tables too large to broadcast, with one host of nearly all pages."""
    rows = [(i, "http://big.example.com", site(i, f"<p>Text {i}, {i * 7}.")) for i in range(60)]
    rows += [(100 + i, f"http://s{i % 5}.example.com", site(i, f"<p>Word {i}.")) for i in range(20)]
    want = Counter(map(tuple, texts(rows).collect()))
    monkeypatch.setattr(site_tree, "BROADCAST_LOW", -1)
    assert Counter(map(tuple, texts(rows).collect())) == want


def test_importance_against_plain_entropies(spark):
    """Numbers of the tree by the definition, page by page."""
    rows = [("a", site(i % 6, f"<p>Text {i % 4}.<p>Shared." + "<ul><li>x</ul>" * (i % 3))) for i in range(9)]
    nodes = site_tree.site_nodes(spark.createDataFrame(rows, "host string, html string"))
    got = {r.path: r for r in site_tree.element_importance(nodes).collect()}
    pages = {}
    for _, html in rows:
        page = page_blocks.Page(html, page_blocks.Elements())
        pages["|".join(f"{b.path}{b.text}" for b in page.blocks)] = page
    styles, said = defaultdict(Counter), defaultdict(Counter)
    for page in pages.values():
        for path, labels in page.children.items():
            styles[path][tuple(labels)] += 1
        for path, text in {(b.path, b.text) for b in page.blocks}:
            said[path][text] += 1
    assert set(got) == set(styles)
    for path, variants in styles.items():
        m = sum(variants.values())
        entropy = -sum(c / m * math.log(c / m) for c in variants.values()) / math.log(m) if m > 1 else 1
        assert got[path].m == m and got[path].style == pytest.approx(entropy)
        if said[path]:
            mean = sum(math.log(c) for c in said[path].values()) / len(said[path])
            assert got[path].content == pytest.approx(1 - mean / math.log(m) if m >= 3 else 1)
    assert unescape(re.sub("<.*?>", "", "<p>&lt;")) == "<"

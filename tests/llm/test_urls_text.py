import re

import pytest

from tessella.llm import page_text, urls

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header class="site"><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="main"><div class="ad">Buy now</div>
<article><h1>A &amp; B</h1><p>First   line<br>goes on, with <b>bold</b> and <a href="/x">a link</a>.<p>Second.
<ul><li>one<li>two</ul><form>Search <input> <button>Go</button></form><!-- hidden <p>no</p> --><p hidden>not shown</p>
<aside>Related: <a href="/r">r</a></aside><section class="comments"><h2>Comments</h2><p>Nice one, said a reader with many words to say about all of this.</p></section>
</article></div><footer>&copy; 2020 someone</footer></body></html>"""


def test_article_alone():
    assert page_text.main_text(PAGE) == "A & B\nFirst line goes on, with bold and a link.\nSecond.\none\ntwo"


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("   ", ""), ("<article></article>", ""), ("<article><p>a", "a"), ("<article><p>a<p>b</article><p", "a\nb"),
    ("<article><p>caf&eacute; &#x41;&#66; &lt;b&gt;</p></article>", "café AB <b>"), ("<article>bare <i>text</i> here</article>", "bare text here"),
    ("<article><p>x<script>if (a<b) {}</script>y</p></article>", None), ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
    ("<article><p><b>Open bold.<br><p>Next.</article><footer>&copy; f</footer>", "Open bold.\nNext."),
])
def test_edges_of_pages(page, text):
    found = page_text.main_text(page)
    assert found == text if text is not None else "if (a" not in found


def test_pages_without_an_article():
    prose = "Many plain words that make up the body of a page without any element that says so. " * 3
    page = f"<body><div class=menu><a href=/>Home</a> <a href=/x>More</a></div><div><p>{prose}</p><p>{prose}</p></div><div class=footer>Imprint</div></body>"
    assert page_text.main_text(page) == f"{prose.strip()}\n{prose.strip()}"


LONG = "a great many plain words that say nothing of use to anyone who reads them here today " * 4


@pytest.mark.parametrize("other", [
    f'<aside><p>{LONG}</p></aside>', f'<div class="related-posts"><p>{LONG}</p></div>', f'<section id="reader_comments"><p>{LONG}</p><p>{LONG}</p></section>', f'<div role="navigation">{LONG}</div>',
    f'<form><p>{LONG}</p><label>Name</label><input></form>', f'<div class="notice notice--info">{LONG}</div>', f"<div style='display: none'>{LONG}</div>", f'<nav>{LONG}</nav>', f"<style>{LONG}</style>",
])
def test_what_is_no_article(other):
    inside = f'<body><div id="page"><article><h1>Title</h1><p>{LONG}</p>{other}<p>End.</p></article></div></body>'
    outside = f'<body><div id="page">{other}<div>{LONG}</div><article><h1>Title</h1><p>{LONG}</p><p>End.</p></article>{other}<p>{LONG}</p></div></body>'
    assert page_text.main_text(inside) == page_text.main_text(outside) == f"Title\n{LONG.strip()}\nEnd."


def test_min_cut_is_minimal():
    import itertools
    import random

    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 7)
        source, sink = [rng.choice([0, 0, 1, 2, 5]) for _ in range(n)], [rng.choice([0, 0, 1, 3, 4]) for _ in range(n)]
        arcs = [(a, b, rng.choice([0.5, 1, 2])) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.6]
        cost = lambda side: sum(t if s else f for s, f, t in zip(side, source, sink)) + sum(c for a, b, c in arcs if side[a] != side[b])  # noqa: E731, B023
        found = page_text.min_cut([float(x) for x in source], [float(x) for x in sink], arcs)
        assert cost(found) == min(cost(s) for s in itertools.product([False, True], repeat=n))


@pytest.mark.parametrize("inside", [
    f'<p title="the hidden cave">{LONG}</p>', f'<p class="meta-analysis">{LONG}</p>', f'<section id="search-algorithms"><p>{LONG}</p></section>', f'<p data-x="display:none">{LONG}</p>', "<p>Yes.</p>",
    f'<header><h2>Of it</h2></header><p>{LONG}</p>', '<p><a href="/x">Only a link here</a></p>', f'<div class="content"><p>{LONG}</p></div>', f'<p class="legal tags">{LONG}</p>',
])
def test_what_stays_in_an_article(inside):
    found = page_text.main_text(f"<body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{LONG}</p>{inside}<p>{LONG}</p></article><footer>End</footer></body>")
    body = re.sub(r"<[^>]*>", "\n", inside)
    assert found.split("\n") == ["Title", LONG.strip(), *(x.strip() for x in body.split("\n") if x.strip()), LONG.strip()]


def test_the_cut_decides():
    import duckdb

    flows, unlike, pages = [0], 0, [h for (h,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()]
    max_flow = page_text._max_flow

    def counted(*args):
        flows[0] += 1
        return max_flow(*args)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(page_text, "_max_flow", counted)
        for page in pages:
            blocks, nodes = page_text.blocks_of(page)
            source, sink, arcs = page_text.graph(blocks, nodes)
            labels = page_text.min_cut(source, sink, arcs)
            unlike += sum(label != (s > t) for label, s, t, _ in zip(labels, source, sink, blocks))
    assert flows[0] == len(pages) and unlike > 0
    # A list of links is boilerplate, a link between paragraphs is not, though their own costs are alike.
    links, link = "<ul>" + "<li><a href=/x>More of it</a>" * 9 + "</ul>", "<p><a href=/x>More of it</a></p>"
    assert page_text.main_text(f"<p>{LONG}</p>{links}<p>{LONG}</p>").count("More") == 0 and page_text.main_text(f"<p>{LONG}</p>{link}<p>{LONG}</p>").count("More") == 1


PARTS = ["<p>one two</p>", f"<p>{LONG}</p>", "<nav><a href=/>Home</a>", "</nav>", "<aside>", "</aside>", "<article>", "</article>", '<div class="tags">a, b</div>', "<h2>Head</h2>", "<div><p>x</p>", "</div>", "<a href=/>link</a><br>"]


def test_cuts_of_whole_pages():
    import itertools
    import random

    rng, tried = random.Random(5), 0
    while tried < 40:
        page = "".join(rng.choice(PARTS) for _ in range(9))
        blocks, nodes = page_text.blocks_of(page)
        n = len(blocks) + len(nodes)
        if not 2 <= n <= 11:
            continue
        tried += 1
        source, sink, arcs = page_text.graph(blocks, nodes)
        cost = lambda side: sum(t if s else f for s, f, t in zip(side, source, sink)) + sum(c for a, b, c in arcs if side[a] != side[b])  # noqa: E731, B023
        best = min(cost(s) for s in itertools.product([False, True], repeat=n))
        labels = page_text.min_cut(source, sink, arcs)
        assert abs(cost(labels) - best) < 1e-6
        assert page_text.main_text(page) == "\n".join(b.text for b, label in zip(blocks, labels) if label)


@pytest.mark.parametrize("piece", ["<div>x ", '<a "', '<a ">"', "<b><div>", "<div><li></li>", "<p>word</p>", "<article><p>word</p><aside>x</aside>", "<![CDATA[", "<!-", "<i></b>", "<p><div>", "<!--", "<script>", "<td><p>"])
def test_long_pages_take_time_in_proportion(piece):
    import time

    def seconds(size):
        page, began = piece * (size // len(piece)), time.process_time()
        page_text.main_text(page)
        return time.process_time() - began

    seconds(10_000)
    assert seconds(400_000) < 10 * max(seconds(80_000), 0.1)


def test_many_blocks():
    page = "<article>" + "".join(f"<p>paragraph {k} of a very long page</p>" for k in range(3000)) + "</article>"
    assert page_text.main_text(page).count("\n") == 2999


def test_extraction_of_a_table(spark):
    rows = spark.createDataFrame([(1, "u", PAGE, 7), (2, None, None, 8), (1, "u", PAGE, 7)], "page_id long, url string, html string, n_chars long")
    found = page_text.extract(rows).collect()
    assert sorted((r["page_id"], r["n_chars"]) for r in found) == sorted([(1, len(page_text.main_text(PAGE)))] * 2 + [(2, 0)])
    assert page_text.extract(rows.limit(0)).count() == 0


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
URLS = [
    (1, "http://Example.org/es/1?q#f", "example.org/es/", "block"), (2, "https://a.example.org/en/12", "example.org/en/1", "block"), (3, "https://xexample.org/es/", "org/", "allow"),
    (4, "https://a.com/de", None, "allow"), (5, "https://a.com/de/x", "com/de/", "block"), (6, None, None, "allow"), (7, "no url", None, "allow"), (8, "", None, "allow"),
    (9, "x://org", None, "allow"), (10, "x://org/", "org/", "allow"), (11, "a://b.net/?u=://example.org/es/", None, "allow"), (12, "https://example.org?x=/es/", None, "allow"),
]


@pytest.mark.parametrize("joined", [False, True])
def test_longest_rule(spark, joined):
    rows = spark.createDataFrame([(k, u) for k, u, _, _ in URLS] + [(1, URLS[0][1])], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string") if joined else RULES
    found = [(r["page_id"], r["rule"], r["verdict"]) for r in urls.judge(rows, rules).collect()]
    assert sorted(found, key=str) == sorted([(k, r, v) for k, _, r, v in [*URLS, URLS[0]]], key=str)
    assert urls.judge(rows.limit(0), rules).count() == 0


def test_aliases(spark):
    rows = spark.createDataFrame([
        (1, "http://a.net/1", '<LINK href="http://b.com/de/9" rel="canonical">'), (2, "http://a.net/2#top", None), (3, "http://c.net/x/y", '<meta http-equiv="refresh" content="0; url=/z">'),
        (4, "http://c.net/z", '<link rel=canonical href=http://d.org/ok>'), (5, "http://c.net/z", '<link rel="canonical" href="http://b.com/de/9">'), (6, "http://e.net/", "<link rel=stylesheet href=http://b.com/de/9>"),
        (7, "http://b.com/de/9", ""), (8, "http://a.net/1#again", "<p>canonical</p>"),
    ], "page_id long, url string, html string")
    found = {r["page_id"]: r["verdict"] for r in urls.judge(rows.where("page_id not in (3, 4, 5)"), RULES, edges=urls.page_links(rows.where("page_id not in (3, 4, 5)"))).collect()}
    assert found == {1: "block", 2: "allow", 6: "allow", 7: "block", 8: "block"}
    # One allowed member is enough for those without a rule of their own; rules of their own stay.
    found = {r["page_id"]: r["verdict"] for r in urls.judge(rows, RULES, edges=urls.page_links(rows)).collect()}
    assert found == {1: "allow", 2: "allow", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "block", 8: "allow"}


def test_links_that_are_none():
    page = """<head><!-- <link rel="canonical" href="http://a.net/1"> --><script>var x = '<link rel=canonical href="http://a.net/2">';</script>
    <style><link rel=canonical href=http://a.net/3></style><noscript><link rel=canonical href=http://a.net/4></noscript><link rel="stylesheet canonical" title="a > b" HREF='/5?x&amp;y'>
    <meta http-equiv=Refresh content="3;URL='http://a.net/6'"><meta http-equiv="refresh" content="3"><title><link rel=canonical href=http://a.net/7></title><link rel=canonical><textarea><link rel=canonical href=/8>"""
    assert urls.targets_of(page) == ["/5?x&y", "http://a.net/6"]


def plain_key(url):
    scheme, found, rest = url.partition("://")
    if not found:
        return None
    rest = rest.split("#")[0]
    cut = min([k for k in (rest.find("/"), rest.find("?")) if k >= 0], default=len(rest))
    return f"{scheme.lower()}://{rest[:cut].lower()}{rest[cut:]}"


def plain_rule(url):
    host = re.match(r"(?s).*?://([^/?#]*)", url)
    path = re.match(r"(?s).*?://[^/?#]*([^?#]*)", url)
    host, path = (host[1].lower(), path[1]) if host else ("", "")
    fits = [(len(h + p), v, h + p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, default=None)


def test_aliases_of_whole_tables(spark):
    """Canonical and refresh chains on every page of a table, and all verdicts by plain means."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(9)
    found = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()
    addresses = [r["url"] for r in found if r["url"]]
    pages, pairs = [], []
    for k, r in enumerate(found):
        page = r["html"] or ""
        # Chains of three to thirty pages, some to urls of no page; every fifth link stands in a comment.
        target = None if k % 30 == 0 or not r["url"] else rng.choice([addresses[k - 1], f"http://none{k % 7}.net/x", addresses[k - 1] + "#part"])
        if target:
            tag = f'<link rel="canonical" href="{target.replace("&", "&amp;")}">' if k % 2 else f'<meta http-equiv="refresh" content="0; url={target.replace("&", "&amp;")}">'
            page = page.replace("</head>", (f"<!-- {tag} -->" if k % 5 == 0 else tag) + "</head>", 1)
            if k % 5 and "</head>" in page:
                pairs.append((plain_key(r["url"]), plain_key(target)))
        pages.append((r["page_id"], r["url"], page))
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    said = {}
    for key in list(root):
        if own := plain_rule(key):
            said.setdefault(find(key), set()).add(own[1])
    expected, through = {}, 0
    for page_id, url, _ in pages:
        own = plain_rule(url or "")
        verdicts = said.get(find(plain_key(url))) if url and plain_key(url) in root else None
        expected[page_id] = own[1] if own else "allow" if not verdicts or "allow" in verdicts else "block"
        through += own is None and verdicts == {"block"}
    rows = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(rows, RULES, edges=urls.page_links(rows)).collect()}
    assert got == expected and len(pairs) > 100 and through > 0
    # The registered query on such a table.
    from tessella.llm import queries

    assert rows.where(F.lower("html").contains("canonical")).count() > 50 and queries.URL_RULES == RULES

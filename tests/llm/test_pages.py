import math
import random
import time
from html.parser import HTMLParser

import pytest

from textquarry.llm.html_density import MATH, Node, _count, extract_main_text, main_text, parse
from textquarry.llm.link_trust import TrustOptions, judge_urls
from textquarry.llm.queries import QUERIES


class Article(HTMLParser):
    """Text of the article element, inline tags glued, other tags as a space."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.parts = False, []

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if self.inside and tag != "b":
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if self.inside and tag != "b":
            self.parts.append(" ")
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.parts.append(data)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_gives_the_articles(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: r for r in QUERIES["op2_main_text"](spark, sf).collect()}
    assert len(got) == len(pages)
    for p in pages:
        parser = Article()
        parser.feed(p.html)
        parser.close()
        want = " ".join("".join(parser.parts).split())
        assert (got[p.page_id].url, got[p.page_id].text, got[p.page_id].n_chars) == (p.url, want, len(want))


PROSE = "Some long sentence of the article, with commas and enough characters to count as dense text. "


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("<html><body></body></html>", ""), ("just text", "just text"), ("&lt;b&gt; &amp; &eacute;&#33;", "<b> & é!"),
    (f"<div id=menu><a href=/a>Home</a></div><div class='content'><h2>Title</h2><p>{PROSE}</p><p>Two <i>in</i>line</p></div>"
     "<div class=sidebar><p>Other things that are long as well but no article at all</p></div>", f"Title {PROSE}Two inline"),
    (f"<nav><nav>x</nav>three</nav><p>{PROSE}<p>more<br>lines<footer>foot", f"{PROSE}more lines"),
    (f"<article><p title='a > b'>hel<b>lo</b></p><script>var t='</p>';</script><p>{PROSE}</p><div class='comments'><p>{PROSE}</p></div></article>", f"hello {PROSE}".strip()),
    (f"<header><h1>Site</h1></header><main><header><h1>Head</h1></header><p>{PROSE}</p><form>mail <input></form></main>", f"Head {PROSE}".strip()),
    (f"<div><div class='ad'>buy</div><div><p>{PROSE}</p><p>{PROSE}</p><ul><li>one<li>two</ul></div><div><a href=1>{PROSE}</a><a href=2>{PROSE}</a></div></div>",
     f"{PROSE}{PROSE}one two"),
    ("<article></article><footer>only a footer here</footer>", ""),
    ("<p>a<!-- b --><style>p{}</style> <![CDATA[x]]>c</p>", "a c"),
])
def test_layouts(page, want):
    assert main_text(page) == want.strip()


@pytest.mark.parametrize("page, want", [
    (f"<div style='overflow:hidden' title=\"the hidden gem\"><p>{PROSE}</p></div>", PROSE),
    (f"<div data-id='menu' data-class=ad title='class=ad'><p>{PROSE}</p></div>", PROSE),
    (f"<div class='page has-sidebar no-comments'><section id=related-work><p>{PROSE}</p></section></div>", PROSE),
    (f"<ul><li class=ad>buy<li>{PROSE}<li>{PROSE}</ul><p>{PROSE}</p>", PROSE * 3),
    (f"<div><div><p class=notice>mind</div><p>{PROSE}</p><p>{PROSE}</p></div>", PROSE * 2),
    (f"<div><p class=notice>mind<p>{PROSE}<p>{PROSE}</div>", PROSE * 2),
    (f"<div><p>{PROSE}</p><figure><img src=x><figcaption>A caption</figcaption></figure><p>{PROSE}</p></div>", f"{PROSE}A caption {PROSE}"),
    (f"<div class='wide AD'><div class=x>buy</div><p>no</div><p>{PROSE}</p><div hidden>no</div>", PROSE),
])
def test_only_boilerplate_is_dropped(page, want):
    assert main_text(page) == want.strip()


@pytest.mark.parametrize("page, want", [
    (f"<div class=top><article><p>Short teaser here.</p></article></div><div class=text><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p></div>", PROSE * 3),
    (f"<div><article><p>{PROSE * 2}</p><p>{PROSE}</p></article><article><p>{PROSE}</p></article></div>", PROSE * 4),
    (f"<article><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p></article><article><p>{PROSE}</p><p>{PROSE}</p></article>", PROSE * 6),
    (f"<div><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></div><div><p>{PROSE}</p><p>{PROSE}</p></div>", PROSE * 2),
])
def test_article_tags_do_not_decide(page, want):
    assert main_text(page) == want.strip()


NAMES = "cookie-banner comment-list ad-slot site-nav related-posts comments-area advert-box newsletter-signup social-share adSlot".split()


@pytest.mark.parametrize("name", [*NAMES, "comment_list", "div-comment-12"])
@pytest.mark.parametrize("kind", ["class", "id"])
def test_compound_names_of_boilerplate_are_dropped(name, kind):
    block = f"<div {kind}='{name}'><p>{PROSE * 5}</p><p>{PROSE * 5}</p></div>"
    assert main_text(f"<article><h1>Title</h1><p>{PROSE}</p>{block}<p>{PROSE}</p></article>") == f"Title {PROSE}{PROSE}".strip()
    assert main_text(f"<div><div><p>{PROSE}</p><p>{PROSE}</p></div>{block}</div>") == f"{PROSE}{PROSE}".strip()


@pytest.mark.parametrize("page, want", [
    (f"<div class=content-sidebar-wrap><div class=text><p>{PROSE}</p></div></div>", PROSE),
    (f"<h1>Title</h1><div class=content-sidebar-wrap><div class=text><p>{PROSE}</p></div></div>", f"Title {PROSE}"),
    (f"<div class=content-sidebar-wrap><main><p>{PROSE}</p></main><div class=comment-list><p>{PROSE}</p></div></div>", PROSE),
    (f"<div class=ad-free><div class=comments-open><h2 id=share-prices>Prices</h2><p>{PROSE}</p></div></div>", f"Prices {PROSE}"),
    (f"<div><p>{PROSE}</p><p>{PROSE}</p><div class=related-work><p>{PROSE}</p></div><div class=related-reading-tips><a href=1>{PROSE}</a></div></div>", PROSE * 3),
    (f"<article><p>Short one.</p></article><div class=comment-list><p>{PROSE}</p></div>", "Short one."),
])
def test_compound_names_alone_do_not_decide(page, want):
    assert main_text(page) == want.strip()


@pytest.mark.parametrize("page, want", [
    (f"<body><h1>Headline</h1><p class=lead>In short.</p><div><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p></div></body>", f"Headline In short. {PROSE * 3}"),
    (f"<body><div class=title><h1>Headline</h1></div><div class=byline>By A</div><div><p>{PROSE}</p><p>{PROSE}</p></div></body>", f"Headline By A {PROSE * 2}"),
    (f"<body><p class=lead>In short.</p><div><p>{PROSE}</p><p>{PROSE}</p></div></body>", f"In short. {PROSE * 2}"),
    (f"<body><div><a href=1>Home</a></div><h1>Headline</h1><ul><li><a href=2>x</a></ul><div><p>{PROSE}</p><p>{PROSE}</p></div></body>", f"Headline {PROSE * 2}"),
    (f"<article><h1>Headline</h1><div><p>{PROSE}</p><p>{PROSE}</p></div></article>", f"Headline {PROSE * 2}"),
])
def test_headline_and_lead_belong_to_the_article(page, want):
    assert main_text(page) == want.strip()


def test_formulas_are_text():
    formula = "<math><mi>x</mi><mo>=</mo><msup><mi>y</mi><mn>2</mn></msup><mi/><annotation encoding=tex>x=y^2</annotation></math>"
    assert main_text(f"<div><p>{PROSE}with {formula} in it</p><p>{PROSE}</p></div>") == f"{PROSE}with x=y2 in it {PROSE}".strip()


N = 100_000


@pytest.mark.parametrize("page, want", [
    ("<div><p>" + PROSE + "</x>" * N, PROSE),
    ("<div>" * 1000 + PROSE + "</x>" * N, PROSE),
    (f"<div>{PROSE}" + "<div>" * N + "<header>x</header>" * N, PROSE),
    (f"<p>{PROSE}</p>" + '<a "' * N, None),
    (f"<p>{PROSE}</p>" + '<a x="' * (N + 1), None),
    (f"<p>{PROSE}</p>" + "<a x=\"'>" * (N + 1), None),
    (f"<p>{PROSE}</p>" + "<b c='>" * (N + 1), None),
    (f"<p>{PROSE}</p><nav>" + "<i>" * N + "</u>" * N, PROSE),
    (f"<p>{PROSE}</p><nav>" + "<i>" * N + "</i>" * N, PROSE),
    ("<div class=ad-x>" * N + PROSE, PROSE),
    ("<div>" + f"<article><a href=1>{PROSE}</a></article>" * (N // 10) + "</div>", None),
    ("<script></script" * N, None),
], ids=range(12))
def test_odd_pages_take_linear_time(page, want):
    start = time.process_time()
    got = main_text(page)
    assert time.process_time() - start < 5
    assert want is None or got == want.strip()


def test_an_open_quote_hides_no_text():
    assert main_text(f"<p title=don't>{PROSE}it isn't</p>") == f"{PROSE}it isn't"
    assert main_text(f'<p title="x>{PROSE}</p><p>{PROSE}</p>') == f"{PROSE}{PROSE}".strip()


def plain_density(node, ratio):
    """Characters, link characters, tags, link tags, density and sum of a node, by the formula, from the leaves up."""
    c = lc = t = lt = own = 0
    total = 0.0
    for part in node.parts:
        if isinstance(part, Node):
            below = plain_density(part, ratio)
            c, lc, total = c + below[0], lc + below[1], total + below[4]
            if part.tag not in MATH and part.tag != "br":
                t, lt = t + below[2] + 1, lt + below[3] + (part.tag == "a")
        else:
            own += len(part.strip())
    c += own
    if node.tag == "a":
        lc = c

    def density(c, lc, t, lt):
        if c == 0:
            return 0.0
        one = lambda x: x or 1
        base = math.log(c / one(c - lc) * lc + ratio * c + math.e)
        arg = math.log(max(1.0, c / one(lc) * one(t) / one(lt)))
        return c / one(t) * (arg if base <= 1 + 1e-12 else arg / math.log(base))

    return c, lc, t, lt, density(c, lc, t, lt), total + density(own, own if node.tag == "a" else 0, 0, 0)


def test_densities_and_sums_are_those_of_the_formula():
    rng = random.Random(11)

    def markup(depth):
        tag = rng.choice(["div", "section", "a", "b", "span", "ul", "h2", "mi"])
        return f"<{tag}>{inner(depth)}</{tag}>"

    def inner(depth):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            parts.append("word " * rng.randrange(12))
            if depth:
                parts.append(markup(depth - 1))
        return "".join(parts)

    for _ in range(200):
        root = parse(inner(4))
        nodes = _count(root)
        ratio = root.link_chars / max(root.chars, 1)
        for node in nodes:
            c, lc, t, lt, density, total = plain_density(node, ratio)
            assert (node.chars, node.link_chars, node.tags, node.link_tags) == (c, lc, t, lt)
            assert node.density == pytest.approx(density) and node.total == pytest.approx(total)


def test_broken_markup_never_fails():
    rng = random.Random(3)
    bits = ["<p>", "</p>", "<div class='x'>", "</div>", "<a href=\"", "\">", "<!--", "-->", "<", ">", "text ", "<script>", "</script>", "<b", "&amp;", "&#x;", "</article>", "<article>", "'", "<nav>", "</nav>"]
    for _ in range(3000):
        assert isinstance(main_text("".join(rng.choice(bits) for _ in range(rng.randrange(30)))), str)
    deep = "<div>" * 20_000 + PROSE + "</div>" * 20_000
    assert main_text(deep) == PROSE.strip()
    assert len(main_text(f"<article>{PROSE * 50_000}</article>")) == len(PROSE) * 50_000 - 1


def test_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u", ""), (1, None, None), (2, "v", "<p>x")], "page_id long, url string, html string")
    pages = pages.selectExpr("*", "1 as html_", "2 as text", "3 as n_chars", "4 as host", "5 as rule", "6 as n")
    got = sorted(((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in extract_main_text(pages).collect()))
    assert got == [(0, "u", "", 0), (1, "", "", 0), (1, "", "", 0), (2, "v", "x", 1)]
    assert extract_main_text(pages.limit(0)).collect() == []
    assert {(r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages).collect()} == {("", "", None, "allow")}
    assert judge_urls(pages.limit(0)).collect() == []


@pytest.mark.parametrize("url, host, path, rule, verdict", [
    ("http://WWW.Example.NET/en/1?x#y", "www.example.net", "/en/1", "example.net/en/", "allow"),
    ("https://a.net", "a.net", "", None, "allow"),
    ("https://a.net/", "a.net", "/", "net/", "block"),
    ("x://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
    ("x://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
    ("x://b.org/fr/a://b", "b.org", "/fr/a://b", "org/fr/", "allow"),
    ("b.org/fr/", "", "", None, "allow"),
    ("://q?p", "q", "", None, "allow"),
    ("http:// \n.net/a\nb", " \n.net", "/a\nb", "net/", "block"),
])
def test_rules(spark, url, host, path, rule, verdict):
    (row,) = judge_urls(spark.createDataFrame([(1, url, "")], "page_id long, url string, html string")).collect()
    assert (row.host, row.path, row.rule, row.verdict) == (host, path, rule, verdict)


def plain_scores(pages, rules, options):
    """Trust and distrust of every host by plain rounds over dictionaries."""
    says, edges = {}, {}
    for _, url, links in pages:
        host, path = url.split("://")[1].split("/", 1)
        fits = [(len(r), v) for r, v in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and ("/" + path).startswith("/" + r.split("/", 1)[1])]
        says.setdefault(host, []).append(max(fits)[1] if fits else None)
        for to in links:
            if to != host:
                edges[host, to] = edges.get((host, to), 0) + 1
    out = {}
    for kind, verdict in enumerate(("allow", "block")):
        seed = {h: s.count(verdict) / len(s) for h, s in says.items()}
        way = edges if not kind else {(b, a): n for (a, b), n in edges.items()}
        every = {}
        for (a, _), n in way.items():
            every[a] = every.get(a, 0) + n
        score = dict(seed)
        for _ in range(200):
            new = dict(seed)
            for (a, b), n in way.items():
                new[b] = new.get(b, 0) + options.damping * score.get(a, 0) * n / every[a]
            score = new
        most = {h: 1.0 for h, x in seed.items() if x > 0}
        for (a, b), n in way.items():
            most[b] = most.get(b, 0) + options.damping * n / every[a]
        for h, x in score.items():
            if x:
                out.setdefault(h, [0, 0])[kind] = x / most[h]
    return says, out


def test_hosts_are_judged_by_their_links(spark):
    rng = random.Random(5)
    hosts = [f"h{i}.example" for i in range(30)] + ["bad.evil", "worse.evil", "good.fine", "fine.fine"]
    rules = (("evil/", "block"), ("fine/", "allow"), ("h1.example/x", "block"))
    pages = []
    for i in range(400):
        host = rng.choice(hosts)
        near = hosts[30:32] if host < "h2" else hosts
        pages.append((i, f"http://{host}/{rng.choice('xyz')}", [rng.choice(near) for _ in range(rng.randrange(4))]))
    link = lambda to: rng.choice([f'<a href="http://{to}/a">', f"<A HREF='//{to}?q'>", f"<a class=b href=https://{to}>"])
    df = spark.createDataFrame([(i, u, " ".join(map(link, ls))) for i, u, ls in pages], "page_id long, url string, html string").repartition(3)
    options = TrustOptions(threshold=0.3)
    says, scores = plain_scores(pages, rules, options)
    got = {r.page_id: r for r in judge_urls(df, rules, options).collect()}
    hit = set()
    for i, url, _ in pages:
        host = url.split("://")[1].split("/")[0]
        if got[i].rule is None:
            trust, distrust = scores.get(host, (0, 0))
            want = "block" if distrust >= 0.3 and distrust > trust else "allow"
            assert got[i].verdict == want
            hit.add(want)
    assert hit == {"allow", "block"}


def judged(spark, rows, rules=(("bad.evil/", "block"), ("good.fine/", "allow")), options=TrustOptions()):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    return {r.host: r.verdict for r in judge_urls(df, rules, options).collect()}


def test_verdicts_do_not_depend_on_how_many_link_to_a_blocked_host(spark):
    link = "<a href=http://bad.evil/1>x</a>"
    for m in (1, 2, 50):
        rows = [("http://bad.evil/1", "")] + [(f"http://l{i}.example/", link) for i in range(m)]
        rows.append(("http://clean.example/", link + "<a href=http://good.fine/>y</a>" * 60))
        got = judged(spark, rows + [("http://good.fine/1", "")])
        assert {v for h, v in got.items() if h.startswith("l")} == {"block"} and got["clean.example"] == "allow" and got["good.fine"] == "allow"


def test_rounds_go_on_until_a_cycle_is_settled(spark):
    from textquarry.llm.link_trust import propagate

    seeds = spark.createDataFrame([("a", 0, 1.0)], "host string, kind int, seed double")
    edges = spark.createDataFrame([("a", "b", 3), ("b", "a", 1)], "src string, dst string, n long")
    got = {(r.host, r.kind): r.score for r in propagate(seeds, edges, TrustOptions(tolerance=1e-3)).collect()}
    exact = 1 / (1 - 0.85**2)
    assert got["a", 0] == pytest.approx(exact, rel=1e-2) and got["b", 0] == pytest.approx(0.85 * exact, rel=1e-2)
    with pytest.raises(ValueError):
        TrustOptions(damping=1.0)


def test_only_links_of_the_page_count(spark):
    bad = "//bad.evil/1"
    none = [f"<!-- <a href={bad}> -->", f"<script>'<a href={bad}>'</script>", f"<style><a href={bad}></style>", f"<link href={bad}>", f"<a data-href={bad}>", f"<!-- <a href={bad}>"]
    some = [f"<a class='x'href='{bad}'>", f"<AREA HREF = \"{bad}\">", f"<!-- x --><a\n href={bad}>", f"<script></script><a href={bad}>"]
    rows = [("http://bad.evil/1", "")] + [(f"http://n{i}.x/", h) for i, h in enumerate(none)] + [(f"http://s{i}.x/", h) for i, h in enumerate(some)]
    got = judged(spark, rows)
    assert {h for h, v in got.items() if v == "block"} == {"bad.evil", *(f"s{i}.x" for i in range(len(some)))}

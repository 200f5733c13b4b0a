"""Pages: their text and their urls."""

from collections import Counter
from urllib.parse import quote

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keyspan.llm.html_text import LABELLED, extract_text, fit_tree, hand_labelled, parsed, train_tree
from keyspan.llm.queries import URL_RULES
from keyspan.llm.url_rules import judge_urls, open_intervals

MODEL = fit_tree([])


def test_written_pages_are_labelled_in_full():
    for (elements, labels), html in zip(hand_labelled(), LABELLED, strict=True):
        assert len(elements) == len(labels) and sum(labels) == html.count(" x>") + html.count(" x ")


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Menu</a></li></ul></nav>
<main><article><h1>A &amp; B</h1><p>First,  with <b>bold</b>
 words &lt;here&gt;.<p>Second &eacute;.<script>var x = "</p>";</script>
<aside><p>Side words, quite a few of them. And more, too.</p></aside><div class="advert">Buy!</div><!-- <p>no</p> -->
<ul><li>one<li>two</ul><form><p>Your name, please.</p></form><div id='comments'><p>I do not think so, sir. Not at all.</p></div>
<p>Be.</p></article></main><div class="cookie-notice"><p>We use cookies, as all do.</p></div><footer>Imprint</footer></body></html>"""


def test_main_text():
    assert MODEL.text(PAGE) == "A & B\n\nFirst, with bold words <here>.\n\nSecond é.\n\none\n\ntwo\n\nBe."


@pytest.mark.parametrize("html", ["", None, "<", "<p", "</p></div>", "<!--", "<script>x", "plain", "<p>" * 3000, "<div " + "a" * 9999, "&#0;&bogus;&#xD800;"])
def test_broken_pages_do_not_fail(html):
    assert isinstance(MODEL.text(html), str)


ARTICLE = (
    "<body><nav><a href=/>Menu</a></nav><article><h1>Title</h1>{}<p>It's the second paragraph, with words. Yes.</p>"
    "<p>Third one, which doesn't end soon, as it's long.</p></article><footer>Foot</footer></body>"
)
REST = "It's the second paragraph, with words. Yes.\n\nThird one, which doesn't end soon, as it's long."
FIRST = "First paragraph, with some words. More of them."


@pytest.mark.parametrize(
    "block, text",
    [(block.format(FIRST), FIRST) for block in (
        "<p title=don't>{}</p>",
        "<p title=\"x>{}</p>",
        "<p title='5 > 4'>{}</p>",
        "<p data-x=a'b\"c>{}</p>",
        "<noscript><p>{}</p>",
        "<svg><p>{}</p>",
        "<object><p>{}</p></object>",
        "<div class='comment-free'><p>{}</p></div>",
        "<p class='search'>{}</p>",
        "<p class='related side'>{}</p>",
        "<p data-class='comments'>{}</p>",
        "<p class=intro><span id=ad-1></span>{}</p>",
        "<p>{}</i></b></section></p>",
    )]
    + [
        ("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be, with some words. More.</p>", "Let x=2 be, with some words. More."),
        ("<p>Text <svg><title>icon</title></svg>goes on, as it should. Yes.</p>", "Text goes on, as it should. Yes."),
        ("<noscript><p>Please turn scripts on, as this page needs them.</p></noscript>", None),
        ("<div class='comments'><p>Reader's paragraph, with some words. More.</p></div>", None),
        ("<div class='cookie-notice'>We use cookies, as others do. Fine?</div>", None),
        ("<div class=sidebar-left><p>Side words, with commas, and more. Yes.</p></div>", None),
        ("<form><p>Your name, please.</p></form>", None),
    ],
)
def test_hard_blocks_of_an_article(block, text):
    assert MODEL.text(ARTICLE.format(block)) == "\n\n".join(part for part in ("Title", text, REST) if part)


@pytest.mark.parametrize(
    "part", ["<b>{}</i>", "<div>{}</i>", "<li><ul><b>{}<li></li>", "<div><b>{}<section></section>", "{}<svg>", "{}<noscript>", "{}<p title='", "{}<a b=\"c", "<b>{}<p></p>"]
)
def test_time_grows_with_the_page(part):
    import time

    def seconds(n):
        head, tail = part.split("{}")
        html = "<article>" + head * n + tail * n + "word"
        began = time.process_time()
        MODEL.text(html)
        return time.process_time() - began

    assert seconds(20_000) < 0.25 + 12 * seconds(5_000)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class=ad>", "</div>", "<article>", "</article>", "<b>", "</b>", "<li>", "<ul>", "</ul>", "<table>", "<td>", "words, and more.", "&amp;", "<br>", "<head>", "<body>"]), max_size=40))
def test_any_nesting(parts):
    page = parsed("".join(parts))
    assert all(e.parent < k for k, e in enumerate(page.elements))
    assert all(0 <= p <= 1 for p in MODEL.marginals(page.elements))


def test_marginals_against_all_labellings():
    """Sum-product over a small tree, against the sum over all assignments."""
    from itertools import product
    from math import exp

    from keyspan.llm.html_text import _looks

    elements = parsed("<body><article><h1>Title here</h1><p>Some words, and a stop.</p><div class=ad>x</div></article><p>y</p></body>").elements
    own = [sum(MODEL.own.get(look, 0.0) for look in _looks(e)) for e in elements]
    own[0] += MODEL.root
    total, content = 0.0, [0.0] * len(elements)
    for labels in product((0, 1), repeat=len(elements)):
        weight = exp(sum(o for o, y in zip(own, labels, strict=True) if y))
        for e, y in zip(elements[1:], labels[1:], strict=True):
            weight *= exp(MODEL.tie[elements[e.parent].zone][labels[e.parent]][y])
        total += weight
        content = [c + weight * y for c, y in zip(content, labels, strict=True)]
    assert MODEL.marginals(elements) == pytest.approx([c / total for c in content], rel=1e-6, abs=1e-9)


def test_extraction(spark):
    rows = [(1, "u", PAGE), (1, None, PAGE), (2, "v", None), (3, "w", ""), (None, "x", "<article><p>Only this, here.</p></article>")]
    pages = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "page_id long, url string, html string, text int")
    found = Counter(map(tuple, extract_text(pages, train_tree(pages)).collect()))
    assert found == Counter((i, u, t := MODEL.text(h), len(t)) for i, u, h in rows)
    empty = pages.limit(0)
    assert extract_text(empty, train_tree(empty)).collect() == []


def brute_verdict(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
        path = rest[end:]
        path = path[: next((k for k, c in enumerate(path) if c in "?#"), len(path))]
    fitting = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fitting, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
    return (host, path, best[0] + best[1] if best else None, best[2] if best else default)


URLS = [
    None, "", "no scheme", "http://", "http://ORG", "http://org/", "http://a.example.org/es/1?q#f", "https://example.org/en/12", "http://xexample.org/en/1",
    "http://www.example.org/en/2", "x://a://b/c", "http://com/fr/x", "http://a.b.com/de/", "http://a.b.com/d", "http://example.org?x/es/", "http://example.org:80/es/",
    "http://example.org./es/", "http://..org/", "http://net/", "HTTP://EXAMPLE.ORG/ES/", "http://ünï.com/fr/é", "http://example.org/es/\nx", "http://example.org/es/\x01",
]
NESTED = (*URL_RULES, ("example.org", "/", "block"), ("b.com", "/de/x", "allow"), ("b.com", "/de/xy", "block"), ("a.b.com", "/", "allow"))


@pytest.mark.parametrize("rules", [URL_RULES, NESTED, ()])
def test_url_rules(spark, rules):
    urls = URLS + ["http://a.b.com/de/xyz", "http://c.b.com/de/xyz", "http://c.b.com/de/x"] + [f"http://h{k}.{quote('x' * (k % 5))}.com/{'de' if k % 2 else 'fr'}/{k}" for k in range(60)]
    pages = spark.createDataFrame([(k, u, "h", k) for k, u in enumerate(urls + urls[:5])], "page_id long, url string, host string, key int")
    table = spark.createDataFrame([*rules, (None, "/", "block"), ("", "/", "block"), ("q", None, "block")], "host string, path string, verdict string")
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(pages, table).collect()}
    assert found == {k: brute_verdict(u, rules) for k, u in enumerate(urls + urls[:5])}


def test_no_pages_and_default(spark):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, None), (None, "http://x.org/")], "page_id long, url string")
    assert judge_urls(pages.limit(0), rules).collect() == []
    assert {tuple(r)[3:] for r in judge_urls(pages, rules, default="block").collect()} == {(None, "block"), ("org/", "allow")}


@pytest.mark.parametrize("size", [2, 7, 500])
def test_sweep_in_blocks_of_any_size(spark, size):
    # Rules nested deeper than a block, keys that are rules themselves, and keys in between.
    rules = ["a" * n for n in range(1, 30)] + ["ab", "b", "bc", "c\x01", "ü", "üx"]
    keys = ["a" * n + end for n in range(0, 32, 3) for end in ("", "b", "\x01", "z")] + ["b", "bcd", "bd", "c", "c\x01/", "d", "üxy", "üy", "東"]
    table, asked = (spark.createDataFrame([(k,) for k in ks + ks[:3]], "key string") for ks in (rules, keys))
    found = {r["key"]: r["open"] for r in open_intervals(asked, table, size).collect()}
    assert found == {k: sorted((r for r in rules if k.startswith(r)), key=len) for k in keys}
    assert open_intervals(asked.limit(0), table, size).collect() == []
    assert all(r["open"] == [] for r in open_intervals(asked, table.limit(0), size).collect())

"""Main text of HTML pages by a tree-structured graphical model (operator 4).

A page's block elements form a tree. Each is content or not; a table of potentials ties what it looks like to that
(its kind of element, the words of its class and id, the length of its own text, its share of links), another ties a
parent to its child. Sum-product messages go up and down the tree once and give every element's marginal probability
of content; the text of the elements at one half or more is the page's.

The potentials are counts of labelled pages: a few that are written down here, and a bounded sample of the table's own
pages, of which elements with a plain meaning (``article``, ``nav``, ...) label themselves and what they hold.
``SAMPLE`` is the bound.

A class, id or role names an element where all its words do, and not a paragraph, heading or quotation, which may have any class: there, and
where other words stand beside, it leaves the decision to the text and to what lies around.

Defined cases: null, empty and textless pages have an empty text. Pages cut off or with tags left open are read as far
as they go: a quote opens a string only right after ``=``, and one that never closes is a character as any; what an unclosed ``svg``,
``noscript``, ``template`` or ``select`` holds ends with its parent. White space is what Unicode calls so. Every page, repeated ids included, gives one row. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyspan.operators.frames import quoted

# Pages of the table that are learned from, at most.
SAMPLE = 300
# Most that what an element is named, and each look of its text, can say for or against content.
MOST_BY_KIND, MOST_BY_TEXT = 10.0, 3.0

# Elements of HTML by how they nest and lay out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe textarea title".split())
# Left out with what they hold; without an end tag they end with their parent.
HIDDEN = frozenset("noscript template svg select".split())
INLINE = frozenset(
    (
        "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span "
        "strike strong sub sup time tt u var wbr "
        "math maction menclose merror mfrac mi mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub "
        "msubsup msup mtext munder munderover semantics annotation"
    ).split()
)
CLOSES_P = frozenset(
    (
        "address article aside blockquote body center details dialog dd dir div dl dt fieldset figcaption figure "
        "footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table ul"
    ).split()
)
SAME_LEVEL = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
    "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
# Words of a class, id or role, by what they name.
MEANINGS = {
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs pagination toc tabs",
    "header": "header masthead banner topbar",
    "footer": "footer copyright colophon contentinfo",
    "side": "sidebar side aside related recommended complementary widget",
    "notice": "notice cookie cookies consent gdpr alert popup modal newsletter subscribe paywall toast disclaimer",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion",
    "form": "form search login signup",
    "comment": "comment comments reply replies discussion disqus respond reviews",
    "share": "share sharing social",
}
# Words of a class that say where or how big an element is, not what.
NEUTRAL = frozenset(
    (
        "area bar block box bottom col column container content fixed float global group holder inner item items large left link links list main "
        "module outer page panel primary region right row secondary section site small sticky text top wrap wrapper"
    ).split()
)
# What a class alone doesn't take out of an article.
TEXTUAL = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 figcaption".split())
_MEANING = {word: kind for kind, words in MEANINGS.items() for word in words.split()}
_ELEMENT = {
    "nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "side", "form": "form",
    "button": "form", "fieldset": "form", "dialog": "notice", "article": "article", "main": "article", "head": "head",
}
_PLAIN = {
    **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), "heading"),
    **dict.fromkeys(("p", "pre", "blockquote", "figcaption"), "paragraph"),
    **dict.fromkeys(("ul", "ol", "dl", "li", "dt", "dd"), "list"),
    **dict.fromkeys(("table", "thead", "tbody", "tr", "td", "th", "caption"), "table"),
}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)", re.S)
_NAMED = re.compile(r"(?<![^\s\"'/])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")


@dataclass(slots=True)
class Element:
    tag: str
    kind: str
    parent: int
    zone: str = "plain"  # what the nearest ancestor or itself with a plain meaning is: article, apart or nothing such
    words: int = 0
    linked: int = 0
    stops: int = 0


@dataclass(slots=True)
class Page:
    """Block elements, parents before children, and the blocks of text as (element, text) in page order."""

    elements: list[Element] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)


def _kind(tag: str, attributes: str) -> str:
    """What an element is named: by its own name, else by a class, id or role whose words say so; "maybe" if some word does."""
    if tag in _ELEMENT:
        return _ELEMENT[tag]
    if tag in HIDDEN:
        return "head"
    maybe = False
    if attributes:
        for found in _NAMED.finditer(attributes):
            for name in (found[1] or found[2] or found[3] or "").lower().split():
                words = _WORD.findall(name)
                named = [_MEANING[word] for word in words if word in _MEANING]
                if named and tag not in TEXTUAL and all(word in _MEANING or word in NEUTRAL for word in words):
                    return named[0]
                maybe |= bool(named)
    return "maybe" if maybe and tag not in _PLAIN else _PLAIN.get(tag, "other")


def _zone(kind: str) -> str | None:
    return "apart" if kind in MEANINGS or kind == "head" else "article" if kind == "article" else None


def parsed(html: str) -> Page:
    page = Page([Element("#page", "other", -1)])
    stack: list[tuple[str, int]] = [("#page", 0)]  # open elements: name and block element
    places: dict[str, list[int]] = defaultdict(list)  # where in the stack each name stands
    blocks: list[int] = [0]  # where in the stack the elements are that are not inline
    endless: set[str] = set()  # elements whose end tag the rest of the page lacks
    held: list[str] = []
    links, linked = 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(held)).split())
        held.clear()
        if text:
            element = page.elements[stack[-1][1]]
            element.words += text.count(" ") + 1
            element.linked += linked
            element.stops += sum(map(text.count, ".!?;:,"))
            page.blocks.append((stack[-1][1], text))
        linked = 0

    def opened(tag: str, element: int) -> None:
        places[tag].append(len(stack))
        if tag not in INLINE:
            blocks.append(len(stack))
        stack.append((tag, element))

    def last(names) -> int:
        """Where the innermost open element of these names stands, 0 if none is open."""
        return max((places[name][-1] for name in names if places[name]), default=0)

    def close(to: int) -> None:
        nonlocal links
        if blocks[-1] >= to:
            flush()
        while len(stack) > to:
            name, _ = stack.pop()
            places[name].pop()
            links -= name == "a"
        while blocks[-1] >= to:
            blocks.pop()

    at = 0
    while found := _TOKEN.search(html, at):
        if found.start() > at:
            part = html[at : found.start()]
            held.append(part)
            if links:
                linked += len(part.split())
        at = found.end()
        tag = found[2]
        if not tag:
            continue
        tag = tag.lower()
        if found[1]:
            if places[tag]:
                close(places[tag][-1])
            continue
        if tag in VOID:
            if tag in INLINE:
                continue
            if tag == "br":
                held.append(" ")
            else:
                flush()
            continue
        if tag in RAW or tag in HIDDEN:
            if found[3].endswith("/"):
                continue
            end = None if tag in endless else re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
            if end or tag in RAW:
                at = end.end() if end else len(html)
                continue
            endless.add(tag)
        if tag in INLINE:
            links += tag == "a"
            opened(tag, stack[-1][1])
            continue
        if tag in CLOSES_P and stack[blocks[-1]][0] == "p":
            close(blocks[-1])
        if tag in SAME_LEVEL and (same := last(SAME_LEVEL[tag])) > last(STOPS[tag]):
            close(same)
        flush()
        if tag == "body" and places["head"]:
            # A head left open ends here.
            close(places["head"][-1])
        kind, parent = _kind(tag, found[3]), stack[-1][1]
        page.elements.append(Element(tag, kind, parent, _zone(kind) or page.elements[parent].zone))
        opened(tag, len(page.elements) - 1)
    held.append(html[at:])
    flush()
    return page


def _looks(element: Element) -> tuple[tuple[str, str], ...]:
    """What a potential depends on, as (table, entry)."""
    kind = ("kind", element.kind)
    if not element.words:
        return kind, ("size", "none")
    size = "few" if element.words < 8 else "some" if element.words < 25 else "many"
    links = ("all", "most", "some", "few")[min(3, int(4 * (1 - element.linked / element.words)))]
    return kind, ("size", size), ("links", links), ("stops", "yes" if element.stops else "no")


@dataclass
class TreeModel:
    """Logarithms of potentials: ``own[table, entry]`` for content against not, ``tie[zone][parent][child]`` for two elements, 1 being content."""

    own: dict[tuple[str, str], float]
    tie: dict[str, list[list[float]]]
    root: float = 0.0

    def marginals(self, elements: list[Element]) -> list[float]:
        """Each element's probability of content: messages to the root, then back."""
        n = len(elements)
        up = [sum(self.own.get(look, 0.0) for look in _looks(e)) for e in elements]  # log odds of what lies below, for content
        up[0] += self.root
        tie = {zone: [exp(x) for row in rows for x in row] for zone, rows in self.tie.items()}
        sent = [0.0] * n
        for k in range(n - 1, 0, -1):
            odds = exp(max(-60.0, min(60.0, up[k])))
            t00, t01, t10, t11 = tie[elements[elements[k].parent].zone]
            sent[k] = log((t10 + t11 * odds) / (t00 + t01 * odds))
            up[elements[k].parent] += sent[k]
        total = up[:]
        for k in range(1, n):
            t00, t01, t10, t11 = tie[elements[elements[k].parent].zone]
            # What the parent knows without this child.
            odds = exp(max(-60.0, min(60.0, total[elements[k].parent] - sent[k])))
            total[k] += log((t01 + t11 * odds) / (t00 + t10 * odds))
        return [1 / (1 + exp(-max(-60.0, min(60.0, x)))) for x in total]

    def text(self, html: str | None) -> str:
        if not html:
            return ""
        page = parsed(html)
        content = self.marginals(page.elements)
        return "\n\n".join(text for k, text in page.blocks if content[k] >= 0.5)


def self_labelled(elements: list[Element]) -> list[int] | None:
    """1 for elements of an article outside all that the article holds of menus, adverts and the like; None for pages without article."""
    if not any(e.kind == "article" for e in elements):
        return None
    labels = [0]
    for e in elements[1:]:
        labels.append(int(_zone(e.kind) != "apart" and (e.kind == "article" or labels[e.parent] == 1)))
    return labels


# Labelled pages that teach what the table's own may not have: x marks elements with content.
LABELLED = (
    "<body><div class=topbar><a href=/>Home</a><a href=/a>About</a></div><div x id=content><h1 x>A title</h1>"
    "<p x>A first sentence, of some length, that tells a reader what comes. More follows here.</p><p x>Short.</p>"
    "<ul x><li x>One point, with words.</li><li x>Two.</li></ul></div><div class=sidebar>"
    "<ul><li><a href=/x>Other page</a></li></ul><p>Words of a side box. And more of them, too.</p></div>"
    "<div class=comments><p>A reader's words, which go on for a while. They are no part of it.</p></div>"
    "<div class=footer>Imprint</div></body>",
    "<body><header><h1>The site's name</h1></header><main x><section x><h2 x>Part</h2>"
    "<p x>Running text, long enough to be read as such, with commas and a full stop at its end.</p><div class=ad>"
    "<p>Buy this now, it is cheap. Really, it is.</p></div><blockquote x>"
    "<p x>Quoted, in a few words.</p></blockquote>"
    "<table x><tr x><td x>Cell</td><td x>9</td></tr></table></section><aside>"
    "<p>Beside the text, a box that tells of other things. It has sentences, too.</p></aside><form>"
    "<p>Your name, please.</p></form></main><footer>"
    "<p>Rights reserved, of course. All of them.</p></footer></body>",
    "<body><div class=cookie-notice><p>This site uses cookies, as sites do. Do you agree?</p></div><nav>"
    "<ul><li><a href=/>Start</a></li><li><a href=/b>News</a></li></ul></nav><article x><h1 x>What happened</h1>"
    "<p x>It happened in a town, on a day in spring, and nobody had thought of it before.</p><p x>Then.</p>"
    "<div x><p x>A paragraph in a box of its own, which belongs to the article all the same.</p></div>"
    "<div class=share><a href=/s>Share</a></div><section id=comments><div>"
    "<p>I don't agree. It was different, and I know it.</p></div></section></article><aside class=related>"
    "<ul><li><a href=/c>More of this</a></li></ul></aside></body>",
    "<body><table><tr><td><a href=/>Home</a></td></tr></table>"
    "<p x>A page without any structure, but with a paragraph, of one or two long sentences, that is what it is about.</p>"
    "<p x>And another one, which goes on about the same matter, for a few more words than the first.</p>"
    "<p><a href=/n>Next</a></p></body>",
)


def hand_labelled() -> Iterator[tuple[list[Element], list[int]]]:
    for html in LABELLED:
        marks = [m[3].split(" ")[1:2] == ["x"] for m in _TOKEN.finditer(html) if m[2] and not m[1] and m[2] not in INLINE and m[2] not in VOID]
        elements = parsed(re.sub(r" x(?=[ >])", "", html)).elements
        yield elements, [0, *map(int, marks)]


def fit_tree(own_pages: list[tuple[list[Element], list[int]]]) -> TreeModel:
    """Potentials from counts, smoothed: looks given a label, and a child's label given its parent's.

    The pages written down here weigh as much as all of ``own_pages``, which may know only some kinds of elements.
    """
    looks: dict[int, Counter] = {0: Counter(), 1: Counter()}
    sizes, ties, roots = Counter(), defaultdict(lambda: 0.5), 0
    written = list(hand_labelled())
    weight = max(1.0, len(own_pages) / len(written))
    for times, (elements, labels) in [(weight, page) for page in written] + [(1.0, page) for page in own_pages]:
        roots += times
        for e, label in zip(elements, labels, strict=True):
            sizes[label] += times
            for look in _looks(e):
                looks[label][look] += times
            if e.parent >= 0:
                ties[elements[e.parent].zone, labels[e.parent], label] += times
    own = {}
    for look in {*looks[0], *looks[1]}:
        # An entry's weight doesn't grow with how often both labels occur: that is what ties are for.
        yes, no = ((looks[k][look] + 0.02) / (sizes[k] + 0.2) for k in (1, 0))
        most = MOST_BY_KIND if look[0] == "kind" else MOST_BY_TEXT
        own[look] = max(-most, min(most, log(yes / no)))
    tie = {z: [[log(ties[z, p, c] / (ties[z, p, 0] + ties[z, p, 1])) for c in (0, 1)] for p in (0, 1)] for z in ("plain", "article", "apart")}
    return TreeModel(own, tie, log(0.5 / (roots + 1)))


def train_tree(pages: DataFrame, html: str = "html", sample: int = SAMPLE) -> TreeModel:
    """From the pages written down here and about ``sample`` different ones of the table, at most twice as many, by their hashes."""
    column = quoted(html)
    share = min(1.0, sample / max(1, pages.count()))
    drawn = pages.select(column.alias("html"), F.xxhash64(column).alias("hash")).where("html is not null")
    drawn = drawn.where(F.pmod("hash", F.lit(1 << 30)) < int(share * (1 << 30)))
    # Copies count once, and are dropped before anything is sent anywhere.
    chosen = drawn.groupBy("hash").agg(F.min("html").alias("html")).orderBy("hash").limit(2 * sample)
    return fit_tree([(p.elements, labels) for r in chosen.collect() if (labels := self_labelled((p := parsed(r["html"])).elements))])


def extract_text(pages: DataFrame, model: TreeModel, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` per row of ``pages``."""
    rows = pages.select(quoted(page_id).alias("page_id"), quoted(url).alias("url"), quoted(html).alias("html"))

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.text(h.as_py()) for h in batch["html"]]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(extracted, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")

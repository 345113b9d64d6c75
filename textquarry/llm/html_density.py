"""Main text of web pages by composite text density.

A page's tags are read into a tree. For every node, C counts its characters, LC those of links below it, T and LT the tags and link
tags below it. Its composite density is

    C / T * log_b( C / LC * T / LT ),   b = ln( C / (C - LC) * LC + LC_body / C_body * C + e )

with every count that divides taken as at least one: many characters per tag, and few of them in links. A node's sum adds up the densities of its
children (and, for text it holds itself, of that text as one child). The subtree of the greatest sum, over all nodes, is the
article (of equal sums an <article> or <main>, then the outermost and first); the least density on its path to the body is the
threshold. Where the article is in several parts, every other subtree as dense as the threshold gives its own subtree of the greatest
sum, in page order; an <article> brings those beside it that are not mostly links, as densities grow with length. A child below the
threshold whose characters are mostly links goes.

A heading that precedes the subtree of the greatest sum below one of the nodes on its path, and what stands between them, belong to
the article, as do paragraphs right before it; parts that are mostly links do not.

What is never an article is left out before counting: scripts, styles, forms, navigation, footers, asides, page headers, and
elements with a class, id or role that is the name of a menu, sidebar, notice, advert or reader comments; they end where the markup
ends them, also without a tag of their own. A name made of such a word and words of layout (``comment-list``) counts likewise, unless
the element holds the page's <main> or <h1> or nothing outside reads as prose; beside other words (``related-work``) it
counts only if the element is mostly links; after a word of state (``has-sidebar``) never. Character references are decoded, white
space within a block becomes one space, and blocks are joined by one space in page order. Nothing is capped, and a page is read in
time linear in its length.

One page is one row of one Arrow batch; pages do not move. Nulls: a null page has no text; null ids and urls are carried. Repeated
rows give equal rows. Broken markup (unclosed or misnested tags, a quoted ``>``) is read as it comes; a quote that is never closed
does not hide the end of its tag, nor do later ones. Of equal sums the order above decides; extra columns are not read. An empty table
stays empty.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import map_batches

# HTML's elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg annotation annotation-xml".split())
DROPPED = RAW | frozenset("head nav footer aside form button select option fieldset menu dialog object canvas audio video".split())
MATH = frozenset("math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts semantics".split())
INLINE = MATH | frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var wbr big".split())
CLOSES = {
    "p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option"]),
}
# Names, as whole words of a class, id or role, of what is no article.
BOILERPLATE = frozenset(
    "ad ads advert advertisement advertising sponsor sponsored promo banner popup modal cookie cookies consent notice alert newsletter subscribe"
    " nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead pagination pager toolbar share sharing social related"
    " recommended comment comments disqus replies search contentinfo complementary dialog".split()
)

# Words that say nothing of their own beside one of those, and words that only tell a state.
LAYOUT = frozenset(
    "list box area slot bar signup wrap wrapper container section block unit widget top bottom left right site page post posts links link"
    " form header inner outer overlay content text item items thread body title button buttons icons panel main primary secondary js div"
    " wp id module row col column group media articles stories news topics policy message feed form count author entry global".split()
)
STATES = frozenset("has no with without is not non open closed free enabled disabled".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE_CHARS = 40  # text of its own, outside of links and headings, from which a node reads as prose

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_QUOTE_OR_END = re.compile(r"""=\s*(["'])|>""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s>/=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")


class Node:
    __slots__ = ("tag", "parent", "parts", "chars", "link_chars", "tags", "link_tags", "density", "total", "named", "headed")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.parts: list[Node | str] = []
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.total = 0.0
        self.named = 0  # 2: a name of boilerplate with words of layout; 1: with other words
        self.headed = tag == "h1"


def _is_boilerplate(attributes: str) -> int:
    """3 for what is dropped by its name, else the ``named`` of a node.

    Attributes are read one by one, their values as wholes; of repeated ones the first counts."""
    seen, found = set(), 0
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name in seen:
            continue
        seen.add(name)
        if name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true"):
            return 3
        if name in ("class", "id", "role"):
            for token in value.split():
                if token.lower() in BOILERPLATE:
                    return 3
                parts = {w.lower() for w in _WORD.findall(token)}
                if not BOILERPLATE.isdisjoint(parts) and STATES.isdisjoint(parts):
                    plain = all(w in BOILERPLATE or w in LAYOUT or w.isdigit() for w in parts)
                    found = max(found, 2 if plain else 1)
    return found


def _tokens(source: str):
    """Texts and tags of a page in order: ``text, closing, tag, attributes``, the tag empty for comments and at the end.

    A tag's name may be sent in to skip its inside, which is no markup. Every search either moves on or is not made again.
    """
    at, start, end, last = 0, 0, len(source), source.rfind(">")
    quotes = True  # until a quoted value is found open
    while True:
        at = source.find("<", at)
        if at < 0:
            yield source[start:], False, "", ""
            return
        if source.startswith("<!--", at):
            close = source.find("-->", at + 4)
            stop, found = (end if close < 0 else close + 3), (False, "", "")
        elif source.startswith(("<!", "<?"), at):
            close = source.find(">", at)
            stop, found = (end if close < 0 else close + 1), (False, "", "")
        else:
            m = _OPEN.match(source, at) if at < last else None
            if m is None:
                at += 1
                continue
            close, here = -1, m.end()
            while quotes:
                q = _QUOTE_OR_END.search(source, here)
                if q is not None and q[1] is None:
                    close = q.start()
                    break
                here = source.find(q[1], q.end()) + 1 if q is not None else 0
                quotes = here > 0
            if close < 0:
                close = source.find(">", m.end())
            if close < 0:
                at += 1
                continue
            stop, found = close + 1, (bool(m[1]), m[2].lower(), source[m.end() : close])
        raw = yield source[start:at], *found
        at = start = stop
        if raw:
            inside = re.compile(rf"</{re.escape(raw)}(?=[\s/>])[^>]*>", re.I).search(source, at, last + 1)
            at = start = inside.end() if inside else end
            yield None


class _Path:
    """Names of open elements, innermost last, and how many there are of each."""

    def __init__(self):
        self.names: list[str] = []
        self.open: dict[str, int] = {}

    def push(self, tag: str) -> None:
        self.names.append(tag)
        self.open[tag] = self.open.get(tag, 0) + 1

    def pop(self) -> str:
        tag = self.names.pop()
        self.open[tag] -= 1
        return tag

    def holds(self, tag: str) -> bool:
        return self.open.get(tag, 0) > 0


def parse(source: str) -> Node:
    """The tree of a page below its body, without what is dropped."""
    root = here = Node("body", None)
    path, skip = _Path(), _Path()  # skip: tags open within a dropped element, itself first
    tokens = _tokens(source)
    for text, closing, tag, attributes in tokens:
        if text and not skip.names:
            here.parts.append(text)
        if not tag:
            continue
        if skip.names and closing:
            if skip.holds(tag):
                while skip.pop() != tag:
                    pass
                continue
            if not path.holds(tag) and tag not in ("body", "html"):
                continue
            skip = _Path()  # the end of what the dropped element lies in
        whole = attributes.endswith("/") and (tag in MATH or tag in ("svg", "annotation", "annotation-xml"))
        if tag in RAW and not closing:
            if not whole:
                tokens.send(tag)
            if not skip.names:
                here.parts.append("" if tag not in RAW - {"svg", "annotation", "annotation-xml"} else " ")
            continue
        if skip.names:
            while skip.names and tag in CLOSES.get(skip.names[-1], ()):
                skip.pop()
            if skip.names:
                if tag not in VOID and not whole:
                    skip.push(tag)
                continue
        if closing:
            if path.holds(tag):
                while path.pop() != tag:
                    here = here.parent
                here = here.parent
            elif tag in ("p", "br"):
                here.parts.append(Node(tag, here))
            continue
        while here.parent is not None and tag in CLOSES.get(here.tag, ()):
            path.pop()
            here = here.parent
        if tag == "body" or tag == "html":
            continue
        page_header = tag == "header" and not (path.holds("article") or path.holds("main"))
        named = _is_boilerplate(attributes) if attributes and tag not in VOID else 0
        if tag not in VOID and (tag in DROPPED or page_header or named == 3):
            skip.push(tag)
            if tag not in INLINE:
                here.parts.append(Node("br", here))
            continue
        node = Node(tag, here)
        node.named = 0 if tag in HEADINGS or tag in INLINE else named
        here.parts.append(node)
        if tag not in VOID and not whole:
            path.push(tag)
            here = node
    _drop_named(root)
    return root


def _drop_named(root: Node) -> None:
    """Take out the blocks that are named by a word of boilerplate and others."""
    nodes = _ordered(root)
    if not any(n.named for n in nodes):
        return
    for node in reversed(nodes):
        node.chars += sum(len(p.strip()) for p in node.parts if isinstance(p, str))
        if node.tag == "a":
            node.link_chars = node.chars
        node.headed |= node.tag == "main"
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.link_chars += node.link_chars
            node.parent.headed |= node.headed
    todo, gone = [root], set()
    while todo:
        # All below one kept node, up to named blocks: what is looked at here is not looked at again.
        walk, named, prose = [(todo.pop(), False)], [], False
        while walk:
            node, inert = walk.pop()
            inert = inert or node.tag in HEADINGS or node.tag == "a"
            prose |= node.tag in ("article", "main") and 2 * node.link_chars < node.chars
            prose |= not inert and sum(len(p.strip()) for p in node.parts if isinstance(p, str)) >= PROSE_CHARS
            for part in node.parts:
                if isinstance(part, Node):
                    if part.named == 1 and 2 * part.link_chars > part.chars:
                        gone.add(part)
                    elif part.named == 2 and not part.headed:
                        named.append(part)
                    else:
                        walk.append((part, inert))
        if prose:
            gone.update(named)
        else:
            todo += named
    for node in nodes:
        if node.parts and not gone.isdisjoint(node.parts):
            node.parts = [Node("br", node) if p in gone else p for p in node.parts]
        node.chars = node.link_chars = 0
        node.headed = node.tag == "h1"


def _ordered(root: Node) -> list[Node]:
    """All nodes, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [p for p in reversed(node.parts) if isinstance(p, Node)]
    return out


def _density(chars: int, link_chars: int, tags: int, link_tags: int, body_ratio: float) -> float:
    if not chars:
        return 0.0
    t, lc, lt, rest = max(tags, 1), max(link_chars, 1), max(link_tags, 1), max(chars - link_chars, 1)
    base = math.log(chars / rest * link_chars + body_ratio * chars + math.e)
    adjusted = math.log(max(chars / lc * t / lt, 1.0))
    return chars / t * (adjusted / math.log(base) if base > 1 + 1e-12 else adjusted)


def _count(root: Node) -> list[Node]:
    nodes = _ordered(root)
    for node in reversed(nodes):
        own = sum(len(html.unescape(p).strip()) if "&" in p else len(p.strip()) for p in node.parts if isinstance(p, str))
        node.chars += own
        if node.tag == "a":
            node.link_chars = node.chars
        if node.parent is not None:
            up = node.parent
            up.chars += node.chars
            up.link_chars += node.link_chars
            up.headed |= node.headed
            if node.tag not in ("br", "wbr") and node.tag not in MATH:
                up.tags += node.tags + 1
                up.link_tags += node.link_tags + (node.tag == "a")
    ratio = root.link_chars / max(root.chars, 1)
    for node in reversed(nodes):
        node.density = _density(node.chars, node.link_chars, node.tags, node.link_tags, ratio)
        own = sum(len(p.strip()) for p in node.parts if isinstance(p, str))
        node.total += _density(own, own if node.tag == "a" else 0, 0, 0, ratio)
        if node.parent is not None:
            node.parent.total += node.density
    return nodes


def _order(node: Node) -> tuple[float, bool]:
    return node.total, node.tag in ("article", "main")


def _pick(root: Node) -> tuple[list[Node], float]:
    """The subtrees that hold the article, in page order, and the least density on the path of the greatest sum to the body.

    The subtree of the greatest sum comes first; then, from the body down, so does that of every node which is as dense as the
    threshold, where none has been taken yet.
    """
    nodes = _count(root)
    tops: dict[Node, Node] = {}
    for node in reversed(nodes):
        tops[node] = max([node, *(tops[p] for p in node.parts if isinstance(p, Node))], key=_order)
    best = tops[root]
    threshold, node = best.density, best
    while node is not None:
        threshold = min(threshold, node.density)
        node = node.parent
    taken, covered, asked = {}, set(), set()  # covered: ancestors of what is taken; asked: parents of articles looked through
    todo = [root]
    while todo:
        node = todo.pop()
        if node in taken or not node.chars or node.density < threshold:
            continue
        top = tops[node] if node not in covered else None
        # A container whose one child has all of its text adds nothing: its parent is taken while all text stays within.
        while top is not None and top is not node and top.tag in INLINE | {"p", "h1", "h2", "h3", "h4", "li"}:
            top = top.parent
        if top is not None and top not in covered:
            taken[top] = None
            if top.tag == "article" and top.parent is not None and top.parent not in asked:
                asked.add(top.parent)
                beside = (p for p in top.parent.parts if isinstance(p, Node) and p.tag == "article" and p not in covered)
                taken.update((p, None) for p in beside if 2 * p.link_chars <= p.chars)
            up = top.parent
            while up is not None and up not in covered:
                covered.add(up)
                up = up.parent
        if node not in taken:
            todo += reversed([p for p in node.parts if isinstance(p, Node)])
    chosen = {*taken, *_lead(best)}
    out, held = [], set()  # held: the chosen and all below them
    for node in nodes:
        if node.parent in held:
            held.add(node)
        elif node in chosen:
            held.add(node)
            out.append(node)
    return out, threshold


def _lead(best: Node) -> list[Node]:
    """What precedes the subtree of the greatest sum below the nodes on its path: its headline with all in between, or paragraphs."""
    out: list[Node] = []
    node = best
    while node.parent is not None and not node.headed:
        before = []
        for part in node.parent.parts:
            if part is node:
                break
            if isinstance(part, Node) and part.chars and 2 * part.link_chars <= part.chars:
                before.append(part)
        node = node.parent
        heads = [i for i, n in enumerate(before) if n.headed] or [i for i, n in enumerate(before) if n.tag in HEADINGS]
        if heads:
            out += before[heads[-1] :]
        else:
            while before and before[-1].tag == "p":
                out.append(before.pop())
        if any(n.headed for n in out):
            break
    return out


def main_text(source: str | None) -> str:
    """The article of a page as one line of text."""
    if not source:
        return ""
    root = parse(source)
    picked, threshold = _pick(root)
    blocks: list[str] = []
    todo: list[Node | str | None] = []
    for node in reversed(picked):
        todo += [None, node]
    tops = set(picked)
    while todo:
        part = todo.pop()
        if part is None:
            blocks.append(" ")
        elif isinstance(part, str):
            blocks.append(part)
        else:
            if part not in tops and part.tag not in INLINE and part.density < threshold and 2 * part.link_chars > part.chars:
                blocks.append(" ")
                continue
            block = part.tag not in INLINE
            if block:
                blocks.append(" ")
                todo.append(None)
            todo += reversed(part.parts)
    return " ".join(html.unescape("".join(blocks)).split())


def extract_main_text(pages: DataFrame, source: str = "html", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``carry``, ``text`` and ``n_chars`` of every page."""
    held = pages.select(*carry, F.col(source).alias("html_"))
    n = len(carry)

    def work(batches):
        for batch in batches:
            texts = [main_text(t) for t in batch.column(n).to_pylist()]
            made = [pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *made], [*carry, "text", "n_chars"])

    schema = held.select(*carry).schema.add("text", "string").add("n_chars", "long")
    return map_batches(held, work, schema)

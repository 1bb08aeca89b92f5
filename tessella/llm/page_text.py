"""Main text of web pages by minimum-cut labelling.

A page is read into blocks of text. What a classifier of the text alone (length, share of
links, tag) says of a block becomes the capacity of its arc to one of the two
terminals. An element that says what it holds (article, nav, a class word) is a node as well:
its capacity grows with the number of its blocks, and an arc ties it to each of them and to
the element around it. Neighbours in page order and blocks with a common parent or
grandparent are tied to each other. The minimum cut, found by maximum flow, labels all.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html import unescape
from math import log2

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import mapped, named

#: Fixed values of the HTML standard: elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown as text.
RAW = frozenset("script style template noscript svg math iframe object canvas audio video head title textarea select option button datalist".split())
#: Elements that run inside a line and end no block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements that an open paragraph ends before.
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: Elements that the next of their kind closes (also the second kind), and what stops the search for it.
CLOSED_BY_NEXT = {
    "li": (("li",), ("ul", "ol", "menu")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold boilerplate.
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog".split())
#: Words of class, id or role that tell boilerplate wherever they stand in a name,
CLEAR_NAMES = re.compile(
    r"nav\w*|menu\w*|masthead|footer\w*|sidebar\w*|breadcrumb\w*|pagination|advert\w*|adsense|banner\w*|promo\w*|sponsor\w*|cookie\w*|consent|gdpr|popup|modal|newsletter"
    r"|subscribe\w*|signup|login|social\w*|related\w*|recommend\w*|trending|comments?|disqus|widget\w*|toolbar|copyright|disclaimer|complementary|contentinfo",
    re.I,
)
#: those that do so as a whole name, and are a hint as part of one,
WHOLE_NAMES = re.compile(r"ads?|header|foot|side|aside|pager|notices?|overlay|shar(?:e|ing)|respond|repl(?:y|ies)|discussion|reviews?|skip", re.I)
#: and those that are a hint only.
HINTS = re.compile(r"alert|popular|legal|search\w*|tags?|meta|byline|sharer|shared|skip\w*", re.I)
CONTENT_NAMES = re.compile(r"article\w*|content\w*|main|post|entry|story", re.I)
WORDS = re.compile(r"[^\W_]+")

#: What a node for an element pays for the other label: so much, and so much for each of its blocks.
STRONG, HINT = (3.0, 2.0), (0.5, 0.5)
#: Capacities of arcs: a block and its element's node (a sure one, one that hints), two such nodes, neighbours, children of one parent, of one grandparent.
OF_ELEMENT, OF_HINT, NESTED, ADJACENT, SIBLINGS, COUSINS = 3.0, 1.0, 0.5, 0.4, 0.4, 0.2

ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]*)))?")
NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
TAG_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
STOPS = re.compile(r"[>\"']")


class Block:
    __slots__ = ("text", "tag", "link", "parent", "grandparent", "node")

    def __init__(self, text: str, tag: str, link: int, parent: int, grandparent: int, node: int):
        self.text, self.tag, self.link, self.parent, self.grandparent, self.node = text, tag, link, parent, grandparent, node


class Element:
    """An open element. node: the number of the nearest one, itself included, that says what it holds."""

    __slots__ = ("tag", "serial", "parent", "hidden", "node", "link")

    def __init__(self, tag: str, serial: int, parent: int, hidden: bool, node: int, link: bool):
        self.tag, self.serial, self.parent, self.hidden, self.node, self.link = tag, serial, parent, hidden, node, link


class Node:
    """An element that says what it holds: its lean (1 content, -1 boilerplate, 0 nothing), how surely, and the node around it."""

    __slots__ = ("kind", "lean", "weight", "outer", "blocks")

    def __init__(self, kind: str, lean: int, weight: tuple[float, float], outer: int):
        self.kind, self.lean, self.weight, self.outer, self.blocks = kind, lean, weight, outer, 0


def attributes(attrs: str) -> dict[str, str]:
    """The attributes of a tag by name; of repeated ones the first."""
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(attrs):
        out.setdefault(name.lower(), a or b or c)
    return out


def leaning(tag: str, has: dict[str, str], inside_article: bool) -> tuple[int, tuple[float, float]] | None:
    """What an element says of its text by tag, class, id and role, or None."""
    if tag in BOILERPLATE_TAGS or tag == "header" and not inside_article:
        return -1, STRONG
    hint = False
    for names in (has.get("class"), has.get("id"), has.get("role")) if has else ():
        for name in (names or "").split():
            words = WORDS.findall(name)
            if any(CLEAR_NAMES.fullmatch(w) for w in words) or len(words) == 1 and WHOLE_NAMES.fullmatch(words[0]):
                return -1, STRONG
            hint = hint or any(WHOLE_NAMES.fullmatch(w) or HINTS.fullmatch(w) for w in words)
    if tag in ("article", "main"):
        return 1, STRONG
    if hint:
        return -1, HINT
    if any(CONTENT_NAMES.fullmatch(w) for name in ("class", "id", "role") for w in WORDS.findall(has.get(name, ""))):
        return 1, HINT
    return None


def tags_of(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, tag, whether it is an end tag, attributes) of each tag; comments and declarations have no tag.

    One pass: what is looked for in vain once, to the end of the page, is not looked for again.
    """
    missing: set[str] = set()
    quotes = True

    def find(what: str, at: int) -> int:
        if what in missing:
            return -1
        found = page.find(what, at)
        if found < 0:
            missing.add(what)
        return found

    at = page.find("<")
    while at >= 0:
        end = -1
        if page.startswith("<!--", at):
            close = find("-->", at + 4)
            end = close + 3 if close >= 0 else len(page)
            yield at, end, "", False, ""
        elif page.startswith("<![CDATA[", at) and (close := find("]]>", at)) >= 0:
            end = close + 3
            yield at, end, "", False, ""
        elif page[at + 1 : at + 2] in ("!", "?"):
            close = find(">", at)
            end = close + 1 if close >= 0 else len(page)
            yield at, end, "", False, ""
        elif m := TAG_NAME.match(page, at):
            k = m.end()
            while True:
                stop = STOPS.search(page, k) if quotes else None
                k = stop.start() if stop else find(">", m.end()) if not quotes else -1
                if k < 0 or page[k] == ">":
                    break
                close = find(page[k], k + 1)
                k = close + 1 if close >= 0 else k + 1  # a quote without its like is a character
            if k < 0 and quotes:
                quotes = False  # every > to the end of the page stands in quotes: from here on quotes are characters
                k = find(">", m.end())
            if k >= 0:
                end = k + 1
                yield at, end, m[1].lower(), page[at + 1] == "/", page[m.end() : k]
        at = page.find("<", end if end >= 0 else at + 1)


def blocks_of(page: str) -> tuple[list[Block], list[Node]]:
    """The blocks of visible text in page order, and the elements that say what they hold (the first: the page)."""
    out: list[Block] = []
    nodes = [Node("page", 0, (0.0, 0.0), -1)]
    stack: list[Element] = [Element("", 0, 0, False, 0, False)]
    #: Where in the stack the open elements of each tag are, and those that are no inline ones.
    places: dict[str, list[int]] = {}
    outer: list[int] = [0]
    parts: list[str] = []
    serial, at, link = 0, 0, 0
    skip = ""

    def last(tag: str) -> int:
        return places[tag][-1] if places.get(tag) else 0

    def end_block() -> None:
        nonlocal link
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                e = stack[outer[-1]]
                out.append(Block(text, e.tag, min(link, len(text)), e.parent, stack[outer[-2]].parent if len(outer) > 1 else -1, e.node))
                nodes[e.node].blocks += 1
            parts.clear()
        link = 0

    def close_to(depth: int) -> None:
        """Ends elements, deepest first, until depth are left; a block ends with the first that is no inline one."""
        if outer[-1] >= depth:
            end_block()
        while len(stack) > depth:
            places[stack.pop().tag].pop()
        while outer[-1] >= depth:
            outer.pop()

    def add(text: str) -> None:
        nonlocal link
        if text and not stack[-1].hidden:
            parts.append(text)
            if stack[-1].link:
                link += len(text.strip())

    for start, stop, tag, ends, attrs in tags_of(page):
        if start < at:
            continue
        if not skip:
            add(page[at:start])
        at = stop
        if not tag:
            continue
        if skip:
            if ends and tag == skip:
                skip = ""
            continue
        if ends:
            # An inline end tag ends nothing beyond the block it stands in.
            if (depth := last(tag)) and (tag not in INLINE or depth > outer[-1]):
                close_to(depth)
            continue
        if tag in RAW:
            if not attrs.endswith("/"):
                if tag in ("script", "style", "title", "textarea"):
                    # Raw text: up to its own end tag, whatever stands in between.
                    end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
                    at = end.end() if end else len(page)
                else:
                    skip = tag
            if tag != "title" and tag not in INLINE:
                end_block()
            if skip == "head":
                skip = ""  # what belongs in a head is skipped element by element
            continue
        if tag in VOID:
            if tag == "br":
                add(" ")
            elif tag == "hr":
                end_block()
            continue
        if tag in ENDS_PARAGRAPH:
            if depth := last("p"):
                close_to(depth)  # inline elements left open inside the paragraph end with it
        elif tag in CLOSED_BY_NEXT:
            closed, stops = CLOSED_BY_NEXT[tag]
            depth = max(map(last, closed))
            if depth > max(map(last, stops)):
                close_to(depth)
        inline = tag in INLINE
        if not inline:
            end_block()
        if attrs.endswith("/") and inline:
            continue
        around = stack[-1]
        has = attributes(attrs) if attrs and not attrs.isspace() else {}
        hidden = around.hidden or bool(has) and ("hidden" in has or has.get("aria-hidden", "").lower() == "true" or bool(NOT_SHOWN.search(has.get("style", ""))))
        node, serial = around.node, serial + 1
        # What is inside boilerplate stays in it, whatever it says; html and body are the page.
        if not inline and tag not in ("html", "body") and not (nodes[node].lean < 0 and nodes[node].weight == STRONG):
            if said := leaning(tag, has, nodes[node].kind == "article"):
                kind = tag if said == (1, STRONG) else nodes[node].kind
                nodes.append(Node(kind, *said, node))
                node = len(nodes) - 1
        places.setdefault(tag, []).append(len(stack))
        if not inline:
            outer.append(len(stack))
        stack.append(Element(tag, serial, stack[outer[-1 if inline else -2]].serial, hidden, node, around.link or tag == "a"))
    if not skip:
        tail = page[at:]
        # A tag that the end of the page cuts off is markup.
        cut = re.search(r"<[/!A-Za-z][^<>]*\Z", tail)
        add(tail[: cut.start()] if cut else tail)
    close_to(1)
    end_block()
    return out, nodes


def lean_of(block: Block) -> float:
    """What a block's own text says of it, from -1.5 (boilerplate) to 1.5 (content)."""
    words = block.text.count(" ") + 1
    score = min(max(log2(words + 1) / 3 - 1, -0.7), 1.0)
    score += 0.2 if block.tag in ("p", "blockquote", "pre") else 0.3 if block.tag in HEADINGS else 0.0
    score -= 1.5 * block.link / max(len(block.text), 1)
    if block.text.startswith(("©", "Copyright ")):
        score -= 1.0
    return min(max(score, -1.5), 1.5)


def min_cut(source: list[float], sink: list[float], arcs: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node lies on the source's side of a minimum cut (of several, the smallest side).

    Nodes whose terminal arc outweighs all their other arcs keep their side in every
    minimum cut; they are taken out first, their arcs becoming their neighbours'
    terminal arcs. Dinic's algorithm finds the maximum flow through what is left.
    """
    n = len(source)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in arcs:
        near[a][b] = near[a].get(b, 0.0) + c
        near[b][a] = near[b].get(a, 0.0) + c
    excess = [s - t for s, t in zip(source, sink)]
    weight = [sum(x.values()) for x in near]
    side: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        v = queue.popleft()
        if side[v] is None and abs(excess[v]) > weight[v]:
            side[v] = excess[v] > 0
            for u, c in near[v].items():
                if side[u] is None:
                    excess[u] += c if side[v] else -c
                    weight[u] -= c
                    queue.append(u)
    left = [v for v in range(n) if side[v] is None]
    if left:
        number = {v: k for k, v in enumerate(left)}
        inner = [(number[v], number[u], c) for v in left for u, c in near[v].items() if v < u and side[u] is None]
        reached = _max_flow([max(excess[v], 0.0) for v in left], [max(-excess[v], 0.0) for v in left], inner)
        for v, r in zip(left, reached):
            side[v] = r
    return [bool(s) for s in side]


def _max_flow(source: list[float], sink: list[float], arcs: list[tuple[int, int, float]]) -> list[bool]:
    """Dinic's algorithm; whether the source reaches each node in the residual graph."""
    n = len(source)
    s, t = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def arc(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(there)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for v in range(n):
        if source[v]:
            arc(s, v, source[v], 0.0)
        if sink[v]:
            arc(v, t, sink[v], 0.0)
    for a, b, c in arcs:
        arc(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            v = queue.popleft()
            for e in out[v]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[v] >= 0 for v in range(n)]
        tried = [0] * (n + 2)
        path: list[int] = []
        v = s
        while True:
            if v == t:
                pushed = min(room[e] for e in path)
                for k, e in enumerate(path):
                    room[e] -= pushed
                    room[e ^ 1] += pushed
                first = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                v = to[path[first] ^ 1]
                del path[first:]
                continue
            while tried[v] < len(out[v]):
                e = out[v][tried[v]]
                if room[e] > 1e-9 and level[to[e]] == level[v] + 1:
                    break
                tried[v] += 1
            if tried[v] < len(out[v]):
                path.append(out[v][tried[v]])
                v = to[path[-1]]
            elif path:
                level[v] = -1
                v = to[path.pop() ^ 1]
                tried[v] += 1
            else:
                break


def graph(blocks: list[Block], nodes: list[Node]) -> tuple[list[float], list[float], list[tuple[int, int, float]]]:
    """Capacities from the source (content), to the sink (boilerplate), and between: blocks first, then nodes.

    Where the page names its article, what lies outside is not it.
    """
    named = next((kind for kind in ("article", "main") if any(nodes[b.node].kind == kind for b in blocks)), "")
    n = len(blocks)
    leans, arcs = [lean_of(b) for b in blocks], []
    for node in nodes:
        lean, (once, each) = (-1, STRONG) if named and node.kind != named and node.lean >= 0 else (node.lean, node.weight)
        leans.append(lean * (once + each * node.blocks))
    for k, node in enumerate(nodes):
        if node.outer >= 0 and leans[n + node.outer]:
            arcs.append((n + node.outer, n + k, NESTED))
    before: dict[tuple[int, bool], int] = {}
    for k, b in enumerate(blocks):
        if leans[n + b.node]:
            arcs.append((n + b.node, k, OF_ELEMENT if nodes[b.node].weight == STRONG or not b.node else OF_HINT))
        if k:
            arcs.append((k - 1, k, ADJACENT))
        for key, room in (((b.parent, True), SIBLINGS), ((b.grandparent, False), COUSINS)):
            if key in before:
                arcs.append((before[key], k, room))
            before[key] = k
    return [max(x, 0.0) for x in leans], [max(-x, 0.0) for x in leans], arcs


def main_text(page: str | None) -> str:
    """The page's article: its content blocks in page order, one to a line."""
    blocks, nodes = blocks_of(page) if page else ([], [])
    if not blocks:
        return ""
    return "\n".join(b.text for b, content in zip(blocks, min_cut(*graph(blocks, nodes))) if content)


class _Extract:
    def __call__(self, batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(h) for h in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "n_chars"])


def extract(pages: DataFrame, *, html_col="html", keep=("page_id", "url")) -> DataFrame:
    """The columns in keep, text (the page's main text) and n_chars (its code points).

    Character references are decoded, white space inside a block becomes one space,
    blocks are trimmed and joined by a line end. A null or empty page, and one without
    content, has an empty text. Every row is worked on alone, so repeated rows agree;
    other columns, whatever they are called, are not looked at. Reading a page takes time
    in proportion to its length, however its tags nest and its quotes stay open.
    """
    rows = pages.select(*keep, named(html_col).cast("string"))
    schema = T.StructType([*pages.select(*keep).schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return mapped(rows, _Extract(), schema)

"""A small, forgiving HTML reader: block-level elements as a tree, text runs in page order."""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field
from html import unescape

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("script style template iframe noembed noframes textarea select option datalist title head".split())  # scripts, styles, form fields, and what stands for other pages
INLINE = frozenset("a abbr acronym audio b bdi bdo big br button canvas cite code data del dfn em font i img input ins kbd label map mark nobr noscript object q rp rt ruby s samp small span strike strong sub sup time tt u var video wbr".split())
HOLLOW = (UNSEEN - {"title", "head"}) | {"math", "svg"}  # nothing in these ends a block
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}

_COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)", re.S)
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    names: list[str]
    label: int = -1
    text: int = 0  # characters of text below
    linked: int = 0  # of those, inside links
    own: int = 0  # characters directly in this block
    stops: int = 0  # sentence ends below
    paragraphs: int = 0  # directly in this block


@dataclass(slots=True)
class Page:
    nodes: list[Node] = field(default_factory=list)
    runs: list[tuple[int, int, str]] = field(default_factory=list)  # (block number, node, text)


def parse(html: str, labelled: bool = False) -> Page:
    """Blocks end wherever a block-level tag starts or ends; an inline tag, and all in formulas and unseen elements, never ends one.

    Every element shows its text, also one that a browser would hide, but for ``UNSEEN`` ones.  The places of open elements are kept
    by tag, so that the depth of the tree costs nothing.  A quote inside a tag protects a ``>``, until a tag is met that doesn't end for
    its quotes: from there on none does, and every tag is read once.
    """
    page = Page([Node("#root", -1, [])])
    nodes, runs = page.nodes, page.runs
    stack: list[tuple[str, int]] = [("#root", 0)]  # open elements; inline ones share their block's node
    places: dict[str, list[int]] = {}  # where each tag is open
    walls: list[int] = [0]  # where blocks are open
    block, unseen, hollow, links, at, size = 0, 0, 0, 0, 0, len(html)
    quoted, last_end = True, html.rfind(">")

    def push(tag: str, node: int, wall: bool) -> None:
        nonlocal unseen, hollow, links
        places.setdefault(tag, []).append(len(stack))
        if wall:
            walls.append(len(stack))
        stack.append((tag, node))
        unseen += tag in UNSEEN
        hollow += tag in HOLLOW
        links += tag == "a"

    def shut(k: int) -> None:
        """Closes the element at place k and all in it."""
        nonlocal unseen, hollow, links
        while len(stack) > k:
            tag = stack.pop()[0]
            places[tag].pop()
            if walls[-1] == len(stack):
                walls.pop()
            unseen -= tag in UNSEEN
            hollow -= tag in HOLLOW
            links -= tag == "a"

    def last(tags: set[str] | frozenset[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(tags: set[str] | frozenset[str], scope: set[str] | frozenset[str]) -> None:
        while (k := last(tags)) > last(scope):
            shut(k)

    def add(text: str) -> None:
        if unseen or not text or text.isspace():
            if text and not unseen and runs and runs[-1][0] == block:
                runs.append((block, stack[-1][1], " "))
            return
        text = unescape(text) if "&" in text else text
        where = stack[-1][1]
        runs.append((block, where, text))
        n = len(text)
        node = nodes[where]
        node.own += n
        node.text += n
        node.linked += n if links else 0
        node.stops += text.count(". ") + text.count(".\n") + text.rstrip().endswith((".", "!", "?"))

    while at < size:
        begin = html.find("<", at)
        if begin < 0:
            add(html[at:])
            break
        if begin > at:
            add(html[at:begin])
        after = html[begin + 1 : begin + 3]
        if after[:1] == "!" and (m := _COMMENT.match(html, begin)):
            at = m.end()
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        if not re.match(r"[!?A-Za-z]|/.", after, re.S):  # a bare "<" is text
            add("<")
            at = begin + 1
            continue
        if begin > last_end:  # nothing ends any more: a broken tag is dropped
            end = html.find("<", begin + 1)
            at = size if end < 0 else end
            continue
        m = _TAG.match(html, begin) if quoted else None
        if m is None and re.match(r"/?[A-Za-z]", after):
            quoted, m = False, _LOOSE.match(html, begin)
        if m is None:  # <!doctype>, <?xml?>, </ >
            at = html.find(">", begin) + 1
            continue
        at = m.end()
        tag = m.group(2)
        tag = tag.lower()
        if m.group(1):
            k = last({tag})
            if k and _is_wall(walls, k):
                block += 1
                shut(k)
            elif k > walls[-1]:  # an inline end tag closes nothing outside its block
                shut(k)
            elif tag == "p" and not k and not hollow:
                block += 1
            continue
        if tag == "br":
            add(" ")
            if runs and runs[-1][0] == block:
                runs.append((block, stack[-1][1], " "))
            continue
        if tag in INLINE or tag in HOLLOW or hollow:
            if tag in RAW:
                end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                at = end.end() if end else size
            elif tag not in VOID and not m.group(0).endswith("/>"):
                push(tag, stack[-1][1], False)
            continue
        block += 1
        if tag in CLOSES_P:
            close({"p"}, {"td", "th", "button", "object", "table"})
        if tag in CLOSED_BY:
            close(CLOSED_BY[tag], SCOPES[tag])
        if tag[0] == "h" and tag[1:].isdigit() and len(stack) > 1 and stack[-1][0] in {"h1", "h2", "h3", "h4", "h5", "h6"}:
            shut(len(stack) - 1)
        if tag == "body":
            close({"head"}, frozenset())
        if tag in VOID:
            continue
        attributes = m.group(3)
        names = []
        if attributes and "=" in attributes:
            names = [t.lower() for found in _NAMES.findall(attributes) for part in found if part for t in _TOKEN.findall(part)]
        node = Node(tag, stack[-1][1], names)
        if labelled:
            y = re.search(r"data-y=(\d)", attributes)
            node.label = int(y[1]) if y else -1
        nodes.append(node)
        nodes[node.parent].paragraphs += tag == "p"
        push(tag, len(nodes) - 1, True)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else size
            shut(len(stack) - 1)
    for node in reversed(nodes[1:]):
        up = nodes[node.parent]
        up.text += node.text
        up.linked += node.linked
        up.stops += node.stops
    return page


def _is_wall(walls: list[int], k: int) -> bool:
    i = bisect_left(walls, k)
    return i < len(walls) and walls[i] == k


def blocks(page: Page, keep: list[bool]) -> list[str]:
    """The kept text of each block, white space as one space, empty blocks left out."""
    out: list[str] = []
    current, parts = -1, []
    for block, node, text in page.runs:
        if not keep[node]:
            continue
        if block != current:
            out.append(" ".join("".join(parts).split()))
            current, parts = block, []
        parts.append(text)
    out.append(" ".join("".join(parts).split()))
    return [x for x in out if x]

"""The readable part of a page by scores of its paragraphs: a small tree, scores handed to ancestors, and the best of these with its like siblings."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .html import _MARK, _PART, comment_end, decoded

#: Elements whose content is no text of the page, and elements beside the main text.
_NO_TEXT = frozenset("script style template svg noscript head title iframe textarea".split())
_BESIDE = frozenset("nav footer aside form header button select".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
#: What the words of class and id speak for.
_AGAINST = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|credits?|disqus|foot\w*|footnote|gdpr|legal|login|masthead|menu|meta|modal|nav\w*|newsletter|outbrain|pag(?:er|ination)|popup|promo\w*|related|replies|rss|shar(?:e|ing)|shoutbox|side\w*|signup|skip|social|sponsor\w*|subscribe|tags?|toolbar|trending|widgets?)(?:$|[\s_-])", re.IGNORECASE)
_FOR = re.compile(r"(?:^|[\s_-])(?:article|blog|body|content|entry|hentry|h-entry|main|page|post|prose|story|text)(?:$|[\s_-])", re.IGNORECASE)
#: What kinds of elements start with.
_BASE = {"article": 10, "main": 10, "section": 3, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "ol": -3, "ul": -3, "dl": -3, "li": -3, "address": -3, "form": -3} | {f"h{k}": -5 for k in range(1, 7)} | {"th": -5}
WEIGHT, SHORTEST, LEAST_SIBLING, SIBLING_SHARE = 25, 25, 10, 0.2


@dataclass
class Node:
    tag: str
    parent: int
    weight: int = 0
    dropped: bool = False
    chars: int = 0  # of text, white space cleaned, with what is below
    linked: int = 0  # of these, inside links
    blocks: int = 0  # block elements below
    marks: int = 0  # tags of elements inside and comments, without what stands in `parts` itself
    score: float = 0.0
    parts: list = field(default_factory=list)  # text and numbers of children, in order


def parse(page: str) -> list[Node]:
    """The elements of a page in order, parents before children. The time is in proportion to the page."""
    nodes = [Node("#page", -1)]
    stack, places, at = [0], {}, 0
    links = 0

    def text(raw: str) -> None:
        nonlocal links
        if raw and raw.strip():
            words = decoded(raw)
            node = nodes[stack[-1]]
            node.parts.append(words)
            n = len(" ".join(words.split()))
            node.chars += n
            node.linked += n if links else 0
        elif raw:
            nodes[stack[-1]].parts.append(" " * len(raw))

    def close(k: int) -> None:
        nonlocal links
        for i in stack[k:]:
            places[nodes[i].tag].pop()
            links -= nodes[i].tag == "a"
        del stack[k:]

    while m := _MARK.search(page, at):
        text(page[at : m.start()])
        if not m[2]:
            at = comment_end(page, m.end()) if m[0] == "<!--" else page.find(">", m.end()) + 1 or len(page)
            nodes[stack[-1]].marks += 1
            continue
        at, found, tag = m.end(), [], m[2].lower()
        while (p := _PART.match(page, at)) and not p[1]:
            at = p.end()
            if p[2].lower() in ("class", "id", "role"):
                found.append(next((x for x in p.groups()[2:] if x is not None), ""))
        at = p.end() if p else len(page)
        if m[1]:
            if places.get(tag):
                close(places[tag][-1])
            nodes[stack[-1]].marks += 1
            continue
        if tag in _NO_TEXT:
            if page[at - 2 : at] != "/>":
                end = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in _VOID:
            nodes[stack[-1]].parts.append("\n" if tag in ("br", "hr") else " ")
            continue
        if tag in _BLOCK and places.get("p"):
            close(places["p"][-1])  # a block ends a paragraph
        if tag == "li" and places.get("li") and places["li"][-1] > max((places[t][-1] for t in ("ul", "ol") if places.get(t)), default=-1):
            close(places["li"][-1])
        words = " ".join(found)
        weight = (WEIGHT if _FOR.search(words) else 0) - (WEIGHT if _AGAINST.search(words) else 0) if words else 0
        nodes.append(Node(tag, stack[-1], weight, tag in _BESIDE or weight < 0))
        nodes[stack[-1]].parts.append(len(nodes) - 1)
        nodes[stack[-1]].marks += 1
        places.setdefault(tag, []).append(len(stack))
        stack.append(len(nodes) - 1)
        links += tag == "a"
    text(page[at:])
    for k in range(len(nodes) - 1, 0, -1):
        n, up = nodes[k], nodes[nodes[k].parent]
        if not n.dropped:
            up.chars += n.chars
            up.linked += n.linked
        up.blocks += n.blocks + (n.tag in _BLOCK)
    return nodes


def density(n: Node) -> float:
    """The share of an element's text that is inside links."""
    return n.linked / n.chars if n.chars else 0.0


def _text(nodes: list[Node], k: int) -> str:
    """The text of an element without what is dropped; blocks are lines."""
    out: list[str] = []
    todo: list = [k]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif not nodes[x].dropped:
            block = nodes[x].tag in _BLOCK
            todo += ["\n"] * block + nodes[x].parts[::-1] + ["\n"] * block
    return "".join(out)


def _size(nodes: list[Node], k: int) -> int:
    """The characters inside an element as they are written there, without what is dropped, each tag and comment as one."""
    n, todo = 0, [k]
    while todo:
        node = nodes[todo.pop()]
        n += node.marks + sum(len(x) for x in node.parts if isinstance(x, str))
        todo += [x for x in node.parts if not isinstance(x, str) and not nodes[x].dropped]
    return n


def scored(nodes: list[Node]) -> list[Node]:
    """Elements with the scores that paragraphs below have handed them: the parent all of it, the one above half, others a share that falls with the distance."""
    given = [False] * len(nodes)
    hidden = [False] * len(nodes)
    for k, n in enumerate(nodes):
        hidden[k] = n.dropped or (n.parent >= 0 and hidden[n.parent])
        if hidden[k] or n.tag not in _BLOCK or n.blocks or n.chars < SHORTEST:
            continue
        words = _text(nodes, k)
        points = 1 + words.count(",") + words.count("，") + words.count("、") + min(n.chars // 100, 3)
        up, far = n.parent, 1
        while up >= 0 and far <= 4:
            if not given[up]:
                given[up], nodes[up].score = True, _BASE.get(nodes[up].tag, 0) + nodes[up].weight
            nodes[up].score += points / (1 if far == 1 else 2 if far == 2 else far * 3)
            up, far = nodes[up].parent, far + 1
    for k, n in enumerate(nodes):
        n.score = n.score * (1 - density(n)) if given[k] else 0.0
    return nodes


def readable(page: str) -> str | None:
    """The main text of a page, its blocks on lines of their own; where no paragraph is long enough to tell, its only article or else its only `main`; None where there is none."""
    return measured(page)[0]


def measured(page: str) -> tuple[str | None, int]:
    """The same, and how long it is in the page, each tag as one character: lines that are added here do not make a text longer."""
    nodes = scored(parse(page))
    best = max(range(len(nodes)), key=lambda k: (nodes[k].score, -k))
    if nodes[best].score <= 0:
        named = [[k for k, n in enumerate(nodes) if n.tag == tag and not n.dropped] for tag in ("article", "main")]
        only = next((x[0] for x in named if len(x) == 1 and nodes[x[0]].chars), None)  # what the page itself says is its text
        return (None, 0) if only is None else (_text(nodes, only), _size(nodes, only))
    top, least = nodes[best], max(LEAST_SIBLING, SIBLING_SHARE * nodes[best].score)

    def joins(k: int) -> bool:
        n = nodes[k]
        if k == best:
            return True
        if n.dropped or n.tag not in _BLOCK:
            return False
        if n.score >= least:
            return True
        return n.tag == "p" and (density(n) < 0.25 if n.chars > 80 else n.linked == 0 and _text(nodes, k).rstrip().endswith((".", "!", "?", "。")))

    # inside, lists and boxes that are mostly links are menus
    for k, n in enumerate(nodes):
        if k != best and n.tag in ("ul", "ol", "dl", "div", "section", "table") and n.chars and density(n) > 0.5 and n.score < least:
            n.dropped = True
    if best == 0:
        return _text(nodes, 0), _size(nodes, 0)
    chosen = [k for k in nodes[top.parent].parts if isinstance(k, int) and joins(k)]
    return "".join(_text(nodes, k) for k in chosen), sum(_size(nodes, k) for k in chosen)

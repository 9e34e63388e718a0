"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page's tree.

A block is a run of text that no block-level tag interrupts. Its features are its ancestors' tags,
the words of their class, id and role attributes, and the look of its text. The field has two
states, main text and anything else; it is trained on labelled pages by gradient steps on the conditional
likelihood (forward and backward sums over all pages at once) and decoded by Viterbi.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, table
from .html_pages import MAIN, OTHER, labelled_page

#: Pages trained on, gradient steps, weight decay.
TRAINING_PAGES, STEPS, DECAY = 700, 160, 2e-4
#: Bytes of pages that are read together.
SLICE_BYTES = 8_000_000

_OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
#: The end of a tag, or a quoted value in it.
_STOP = re.compile(r""">|=\s*(["'])""")
#: The rest of a comment after its opening: `>` or `->` at once, or up to its end.
_COMMENT = re.compile(r"-?>|.*?--!?>", re.DOTALL)
#: Ancestors that a block keeps: the outermost and the innermost ones.
_OUTER, _INNER = 8, 56
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html input label legend li main menu nav noscript ol "
    "optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul video audio canvas".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style template svg iframe noembed noframes xmp".split())
_HIDDEN = frozenset(["head", "title"])
#: Start tags that end an open element of these kinds.
_ENDS = {t: ("p",) for t in "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()}
_ENDS |= {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",), "body": ("head",)}
_BARRIER = {"li": frozenset(["ul", "ol", "menu"]), "tr": frozenset(["table"]), "td": frozenset(["table", "tr"]), "th": frozenset(["table", "tr"])}


@dataclass
class Block:
    text: str
    path: tuple[tuple[str, tuple[str, ...]], ...]  # tag and words of its attributes, from the root
    linked: int  # characters inside links


def tag_end(page: str, at: int) -> int:
    """Where the tag whose name ends at `at` ends, its `>` included; -1 if it does not. A quote that is never closed is an ordinary character."""
    while True:
        m = _STOP.search(page, at)
        if not m:
            return -1
        if not m[1]:
            return m.end()
        close = page.find(m[1], m.end())
        if close < 0:
            return page.find(">", m.end()) + 1 or -1
        at = close + 1


def blocks_of(page: str) -> list[Block]:
    """The blocks that have text, in page order. The time is in proportion to the page, however broken its markup is."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    places: dict[str, list[int]] = {}  # where in the stack the elements of each tag are
    walls: list[int] = []  # where the block elements are that are no paragraphs
    held: list[str] = []
    path: tuple = ()
    linked = 0
    at, end = 0, len(page)
    raw_end: dict[str, re.Pattern] = {}

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(held).split())
        if text:
            out.append(Block(text, path, linked))
        held.clear()
        linked = 0

    def put(raw: str) -> None:
        nonlocal path, linked
        if not any(t in _HIDDEN for t, _ in stack[:3]):
            text = html.unescape(raw) if "&" in raw else raw
            if not held or not path:
                path = tuple(stack if len(stack) <= _OUTER + _INNER else stack[:_OUTER] + stack[-_INNER:])
            held.append(text)
            if places.get("a"):
                linked += len(text)

    def close(k: int) -> None:
        for t, _ in stack[k:]:
            places[t].pop()  # the last is the innermost, and all above k go
        while walls and walls[-1] >= k:
            walls.pop()
        del stack[k:]

    while at < end:
        m = _OPEN.search(page, at)
        if not m:
            put(page[at:])
            break
        if m.start() > at:
            put(page[at : m.start()])
        if not m[2]:  # a comment or a declaration
            if m[0] == "<!--":
                rest = _COMMENT.match(page, m.end())
                at = rest.end() if rest else end
                continue
            at = page.find(">", m.end()) + 1
            if not at:
                put(page[m.start() :])
                break
            continue
        at = tag_end(page, m.end())
        if at < 0:
            put(page[m.start() :])
            break
        inside = page[m.end() : at - 1]
        tag = m[2].lower()
        if tag in _BLOCK:
            flush()
        elif tag == "br":
            held.append(" ")
            continue
        if m[1]:
            if places.get(tag):
                close(places[tag][-1])
            continue
        if tag in _RAW:
            if not inside.rstrip().endswith("/"):
                pattern = raw_end.setdefault(tag, re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE))
                stop = pattern.search(page, at)
                at = (page.find(">", stop.end()) + 1 or end) if stop else end
            continue
        if tag in _VOID:
            continue
        ended = [t for t in _ENDS.get(tag, ()) if places.get(t)]
        if ended:
            if tag in _BARRIER:
                wall = max((places[t][-1] for t in _BARRIER[tag] if places.get(t)), default=-1)
            else:  # the innermost block that is not ended itself; those above it are ended, so each is looked at once
                wall = next((k for k in reversed(walls) if stack[k][0] not in ended), -1)
            beyond = [places[t][bisect_right(places[t], wall)] for t in ended if places[t][-1] > wall]
            if beyond:
                close(min(beyond))
        words: tuple[str, ...] = ()
        if "=" in inside:
            words = tuple({w.lower() for a in _ATTR.findall(inside) for w in _NAME.findall(a[1] or a[2] or a[3])})
        places.setdefault(tag, []).append(len(stack))
        if tag in _BLOCK and tag != "p":
            walls.append(len(stack))
        stack.append((tag, words))
    flush()
    return out


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of the features that hold for each block."""
    out = []
    n = len(blocks)
    for i, b in enumerate(blocks):
        f = ["bias"]
        tags = [t for t, _ in b.path if t not in ("html", "body")]
        f += {f"in:{t}" for t in tags}
        words = {w for _, ws in b.path for w in ws}
        f += [f"word:{w}" for w in words]
        if tags:
            f.append(f"own:{tags[-1]}")
        kinds = [t for t in tags if t in ("article", "main", "nav", "header", "footer", "aside", "form", "section")]
        f.append("nearest:" + (kinds[-1] if kinds else "none"))
        if len(kinds) > 1:
            f.append(f"within:{kinds[-2]}>{kinds[-1]}")
        near = next((ws for _, ws in reversed(b.path) if ws), ())
        f += [f"near:{w}" for w in near]
        size = len(b.text)
        f.append(f"size:{min(size, 1000).bit_length()}")
        f.append("links:" + ("all" if b.linked >= 0.9 * size else "half" if b.linked > 0.4 * size else "some" if b.linked else "none"))
        f.append("ends:" + ("stop" if b.text[-1] in ".!?…。" else "other"))
        if "©" in b.text:
            f.append("copyright")
        if i == 0:
            f.append("first")
        if i == n - 1:
            f.append("last")
        out.append(f)
    return out


@dataclass
class Field:
    """Weights: of each feature for each state, of neighbouring states, of the first and the last state."""

    names: dict[str, int]
    emit: np.ndarray
    move: np.ndarray
    ends: np.ndarray

    def scores(self, feats: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(feats), 2))
        for i, f in enumerate(feats):
            k = [self.names[x] for x in f if x in self.names]
            out[i] = self.emit[k].sum(0)
        return out

    def decode(self, feats: list[list[str]]) -> list[int]:
        """The most likely states (Viterbi)."""
        if not feats:
            return []
        s = self.scores(feats).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = s[0][0] + self.ends[0, 0], s[0][1] + self.ends[0, 1]
        back = []
        for x, y in s[1:]:
            from_a, from_b = a + m00 >= b + m10, a + m01 >= b + m11
            back.append((0 if from_a else 1, 0 if from_b else 1))
            a, b = x + (a + m00 if from_a else b + m10), y + (a + m01 if from_b else b + m11)
        state = int(b + self.ends[1, 1] > a + self.ends[1, 0])
        out = [state]
        for step in reversed(back):
            state = step[state]
            out.append(state)
        return out[::-1]


def fit(pages: list[tuple[list[list[str]], list[int]]], steps: int = STEPS, decay: float = DECAY) -> Field:
    """Maximise the conditional likelihood of the labels (Adam on its gradient, all pages at once)."""
    count: dict[str, int] = {}
    for feats, _ in pages:
        for f in feats:
            for x in f:
                count[x] = count.get(x, 0) + 1
    names = {x: k for k, x in enumerate(sorted(x for x, n in count.items() if n >= 3))}
    total, longest = len(pages), max(len(y) for _, y in pages)
    owner, cell = [], []
    gold = np.zeros((total, longest), np.int64)
    mask = np.zeros((total, longest), bool)
    for p, (feats, y) in enumerate(pages):
        gold[p, : len(y)] = y
        mask[p, : len(y)] = True
        for t, f in enumerate(feats):
            mine = [names[x] for x in f if x in names]
            owner += mine
            cell += [p * longest + t] * len(mine)
    owner, cell = np.array(owner), np.array(cell)
    length = mask.sum(1)
    last = (np.arange(total), length - 1)
    w = {"emit": np.zeros((len(names), 2)), "move": np.zeros((2, 2)), "ends": np.zeros((2, 2))}
    first_moment, second_moment = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    one_hot = np.eye(2)[gold] * mask[:, :, None]
    pair = mask[:, 1:]
    gold_moves = np.einsum("pti,ptj->ij", one_hot[:, :-1], one_hot[:, 1:] * pair[:, :, None])
    gold_ends = np.stack([one_hot[:, 0].sum(0), one_hot[last].sum(0)])
    add = lambda x: np.logaddexp(x[..., 0, :], x[..., 1, :])
    for step in range(1, steps + 1):
        s = np.stack([np.bincount(cell, w["emit"][owner, c], minlength=total * longest) for c in (0, 1)], 1).reshape(total, longest, 2)
        fwd, bwd = np.zeros_like(s), np.zeros_like(s)
        fwd[:, 0] = s[:, 0] + w["ends"][0]
        for t in range(1, longest):
            fwd[:, t] = s[:, t] + add(fwd[:, t - 1][:, :, None] + w["move"])
        for t in range(longest - 1, -1, -1):
            closes = np.broadcast_to(w["ends"][1], (total, 2))
            if t == longest - 1:
                bwd[:, t] = closes
            else:
                onward = add((w["move"] + (s[:, t + 1] + bwd[:, t + 1])[:, None, :]).transpose(0, 2, 1))
                bwd[:, t] = np.where((length - 1 == t)[:, None], closes, onward)
        z = np.logaddexp(*(fwd[last] + w["ends"][1]).T)
        node = np.exp(fwd + bwd - z[:, None, None]) * mask[:, :, None]
        edge = np.exp(fwd[:, :-1, :, None] + w["move"] + (s + bwd)[:, 1:, None, :] - z[:, None, None, None]) * pair[:, :, None, None]
        gap = (one_hot - node).reshape(-1, 2)
        grad = {
            "emit": np.stack([np.bincount(owner, gap[cell, c], minlength=len(names)) for c in (0, 1)], 1),
            "move": gold_moves - edge.sum((0, 1)),
            "ends": gold_ends - np.stack([node[:, 0].sum(0), node[last].sum(0)]),
        }
        for k in w:
            g = grad[k] / total - decay * w[k]
            first_moment[k] = 0.9 * first_moment[k] + 0.1 * g
            second_moment[k] = 0.99 * second_moment[k] + 0.01 * g * g
            w[k] += 0.15 * (first_moment[k] / (1 - 0.9**step)) / (np.sqrt(second_moment[k] / (1 - 0.99**step)) + 1e-8)
    return Field(names, w["emit"], w["move"], w["ends"])


def labelled(page: str) -> tuple[list[list[str]], list[int]]:
    """Features and labels of a page whose texts begin with their marks."""
    blocks = blocks_of(page)
    y = [int(b.text[0] == MAIN) for b in blocks]
    for b in blocks:
        b.text = b.text.replace(MAIN, "").replace(OTHER, "").strip() or "x"
    return features(blocks), y


@lru_cache(maxsize=2)
def trained(pages: int = TRAINING_PAGES) -> Field:
    made = [labelled(labelled_page(seed)) for seed in range(pages)]
    return fit([p for p in made if p[1]])


def main_text(page: str, field: Field) -> str:
    blocks = blocks_of(page)
    return "\n\n".join(b.text for b, s in zip(blocks, field.decode(features(blocks)), strict=True) if s)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The columns page_id and url of each row of `pages`, with text and n_chars (its code points).

    Null or empty html, and pages without main text, give an empty text. Null ids and urls are kept; equal rows give
    equal rows; an empty table gives none. A page is read in time in proportion to its length, whatever its markup. Other columns are not looked at, whatever their names.
    """
    field = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches):
        for b in (x for batch in batches for x in by_bytes(batch, 2, SLICE_BYTES)):
            texts = [main_text(p or "", field.value) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", F.col(html_col)).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op5_html(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))

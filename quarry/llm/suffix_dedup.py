"""Repeated substrings: a sparse suffix array of anchors, scanned as a tree of common-prefix intervals.

Anchors are places that the bytes around them choose: the start of the K-byte string with the smallest
hash among all that lie in a window of LENGTH bytes. Two equal windows choose the same place, so
every repeat of LENGTH bytes or more holds an anchor that it shares with its other occurrence, and only
one position in about 170 has to be sorted. Anchors whose K bytes occur once are dropped.

The suffixes at the anchors are sorted with what follows them (up to LENGTH bytes); anchors with the
same K bytes are next to each other. A stack scan over the lengths of common prefixes of neighbours lists the
intervals of the suffix array, deepest first. Within an interval of depth R, the occurrences are sorted by
what precedes them; where that differs, the left extension ends. Occurrences that share L bytes to
the left with L + R >= LENGTH are a maximal repeat group: each of them, not only neighbours in the array, is covered
from L before to R after its anchor.

An anchor stands for the windows that choose it, and only what those windows span is kept of its surroundings. Lines and
passages that very many texts share give anchors with the same surroundings again and again. Of those that agree in all that
is kept, two stand for the rest in each task, before anything is exchanged: the rest are covered as far as can be, and as
partners of others the two do as well.

An anchor with more than HOT occurrences is not scanned in one task. Its windows are dealt into blocks of neighbours, each with
what those windows span, and occurrences meet only if they agree in what all windows of a block have in common (288 of 400
bytes, then 384, then all): so sorting goes on by longer prefixes, bucket by bucket, until a bucket is small enough to be scanned.
At the last step a bucket is one interval, and two of each task stand for it.

With `words`, as many whole words in a row (white space between and around them, or the text's ends) are a repeat as well,
however few their bytes. Each window of so many words chooses an anchor among its word starts by the same hashes, and the
windows of LENGTH bytes choose only where they do not hold so many words. Words in a row that span LENGTH bytes or more are
found as bytes, and fewer bytes lie within what is kept of an anchor's surroundings, so both rules are exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, discard, mix64, released, store, table, whole_rows

LENGTH, K = 400, 64
#: Whole words in a row that are a passage, where words count: over 50.
PASSAGE_WORDS = 51
#: Occurrences of an anchor that are scanned together; a bound of a task's memory that does not change what is found.
HOT = 5000
#: Surroundings that a task remembers (a bound of its memory: beyond it, more than two may be sent on).
MOST_MET = 200_000
#: Bytes of text whose hashes are computed together.
SLICE = 1 << 19
#: Bytes of a text above which its anchors are looked for in parts.
CHUNK = 1 << 22

#: ASCII white space, as bytes.split() has it.
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_OTHER_SPACES = [bytes([c]) for c in b"\t\n\v\f\r"]
_ALL_SPACES = {b" ", *_OTHER_SPACES}
_SPACES, _WORDS = re.compile(rb"[\t-\r ]"), re.compile(rb"[^\t-\r ]+")

_rng = np.random.default_rng(41)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _rng.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the `k` bytes (a power of two) from each position."""
    h, n, step = _BYTE[data], 1, 0
    while n < k:
        h = (h[:-n] ^ (h[:-n] >> np.uint64(29))) * _STEP[step] + h[n:]
        n, step = 2 * n, step + 1
    return mix64(h)


def _minima(keys: np.ndarray, window: int) -> np.ndarray:
    """The smallest of each `window` keys in a row."""
    n = len(keys) - window + 1
    padded = np.full(-(-len(keys) // window) * window, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, window)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[window - 1 : window - 1 + n])


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, k: int = K, words: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the anchors of texts that lie one after another in `data`, the hashes there, and how far the windows that chose each reach to its left and right."""
    none = np.zeros(0, np.int64)
    if len(data) < (min(length, 2 * words - 1) if words else length):
        return none, np.zeros(0, np.uint64), none, none
    bits = np.uint64(int(len(data)).bit_length())
    mask = (np.uint64(1) << bits) - np.uint64(1)
    h = _hashes(data, k)
    keys = (h & ~mask) | np.arange(len(h), dtype=np.uint64)  # of equal hashes in a window, the first
    window = length - k + 1
    valid = np.zeros(max(0, len(keys) - window + 1), bool)
    start = 0
    for end in ends.tolist():
        keys[max(start, end - k + 1) : end] = np.iinfo(np.uint64).max  # would reach into the next text
        valid[start : max(start, end - length + 1)] = True
        start = end
    begins = np.flatnonzero(valid)
    chosen = _minima(keys, window)[begins] if len(begins) else np.zeros(0, np.uint64)
    spans = []
    if words:
        by_word, opens, closes, first_word, held = _word_anchors(data, ends, keys, length, k, words)
        within = held[begins]
        chosen[within] = by_word[first_word[begins[within]]]
        short = np.flatnonzero((closes - opens < length) & (by_word != np.iinfo(np.uint64).max))
        spans.append((by_word[short], opens[short], closes[short]))
    spans.append((chosen, begins, begins + length))
    # windows that choose one place follow each other, but for those that choose it by their words
    runs = []
    for place, start, end in spans:
        edge = np.flatnonzero(np.r_[True, place[1:] != place[:-1]][: len(place)])
        runs.append((place[edge], start[edge], end[np.r_[edge[1:], len(place)] - 1] if len(edge) else end))
    place, start, end = (np.concatenate(x) for x in zip(*runs, strict=True))
    place = (place & mask).astype(np.int64)
    order = np.argsort(place, kind="stable")
    place, start, end = place[order], start[order], end[order]
    edge = np.flatnonzero(np.r_[True, place[1:] != place[:-1]][: len(place)])
    if not len(edge):
        return none, np.zeros(0, np.uint64), none, none
    places = place[edge]
    return places, h[places], places - np.minimum.reduceat(start, edge), np.maximum.reduceat(end, edge) - places


def _word_anchors(data: np.ndarray, ends: np.ndarray, keys: np.ndarray, length: int, k: int, words: int) -> tuple[np.ndarray, ...]:
    """For each `words` words in a row the smallest key at a word start (the largest number if there is none), their begin and end;
    for each window of `length` bytes the first of its whole words, and whether it holds so many."""
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[np.r_[0, ends]] = True
    opens = solid & (edge[:-1] | ~np.r_[False, solid[:-1]])
    begin = np.flatnonzero(opens)
    close = np.flatnonzero(solid & (edge[1:] | ~np.r_[solid[1:], False])) + 1
    n = max(0, len(begin) - words + 1)
    # counted by what the window itself shows: white space stands before the first and after the last
    next_word = np.cumsum(opens)
    last = np.r_[close[words - 1 :], np.full(words, np.iinfo(np.int64).max)][np.minimum(next_word, n)]
    held = last < np.arange(len(data)) + length
    out = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    doc = np.searchsorted(ends, begin, side="right")
    first = np.flatnonzero(doc[:n] == doc[words - 1 :]) if n else np.zeros(0, np.int64)
    if len(first):
        past = np.searchsorted(begin, close[first + words - 1] - k, side="right")
        span = past - first
        level, found = np.r_[keys, np.full(k - 1, np.iinfo(np.uint64).max, np.uint64)][begin], np.zeros(len(first), np.uint64)
        size = 1
        while size <= span.max():
            mine = (span >= size) & (span < 2 * size)
            found[mine] = np.minimum(level[first[mine]], level[past[mine] - size])
            level, size = np.minimum(level[: len(level) - size], level[size:]), 2 * size
        out[first] = found
    return out, begin[:n], close[words - 1 :][:n], next_word, held


def _chunks(text: bytes, length: int, chunk: int) -> Iterator[tuple[int, bytes]]:
    """A very long text in overlapping parts, each with its place: every window is whole in one of them. Parts begin and end at white
    space, or within a run of bytes without any that is longer than what windows of words can span."""
    if len(text) <= chunk:
        yield 0, text
        return

    def near(at: int) -> int:
        m = _SPACES.search(text, at, at + chunk)
        return m.start() if m else at

    at = 0
    while at < len(text):
        onward = min(len(text), near(at + chunk))
        end = near(onward + length + 1)
        yield at, text[at:end]
        at = onward


def anchors_of(texts: list[bytes], length: int, k: int, words: int, chunk: int = CHUNK) -> tuple[np.ndarray, ...]:
    """How many anchors each text has, and of all anchors the positions, the hashes, and the reaches to the left and right, packed into one number."""
    owner, offset, parts = [], [], []
    for i, t in enumerate(texts):
        for at, part in _chunks(t, length, chunk):
            owner.append(i)
            offset.append(at)
            parts.append(part)
    owner, offset = np.array(owner, np.int64), np.array(offset, np.int64)
    found = [(np.zeros(0, np.int64),) * 5]
    first = size = 0
    for n, part in enumerate(parts):
        size += len(part)
        if size >= SLICE or n == len(parts) - 1:
            some = parts[first : n + 1]
            ends = np.cumsum([len(x) for x in some])
            at, h, to_left, to_right = anchors(np.frombuffer(b"".join(some), np.uint8), ends, length, k, words)
            mine = np.searchsorted(ends, at, side="right")
            begin = ends[mine] - np.array([len(x) for x in some])[mine] if len(at) else at
            found.append((owner[first + mine], at - begin + offset[first + mine], h.view(np.int64), to_left, to_right))
            first, size = n + 1, 0
    doc, at, h, to_left, to_right = (np.concatenate(x) for x in zip(*found, strict=True))
    if len(parts) > len(texts):  # an anchor near a border is met in two parts, with the windows of each
        order = np.lexsort((at, doc))
        doc, at, h, to_left, to_right = (x[order] for x in (doc, at, h, to_left, to_right))
        edge = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])][: len(doc)])
        if len(edge):
            to_left, to_right = np.maximum.reduceat(to_left, edge), np.maximum.reduceat(to_right, edge)
        doc, at, h = doc[edge], at[edge], h[edge]
    return np.bincount(doc, minlength=len(texts)), at, h, to_left * (length + 1) + to_right


def _scanned(rows: DataFrame, length: int, k: int, words: int) -> DataFrame:
    """For each text its digest, its size, whether it is long enough to be a repeat, and its anchors."""

    def run(batches):
        for b in (x for batch in batches for x in by_bytes(batch, 1, 8 * SLICE)):
            raw = b.column(1).cast(pa.large_binary()).fill_null(b"")
            texts = raw.to_pylist()
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            counts, *found = anchors_of(texts, length, k, words)
            offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
            at, h, reach = (pa.ListArray.from_arrays(offsets, pa.array(x.astype(t))) for x, t in zip(found, (np.int32, np.int64, np.int32), strict=True))
            sha = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            enough = pa.array([len(t) >= length or 0 < words <= len(t.split()) for t in texts], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), enough, sha, at, h, reach], names=["id", "n_bytes", "enough", "sha", "at", "h", "reach"])

    return rows.mapInArrow(released(run), "id long, n_bytes long, enough boolean, sha binary, at array<int>, h array<long>, reach array<int>")


#: What is kept of an occurrence: what follows the anchor, and what precedes it, backwards; the windows that count lie in both together.
#: With words, a byte more on each side; `ends` says where there is none (1: the text ends, 2: it begins). Or a span that is known to repeat.
_CONTEXT = {"key": pa.int64(), "sha": pa.binary(), "at": pa.int32(), "right": pa.binary(), "left": pa.binary(), "ends": pa.int32(), "start": pa.int64(), "end": pa.int64(), "by_words": pa.bool_()}
_CONTEXT_SQL = "key long, sha binary, at int, right binary, left binary, ends int, start long, end long, by_words boolean"


class _Sender:
    """Collects occurrences; of those of a task that agree in all that is kept, the third and later ones become spans."""

    def __init__(self, length: int, words: int):
        self.length, self.beside, self.met, self.cols = length, int(words > 0), {}, {n: [] for n in _CONTEXT}

    def send(self, key: int, sha: bytes, at: int, data: bytes, p: int, to_left: int, to_right: int, begins: bool, ends: bool) -> None:
        """`data` holds the anchor at `p`; it begins and ends with its text, or goes on by a byte at least where words count."""
        first, last = p - to_left - self.beside, p + to_right + self.beside
        flags = (2 if first < 0 and begins else 0) + (1 if last > len(data) and ends else 0)
        first, last = max(first, 0), min(last, len(data))
        around = xxhash.xxh3_128_digest(data[first:last], seed=(key * 5 + flags * 2048 + p - first) & 0xFFFFFFFFFFFFFFFF)
        seen = self.met[around] = self.met.get(around, 0) + 1
        if seen <= 2:
            row = (key, sha, at, data[p:last], data[first:p][::-1], flags, None, None, None)
        else:
            row = (int.from_bytes(sha[:8], "little", signed=True), sha, at, None, None, None, at - to_left, at + to_right, to_left + to_right < self.length)
        for n, v in zip(self.cols, row, strict=True):
            self.cols[n].append(v)

    def full(self) -> bool:
        return len(self.cols["key"]) > 5000

    def take(self) -> pa.RecordBatch:
        if len(self.met) > MOST_MET:
            self.met.clear()
        out, self.cols = self.cols, {n: [] for n in _CONTEXT}
        return pa.RecordBatch.from_arrays([pa.array(v, _CONTEXT[n]) for n, v in out.items()], names=list(out))


def steps(length: int, k: int, words: int) -> list[tuple[int, int]]:
    """How many neighbouring windows share a block, of bytes and of words, from the first deal of a crowded anchor to the last."""
    n = length - k + 1
    return sorted({(n // 3 + 1, words // 3 + 1), (n // 20 + 1, words // 12 + 1), (1, 1)}, reverse=True)


def blocks(data: bytes, p: int, to_left: int, to_right: int, begins: bool, ends: bool, step: tuple[int, int], length: int, k: int, words: int) -> Iterator[tuple[int, int, int]]:
    """(key, reach to the left, to the right) of the blocks of the windows around the anchor at `p`; equal windows are in blocks with equal keys."""
    low, high = max(0, length - to_right), min(length - k, to_left)  # how far before the anchor windows begin
    size = step[0]
    for j in range(low // size, high // size + 1) if low <= high else ():
        top = min(j * size + size - 1, length - k)
        key = xxhash.xxh3_64_intdigest(data[p - j * size : p - top + length], seed=j)
        yield key - (1 << 63), min(high, top), length - max(low, j * size)
    if not words:
        return
    first, last = max(0, p - to_left - 1), min(len(data), p + to_right + 1)
    at = [(first + m.start(), first + m.end()) for m in _WORDS.finditer(data[first:last])]
    if at and at[0][0] == first and not (begins and first == 0):
        del at[0]  # it may begin before
    if at and at[-1][1] == last and not (ends and last == len(data)):
        del at[-1]
    q = next((i for i, (b, _) in enumerate(at) if b == p), None)
    if q is None:
        return
    size, found = step[1], {}
    for t in range(max(0, q + words - len(at)), min(words - 1, q) + 1):
        if at[q - t + words - 1][1] >= p + k and at[q - t + words - 1][1] - at[q - t][0] < length:
            found.setdefault(t // size, []).append(t)
    for j, ts in found.items():
        top = min(j * size + size - 1, words - 1)
        key = xxhash.xxh3_64_intdigest(data[at[q - j * size][0] : at[q - top + words - 1][1]], seed=length + j)
        yield key - (1 << 63), p - at[q - ts[-1]][0], at[q - ts[0] + words - 1][1] - p


def _contexts(texts: DataFrame, length: int, k: int, words: int) -> DataFrame:
    """What stands around each repeated anchor, by its hash; of a crowded one, by the first deal's blocks."""

    def run(batches):
        out = _Sender(length, words)
        for batch in batches:
            for b in by_bytes(batch, 1, SLICE):
                for sha, text, at, hs, reach, hot in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    data = text.encode()
                    for p, h, r, crowded in zip(at, hs, reach, hot, strict=True):
                        to_left, to_right = divmod(r, length + 1)
                        if crowded:
                            for key, lo, hi in blocks(data, p, to_left, to_right, True, True, steps(length, k, words)[0], length, k, words):
                                out.send(key, sha, p, data, p, lo, hi, True, True)
                        else:
                            out.send(h, sha, p, data, p, to_left, to_right, True, True)
                    if out.full():
                        yield out.take()
        yield out.take()

    return texts.select("sha", "text", "at", "h", "reach", "hot").mapInArrow(released(run), _CONTEXT_SQL)


def _dealt(rows: DataFrame, step: tuple[int, int], length: int, k: int, words: int) -> DataFrame:
    """Occurrences of buckets that were too large, by the blocks of the next step."""

    def run(batches):
        out = _Sender(length, words)
        for b in batches:
            for sha, at, right, left, flags in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data, p, begins, ends = left[::-1] + right, len(left), bool(flags & 2), bool(flags & 1)
                to_left, to_right = len(left) - (words > 0 and not begins), len(right) - (words > 0 and not ends)
                for key, lo, hi in blocks(data, p, to_left, to_right, begins, ends, step, length, k, words):
                    out.send(key, sha, at, data, p, lo, hi, begins, ends)
                if out.full():
                    yield out.take()
        yield out.take()

    return rows.select("sha", "at", "right", "left", "ends").mapInArrow(released(run), _CONTEXT_SQL)


def _matrix(rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows of one matrix, and their lengths."""
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    joined = b"".join([r.ljust(width, b"\0") for r in rows])
    return np.frombuffer(joined, np.uint8).reshape(len(rows), width), lengths


def _common(a: np.ndarray, a_len: np.ndarray, b: np.ndarray, b_len: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of the rows of two matrices."""
    differs = a != b
    first = np.where(differs.any(1), differs.argmax(1), a.shape[1])
    return np.minimum(first, np.minimum(a_len, b_len))


def _prefix(a: bytes, b: bytes) -> int:
    """The length of what two byte strings begin with in common."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax())


def _reach(shared: np.ndarray) -> np.ndarray:
    """The larger of what each row shares with the one before and the one after."""
    out = np.zeros(len(shared) + 1, np.int64)
    out[:-1] = shared
    np.maximum(out[1:], shared, out=out[1:])
    return out


def intervals(common: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of the intervals of a suffix array, from the common prefixes of neighbours, each before those around it."""
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*common, -1]):
        first = i
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            yield d, first, i
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def cover(right: list[bytes], left: list[bytes], length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """How far each occurrence of an anchor is covered to the left and to the right (0, 0 if it is not).

    `right` is sorted; occurrences that tie are sorted by `left`.
    """
    n = len(right)
    far_left, far_right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n == 2:  # the tree is one interval
        both, depth = _prefix(*left), _prefix(*right)
        if both + depth >= length:
            far_left[:], far_right[:] = both, depth
        return far_left, far_right
    rights, right_len = _matrix(right, max(map(len, right)))
    lefts, left_len = _matrix(left, max(1, max(map(len, left))))
    depth = _common(rights[1:], right_len[1:], rights[:-1], right_len[:-1])
    # of occurrences that agree in all that is looked at, two stand for the rest: they reach as far as any
    same = np.r_[False, (depth == right_len[1:]) & (depth == right_len[:-1]) & (left_len[1:] == left_len[:-1]) & (lefts[1:] == lefts[:-1]).all(1)]
    kept = np.flatnonzero(~(same & np.r_[False, same[:-1]]))
    stands = np.searchsorted(kept, np.arange(n), side="right") - 1
    order_left = np.zeros(len(kept), np.int64)
    order_left[sorted(range(len(kept)), key=lambda i: left[kept[i]])] = np.arange(len(kept))
    lo, ro = np.zeros(len(kept), np.int64), np.zeros(len(kept), np.int64)
    # between kept neighbours only rows that equal the one before were left out
    between = _common(rights[kept[1:]], right_len[kept[1:]], rights[kept[:-1]], right_len[kept[:-1]])
    for d, first, last in intervals(between.tolist()):
        need = length - d
        if need > length - k:
            continue
        inside = np.arange(first, last + 1)
        if (ro[inside] > 0).all() and (lo[inside] == left_len[kept[inside]]).all():
            continue  # nothing here can reach farther
        inside = inside[np.argsort(order_left[inside], kind="stable")]
        rows = kept[inside]
        shared = _common(lefts[rows[1:]], left_len[rows[1:]], lefts[rows[:-1]], left_len[rows[:-1]])
        reach = _reach(shared)
        ok = reach >= need
        hit = inside[ok]
        lo[hit] = np.maximum(lo[hit], reach[ok])
        ro[hit] = np.maximum(ro[hit], d)
    return lo[stands], ro[stands]


def cover_words(right: list[bytes], left: list[bytes], ends: list[int], words: int) -> list[tuple[int, int] | None]:
    """For each occurrence of an anchor where the repeats of at least `words` whole words around it begin and end, from the anchor."""
    if len(right) == 2:
        return [_pair_words(right, left, ends, words)] * 2
    # white space is written twice, first as any and then as itself, and a text's end as any: so
    # words end alike before different white space, but go on alike only after the same
    right, left = [_wide(t, e & 1) for t, e in zip(right, ends, strict=True)], [_wide(t, e & 2) for t, e in zip(left, ends, strict=True)]
    order = sorted(range(len(right)), key=lambda i: (right[i], left[i]))
    # of occurrences that agree in all, two stand for the rest
    kept, stands = [], np.zeros(len(right), np.int64)
    for n, i in enumerate(order):
        same = [n >= m and right[order[n - m]] == right[i] and left[order[n - m]] == left[i] for m in (1, 2)]
        if not all(same):
            kept.append(i)
        stands[i] = len(kept) - 1
    out: list[tuple[int, int] | None] = [None] * len(right)
    rights, right_len = _matrix([right[i] for i in kept], max(map(len, right)))
    lefts, left_len = _matrix([left[i] for i in kept], max(1, max(map(len, left))))
    inner = ~_SPACE[rights[:, 0]]
    closed = np.cumsum(_SPACE[rights] & ~np.c_[np.zeros(len(kept), bool), _SPACE[rights[:, :-1]]] & (np.arange(rights.shape[1]) > 0), axis=1, dtype=np.int16)
    opened = np.c_[np.zeros(len(kept), np.int16), np.cumsum(_SPACE[lefts] & np.c_[inner, ~_SPACE[lefts[:, :-1]]], axis=1, dtype=np.int16)]
    order_left = np.zeros(len(kept), np.int64)
    order_left[sorted(range(len(kept)), key=lambda i: left[kept[i]])] = np.arange(len(kept))
    lo, ro = np.zeros(len(kept), np.int64), np.zeros(len(kept), np.int64)
    for d, first, last in intervals(_common(rights[1:], right_len[1:], rights[:-1], right_len[:-1]).tolist()):
        if not d:
            continue
        inside = np.arange(first, last + 1)
        inside = inside[np.argsort(order_left[inside], kind="stable")]
        # words that open before the anchor and close after it are counted on both sides
        need = words - closed[inside, d - 1] + inner[inside]
        if (need > opened[inside, left_len[inside]]).all() or (ro[inside] > 0).all() and (lo[inside] == left_len[inside]).all():
            continue
        shared = _common(lefts[inside[1:]], left_len[inside[1:]], lefts[inside[:-1]], left_len[inside[:-1]])
        reach = _reach(shared)
        ok = opened[inside, reach] >= need
        hit = inside[ok]
        lo[hit] = np.maximum(lo[hit], reach[ok])
        ro[hit] = np.maximum(ro[hit], d)
    ends = [_whole_words(right[i][:d], left[i][:reach]) if d else None for i, d, reach in zip(kept, ro.tolist(), lo.tolist(), strict=True)]
    for i, m in enumerate(stands.tolist()):
        out[i] = ends[m]
    return out


def _wide(text: bytes, ends: int) -> bytes:
    text = text.replace(b" ", b"  ")
    for c in _OTHER_SPACES:
        text = text.replace(c, b" " + c)
    return text + b" " if ends else text


def _narrow(text: bytes) -> bytes:
    for c in _OTHER_SPACES:
        text = text.replace(b" " + c, c)
    return text.replace(b"  ", b" ")


def _pair_words(right: list[bytes], left: list[bytes], ends: list[int], words: int) -> tuple[int, int] | None:
    """The same for two occurrences: the whole words of what they share, if they are enough."""
    r, l = _prefix(*right), _prefix(*left)
    bounded = lambda t, at, end: t[at : at + 1] in _ALL_SPACES if at < len(t) else bool(end)
    shared = left[0][:l][::-1] + right[0][:r]
    found = [m.span() for m in _WORDS.finditer(shared)]
    if found and found[0][0] == 0 and not all(bounded(t, l, e & 2) for t, e in zip(left, ends, strict=True)):
        del found[0]
    if found and found[-1][1] == len(shared) and not all(bounded(t, r, e & 1) for t, e in zip(right, ends, strict=True)):
        del found[-1]
    return (found[0][0] - l, found[-1][1] - l) if len(found) >= words else None


def _whole_words(right: bytes, left: bytes) -> tuple[int, int]:
    """Begin and end, from the anchor, of the words that white space bounds on both sides."""
    right, left = _narrow(right), _narrow(left)
    around = left[::-1] + right
    first, last = _SPACES.search(around).start(), len(around) - 1 - _SPACES.search(around[::-1]).start()
    inner = around[first:last]
    return first + len(inner) - len(inner.lstrip()) - len(left), first + len(inner.rstrip()) - len(left)


def _covered(contexts: DataFrame, length: int, k: int, words: int, hot: int, last: bool) -> DataFrame:
    """(sha, start, end, by_words) of what is repeated around each anchor; `contexts` comes sorted by key.

    Buckets of more than `hot` rows are handed on (key is not null), but for the last deal, in which all rows of a bucket agree.
    """

    def run(batches):
        held: list[tuple] = []
        large = None
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[6] is not None:
                    done.append((r[1], r[6], r[7], r[8], None, None, None, None, None))
                elif r[0] == large:
                    hand_on(r)
                else:
                    if held and held[0][0] != r[0]:
                        scan(held)
                        held = []
                    held.append(r)
                    if len(held) > hot and not last:
                        large = r[0]
                        for x in held:
                            hand_on(x)
                        held = []
                if len(done) >= 10_000:
                    yield batch()
        scan(held)
        yield batch()

    done: list[tuple] = []

    def hand_on(r: tuple) -> None:
        done.append((r[1], None, None, None, r[0], *r[2:6]))

    def scan(rows: list[tuple]) -> None:
        if len(rows) < 2:
            return
        right, left = [r[3] for r in rows], [r[4] for r in rows]
        lo, ro = cover(right, left, length, k)
        for m in np.flatnonzero(ro).tolist():
            at = rows[m][2]
            done.append((rows[m][1], at - int(lo[m]), at + int(ro[m]), False, None, None, None, None, None))
        # where all that is looked at is covered, words can add nothing
        if words and not all(a == len(x) and b == len(y) for a, x, b, y in zip(lo.tolist(), left, ro.tolist(), right, strict=True)):
            for m, found in enumerate(cover_words(right, left, [r[5] for r in rows], words)):
                if found and (-found[0] > lo[m] or found[1] > ro[m]):
                    done.append((rows[m][1], rows[m][2] + found[0], rows[m][2] + found[1], True, None, None, None, None, None))

    def batch() -> pa.RecordBatch:
        cols = list(zip(*done, strict=True)) or [[]] * 9
        done.clear()
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["sha", "start", "end", "by_words", "key", "at", "right", "left", "ends"])

    return contexts.mapInArrow(released(run), "sha binary, start long, end long, by_words boolean, key long, at int, right binary, left binary, ends int")


def merged(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes; runs that touch are one."""
    out: list[list[int]] = []
    for s, e in sorted(zip(starts, ends, strict=True)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def _cut(texts: DataFrame, with_text: bool) -> DataFrame:
    """What bytes and, in passage_bytes and kept_text, bytes and words take out of each text."""

    def run(batches):
        for batch in batches:
            for b in by_bytes(batch, 1, SLICE):
                out = []
                for sha, text, starts, ends, by_words in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    data = text.encode()
                    runs = merged([x for x, w in zip(starts, by_words, strict=True) if not w], [x for x, w in zip(ends, by_words, strict=True) if not w])
                    passages = merged(starts, ends) if any(by_words) else runs
                    rest = without(data, runs)
                    row = (sha, sum(e - s for s, e in runs), len(runs), hashlib.sha256(rest).digest(), sum(e - s for s, e in passages))
                    out.append((*row, without(data, passages).decode("utf-8", "ignore")) if with_text else row)
                cols = list(zip(*out)) or [[]] * 6
                kinds = [pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
                names = ["sha", "n_removed", "n_spans", "kept_sha", "passage_bytes", "kept_text"]
                n = 6 if with_text else 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:n], kinds, strict=False)], names=names[:n])

    return texts.select("sha", "text", "starts", "ends", "by_words").mapInArrow(released(run), "sha binary, n_removed long, n_spans long, kept_sha binary, passage_bytes long" + ", kept_text string" * with_text)


def without(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for s, e in runs:
        kept.append(data[at:s])
        at = e
    return b"".join([*kept, data[at:]])


def _tails(items: list) -> Iterator[list]:
    """`items`, then without its first, and so on."""
    for n in range(len(items)):
        yield items[n:]


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, words: int = 0, hot: int = HOT) -> DataFrame:
    """One row for each row of `docs`: id, n_bytes, n_removed, n_spans, kept_sha256, passage_bytes and, if asked for, kept_text and text_sha256.

    The first of these tell of repeats of `length` bytes. passage_bytes and kept_text tell of passages: these repeats and, with `words`,
    that many whole words in a row. kept_text is null where nothing was taken out; bytes of a character that was cut in two are left
    out of it, though not of kept_sha256. Null text is empty. What is removed depends on the text alone, so equal
    rows, and rows with a null id, fare like any others: all copies of a text of `length` bytes or more go whole, shorter
    texts stay. `hot` bounds what a task scans together, and changes nothing else. An empty table gives no rows; other
    columns are not looked at.
    """
    if k & (k - 1) or not 2 <= k < length:
        raise ValueError("k must be a power of two below length")
    if words and 2 * words - 1 < k:
        raise ValueError("words must span at least k bytes")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scanned = store(_scanned(rows, length, k, words), "scanned")
    # one text stands for all its copies from here on
    texts = store(scanned.groupBy("sha").agg(F.min(F.struct(F.col("id").isNull(), F.col("id"))).alias("m"), F.count("*").alias("copies")).select("sha", F.col("m.id").alias("id"), "copies"), "texts")
    copied = texts.where("copies > 1")
    single = scanned.where(F.size("at") > 0).join(copied.select("sha", F.col("id").alias("rep")), "sha", "left").where("rep is null or rep <=> id").select("sha", "id", "at", "h", "reach").dropDuplicates(["sha"])
    placed = store(single.select("sha", "id", F.explode(F.arrays_zip("at", "h", "reach")).alias("x")).select("sha", "id", "x.at", "x.h", "x.reach"), "anchors")
    repeated = store(placed.groupBy("h").count().where("count > 1").select("h", (F.col("count") > hot).alias("hot")), "repeated")
    per_text = placed.join(repeated, "h").groupBy("sha", "id").agg(F.collect_list(F.struct("at", "h", "reach", "hot")).alias("x")).select(F.col("sha").alias("want"), "id", "x.at", "x.h", "x.reach", "x.hot")
    per_text = store(per_text, "per_text")
    discard(placed, repeated)
    same = F.unhex(F.sha2(F.col("text").cast("binary"), 256)) == F.col("want")
    needed = store(rows.join(per_text.hint("shuffle_hash"), rows["id"].eqNullSafe(per_text["id"])).where(same).select(F.col("want").alias("sha"), "text", "at", "h", "reach", "hot"), "needed")
    discard(per_text)
    rows, found, parts = _contexts(needed, length, k, words), None, []
    for _, *later in _tails(steps(length, k, words)):
        met = rows.repartition("key").sortWithinPartitions("key", "right", "left")
        covered = store(_covered(met, length, k, words, hot, last=not later), "covered")
        parts.append(covered)
        spans = covered.where("key is null").select("sha", "start", "end", "by_words")
        found = spans if found is None else found.unionByName(spans)
        crowded = covered.where("key is not null")
        if not later or crowded.isEmpty():
            break
        rows = _dealt(crowded, later[0], length, k, words)
    found = found.distinct()
    spans = found.groupBy("sha").agg(F.collect_list(F.struct("start", "end", "by_words")).alias("x")).select("sha", F.col("x.start").alias("starts"), F.col("x.end").alias("ends"), "x.by_words")
    kept = store(_cut(needed.select("sha", "text").join(spans, "sha"), with_text), "removed")
    discard(needed, *parts)
    removed = kept.dropDuplicates(["sha"])
    nothing = hashlib.sha256(b"").hexdigest()
    info = store(removed.join(copied.select("sha", "copies"), "sha", "full"), "info")
    discard(kept, texts)
    copy, long = F.col("copies") > 1, F.col("n_bytes") >= length
    out = scanned.select("id", "n_bytes", "enough", "sha").join(info, "sha", "left")
    return out.select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.when(copy & long, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy & long, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy & long, F.lit(nothing)).otherwise(F.lower(F.hex(F.coalesce("kept_sha", "sha")))).alias("kept_sha256"),
        F.when(copy & F.col("enough"), F.col("n_bytes")).otherwise(F.coalesce("passage_bytes", F.lit(0))).alias("passage_bytes"),
        *([F.when(copy & F.col("enough"), F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"), F.lower(F.hex("sha")).alias("text_sha256")] if with_text else []),
    )


def without_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, id_col: str = "doc_id", text_col: str = "text", words: int = 0, hot: int = HOT) -> DataFrame:
    """`docs` with what is repeated taken out of the texts; all rows and columns stay, null texts become empty.

    Rows with a null id or a repeated id and text fare like any others; an empty table gives an empty one.
    """
    found = remove_repeats(docs, length, k, id_col, text_col, with_text=True, words=words, hot=hot).where("passage_bytes > 0")
    found = found.select(F.col(id_col).alias("_id"), F.unhex("text_sha256").alias("_sha"), F.coalesce("kept_text", F.lit("")).alias("_kept")).dropDuplicates(["_id", "_sha"])
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(whole_rows(docs), F.col(id_col).alias("_row_id"), text.alias("_text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("_own"))
    on = rows["_row_id"].eqNullSafe(found["_id"]) & (rows["_own"] == found["_sha"])
    kept = rows.join(found, on, "left")
    return kept.select(*[F.coalesce("_kept", "_text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Repeats of 400 bytes; passage_bytes counts passages of over 50 words as well."""
    return remove_repeats(table(spark, sf_dir, "documents"), words=PASSAGE_WORDS)

"""Byte-level BPE encoding and decoding with a pair occurrence index.

Texts are cut into pre-tokens, which encode on their own; the distinct pre-tokens of a batch that have not
been met before are merged together. The index maps each pair of neighbouring symbols to all its
positions; the active ranks are applied in ascending order from a heap, each to all its positions at once, and the
lists of the pairs that a merge creates are extended. Positions that a merge has made void are recognised when their list is used.

Cutting, finding equal pre-tokens and putting ids together are array operations over the characters of many texts.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import by_bytes, mix64, table

#: How byte-level BPE of this family cuts a text before merging (a fixed value of the format).
PRETOKENS = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What its classes come to for each character, and the letters that it cuts off after an apostrophe.
SPACE, LETTER, NUMBER, OTHER = range(4)
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")
#: Characters of text that are cut together, bytes of text whose new pre-tokens are merged together, and
#: pre-tokens whose ids are kept from batch to batch (a cache: when full, it is emptied).
SLICE_CHARS, BATCH_BYTES, KEPT = 1_000_000, 16_000_000, 300_000
#: A place where every text may be cut without changing its pre-tokens.
_SAFE = re.compile(r"(?<=[^\s])(?= [^\s])")

_rng = np.random.default_rng(17)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64)
_POWER = 0x9E3779B97F4A7C15


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in names:
            names[b] = chr(extra)
            extra += 1
    return [names[b] for b in range(256)]


class Vocabulary:
    """A tokenizer file: symbols, merges and added tokens; truncation and padding are not used."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        symbols = byte_symbols()
        to_byte = {c: b for b, c in enumerate(symbols)}
        self.first = [ids[c] for c in symbols]
        #: left id, right id and merged id of each rank; the rank of each pair, by left and then right id
        self.merges: list[tuple[int, int, int]] = []
        self.ranks: list[dict[int, int]] = [{} for _ in range(max(ids.values()) + 1)]
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.append((ids[a], ids[b], ids[a + b]))
            self.ranks[ids[a]].setdefault(ids[b], rank)
        pairs = np.array([(a << 32) | b for a, b, _ in self.merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        keep = np.r_[True, pairs[order][1:] != pairs[order][:-1]] if len(order) else np.zeros(0, bool)
        self._pairs, self._ranks = pairs[order][keep], order[keep].astype(np.int32)
        self.byte_ranks = np.array([[self.ranks[a].get(b, -1) for b in self.first] for a in self.first], np.int32)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.bytes = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, i in ids.items():
            self.bytes[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it does not merge."""
        if not len(self._pairs):
            return np.full(len(left), -1, np.int32)
        pair = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self._pairs, pair), len(self._pairs) - 1)
        return np.where(self._pairs[at] == pair, self._ranks[at], np.int32(-1))


def character_classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    everything = "".join(map(chr, range(0x110000)))
    for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, everything):
            out[m.start() : m.end()] = kind
    return out


def pretoken_starts(codes: np.ndarray, pieces: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where PRETOKENS begins a new match in texts (code points, one after another) that begin at `pieces`."""
    n = len(codes)
    kind = classes[codes]
    fresh = np.zeros(n + 1, bool)
    fresh[pieces] = True
    fresh[n] = True
    run = fresh[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    before_word = np.zeros(n, bool)  # the last white character before something else of the same text
    before_word[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~fresh[1:n]
    joined = np.zeros(n, bool)  # a word that takes the space before it
    joined[1:] = before_word[:-1] & (codes[:-1] == 0x20)
    starts = (run | before_word) & ~joined
    lone = np.flatnonzero((codes == 0x27) & starts & run & ~fresh[1:])
    lone = lone[kind[lone + 1] == LETTER]
    for letters in CONTRACTIONS:
        at = lone[lone + len(letters) < n]
        for k, c in enumerate(letters, 1):
            at = at[(codes[at + k] == ord(c)) & ~fresh[at + k]]
        starts[at + 1] = False
        past = at + 1 + len(letters)
        starts[past[past < n]] = True
    return np.flatnonzero(starts)


def merge_pretokens(vocab: Vocabulary, pretokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all pre-tokens, and how many each has; all are merged through one pair occurrence index."""
    data = np.frombuffer(b"".join(pretokens), np.uint8)
    lengths = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
    if not len(data):
        return np.zeros(0, np.int32), lengths
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[lengths > 0]
    symbols = np.array(vocab.first, np.int32)[data]
    # the next and the previous symbol's position, -1 at the ends of a pre-token
    after, before = np.arange(1, len(data) + 1, dtype=np.int32), np.arange(-1, len(data) - 1, dtype=np.int32)
    after[ends[lengths > 0] - 1] = -1
    before[starts] = -1
    ranked = np.r_[vocab.byte_ranks[data[:-1], data[1:]], np.int32(-1)]
    ranked[ends[lengths > 0] - 1] = -1
    places = np.flatnonzero(ranked >= 0).astype(np.int32)
    places = places[np.argsort(ranked[places], kind="stable")]
    active, first = np.unique(ranked[places], return_index=True)
    heap = active.tolist()  # ascending, so a heap already
    index = {r: [p] for r, p in zip(heap, np.split(places, first[1:]), strict=False)}
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        rank = pop(heap)
        found = index.pop(rank)
        i = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
        left, right, merged = vocab.merges[rank]
        j = after[i]
        whole = (j >= 0) & (symbols[i] == left) & (symbols[j] == right)  # else an earlier merge has used one of the two
        i, j = i[whole], j[whole]
        if left == right and len(i) > 1:  # of overlapping pairs every other one, from the left
            chain = np.r_[True, i[1:] != j[:-1]]
            place = np.arange(len(i))
            odd = (place - np.maximum.accumulate(np.where(chain, place, 0))) & 1 == 1
            i, j = i[~odd], j[~odd]
        if not len(i):
            continue
        k = after[j]
        symbols[i], symbols[j], after[i], after[j] = merged, -1, k, -1
        goes_on = k >= 0
        before[k[goes_on]] = i[goes_on]
        h = before[i]
        made = np.concatenate([i[goes_on], h[h >= 0]])
        new = vocab.rank_of(symbols[made], symbols[after[made]])
        known = new >= 0
        if not known.any():
            continue
        made, new = made[known], new[known]
        order = np.argsort(new, kind="stable")
        made, new = made[order], new[order]
        edge = np.flatnonzero(new[1:] != new[:-1]) + 1
        for r, some in zip(new[np.r_[0, edge]].tolist(), np.split(made, edge), strict=True):
            if r in index:
                index[r].append(some)
            else:
                index[r] = [np.unique(some)]
                push(heap, r)
    final = symbols >= 0
    counts = np.add.reduceat(final, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
    lengths[lengths > 0] = counts
    return symbols[final], lengths


class ChunkEncoder:
    """Texts to ids, by way of pre-tokens that are merged once each and kept for later texts."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.classes = vocab, character_classes()
        self._forget()

    def _forget(self) -> None:
        self.kept: dict[bytes, int] = {}
        self.ids, self.begin, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _pieces(self, text: str) -> list[str | int]:
        """Special tokens as ids, and what stands between them; a very long text in several pieces."""
        special = self.vocab.special
        cut = self.vocab.cut_special.split(text) if any(s in text for s in special) else [text]
        out: list[str | int] = []
        for k, piece in enumerate(cut):
            if k % 2:
                out.append(special[piece])
                continue
            while len(piece) > SLICE_CHARS:
                safe = _SAFE.search(piece, SLICE_CHARS)
                if not safe:
                    break
                out.append(piece[: safe.start()])
                piece = piece[safe.start() :]
            out.append(piece)
        return out

    def _cut(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of each pre-token (in the order of `kept`), and how many pre-tokens each piece has."""
        joined = "".join(pieces)
        raw = joined.encode()
        data = np.frombuffer(raw, np.uint8)
        codes = data if len(raw) == len(joined) else np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        begins = np.cumsum(lengths) - lengths
        if not len(codes):
            return np.zeros(0, np.int64), np.zeros(len(pieces), np.int64)
        starts = pretoken_starts(codes, begins[lengths > 0], self.classes)
        counts = np.searchsorted(starts, begins + lengths) - np.searchsorted(starts, begins)
        if codes is not data:  # from characters to bytes
            starts = np.flatnonzero((data & 0xC0) != 0x80)[starts]
        ends = np.r_[starts[1:], len(data)]
        # a sum over bytes and places tells pre-tokens apart; that equal sums are equal bytes is looked up
        if len(data) >= len(self._powers()[0]):
            self._more_powers(len(data) + 1)
        up, down = self._powers()
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
        key = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        _, first, number = np.unique(key, return_index=True, return_inverse=True)
        shift = starts[first][number] - starts
        size = ends - starts
        if not ((ends - starts)[first][number] == size).all() or not (data[np.arange(len(data)) + np.repeat(shift, size)] == data).all():
            words = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            place = {w: k for k, w in enumerate(dict.fromkeys(words))}
            number, words = np.array([place[w] for w in words]), list(place)
        else:
            words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        kept = self.kept
        mine = np.fromiter((kept.setdefault(w, len(kept)) for w in words), np.int64, len(words))
        return mine[number].astype(np.int32), counts

    _up, _down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _powers(self) -> tuple[np.ndarray, np.ndarray]:
        return self._up, self._down

    def _more_powers(self, n: int) -> None:
        """Powers of an odd number and of its inverse, modulo 2 ** 64."""
        power = lambda x: np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, x, np.uint64)])
        type(self)._up, type(self)._down = power(_POWER), power(pow(_POWER, -1, 1 << 64))

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, as the tokenizers library gives them without special tokens added."""
        if len(self.kept) > KEPT:
            self._forget()
        cut = [self._pieces(t) for t in texts]
        plain = [p for pieces in cut for p in pieces if isinstance(p, str)]
        numbers, counts, at = [], [], 0
        while at < len(plain):
            upto, size = at, 0
            while upto < len(plain) and (upto == at or size + len(plain[upto]) <= SLICE_CHARS):
                size += len(plain[upto])
                upto += 1
            n, c = self._cut(plain[at:upto])
            numbers.append(n)
            counts.append(c)
            at = upto
        new = list(itertools.islice(self.kept, len(self.begin), None))
        ids, n = merge_pretokens(self.vocab, new)
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(n) - n])
        self.ids, self.count = np.concatenate([self.ids, ids]), np.concatenate([self.count, n])
        flat = (x for n, c in zip(numbers, counts, strict=True) for x in self._ids(n, c))
        for pieces in cut:
            if len(pieces) == 1:
                yield next(flat) if isinstance(pieces[0], str) else np.array(pieces, "<u4")
            else:
                yield np.concatenate([np.zeros(0, "<u4"), *(next(flat) if isinstance(p, str) else np.array([p], "<u4") for p in pieces)])

    def _ids(self, numbers: np.ndarray, pretokens: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of each piece from the numbers of its pre-tokens."""
        count = self.count[numbers]
        upto = np.r_[0, np.cumsum(count)]
        ids = self.ids[np.arange(upto[-1]) + np.repeat(self.begin[numbers] - upto[:-1], count)].astype("<u4")
        at = 0
        for n in pretokens.tolist():
            yield ids[upto[at] : upto[at + n]]
            at += n

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD, special tokens stay."""
        return b"".join(map(self.vocab.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


_encoders: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, kind: type = ChunkEncoder) -> ChunkEncoder:
    """One encoder for each Python worker and tokenizer file."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = kind(Vocabulary(path))
    return _encoders[path, kind]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: id and ids (array of int).

    Null text is empty and has no ids; a null id is kept; equal rows give equal rows; an empty
    table gives none. Other columns are not looked at.
    """

    def run(batches):
        enc = encoder(path)
        for b in (x for batch in batches for x in by_bytes(batch, 1, BATCH_BYTES)):
            ids = list(enc.encode([t or "" for t in b.column(1).to_pylist()]))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = pa.array(np.concatenate([np.zeros(0, "<u4"), *ids]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row for each row of `encoded`: id and text. Null ids give an empty text."""

    def run(batches):
        enc = encoder(path)
        for b in batches:
            texts = [enc.decode(np.array(x or [], "<u4")) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the text that they decode to.

    Encoder and decoder are those of `encode_documents` and `decode_documents`; the digests are
    taken where the ids are, which spares moving them. A repeated row gives its row again.
    """
    path = public_tokenizers.path("byte_bpe_50k.json")

    def run(batches):
        enc = encoder(path)
        decimal = list(map(str, range(len(enc.vocab.bytes)))).__getitem__
        for b in (x for batch in batches for x in by_bytes(batch, 1, BATCH_BYTES)):
            n, ids_sha, text_sha = [], [], []
            for ids in enc.encode([t or "" for t in b.column(1).to_pylist()]):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(decimal, ids.tolist())).encode()).hexdigest())
                text_sha.append(hashlib.sha256(enc.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

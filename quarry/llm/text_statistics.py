"""Statistics of texts: shares of characters, words and lines, counted for many texts at once over joined code points."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np

from .common import mix64

#: What a text is described by. All are 0 for a text without words, but the first.
STATISTICS = (
    "characters", "words", "word_length", "word_spread", "longest_word", "letters", "capitals", "digits", "punctuation", "symbols", "running_characters",
    "bare_words", "shouted_words", "tailed_words", "repeated_neighbours", "known_words", "commonest_word", "words_of_line", "repeated_lines", "ended_lines",
)

#: A longer text is counted in pieces of about so many characters, cut at white space; lines are compared within a piece.
PIECE = 1_000_000
#: Words in a row among which repeated ones are counted, so that a long text does not look poorer for its length.
RUN = 256

_LETTER, _UPPER, _LOWER, _DIGIT, _PUNCTUATION, _SYMBOL, _SPACE, _LINE = (1 << k for k in range(8))
_rng = np.random.default_rng(20240611)
_PLACE = (_rng.integers(0, 1 << 63, 4096, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_classes = np.zeros(0x110000, np.uint8)


def _class_of(c: str) -> int:
    if c in "\n\r\x0b\x0c\x1c\x1d\x1e\x85  ":
        return _SPACE | _LINE
    if c.isspace():
        return _SPACE
    kind = unicodedata.category(c)
    if kind[0] in "LM":
        return _LETTER | (_UPPER if kind in ("Lu", "Lt") else _LOWER if kind == "Ll" else 0)
    if kind[0] == "N":
        return _DIGIT
    return _PUNCTUATION if c in ".,;:!?'\"()-¿¡«»“”‘’„–—…。、，！？：；（）" else _SYMBOL


def _classified(codes: np.ndarray) -> np.ndarray:
    """The class of each code point; those not met before are looked up once."""
    out = _classes[codes]
    if not out.all():
        for c in np.unique(codes[out == 0]).tolist():
            _classes[c] = _class_of(chr(c))
        out = _classes[codes]
    return out


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PIECE:
        past = at + PIECE
        while past < len(text) and past < at + 2 * PIECE and not text[past].isspace():
            past += 1
        yield text[at:past]
        at = past
    if at < len(text):
        yield text[at:]


def measure(texts: list[str]) -> np.ndarray:
    """A row of STATISTICS for each text."""
    out = np.zeros((len(texts), len(STATISTICS)))
    cut = [(i, piece) for i, text in enumerate(texts) for piece in _pieces(text)]
    if not cut:
        return out
    owner = np.array([i for i, _ in cut])
    sizes = np.array([len(p) for _, p in cut])
    codes = np.frombuffer("".join(p for _, p in cut).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _classified(codes)
    ends = np.cumsum(sizes)
    begins = ends - sizes

    def summed(mask: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return upto[end] - upto[start]

    def of_texts(x: np.ndarray, at: np.ndarray = owner) -> np.ndarray:
        return np.bincount(at, x, minlength=len(texts))

    is_kind = lambda bits: (kind & bits) != 0
    space = is_kind(_SPACE)
    edge = np.zeros(len(codes) + 1, bool)
    edge[begins] = edge[-1] = True
    start = np.flatnonzero(~space & (np.append(True, space[:-1]) | edge[:-1]))
    end = np.flatnonzero(~space & (np.append(space[1:], True) | edge[1:])) + 1
    out[:, 0] = np.log2(1 + of_texts(sizes))
    if not len(start):
        return out
    piece = np.searchsorted(ends, start, side="right")
    word_owner = owner[piece]
    length = end - start
    words = np.maximum(of_texts(np.ones(len(start)), word_owner), 1)
    solid = np.maximum(of_texts(sizes - summed(space, begins, ends)), 1)
    letters = np.maximum(of_texts(summed(is_kind(_LETTER), begins, ends)), 1)

    # words and lines are compared by hashes of their characters and words with their places
    begun = np.zeros(len(codes), np.int64)
    begun[start] = start
    place = np.arange(len(codes)) - np.maximum.accumulate(begun)
    spread = (codes.astype(np.uint64) + np.uint64(1)) * _PLACE[place % len(_PLACE)]
    spread[space] = 0
    word = mix64(np.add.reduceat(spread, start) + length.astype(np.uint64))
    line = np.cumsum(is_kind(_LINE) | edge[:-1])[start]
    first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
    in_line = np.arange(len(word)) - np.repeat(first, np.diff(np.append(first, len(word))))
    line_hash = mix64(np.add.reduceat(word * _PLACE[in_line % len(_PLACE)], first))
    line_owner, lines = word_owner[first], np.maximum(of_texts(np.ones(len(first)), word_owner[first]), 1)

    def distinct(hashes: np.ndarray, at: np.ndarray, whose: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many distinct hashes the groups `at` of each text hold, and the sum of how often the commonest of each group comes."""
        _, where, times = np.unique(hashes ^ mix64(at.astype(np.uint64) + np.uint64(1)), return_index=True, return_counts=True)
        most = np.zeros(at[-1] + 1)
        np.maximum.at(most, at[where], times)
        last = np.append(np.flatnonzero(at[1:] != at[:-1]), len(at) - 1)
        return of_texts(np.ones(len(where)), whose[where]), of_texts(most[at[last]], whose[last])

    of_piece = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
    in_piece = np.arange(len(word)) - np.repeat(of_piece, np.diff(np.append(of_piece, len(word))))
    run = np.cumsum(in_piece % RUN == 0) - 1
    kinds, commonest = distinct(word, run, word_owner)
    line_kinds, _ = distinct(line_hash, piece[first], line_owner)
    word_letters, word_upper, word_lower, word_digits = (summed(is_kind(k), start, end) for k in (_LETTER, _UPPER, _LOWER, _DIGIT))
    last, before = end - 1, np.maximum(end - 2, start)
    plain = is_kind(_LETTER | _DIGIT)
    tailed = (length > 2) & ~plain[last] & ~plain[before] & (word_letters > 0)
    same_word = np.append(False, (word[1:] == word[:-1]) & (piece[1:] == piece[:-1]))
    running = np.append(False, (codes[1:] == codes[:-1]) & ~space[1:]) & ~edge[:-1]
    last_of_line = np.append(first[1:], len(word)) - 1
    ended = np.isin(codes[last[last_of_line]], np.array([ord(c) for c in ".!?…。！？"], np.uint32))
    mean = of_texts(length, word_owner) / words
    longest = np.zeros(len(texts))
    np.maximum.at(longest, word_owner, length)

    out[:, 1] = np.log2(words)
    out[:, 2] = mean
    out[:, 3] = np.sqrt(np.maximum(of_texts(length.astype(float) ** 2, word_owner) / words - mean**2, 0))
    out[:, 4] = np.log2(1 + longest)
    out[:, 5] = of_texts(word_letters, word_owner) / solid
    out[:, 6] = of_texts(word_upper, word_owner) / letters
    out[:, 7] = of_texts(word_digits, word_owner) / solid
    out[:, 8] = of_texts(summed(is_kind(_PUNCTUATION), start, end), word_owner) / solid
    out[:, 9] = of_texts(summed(is_kind(_SYMBOL), start, end), word_owner) / solid
    out[:, 10] = of_texts(summed(running, begins, ends)) / solid
    out[:, 11] = of_texts((word_letters + word_digits == 0).astype(float), word_owner) / words
    out[:, 12] = of_texts(((word_upper > 1) & (word_lower == 0)).astype(float), word_owner) / words
    out[:, 13] = of_texts(tailed.astype(float), word_owner) / words
    out[:, 14] = of_texts(same_word.astype(float), word_owner) / words
    out[:, 15] = 1 - kinds / words
    out[:, 16] = commonest / words
    out[:, 17] = np.log2(1 + words / lines)
    out[:, 18] = 1 - line_kinds / lines
    out[:, 19] = of_texts(ended.astype(float), line_owner) / lines
    out[of_texts(np.ones(len(word)), word_owner) == 0, 1:] = 0
    return out

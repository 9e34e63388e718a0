"""Segmentation of text without spaces: the most probable path through the lattice of a dictionary's words.

A run's lattice has an edge for each dictionary word at each place, and one for each single character. The path whose words are
most probable (by the caller's frequencies) is found from left to right. Where it goes over characters that the dictionary does not know, several in a
row, a hidden Markov model of word beginnings, middles, ends and single characters cuts them; it is estimated from the same frequencies.
Costs are whole numbers, so equal paths are equal, and the one with the longer last word is taken.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Mapping
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import _RUN, HAN, SHORTEST, _step

#: Costs are negative logarithms, times this.
SCALE = 1_000_000
#: Runs are cut together up to this length, about so many characters at a time, and texts so many at a time.
_TOGETHER, _CELLS, _TEXTS = 400, 200_000, 256
_NONE = 1 << 60
_RUNS, _IS_HAN = re.compile(_RUN), re.compile(f"[{HAN}]")
# The states of a character (begin, middle, end, single) and what may follow each.
STATES = "BMES"
FOLLOWS = {"B": "ME", "M": "ME", "E": "BS", "S": "BS"}


def cost(count: float, total: float) -> int:
    return int(SCALE * (log(total) - log(count)) + 0.5)


class Lattice:
    """A dictionary of words with their counts; words without a positive count are not in it."""

    def __init__(self, frequencies: Mapping[str, int], hidden: bool = True):
        known = {w: n for w, n in frequencies.items() if w and n and n > 0}
        self.total = max(2, sum(known.values()))
        self.costs = {w: cost(n, self.total) for w, n in known.items()}
        self.unknown = cost(1, self.total)
        self.longest = max(map(len, known), default=1)
        self.hidden = _Hidden(known) if hidden and known else None
        # the words as a tree: the node after a node and a character (0: none, 1: where words begin), and what the word that ends there costs
        letters = sorted(set("".join(known)))
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        after, ends = [{}, {}], [_NONE, _NONE]
        for word, c in self.costs.items():
            at = 1
            for x in word:
                if x not in after[at]:
                    after[at][x] = len(after)
                    after.append({})
                    ends.append(_NONE)
                at = after[at][x]
            ends[at] = c
        self.places = np.zeros((len(after), len(letters) + 1), np.int32)
        for at, following in enumerate(after):
            for x, to in following.items():
                self.places[at, self.letter[ord(x)]] = to
        self.ends = np.array(ends, np.int64)

    def path(self, run: str) -> list[str]:
        """The words of the cheapest path; a character that is no word costs as much as a word that was met once."""
        best, back = [0], [0]
        for i in range(1, len(run) + 1):
            found = best[i - 1] + self.costs.get(run[i - 1], self.unknown), 1
            for k in range(2, min(self.longest, i) + 1):
                c = self.costs.get(run[i - k : i])
                if c is not None and best[i - k] + c <= found[0]:
                    found = best[i - k] + c, k
            best.append(found[0])
            back.append(found[1])
        out, i = [], len(run)
        while i:
            out.append(run[i - back[i] : i])
            i -= back[i]
        return out[::-1]

    def paths(self, runs: list[str]) -> dict[str, list[str]]:
        """The path of each run, runs of like length together."""
        out = {run: self.path(run) for run in runs if len(run) > _TOGETHER}
        short = sorted({run for run in runs if 0 < len(run) <= _TOGETHER}, key=len)
        while short:
            n = max(1, _CELLS // len(short[-1]))
            some, short = short[-n:], short[:-n]
            length = len(some[-1])
            raw = np.frombuffer("".join(run.ljust(length, "\0") for run in some).encode("utf-32-le", "surrogatepass"), np.uint32)
            chars = self.letter[raw.reshape(len(some), length).T]
            node, words = np.ones_like(chars), []
            for k in range(min(self.longest, length)):  # words of k + 1 characters from each place on
                node = self.places[node[: length - k], chars[k:]]
                words.append(self.ends[node])
            single = np.where(words[0] < _NONE, words[0], self.unknown)
            best, back = np.zeros((length + 1, len(some)), np.int64), np.ones((length + 1, len(some)), np.int32)
            for i in range(1, length + 1):
                best[i] = best[i - 1] + single[i - 1]
                for k in range(2, min(len(words), i) + 1):
                    cost_ = best[i - k] + words[k - 1][i - k]
                    less = cost_ <= best[i]
                    best[i][less], back[i][less] = cost_[less], k
            for run, sizes in zip(some, back.T.tolist(), strict=True):
                path, i = [], len(run)
                while i:
                    path.append(run[i - sizes[i] : i])
                    i -= sizes[i]
                out[run] = path[::-1]
        return out

    def cut(self, run: str, mode: str = "accurate", path: list[str] | None = None) -> list[str]:
        """The words of a run. For searches, the dictionary words of two and three characters inside a longer word come before it."""
        out: list[str] = []
        strange = ""
        for word in [*(self.path(run) if path is None else path), ""]:
            if len(word) == 1 and word not in self.costs:
                strange += word
                continue
            if strange:
                out += self.hidden.cut(strange) if self.hidden and len(strange) > 1 else list(strange)
                strange = ""
            if mode == "search":
                out += [word[i : i + n] for n in (2, 3) if n < len(word) for i in range(len(word) - n + 1) if word[i : i + n] in self.costs]
            if word:
                out.append(word)
        return out

    def tokens(self, text: str | None, mode: str = "accurate") -> list[str]:
        """Tokens of a text: words of its Han runs, and what the default tokeniser takes elsewhere."""
        return self.token_lists([text], mode)[0]

    def token_lists(self, texts: list[str | None], mode: str = "accurate") -> list[list[str]]:
        """The same for several texts."""
        _step(mode)
        out: list[list[str]] = []
        for at in range(0, len(texts), _TEXTS):
            each = [_RUNS.findall(t or "") for t in texts[at : at + _TEXTS]]
            cut = {run: [t for t in self.cut(run, mode, path) if len(t) >= SHORTEST] for run, path in self.paths([r for runs in each for r in runs if _IS_HAN.match(r)]).items()}
            out += [[t for run in runs for t in (cut[run] if run in cut else [run] if len(run) >= SHORTEST else [])] for runs in each]
        return out


class _Hidden:
    """A hidden Markov model of characters, counted over the words of a dictionary as often as they come."""

    def __init__(self, frequencies: Mapping[str, int]):
        emitted: dict[str, dict[str, float]] = {s: defaultdict(float) for s in STATES}
        total, moves = dict.fromkeys(STATES, 0.0), defaultdict(float)
        singles = sum(n for w, n in frequencies.items() if len(w) == 1)
        words = sum(frequencies.values())
        for word, n in frequencies.items():
            states = "S" if len(word) == 1 else "B" + "M" * (len(word) - 2) + "E"
            for s, c in zip(states, word, strict=True):
                emitted[s][c] += n
                total[s] += n
            for a, b in zip(states, states[1:], strict=False):
                moves[a, b] += n
        new = {"B": (words - singles + 1) / (words + 2), "S": (singles + 1) / (words + 2)}  # how a word begins
        self.start = {s: log(new[s]) if s in new else None for s in STATES}
        self.moves = {}
        for a in STATES:
            for b in FOLLOWS[a]:
                self.moves[a, b] = log(new[b]) if a in "ES" else log((moves[a, b] + 1) / (moves[a, "M"] + moves[a, "E"] + 2))
        self.emitted = {s: {c: log((n + 0.5) / (total[s] + 1)) for c, n in emitted[s].items()} for s in STATES}
        self.strange = {s: log(0.5 / (total[s] + 1)) for s in STATES}

    def score(self, run: str, states: str) -> float:
        """The logarithm of the probability of a run with its states."""
        out = self.start[states[0]]
        for k, (s, c) in enumerate(zip(states, run, strict=True)):
            out += (self.moves[states[k - 1], s] if k else 0) + self.emitted[s].get(c, self.strange[s])
        return out

    def states(self, run: str) -> str:
        """The most probable states, of which the last ends a word."""
        at: dict[str, float] = {s: self.start[s] + self.emitted[s].get(run[0], self.strange[s]) for s in "BS"}
        back: list[dict[str, str]] = []
        for c in run[1:]:
            before = {b: max((p + self.moves[a, b], a) for a, p in at.items() if b in FOLLOWS[a]) for b in STATES if any(b in FOLLOWS[a] for a in at)}
            at = {b: p + self.emitted[b].get(c, self.strange[b]) for b, (p, _) in before.items()}
            back.append({b: a for b, (_, a) in before.items()})
        out = [max((at[s], s) for s in "ES" if s in at)[1]]
        for step in reversed(back):
            out.append(step[out[-1]])
        return "".join(reversed(out))

    def cut(self, run: str) -> list[str]:
        out = [""]
        for s, c in zip(self.states(run), run, strict=True):
            out[-1] += c
            if s in "ES":
                out.append("")
        return [w for w in out if w]


def lattice_tokeniser(frequencies: Mapping[str, int], mode: str = "accurate", hidden: bool = True):
    """A tokeniser column function over a dictionary with frequencies, which goes to every executor with the plan."""
    _step(mode)
    known = dict(frequencies)
    made: list[Lattice] = []

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(texts: pd.Series) -> pd.Series:
        if not made:  # once in each Python worker
            made.append(Lattice(known, hidden))
        return pd.Series(made[0].token_lists(list(texts), mode), index=texts.index, dtype=object)

    return cut

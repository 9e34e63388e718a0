"""Tokenisers. The default runs inside the plan, for Latin and for Han text, so all executors cut alike."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a token looks like outside Han text, what Han text is, and how long a token is at least.
TOKEN = r"[a-zA-Z0-9]+(?:\.[0-9]+)?%?"
HAN = "一-鿕"
SHORTEST = 2

_RUN = f"[{HAN}]+|{TOKEN}"
_HAN, _TOKEN = re.compile(f"[{HAN}]"), re.compile(TOKEN)


def tokens(text: Column | str, mode: str = "search") -> Column:
    """Tokens of a text in order, repeats included, in the case they have. Null gives none.

    Han text has no spaces: for searches each two characters in a row are a token, in "accurate" mode each pair is cut off
    before the next begins.
    """
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    step = _step(mode)

    def cut(run: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1)), F.lit(step)), lambda i: F.substr(run, i, F.lit(2)))
        return F.when(run.rlike(f"^[{HAN}]"), pairs).otherwise(F.array(run))

    mixed = F.flatten(F.transform(F.regexp_extract_all(c, F.lit(_RUN), F.lit(0)), cut))
    found = F.when(c.rlike(f"[{HAN}]"), mixed).otherwise(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)))
    return F.filter(found, lambda t: F.length(t) >= SHORTEST)


def _step(mode: str) -> int:
    if mode not in ("search", "accurate"):
        raise ValueError("mode must be 'search' or 'accurate'")
    return 1 if mode == "search" else 2


def token_list(text: str | None, mode: str = "search") -> list[str]:
    """The same for a string in Python."""
    if not text or text.isascii() or not _HAN.search(text):
        return [t for t in _TOKEN.findall(text or "") if len(t) >= SHORTEST]
    out: list[str] = []
    for run in re.findall(_RUN, text or ""):
        out += [run[i : i + 2] for i in range(0, max(1, len(run) - 1), _step(mode))] if "一" <= run[0] <= "鿕" else [run]
    return [t for t in out if len(t) >= SHORTEST]


def query_terms(query: str) -> list[str]:
    """The distinct tokens of a query: how often it repeats one does not count."""
    return list(dict.fromkeys(token_list(query)))


def segmented(text: str | None, words: frozenset[str], longest: int, mode: str = "search") -> list[str]:
    """Tokens with Han text cut into the longest words of a dictionary; what it does not know comes in pairs.

    For searches, the words of two and three characters inside a longer word come before it.
    """
    out: list[str] = []
    for run in re.findall(_RUN, text or ""):
        if not "一" <= run[0] <= "鿕":
            out.append(run)
            continue
        at = unknown = 0
        while at < len(run):
            size = next((n for n in range(min(longest, len(run) - at), 1, -1) if run[at : at + n] in words), 0)
            if not size:
                at += 1
                continue
            out += token_list(run[unknown:at], mode)
            word = run[at : at + size]
            if mode == "search":
                out += [word[i : i + n] for n in (2, 3) if n < size for i in range(size - n + 1) if word[i : i + n] in words]
            out.append(word)
            at = unknown = at + size
        out += token_list(run[unknown:], mode)
    return [t for t in out if len(t) >= SHORTEST]


def dictionary_tokeniser(words: Iterable[str], mode: str = "search"):
    """A tokeniser over a dictionary of Han words, which goes to every executor with the plan."""
    known = frozenset(words)
    longest = max(map(len, known), default=0)
    _step(mode)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([segmented(t, known, longest, mode) for t in texts])

    return cut


#: Tokenisers by name, as columns and as the modes of `token_list`.
MODES = {"regex": "search", "accurate": "accurate"}
TOKENISERS = {"regex": tokens, "accurate": lambda c: tokens(c, "accurate")}

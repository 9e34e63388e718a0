"""Scalar functions over text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str sees it, spelt out because regex dialects differ.
WHITE = r"[\t\n\x0B\f\r\x1c-\x1f \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
SNIPPET = 200


def snippet(content: Column, length: int = SNIPPET) -> Column:
    return F.when(F.length(content) > length, F.concat(F.left(content, F.lit(length)), F.lit("..."))).otherwise(content)


def clean(content: Column) -> Column:
    """Runs of white space become one space, none at the ends; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(content, F.lit("")), WHITE, " "))


def display_url(url: Column) -> Column:
    """Without its scheme, if it is longer than the scheme could be (in bytes)."""
    return F.when(F.octet_length(url) > 8, F.regexp_replace(url, "^https?://", "")).otherwise(url)


def keyword(query: Column) -> Column:
    """Trimmed and in lower case; null if nothing is left."""
    return F.nullif(F.lower(F.trim(query)), F.lit(""))


def cache_key(query: Column, ids: Column | None = None, prefix: str = "quarry:summary:") -> Column:
    """Digest of the normalised query and, if there are any, of the ids in numeric order."""
    base = F.lower(F.trim(query))
    if ids is not None:
        joined = F.array_join(F.transform(F.array_sort(ids), lambda x: x.cast("string")), ",")
        base = F.when(F.size(ids) > 0, F.concat(base, F.lit(":"), joined)).otherwise(base)
    return F.concat(F.lit(prefix), F.md5(base.cast("binary")))


def question_lines(answer: Column, most: int = 6, longer_than: int = 10) -> Column:
    """Lines of over `longer_than` characters, without list numbers and bullets, `most` of them."""
    lines = F.filter(F.transform(F.split(answer, "\n"), F.trim), lambda x: F.length(x) > longer_than)
    return F.slice(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^[0-9.\-*•]+", ""))), 1, most)


def refined_query(answer: Column, original: Column, longest: int = 100) -> Column:
    """A rewritten query without quotes around it; the original if it is empty or too long."""
    bare = F.trim(F.regexp_replace(F.trim(answer), "^[\"']+|[\"']+$", ""))
    return F.when(F.length(bare).between(1, longest), bare).otherwise(original)


def question_keywords(questions: Column, most: int = 3) -> Column:
    """Questions as search words: no question marks, the first few."""
    return F.slice(F.transform(questions, lambda q: F.trim(F.regexp_replace(q, "[?？]", ""))), 1, most)


def data_uri_payload(value: Column) -> Column:
    """What follows the first comma of a data URI, up to the next; a value without comma is itself."""
    return F.when(F.instr(value, ",") > 0, F.split_part(value, F.lit(","), F.lit(2))).otherwise(value)


def total_pages(total: Column, page_size: int) -> Column:
    if page_size <= 0:
        raise ValueError("page_size must be positive")
    return F.floor((total + (page_size - 1)) / page_size).cast("long")


def filled(value: Column, default: str) -> Column:
    """The default for null and for the empty string."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))

"""A dictionary of keywords for suggestions: words within a few edits, and words that begin so, without reading all words.

Two words within d edits have openings (their first OPENING letters) that become the same when at most d letters are
left out of each. So each word is written under all of its opening's remnants, sorted; a search looks up the remnants of what was typed, and only the
words found there are compared letter by letter. Words are also written with their keywords, most frequent first, and so are the short
beginnings of words, with their best keywords. All lookups are filters that reach the scan of sorted tables.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.suggest import LIMIT, MOST_EDITS, _words, in_stages, merged
from quarry.sources.tables import keep

#: Letters of a word that are looked at for edits; beginnings up to so many letters have their best keywords written with them, so many of each.
OPENING, BEGINNING, BEST = 7, 3, 50


@dataclass
class Dictionary:
    remnants: DataFrame  # remnant, word: sorted by remnant
    words: DataFrame  # word, place, keyword, count: sorted by word and place
    beginnings: DataFrame  # beginning, place, keyword, count: the BEST of each
    most_edits: int


def remnants(word: str, edits: int) -> set[str]:
    """What is left of a word's opening when at most so many letters are left out."""
    opening = word[:OPENING]
    return {"".join(kept) for n in range(max(0, len(opening) - edits), len(opening) + 1) for kept in combinations(opening, n)}


def _remnants(word: Column, edits: int) -> Column:
    """The same in the plan: letters are left out one after the other."""
    step = lambda found: F.array_distinct(F.concat(found, F.flatten(F.transform(found, _without_one))))
    return reduce(lambda found, _: step(found), range(edits), F.array(F.left(word, F.lit(OPENING))))


def _without_one(s: Column) -> Column:
    places = F.when(F.length(s) > 0, F.sequence(F.lit(1), F.length(s))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)))


def build(keywords: DataFrame, most_edits: int = MOST_EDITS) -> Dictionary:
    """The dictionary of (keyword, count), written. Each keyword is found by each of its words."""
    each = _words(keywords).select("word", "keyword", "count").distinct()
    best = Window.partitionBy("word").orderBy(F.desc("count"), "keyword")
    words = keep(each.withColumn("place", F.row_number().over(best)).select("word", "place", "keyword", "count"), "words", by=("word", "place"))
    distinct = words.where("place = 1").select("word")
    left = keep(distinct.select(F.explode(_remnants(F.col("word"), most_edits)).alias("remnant"), "word"), "remnants", by=("remnant", "word"))
    # of a beginning's keywords, the best of each word are enough
    opened = words.where(F.col("place") <= BEST).select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(BEGINNING)), lambda n: F.left("word", n))).alias("beginning"), "keyword", "count").distinct()
    first = Window.partitionBy("beginning").orderBy(F.desc("count"), "keyword")
    begun = opened.withColumn("place", F.row_number().over(first)).where(F.col("place") <= BEST).select("beginning", "place", "keyword", "count")
    return Dictionary(left, words, keep(begun, "beginnings", by=("beginning", "place")), most_edits)


def near_words(known: Dictionary, typed: str, edits: int) -> list[tuple[str, int]]:
    """The words within so many edits, with their distances; there are few."""
    if edits > known.most_edits:
        raise ValueError(f"the dictionary serves up to {known.most_edits} edits")
    met = known.remnants.where(F.col("remnant").isin(sorted(remnants(typed, edits)))).select("word").distinct()
    return [(r.word, r.d) for r in met.select("word", F.levenshtein("word", F.lit(typed), edits).alias("d")).where("d >= 0").collect()]


def fuzzy(known: Dictionary, typed: str, limit: int = LIMIT, most_edits: int = MOST_EDITS) -> DataFrame:
    """The rows of `suggest.fuzzy`."""
    typed = typed.strip().lower()
    found = near_words(known, typed, most_edits)
    spark = known.words.sparkSession
    near = F.broadcast(spark.createDataFrame(found, "word string, d int"))  # as many rows as words so near
    # a keyword among the best within some distance is among the best of its nearest word
    mine = known.words.where(F.col("word").isin([w for w, _ in found]) & (F.col("place") <= 2 * limit)) if found else known.words.limit(0)
    return in_stages(mine.join(near, "word").select("keyword", "count", "d"), limit, most_edits)


def prefixed(known: Dictionary, typed: str, limit: int = LIMIT) -> DataFrame:
    """The rows of `suggest.prefixed`: a short beginning's best are looked up, of a longer one the range of words is read."""
    typed = typed.strip().lower()
    if 0 < len(typed) <= BEGINNING and limit <= BEST:
        return known.beginnings.where((F.col("beginning") == typed) & (F.col("place") <= limit)).select("keyword", "count", F.lit(0).cast("long").alias("distance"))
    found = known.words.where(F.col("word").startswith(typed) & (F.col("place") <= limit)).select("keyword", "count").distinct()
    return found.orderBy(F.desc("count"), "keyword").limit(limit).withColumn("distance", F.lit(0).cast("long"))


def suggestions(known: Dictionary, typed: str, limit: int = LIMIT, most_edits: int = MOST_EDITS, compat: bool = True) -> DataFrame:
    """The rows of `suggest.suggestions`."""
    if not typed.strip():
        return known.words.select("keyword", "count", F.lit(0).cast("long").alias("distance")).limit(0)
    return merged(fuzzy(known, typed, limit, most_edits), prefixed(known, typed, limit), limit, compat)

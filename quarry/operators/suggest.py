"""Query suggestions: words a few edits away, words that begin with what was typed, and both merged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import keyword

LIMIT, MOST_EDITS = 5, 3


def keyword_counts(log: DataFrame, query: str = "query", weight: str | None = None) -> DataFrame:
    """(keyword, count) of normalised, non-empty queries."""
    n = F.sum(weight) if weight else F.count("*")
    return log.select(keyword(F.col(query)).alias("keyword"), *([weight] if weight else [])).where("keyword is not null").groupBy("keyword").agg(n.cast("long").alias("count"))


def _words(keywords: DataFrame) -> DataFrame:
    return keywords.withColumn("word", F.explode(F.split("keyword", r"[^\p{L}\p{N}]+"))).where("word <> ''")


def fuzzy(keywords: DataFrame, typed: str, limit: int = LIMIT, most_edits: int = MOST_EDITS) -> DataFrame:
    """(keyword, count, distance): any word of the keyword within so many edits.

    Distances are tried from 1 up, each giving its 2 * limit most frequent keywords; the first to meet a
    keyword names its distance, and no further distance is tried once `limit` have been met. An exact match has distance 1 here.
    """
    typed = typed.strip().lower()
    nearest = _words(keywords).select("keyword", "count", F.levenshtein("word", F.lit(typed), most_edits).alias("d")).where("d >= 0")
    return in_stages(nearest, limit, most_edits)


def in_stages(nearest: DataFrame, limit: int, most_edits: int) -> DataFrame:
    """The stages of `fuzzy` over (keyword, count, d), which has a row for each near word of a keyword."""
    nearest = nearest.groupBy("keyword", "count").agg(F.greatest(F.min("d"), F.lit(1)).alias("least"))
    # within d edits, the most frequent: bounded by the limit, so the rest runs on a few rows
    tried = nearest.withColumn("distance", F.explode(F.sequence("least", F.lit(most_edits))))
    place = F.row_number().over(Window.partitionBy("distance").orderBy(F.desc("count"), "keyword"))
    met = tried.withColumn("place", place).where(F.col("place") <= 2 * limit).groupBy("keyword", "count").agg(F.min("distance").alias("distance"))
    reached = met.groupBy("distance").agg(F.count("*").alias("n"))
    before = reached.select(F.col("distance").alias("d"), F.sum("n").over(Window.orderBy("distance").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("so_far"))
    stop = before.where(F.col("so_far") >= limit).agg(F.coalesce(F.min("d"), F.lit(most_edits)).alias("stop"))
    return met.crossJoin(F.broadcast(stop)).where("distance <= stop").select("keyword", "count", F.col("distance").cast("long").alias("distance"))


def prefixed(keywords: DataFrame, typed: str, limit: int = LIMIT) -> DataFrame:
    """(keyword, count, distance 0): any word of the keyword begins so."""
    found = _words(keywords).where(F.col("word").startswith(typed.strip().lower())).select("keyword", "count").distinct()
    return found.orderBy(F.desc("count"), "keyword").limit(limit).withColumn("distance", F.lit(0).cast("long"))


def suggestions(keywords: DataFrame, typed: str, limit: int = LIMIT, most_edits: int = MOST_EDITS, compat: bool = True) -> DataFrame:
    """The merge of both, by distance, count and keyword. With `compat` a keyword that the fuzzy stage has met keeps
    the distance from there even if it begins so, as established rankings have it; otherwise the prefix stage comes first."""
    if not typed.strip():
        return keywords.select("keyword", "count", F.lit(0).cast("long").alias("distance")).limit(0)
    return merged(fuzzy(keywords, typed, limit, most_edits), prefixed(keywords, typed, limit), limit, compat)


def merged(near: DataFrame, begun: DataFrame, limit: int, compat: bool) -> DataFrame:
    """The merge of the two stages."""
    stages = [near, begun]
    if not compat:
        stages.reverse()
    staged = reduce(DataFrame.unionByName, [s.withColumn("stage", F.lit(k)) for k, s in enumerate(stages)])
    first = F.row_number().over(Window.partitionBy("keyword").orderBy("stage"))
    found = staged.withColumn("first", first).where("first = 1")
    return found.orderBy("distance", F.desc("count"), "keyword").limit(limit).select("keyword", "count", "distance")


def fallback(raw_counts: DataFrame, typed: str, limit: int = LIMIT, among: int = 1000) -> DataFrame:
    """Of the most frequent raw queries, those that begin so, in any case."""
    best = raw_counts.orderBy(F.desc("count"), F.desc("query")).limit(among)
    return best.where(F.lower("query").startswith(typed.lower())).orderBy(F.desc("count"), F.desc("query")).limit(limit)


def top_keywords(keywords: DataFrame, limit: int = 10) -> DataFrame:
    return keywords.orderBy(F.desc("count"), "keyword").limit(limit)

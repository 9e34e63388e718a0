"""Upserts by URL, deletes, purges and metadata, over document tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert_by_url(current: DataFrame, incoming: DataFrame, order: list[str]) -> DataFrame:
    """`current` with `incoming` in it: of each URL the last incoming row (by `order`) takes the place of what was there;
    rows without a URL are always added."""
    has_url = F.coalesce(F.col("url"), F.lit("")) != ""
    w = Window.partitionBy("url").orderBy(*[F.desc(c) for c in order])
    newest = incoming.where(has_url).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    untouched = current.join(newest.select("url"), "url", "left_anti").select(current.columns)
    return untouched.unionByName(newest).unionByName(incoming.where(~has_url))


def stamped(current: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """`incoming` with created_at and updated_at: a URL that is already there keeps when it was created."""
    known = current.where("url is not null and url <> ''").groupBy("url").agg(F.min("created_at").alias("_created"))
    rows = incoming.drop("created_at", "updated_at").join(known, "url", "left")
    return rows.withColumn("created_at", F.coalesce("_created", now)).withColumn("updated_at", now).drop("_created")


def enriched_metadata(metadata: Column, title: Column, content: Column) -> Column:
    """Metadata with the title and content as they came; keys of the same name are replaced."""
    rest = F.map_filter(F.coalesce(metadata, F.expr("map()").cast("map<string,string>")), lambda k, _: ~k.isin("original_title", "original_content"))
    return F.map_concat(rest, F.create_map(F.lit("original_title"), title, F.lit("original_content"), content))


def bad_documents(docs: DataFrame, titles: list[str], fragments: list[str]) -> DataFrame:
    """Documents whose title is one of `titles` or holds one of `fragments`."""
    bad = F.col("title").isin(titles)
    for f in fragments:
        bad |= F.contains(F.col("title"), F.lit(f))
    return docs.where(F.coalesce(bad, F.lit(False)))


def purge(docs: DataFrame, bad: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents without the bad ones, and the frontier rows that fetch those again first (priority 0, depth 0)."""
    again = bad.where("url is not null and url <> ''").select("url").distinct().select("url", F.lit(0).alias("depth"), F.lit(0).alias("priority"))
    return docs.join(bad.select("doc_id"), "doc_id", "left_anti"), again


def cascade(children: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """Child rows whose parent is not gone."""
    return children.join(gone.select(key), key, "left_anti")

"""The crawl as tables: links, frontier, breadth-first levels, batches between rests, extraction."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.html import own_text, read_page
from quarry.functions.readability import measured
from quarry.functions.text import clean
from quarry.functions.urls import is_image, is_valid, normalise
from quarry.operators.visited import Bloom, unvisited
from quarry.sources.tables import keep

# Lengths of pages and contents, images of a page, pages between rests.
SHORTEST_PAGE, SHORTEST_CONTENT, LONGEST_CONTENT, MOST_IMAGES, BURST = 100, 100, 50_000, 4, 10


def fetched(pages: DataFrame) -> DataFrame:
    """Pages that are long enough to count as fetched."""
    return pages.where(F.length("html") >= SHORTEST_PAGE)


def read_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, links, images) of each page; links and images are absolute, in order, and repeats are kept.

    Pages are parsed in Arrow batches, each on its own; null html and null urls give what can be had without them.
    """
    link = pa.struct([("href", pa.string()), ("target", pa.string())])

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                found = [read_page(u or "", h or "") for u, h in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                titles, links, images = ([x[n] for x in found] for n in range(3))
                linked = pa.array([[{"href": h, "target": t} for h, t in x] for x in links], pa.list_(link))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(titles, pa.string()), linked, pa.array(images, pa.list_(pa.string()))], names=["page_id", "url", "title", "links", "images"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, title string, links array<struct<href: string, target: string>>, images array<string>")


def links(pages: DataFrame) -> DataFrame:
    """(page_id, url, href, target) of every link, repeats kept; targets are absolute and not yet judged."""
    return read_pages(pages).select("page_id", "url", F.inline("links"))


def crawlable(found: DataFrame) -> DataFrame:
    return found.where(is_valid(F.col("target"))).withColumn("target", normalise(F.col("target")))


def frontier(candidates: DataFrame, visited: DataFrame) -> DataFrame:
    """(url, depth) of valid candidates that have not been visited, each at its least depth."""
    fresh = candidates.where(is_valid(F.col("url"))).select(normalise(F.col("url")).alias("url"), "depth")
    return fresh.groupBy("url").agg(F.min("depth").alias("depth")).join(visited.select("url").distinct(), "url", "left_anti")


def bloom_frontier(candidates: DataFrame, visited: DataFrame, bloom: Bloom) -> DataFrame:
    """The same, by a filter that knows the visited pages: only candidates that it may know are looked up among them."""
    fresh = candidates.where(is_valid(F.col("url"))).select(normalise(F.col("url")).alias("url"), "depth")
    return unvisited(fresh.groupBy("url").agg(F.min("depth").alias("depth")), visited, bloom)


def seeded(queue: DataFrame, seeds: DataFrame) -> DataFrame:
    """The queue, or the seeds at depth 0 if it is empty."""
    waiting = F.broadcast(queue.agg(F.count("*").alias("_waiting")))
    return queue.unionByName(seeds.select("url", F.lit(0).alias("depth")).crossJoin(waiting).where("_waiting = 0").drop("_waiting"))


def breadth_first(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(url, depth) of everything within `max_depth` links of the seeds; each level is kept before the next is looked for."""
    visited = keep(seeds.select("url").distinct().withColumn("depth", F.lit(0)), "visited")
    level = visited
    for depth in range(1, max_depth + 1):
        found = edges.join(level.select(F.col("url").alias("src")), "src").select(F.col("dst").alias("url")).distinct()
        level = keep(found.join(visited.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)), "level")
        if level.isEmpty():
            break
        visited = visited.unionByName(level)
    return visited


def popped(queue: DataFrame, n: int | None = None) -> DataFrame:
    """The queue in the order of work: urgent rows first, then by level, then as they came. With `n` only the next so many, for which no row is sorted
    but those of each task's best."""
    inorder = queue.orderBy("priority", "depth", "seq")
    return inorder.limit(n) if n is not None else inorder


def batches(queue: DataFrame, parts: int | None = None, burst: int = BURST) -> DataFrame:
    """(url, seq, batch): `burst` pages are fetched between two rests, in the order of `seq`.

    Rows are numbered without one task that sees them all: ranges of `seq` are counted first, then
    numbered from where the range before ends.
    """
    spark = queue.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = keep(queue.repartitionByRange(parts, "seq").withColumn("_part", F.spark_partition_id()), "queue")
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("seq"))
    return dealt.withColumn("_row", place).join(F.broadcast(before), "_part").select("url", "seq", F.floor((F.col("_before") + F.col("_row") - 1) / burst).cast("long").alias("batch"))


def titles(pages: DataFrame) -> DataFrame:
    """(page_id, title): what the page is shared as, else its title, else its first heading."""
    return read_pages(pages).select("page_id", clean(F.col("title")).alias("title"))


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, text): the page without menus, headers, footers, asides, forms, scripts and tags. A plain form of content extraction.

    Length is tested, and text cut, before white space is cleaned; too short a text gives null.
    """

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([own_text(h or "") for h in part.column(1).to_pylist()], pa.string())], names=["page_id", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    text = F.when(F.length("text") >= SHORTEST_CONTENT, clean(F.left("text", F.lit(LONGEST_CONTENT))))
    return pages.select("page_id", "html").mapInArrow(run, f"page_id {kind}, text string").select("page_id", text.alias("text"))


def readable_texts(pages: DataFrame) -> DataFrame:
    """(page_id, text): the whole readable part of each page by the scores of its paragraphs, its blocks on lines of their own; where no paragraph
    is long enough to tell, the text outside menus, headers and the like. Too short a text, as it stands in the page, gives null."""

    def read(page: str) -> tuple[str, int]:
        text, size = measured(page)
        return (text, size) if text else ((own := own_text(page)), len(own))

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                found = [read(h or "") for h in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t for t, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["page_id", "text", "size"])

    kind = pages.schema["page_id"].dataType.simpleString()
    lines = F.filter(F.transform(F.split("text", r"\n+"), clean), lambda x: x != "")
    text = F.when(F.col("size") >= SHORTEST_CONTENT, F.array_join(lines, "\n"))
    return pages.select("page_id", "html").mapInArrow(run, f"page_id {kind}, text string, size long").select("page_id", text.alias("text"))


def images(pages: DataFrame) -> DataFrame:
    """(page_id, position, image_url): the first few distinct image addresses of each page, in order."""
    first = F.slice(F.array_distinct(F.filter("images", is_image)), 1, MOST_IMAGES)
    return read_pages(pages).select("page_id", F.posexplode(first).alias("position", "image_url"))


def acceptable_image(width: Column, height: Column, base64: Column, side: int = 200, kilobytes: int = 500) -> Column:
    """Large enough to show, and small enough to keep."""
    return (width >= side) & (height >= side) & (F.length(base64) <= int(kilobytes * 1024 * 1.4))

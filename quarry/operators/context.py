"""What goes into and comes out of a language model's call; the call itself is not ours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import filled

MOST_RESULTS = 10


def result_block(rank: Column, title: Column, url: Column, snippet: Column) -> Column:
    return F.concat(F.lit("["), rank.cast("string"), F.lit("] "), filled(title, "Untitled"), F.lit(" | "), filled(url, "no address"), F.lit(" | "), filled(snippet, "no content"))


def results_context(results: DataFrame, keys: list[str], most: int = MOST_RESULTS) -> DataFrame:
    """One text for each key: the blocks of its best results, in order of rank (rank, title, url, snippet)."""
    best = results.where(F.col("rank") <= most)
    blocks = F.sort_array(F.collect_list(F.struct("rank", result_block(F.col("rank"), F.col("title"), F.col("url"), F.col("snippet")).alias("block"))))
    return best.groupBy(*keys).agg(F.array_join(F.transform(blocks, lambda x: x.block), "\n").alias("context"))


def transcript(turns: DataFrame) -> DataFrame:
    """(conv_id, transcript): lines of who said what, in order of turn."""
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.coalesce("text", F.lit("")))
    said = F.sort_array(F.collect_list(F.struct("turn", line.alias("line"))))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(said, lambda x: x.line), "\n").alias("transcript"))


def shown_turns(turns: DataFrame) -> DataFrame:
    """What a chat sends on: all of the user's turns, and the assistant's but for its greeting."""
    return turns.where((F.col("role") == "user") | ((F.col("role") == "assistant") & ~F.contains(F.col("text"), F.lit("Hi!"))))


#: What each request asks for, and which of its parts it has.
TASKS = {
    "summary": "Answer the query from the results. Name the numbers of the results that you use.",
    "chat": "Go on with the conversation. Use the results where they help.",
    "questions": "Write six questions that someone who asked this might ask next, one on each line.",
    "refine": "Rewrite the query so that a search engine finds more. Give the query only.",
}
MOST_CHAT_IMAGES = 4


def prompt(task: str, query: Column, context: Column) -> Column:
    """The text of a request: its task (a name of TASKS, or the text itself), the query, the results or turns it may use."""
    head = F.concat(F.lit(TASKS.get(task, task) + "\nQuery: "), F.coalesce(query, F.lit("")))
    return head if task == "refine" else F.concat(head, F.lit("\nConversation:\n" if task == "chat" else "\nResults:\n"), F.coalesce(context, F.lit("")))


def chat_images(results: DataFrame, keys: list[str], most: int = MOST_CHAT_IMAGES) -> DataFrame:
    """The first images over all results of a key (rank, images array), best results first."""
    each = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.coalesce("images", F.array().cast("array<string>")).alias("images")))), lambda x: x.images))
    return results.groupBy(*keys).agg(F.slice(each, 1, most).alias("images"))


def chosen_documents(ids: DataFrame, docs: DataFrame, passed: DataFrame | None = None) -> DataFrame:
    """Documents of a list of ids (column ids, array), in its order; ids without a document are passed over.

    If none has a document, the results that were `passed` along (position and the columns of `docs`) take their place.
    """
    found = ids.select(F.posexplode("ids").alias("position", "doc_id")).join(docs, "doc_id")
    if passed is not None:
        none = F.broadcast(found.agg(F.count("*").alias("_found")))
        found = found.unionByName(passed.select(found.columns).crossJoin(none).where("_found = 0").drop("_found"))
    return found.orderBy("position")

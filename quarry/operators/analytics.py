"""Search analytics, per-user history, cached answers and worker states, from append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HISTORY_LIMIT, RECENT, TOP_QUERIES = 50, 10, 20
CACHE_SECONDS, TRACE_SECONDS, STATUS_SECONDS = 600, 3600, 60


def latest(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first `n` rows of each key; the limit is applied before rows are exchanged."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def query_counts(log: DataFrame) -> DataFrame:
    """(query, count) of raw queries: case and spaces count."""
    return log.groupBy("query").agg(F.count("*").alias("count"))


def top_queries(log: DataFrame, n: int = TOP_QUERIES) -> DataFrame:
    return query_counts(log).orderBy(F.desc("count"), F.desc("query")).limit(n)


def recent_searches(log: DataFrame, n: int = RECENT) -> DataFrame:
    return log.orderBy(F.desc("ts"), F.desc("id")).limit(n)


def live(rows: DataFrame, ts: str, now: Column, seconds: int) -> DataFrame:
    """Rows not older than so many seconds."""
    return rows.where(F.col(ts) > now - F.make_interval(secs=F.lit(seconds)))


def latest_trace(log: DataFrame, now: Column, seconds: int = TRACE_SECONDS) -> DataFrame:
    return live(log, "ts", now, seconds).orderBy(F.desc("ts"), F.desc("id")).limit(1)


def worker_states(reports: DataFrame, now: Column | None = None, seconds: int = STATUS_SECONDS) -> DataFrame:
    """The last report of each worker; with `now`, only those that have not expired."""
    rows = live(reports, "ts", now, seconds) if now is not None else reports
    return latest(rows, ["worker_id"], [F.desc("ts"), F.desc("id")])


def dashboard(documents: DataFrame, images: DataFrame, queue: DataFrame, states: DataFrame) -> DataFrame:
    """One row: how many documents, images, queued pages, workers and active workers there are."""
    count = lambda df, name: F.broadcast(df.agg(F.count("*").alias(name)))
    active = F.broadcast(states.agg(F.count("*").alias("workers"), F.count_if(F.col("status") == "processing").alias("active_workers")))
    return count(documents, "total_documents").crossJoin(count(images, "total_images")).crossJoin(count(queue, "queue_size")).crossJoin(active)


def board(states: DataFrame) -> DataFrame:
    """Workers as a dashboard lists them: in the order of their ids, numbered from 1. There are a few of them."""
    return states.withColumn("place", F.row_number().over(Window.orderBy("worker_id")).cast("long"))


def health(components: dict[str, str]) -> list[tuple[str, str]]:
    """What a health report says: it is told, not measured."""
    return sorted(components.items())


def log_searches(spark, path: str, traces: DataFrame) -> DataFrame:
    """Append traces to the search log at `path`, and read it: counters, recent searches and suggestions are derived from it."""
    traces.write.mode("append").parquet(path)
    return spark.read.schema(traces.schema).parquet(path)


def history_add(history: DataFrame, new: DataFrame) -> DataFrame:
    """History with `new` in it: of each user and query, the last row stays."""
    return latest(history.unionByName(new), ["user_id", "query"], [F.desc("ts"), F.desc("id")])


def history_list(history: DataFrame, n: int = HISTORY_LIMIT) -> DataFrame:
    """The last `n` rows of each user."""
    return latest(history, ["user_id"], [F.desc("ts"), F.desc("id")], n)


def history_delete(history: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the rows named by (id, user_id); a user cannot name another's row."""
    return history.join(gone, ["id", "user_id"], "left_anti")


def history_clear(history: DataFrame, users: DataFrame) -> DataFrame:
    return history.join(users, "user_id", "left_anti")


def worth_keeping(searches: DataFrame) -> DataFrame:
    """Searches that a history takes: first pages, and none by image."""
    return searches.where("page = 1 and query <> '[Image Search]'")


def cache_live(entries: DataFrame, now: Column, seconds: int = CACHE_SECONDS) -> DataFrame:
    """The last value of each key that has not expired."""
    return latest(live(entries, "ts", now, seconds), ["key"], [F.desc("ts"), F.desc("id")])


def cache_invalidate(entries: DataFrame, key: Column) -> DataFrame:
    return entries.where(F.col("key") != key)

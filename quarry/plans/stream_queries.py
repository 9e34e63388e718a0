"""Streaming queries, each run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.urls import normalise
from quarry.sources.tables import table
from quarry.streaming import jobs, keyed

from .analytics_queries import _STATES, _TS, _stamp
from .crawl_queries import _norm
from .registry import query
from .sql import index_of


def _stream(spark, d, name):
    return jobs.stream_of(spark, f"{d}/{name}.parquet")


@query("stream_keyword_counts", "SELECT lower(trim(event_type)) AS keyword, count(*) AS count FROM events GROUP BY 1")
def stream_keyword_counts(spark, d):
    return jobs.keyword_counts(_stream(spark, d, "events"), "event_type")


@query("stream_url_dedupe", f"SELECT DISTINCT {_norm('url')} AS url FROM pages")
def stream_url_dedupe(spark, d):
    return jobs.first_seen(_stream(spark, d, "pages"), normalise(F.col("url")), "url")


@query("stream_worker_status", f"WITH {_STATES} SELECT worker_id, id, {_TS}, status FROM states")
def stream_worker_status(spark, d):
    e = _stream(spark, d, "events")
    reports = e.select((F.col("user_id") % 10).alias("worker_id"), F.col("event_id").alias("id"), "ts", F.when(F.col("event_type") == "click", "processing").otherwise(F.col("event_type")).alias("status"))
    return _stamp(jobs.last_status(reports), "ts")


@query("stream_worker_alive", f"WITH {_STATES} SELECT worker_id, id, {_TS}, status FROM states WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 60 SECOND")
def stream_worker_alive(spark, d):
    """Workers whose last report has not expired when the stream ends."""
    e = _stream(spark, d, "events")
    reports = e.select((F.col("user_id") % 10).alias("worker_id"), F.col("event_id").alias("id"), "ts", F.when(F.col("event_type") == "click", "processing").otherwise(F.col("event_type")).alias("status"))
    end = table(spark, d, "events").agg(F.max("ts")).first()[0]
    return _stamp(jobs.last_status(reports, F.lit(end)), "ts")


@query("stream_worker_expiry", f"WITH {_STATES} SELECT worker_id, id, {_TS}, status FROM states WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 60 SECOND")
def stream_worker_expiry(spark, d):
    """The same by state that expires under timers."""
    e = _stream(spark, d, "events")
    reports = e.select((F.col("user_id") % 10).alias("worker_id"), F.col("event_id").alias("id"), "ts", F.when(F.col("event_type") == "click", "processing").otherwise(F.col("event_type")).alias("status"))
    return _stamp(keyed.alive_workers(reports), "ts")


@query("stream_events_once", "SELECT event_type, count(*) AS events, sum(event_id)::BIGINT AS ids FROM events GROUP BY event_type")
def stream_events_once(spark, d):
    """Events that are delivered twice, counted once."""
    e = _stream(spark, d, "events").select("event_id", "event_type", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery")).drop("delivery")
    return keyed.without_repeats(e, ["event_id"], "ts", "1 hour", "event_id long, event_type string, ts timestamp").groupBy("event_type").agg(F.count("*").alias("events"), F.sum("event_id").alias("ids"))


@query("stream_document_upsert", "WITH p AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS url, length(html)::BIGINT AS size FROM pages) SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC) = 1")
def stream_document_upsert(spark, d):
    """URLs are cut to the host, so that documents come again."""
    pages = _stream(spark, d, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("url"), F.length("html").cast("long").alias("size"))
    return jobs.upserted(pages, "page_id long, url string, size long", ["page_id"])


# ten documents share an id, and the last of them counts
_AGAIN = "last_text AS (SELECT doc_id // 10 AS doc_id, text FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id // 10 ORDER BY documents.doc_id DESC) = 1)"


@query("stream_index_upsert", f"WITH {_AGAIN}, {index_of('last_text')} SELECT term, doc_frequency, total_frequency FROM terms")
def stream_index_upsert(spark, d):
    """Term statistics of an index that a stream of documents keeps up to date."""
    docs = _stream(spark, d, "documents").select(F.floor(F.col("doc_id") / 10).cast("long").alias("doc_id"), F.col("doc_id").alias("version"), "text")
    return jobs.indexed(docs, F.col("text"), ["version"]).terms.where("doc_frequency > 0")


@query("stream_traffic_ext", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS searches FROM events GROUP BY 1")
def stream_traffic(spark, d):
    return _stamp(jobs.traffic_stream(_stream(spark, d, "events"), "ts", "1 hour", "1 day"), "window_start").select("window_start", "searches")


@query("stream_recent", f"WITH r AS (SELECT event_id AS id, user_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100) SELECT id, user_id, {_TS} FROM r")
def stream_recent(spark, d):
    e = _stream(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", "ts")
    return _stamp(jobs.recent(e, "id long, user_id long, ts timestamp", ["ts", "id"]), "ts")


@query("traffic_windows_ext", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS searches FROM events GROUP BY 1")
def traffic_windows(spark, d):
    return _stamp(jobs.traffic(table(spark, d, "events"), "ts", "1 hour"), "window_start").select("window_start", "searches")


@query(
    "session_windows_ext",
    """WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM m)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS searches FROM s GROUP BY user_id, n""",
)
def session_windows(spark, d):
    return _stamp(jobs.sessions(table(spark, d, "events"), "user_id", "ts", "30 minutes"), "session_start")

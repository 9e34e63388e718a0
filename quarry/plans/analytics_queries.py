"""Queries over logs: dashboards, history, cached answers. `events` plays the search log."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.text import cache_key
from quarry.operators import analytics as a
from quarry.operators import context, heavy
from quarry.sources.tables import table

from .registry import query

_LOG = "log AS (SELECT event_id AS id, user_id, event_type AS query, ts FROM events)"


def _log(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("query"), "ts")


def _reports(spark, d):
    return table(spark, d, "events").select((F.col("user_id") % 10).alias("worker_id"), F.col("event_id").alias("id"), "ts", F.when(F.col("event_type") == "click", "processing").otherwise(F.col("event_type")).alias("status"))


_REPORTS = "reports AS (SELECT user_id % 10 AS worker_id, event_id AS id, ts, CASE WHEN event_type = 'click' THEN 'processing' ELSE event_type END AS status FROM events)"
_STATES = f"{_REPORTS}, states AS (SELECT * FROM reports QUALIFY row_number() OVER (PARTITION BY worker_id ORDER BY ts DESC, id DESC) = 1)"


def _stamp(df, *names):
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n in names})


_TS = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"


@query("top_keywords", f"WITH {_LOG} SELECT query, count(*) AS count FROM log GROUP BY query ORDER BY count DESC, query DESC LIMIT 20")
def top_keywords(spark, d):
    return a.top_queries(_log(spark, d))


_KEY = "event_type || ' ' || length(bin(user_id))"


@query("heavy_hitters", f"WITH k AS (SELECT {_KEY} AS key FROM events) SELECT key, count(*) AS count FROM k GROUP BY key HAVING count(*) >= 0.03 * (SELECT count(*) FROM k)")
def heavy_hitters(spark, d):
    """Searches with three hundredths of the log or more, by summaries of two halves with fewer counters than there are searches."""
    log = table(spark, d, "events").select("event_id", F.concat_ws(" ", "event_type", F.length(F.bin("user_id"))).alias("key"))
    halves = [heavy.summarise(log.where(F.col("event_id") % 2 == k), "key", 24) for k in (0, 1)]
    return heavy.frequent(log, "key", heavy.merged(halves), 0.03)


@query("recent_searches", f"WITH {_LOG}, r AS (SELECT * FROM log ORDER BY ts DESC, id DESC LIMIT 10) SELECT id, user_id, query, {_TS} FROM r")
def recent_searches(spark, d):
    return _stamp(a.recent_searches(_log(spark, d)), "ts")


@query("latest_trace", f"WITH {_LOG}, r AS (SELECT * FROM log WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 HOUR ORDER BY ts DESC, id DESC LIMIT 1) SELECT id, user_id, query, {_TS} FROM r")
def latest_trace(spark, d):
    log = _log(spark, d)
    # the clock is the log's own last moment
    now = F.broadcast(log.agg(F.max("ts").alias("now")))
    return _stamp(a.latest_trace(log.crossJoin(now), F.col("now")).drop("now"), "ts")


@query("worker_states", f"WITH {_STATES} SELECT worker_id, id, {_TS}, status FROM states")
def worker_states(spark, d):
    return _stamp(a.worker_states(_reports(spark, d)), "ts")


@query("dashboard_stats", f"WITH {_STATES} SELECT (SELECT count(*) FROM documents) AS total_documents, (SELECT count(*) FROM embeddings) AS total_images, (SELECT count(*) FROM pages) AS queue_size, count(*) AS workers, count(*) FILTER (status = 'processing') AS active_workers FROM states")
def dashboard_stats(spark, d):
    return a.dashboard(table(spark, d, "documents"), table(spark, d, "embeddings"), table(spark, d, "pages"), a.worker_states(_reports(spark, d)))


@query("crawler_monitor", f"WITH {_STATES} SELECT count(*) AS alive, (SELECT count(*) FROM pages) AS queued, (SELECT count(DISTINCT url) FROM pages) AS visited FROM states")
def crawler_monitor(spark, d):
    alive = F.broadcast(a.worker_states(_reports(spark, d)).agg(F.count("*").alias("alive")))
    return table(spark, d, "pages").agg(F.count("*").alias("queued"), F.count_distinct("url").alias("visited")).crossJoin(alive).select("alive", "queued", "visited")


@query("docs_per_source", "SELECT source, count(*) AS documents FROM documents GROUP BY source")
def docs_per_source(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("documents"))


@query("history_add_dedupe", f"WITH {_LOG}, h AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY user_id, query ORDER BY ts DESC, id DESC) = 1) SELECT id, user_id, query, {_TS} FROM h")
def history_add_dedupe(spark, d):
    log = _log(spark, d)
    return _stamp(a.history_add(log.where("id % 2 = 0"), log.where("id % 2 = 1")), "ts")


@query("history_latest_50", f"WITH {_LOG}, h AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) <= 50) SELECT id, user_id, query, {_TS} FROM h")
def history_latest_50(spark, d):
    return _stamp(a.history_list(_log(spark, d)), "ts")


@query("history_delete", f"WITH {_LOG} SELECT user_id, count(*) AS kept FROM log WHERE NOT (query = 'error') GROUP BY user_id")
def history_delete(spark, d):
    log = _log(spark, d)
    return a.history_delete(log, log.where("query = 'error'").select("id", "user_id")).groupBy("user_id").agg(F.count("*").alias("kept"))


@query("history_clear", f"WITH {_LOG} SELECT user_id, count(*) AS kept FROM log WHERE user_id NOT IN (SELECT user_id FROM log WHERE query = 'signup' GROUP BY user_id HAVING count(*) > 12) GROUP BY user_id")
def history_clear(spark, d):
    log = _log(spark, d)
    users = log.where("query = 'signup'").groupBy("user_id").agg(F.count("*").alias("n")).where("n > 12").select("user_id")
    return a.history_clear(log, users).groupBy("user_id").agg(F.count("*").alias("kept"))


@query("history_worth_keeping", "SELECT user_id, count(*) AS searches FROM events WHERE event_id % 3 + 1 = 1 AND event_type <> 'view' GROUP BY user_id")
def history_worth_keeping(spark, d):
    log = table(spark, d, "events").select("user_id", (F.col("event_id") % 3 + 1).alias("page"), F.when(F.col("event_type") == "view", "[Image Search]").otherwise(F.col("event_type")).alias("query"))
    return a.worth_keeping(log).groupBy("user_id").agg(F.count("*").alias("searches"))


_ENTRIES = "entries AS (SELECT 'quarry:summary:' || md5(lower(trim(event_type)) || ':' || user_id % 5) AS key, event_id AS id, ts, value FROM events)"


def _entries(spark, d):
    e = table(spark, d, "events")
    return e.select(cache_key(F.col("event_type"), F.array(F.col("user_id") % 5)).alias("key"), F.col("event_id").alias("id"), "ts", "value")


@query("cache_live_entries", f"WITH {_ENTRIES} SELECT key, id, round(value, 6) AS value FROM entries WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 600 SECOND QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, id DESC) = 1")
def cache_live_entries(spark, d):
    entries = _entries(spark, d)
    now = F.broadcast(entries.agg(F.max("ts").alias("now")))
    return a.cache_live(entries.crossJoin(now), F.col("now")).select("key", "id", F.round("value", 6).alias("value"))


@query("cache_invalidate", f"WITH {_ENTRIES} SELECT key, count(*) AS entries FROM entries WHERE key <> 'quarry:summary:' || md5('view:3') GROUP BY key")
def cache_invalidate(spark, d):
    key = cache_key(F.lit(" View"), F.array(F.lit(3).cast("long")))
    return a.cache_invalidate(_entries(spark, d), key).groupBy("key").agg(F.count("*").alias("entries"))


@query("cache_stats", f"WITH {_ENTRIES} SELECT count(*) AS entries, count(DISTINCT key) AS keys FROM entries")
def cache_stats(spark, d):
    return _entries(spark, d).agg(F.count("*").alias("entries"), F.count_distinct("key").alias("keys"))


@query("json_trace", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"query\":\"' || event_type || '\",\"k\":' || json_extract(props, '$.k') || '}' AS trace FROM events")
def json_trace(spark, d):
    e = table(spark, d, "events").withColumn("p", F.from_json("props", "k bigint"))
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.to_json(F.struct(F.col("event_type").alias("query"), F.col("p.k").alias("k"))).alias("trace"))


@query(
    "llm_context",
    """WITH r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank, source AS title, '' AS url,
CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS snippet FROM documents)
SELECT lang, md5(string_agg('[' || rank || '] ' || title || ' | no address | ' || coalesce(nullif(snippet, ''), 'no content'), chr(10) ORDER BY rank)) AS context_md5 FROM r WHERE rank <= 10 GROUP BY lang""",
)
def llm_context(spark, d):
    from pyspark.sql import Window

    from quarry.functions.text import snippet

    docs = table(spark, d, "documents")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id"))
    results = docs.withColumn("rank", rank).where("rank <= 10").select("lang", "rank", F.col("source").alias("title"), F.lit("").alias("url"), snippet(F.col("text")).alias("snippet"))
    return context.results_context(results, ["lang"]).select("lang", F.md5(F.col("context").cast("binary")).alias("context_md5"))


_SAID = "CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || coalesce(text, '')"


@query("chat_transcript", f"SELECT conv_id, md5(string_agg({_SAID}, chr(10) ORDER BY turn)) AS transcript_md5 FROM conversations GROUP BY conv_id")
def chat_transcript(spark, d):
    return context.transcript(table(spark, d, "conversations")).select("conv_id", F.md5(F.col("transcript").cast("binary")).alias("transcript_md5"))


@query("chat_prompt", f"SELECT conv_id, md5('Refine the query.' || chr(10) || 'Query: ' || min(text) FILTER (turn = 0) || chr(10) || 'Results:' || chr(10) || string_agg({_SAID}, chr(10) ORDER BY turn)) AS prompt_md5 FROM conversations GROUP BY conv_id HAVING count(*) FILTER (turn = 0) > 0")
def chat_prompt(spark, d):
    turns = table(spark, d, "conversations")
    first = turns.where("turn = 0").groupBy("conv_id").agg(F.min("text").alias("query"))
    both = context.transcript(turns).join(first, "conv_id")
    return both.select("conv_id", F.md5(context.prompt("Refine the query.", F.col("query"), F.col("transcript")).cast("binary")).alias("prompt_md5"))


@query("chat_filter", "SELECT conv_id, count(*) AS turns FROM conversations WHERE role = 'user' OR (role = 'assistant' AND NOT contains(text, 'Hi!')) GROUP BY conv_id")
def chat_filter(spark, d):
    return context.shown_turns(table(spark, d, "conversations")).groupBy("conv_id").agg(F.count("*").alias("turns"))


@query("chosen_documents", "WITH l AS (SELECT unnest([5, 3, 999999999, 8])::BIGINT AS doc_id, generate_subscripts([5, 3, 999999999, 8], 1) - 1 AS position) SELECT position::BIGINT AS position, doc_id, lang, source FROM l JOIN documents USING (doc_id)")
def chosen_documents(spark, d):
    ids = spark.range(1).select(F.array(*[F.lit(x).cast("long") for x in (5, 3, 999999999, 8)]).alias("ids"))
    return context.chosen_documents(ids, table(spark, d, "documents")).select(F.col("position").cast("long").alias("position"), "doc_id", "lang", "source")

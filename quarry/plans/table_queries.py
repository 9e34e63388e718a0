"""Queries of sources, sinks and the smaller operators around search and crawl."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.functions.vectors import embedding_text, encoder, letter_counts
from quarry.operators import analytics, context, crawl, retrieve
from quarry.sources import csv_documents, samples, tables
from quarry.sources.tables import table

from .analytics_queries import _STATES, _TS, _reports, _stamp
from .registry import query
from .search_queries import _query_vector, _vectors
from .sql import VECTOR


def _folder(spark, name):
    return f"{tables.working_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"


@query("csv_first_rows", "SELECT row_number() OVER (ORDER BY p_partkey) AS row_number, p_name AS title, p_type AS content, '' AS url FROM part ORDER BY p_partkey LIMIT 100")
def csv_first_rows(spark, d):
    """A CSV file with a header, of which the loader takes the first hundred rows; the first thousand parts are in it."""
    path = _folder(spark, "csv")
    part = table(spark, d, "part").orderBy("p_partkey").limit(1000).select(F.col("p_name").alias("title"), F.col("p_type").alias("answer"), F.lit("").alias("link"))
    part.write.option("header", True).csv(path)
    return csv_documents.read_csv_documents(spark, path)


@query("sample_documents", "SELECT source AS source_type, count(*)::INTEGER AS documents, count(DISTINCT doc_id)::INTEGER AS urls FROM documents GROUP BY source UNION ALL SELECT 'web', 10, 10")
def sample_documents(spark, d):
    """The samples beside the documents of the table."""
    docs = table(spark, d, "documents").select(F.col("source").alias("source_type"), F.concat(F.lit("https://docs.example.org/"), "doc_id").alias("url"))
    return docs.unionByName(samples.sample_documents(spark).select("source_type", "url")).groupBy("source_type").agg(F.count("*").cast("int").alias("documents"), F.count_distinct("url").cast("int").alias("urls"))


@query("cleared_table", "SELECT 'before' AS what, count(*) AS n FROM customer UNION ALL SELECT 'after', 0")
def cleared_table(spark, d):
    """A table of the engine's own, written and cleared."""
    customers, path = table(spark, d, "customer"), _folder(spark, "customer")
    customers.write.parquet(path)
    before = spark.read.parquet(path).count()
    after = tables.overwrite_empty(spark, path, customers.schema)
    return after.agg(F.count("*").alias("n")).select(F.lit("after").alias("what"), "n").union(spark.createDataFrame([("before", before)], "what string, n long"))


@query("active_users", "SELECT c_custkey AS id, c_name AS name, 'user' || c_custkey || '@example.org' AS email FROM customer WHERE c_acctbal >= 0")
def active_users(spark, d):
    """Users that are not softly deleted, without what only the server may know."""
    users = table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.concat(F.lit("user"), "c_custkey", F.lit("@example.org")).alias("email"),
        F.sha2(F.col("c_name"), 256).alias("password_hash"), F.when(F.col("c_acctbal") < 0, F.lit("2024-01-01")).alias("deleted_at"),
    )
    return tables.public(tables.active(users))


_QUEUE = "queue AS (SELECT url, page_id % 4 AS depth, CASE WHEN page_id % 9 = 0 THEN 0 ELSE 1 END AS priority, page_id AS seq FROM pages)"


def _queue(spark, d):
    return table(spark, d, "pages").select("url", (F.col("page_id") % 4).alias("depth"), F.when(F.col("page_id") % 9 == 0, 0).otherwise(1).alias("priority"), F.col("page_id").alias("seq"))


@query("crawl_queue_order", f"WITH {_QUEUE} SELECT url, depth, priority, seq FROM queue ORDER BY priority, depth, seq LIMIT 25")
def crawl_queue_order(spark, d):
    """The next pages to be fetched."""
    return crawl.popped(_queue(spark, d)).limit(25)


@query("crawl_seeding", "SELECT 'empty' AS queue, count(*) AS waiting, sum(0)::BIGINT AS depth FROM pages WHERE page_id % 10 = 0 UNION ALL SELECT 'filled', count(*), sum(page_id % 4)::BIGINT FROM pages")
def crawl_seeding(spark, d):
    """Seeds enter an empty queue, and only that."""
    queue, seeds = _queue(spark, d).select("url", "depth"), table(spark, d, "pages").where("page_id % 10 = 0").select("url")
    told = lambda q, name: crawl.seeded(q, seeds).agg(F.count("*").alias("waiting"), F.sum("depth").alias("depth")).select(F.lit(name).alias("queue"), "waiting", "depth")
    return told(queue.limit(0), "empty").union(told(queue, "filled"))


@query("image_acceptance", "SELECT page_id, page_id * 37 % 600 >= 200 AND page_id * 53 % 500 >= 200 AND page_id * 7919 % 1000000 <= 716800 AS accepted FROM pages")
def image_acceptance(spark, d):
    images = table(spark, d, "pages").select("page_id", (F.col("page_id") * 37 % 600).alias("width"), (F.col("page_id") * 53 % 500).alias("height"), F.repeat(F.lit("x"), (F.col("page_id") * 7919 % 1000000).cast("int")).alias("base64"))
    return images.select("page_id", crawl.acceptable_image(F.col("width"), F.col("height"), F.col("base64")).alias("accepted"))


@query("image_search_response", f"WITH {VECTOR.format(query=7)}, t AS (SELECT * FROM vec ORDER BY score DESC, doc_id LIMIT 10) SELECT doc_id, row_number() OVER (ORDER BY t.score DESC, doc_id) AS rank, round(t.score, 6) AS score, '[Image Search]' AS query, 10::BIGINT AS total, 1::BIGINT AS page, 10::BIGINT AS page_size, 1::BIGINT AS total_pages FROM t")
def image_search_response(spark, d):
    found = retrieve.vector_search(_vectors(spark, d), _query_vector(spark, d, 7), 10)
    return retrieve.image_response(found).withColumn("score", F.round("score", 6))


@query("worker_board", f"WITH {_STATES} SELECT worker_id, id, {_TS}, status, row_number() OVER (ORDER BY worker_id) AS place FROM states")
def worker_board(spark, d):
    return _stamp(analytics.board(analytics.worker_states(_reports(spark, d))), "ts")


@query("dashboard_keywords", "SELECT c_mktsegment || ' ' || c_nationkey AS query, count(*) AS count FROM customer GROUP BY 1 ORDER BY count DESC, query DESC LIMIT 8")
def dashboard_keywords(spark, d):
    """The eight keywords that a dashboard has room for."""
    return analytics.top_queries(table(spark, d, "customer").select(F.concat_ws(" ", "c_mktsegment", "c_nationkey").alias("query")), 8)


@query("search_log_sink", "WITH log AS (SELECT event_id AS id, event_type AS query FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, event_type FROM events WHERE event_id % 3 = 0) SELECT query, count(*) AS count FROM log GROUP BY query")
def search_log_sink(spark, d):
    """Traces appended in two goes; counters are read off the log."""
    path, events = _folder(spark, "log"), table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("query"), "ts")
    analytics.log_searches(spark, path, events.where("id % 2 = 0"))
    return analytics.query_counts(analytics.log_searches(spark, path, events.where("id % 3 = 0")))


@query("event_epochs", "SELECT event_id, round(epoch(ts), 3) AS epoch_seconds FROM events")
def event_epochs(spark, d):
    return table(spark, d, "events").select("event_id", F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, 3).alias("epoch_seconds"))


@query("chosen_documents_fallback", "SELECT doc_id AS position, -doc_id AS doc_id, lang, 'passed' AS source FROM documents WHERE n_chars > 3000")
def chosen_documents_fallback(spark, d):
    """None of the ids has a document, so the results that came with them are used."""
    docs = table(spark, d, "documents")
    ids = docs.agg(F.array(-F.max("doc_id") - 5, -F.max("doc_id") - 6).alias("ids"))
    passed = docs.where("n_chars > 3000").select(F.col("doc_id").alias("position"), (-F.col("doc_id")).alias("doc_id"), "lang", F.lit("passed").alias("source"))
    return context.chosen_documents(ids, docs.select("doc_id", "lang", "source"), passed).select(F.col("position").cast("long").alias("position"), "doc_id", "lang", "source")


_FIRST = "first AS (SELECT conv_id, coalesce(min(text) FILTER (turn = 0), '') AS query, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || coalesce(text, ''), chr(10) ORDER BY turn) AS said FROM conversations GROUP BY conv_id)"


def _prompt_sql(task: str) -> str:
    rest = "" if task == "refine" else f" || chr(10) || '{'Conversation' if task == 'chat' else 'Results'}:' || chr(10) || said"
    return f"SELECT conv_id, '{task}' AS task, md5('{context.TASKS[task]}' || chr(10) || 'Query: ' || query{rest}) AS prompt_md5 FROM first"


@query("prompts", f"WITH {_FIRST} " + " UNION ALL ".join(_prompt_sql(t) for t in context.TASKS))
def prompts(spark, d):
    """All kinds of requests, for every conversation; one without a first turn has an empty query."""
    turns = table(spark, d, "conversations")
    first = turns.groupBy("conv_id").agg(F.min(F.when(F.col("turn") == 0, F.col("text"))).alias("query"))
    both = context.transcript(turns).join(first, "conv_id")
    each = [F.struct(F.lit(t).alias("task"), F.md5(context.prompt(t, F.col("query"), F.col("transcript")).cast("binary")).alias("prompt_md5")) for t in context.TASKS]
    return both.select("conv_id", F.inline(F.array(*each)))


@query("chat_images", "WITH r AS (SELECT doc_id % 20 AS k, doc_id AS rank, unnest(['a' || doc_id, 'b' || doc_id]) AS image, unnest([1, 2]) AS n FROM documents WHERE doc_id % 3 <> 0) SELECT k, array_to_string(list(image ORDER BY rank, n)[1:4], ' ') AS images FROM r GROUP BY k")
def chat_images(spark, d):
    """A chat takes along the first four images over all its results."""
    r = table(spark, d, "documents").select((F.col("doc_id") % 20).alias("k"), F.col("doc_id").alias("rank"), F.when(F.col("doc_id") % 3 != 0, F.array(F.concat(F.lit("a"), "doc_id"), F.concat(F.lit("b"), "doc_id"))).alias("images"))
    return context.chat_images(r, ["k"]).select("k", F.array_join("images", " ").alias("images"))


_COUNTS = ", ".join(f"(length(t) - length(replace(t, '{c}', '')))::DOUBLE" for c in "aeiou")


@query("embed_documents", f"WITH d AS (SELECT doc_id, lang || ' ' || source || '. ' || text AS t FROM documents), v AS (SELECT doc_id, [{_COUNTS}] AS v FROM d) SELECT doc_id, " + ", ".join(f"round(coalesce(v[{k}] / nullif(sqrt(list_inner_product(v, v)), 0), 0), 6) AS x{k}" for k in range(1, 6)) + " FROM v")
def embed_documents(spark, d):
    """Documents through a model that stands where a real one would, brought to length 1."""
    docs = table(spark, d, "documents").select("doc_id", encoder(letter_counts("aeiou"))(embedding_text(F.concat_ws(" ", "lang", "source"), F.col("text"))).alias("v"))
    return docs.select("doc_id", *[F.round(F.col("v")[k], 6).alias(f"x{k + 1}") for k in range(5)])

"""Queries over the inverted index and its maintenance."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.functions.tokens import TOKEN, tokens
from quarry.operators import index as ix
from quarry.operators import maintain, segments
from quarry.operators.retrieve import bm25_search, keywords_tfidf
from quarry.operators.segments import open_segments
from quarry.sources.csv_documents import coalesce_columns
from quarry.sources.tables import table, table_counts, working_dir

from .registry import query
from .text_queries import AZ, FOUR, HAN_LETTERS, as_han
from .sql import INDEX, TOK, TOKENS, bm25, index_of

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("document_count", "SELECT count(*) AS documents FROM documents")
def document_count(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("documents"))


@query("table_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES))
def all_table_counts(spark, d):
    return table_counts({t: table(spark, d, t) for t in TABLES})


@query("tokenize_documents", f"WITH {TOK} SELECT doc_id, len(tokens)::BIGINT AS token_count, md5(array_to_string(tokens, ' ')) AS joined_md5 FROM tok")
def tokenize_documents(spark, d):
    t = ix.tokenised(table(spark, d, "documents"), F.col("text"))
    return t.select("doc_id", F.size("tokens").cast("long").alias("token_count"), F.md5(F.array_join("tokens", " ").cast("binary")).alias("joined_md5"))


@query("doc_lengths", f"WITH {INDEX} SELECT * FROM len")
def doc_lengths(spark, d):
    return ix.open_index(spark, d).lengths


@query("postings", f"WITH {INDEX} SELECT term, doc_id, tf FROM post")
def postings(spark, d):
    return ix.open_index(spark, d).rows.select("term", "doc_id", "tf")


@query(
    "posting_positions",
    f"""WITH {TOK}, pos AS (SELECT doc_id, unnest(tokens) AS term, generate_subscripts(tokens, 1) - 1 AS p FROM tok)
SELECT term, doc_id, count(*) AS tf, array_to_string(list_slice(list_sort(list(p)), 1, 5), ',') AS first_positions FROM pos GROUP BY term, doc_id""",
)
def posting_positions(spark, d):
    p = ix.postings_in(ix.by_document(table(spark, d, "documents"), F.col("text")))
    return p.select("term", "doc_id", "tf", F.array_join(F.slice("positions", 1, 5).cast("array<string>"), ",").alias("first_positions"))


@query("term_stats", f"WITH {INDEX} SELECT * FROM terms")
def term_stats(spark, d):
    return ix.open_index(spark, d).terms


@query("doc_stats", f"WITH {INDEX} SELECT total_docs, round(avg_doc_length, 6) AS avg_doc_length FROM stats")
def doc_stats(spark, d):
    return ix.open_index(spark, d).stats.select("total_docs", F.round("avg_doc_length", 6).alias("avg_doc_length"))


@query("top_terms", f"WITH {INDEX} SELECT * FROM terms ORDER BY total_frequency DESC, term LIMIT 10")
def top_terms(spark, d):
    return ix.top_terms(ix.open_index(spark, d).terms)


@query("term_posting_list", f"WITH {INDEX} SELECT term, doc_id, tf, doc_frequency, total_frequency, doc_length FROM post JOIN terms USING (term) JOIN len USING (doc_id) WHERE term = 'the' ORDER BY tf DESC, doc_id LIMIT 5")
def term_posting_list(spark, d):
    i = ix.open_index(spark, d)
    return ix.term_documents(i.postings, i.terms, "the").select("term", "doc_id", "tf", "doc_frequency", "total_frequency", "doc_length")


@query("doc_top_terms", f"WITH {INDEX} SELECT term, tf, doc_frequency, total_frequency FROM post JOIN terms USING (term) WHERE doc_id = 1 ORDER BY tf DESC, term LIMIT 10")
def doc_top_terms(spark, d):
    i = ix.open_index(spark, d)
    return ix.document_terms(i.rows, i.terms, 1).select("term", "tf", "doc_frequency", "total_frequency")


_GONE = "gone AS (SELECT doc_id FROM documents WHERE lang = 'de')"


def _gone(spark, d):
    return table(spark, d, "documents").where("lang = 'de'").select("doc_id")


@query("orphan_terms", f"WITH {INDEX}, {_GONE} SELECT term FROM terms WHERE term NOT IN (SELECT term FROM post WHERE doc_id NOT IN (SELECT doc_id FROM gone))")
def orphan_terms(spark, d):
    i = ix.open_index(spark, d)
    left, _ = ix.delete_documents(i.rows, i.lengths, _gone(spark, d))
    return ix.orphan_terms(i.terms, left).select("term")


@query(
    "delete_documents",
    f"""WITH {INDEX}, {_GONE}, kept AS (SELECT * FROM post WHERE doc_id NOT IN (SELECT doc_id FROM gone))
SELECT term, coalesce(n, 0)::BIGINT AS doc_frequency, coalesce(f, 0)::BIGINT AS total_frequency
FROM terms LEFT JOIN (SELECT term, count(*) AS n, sum(tf) AS f FROM kept GROUP BY term) USING (term)""",
)
def delete_documents(spark, d):
    i = ix.open_index(spark, d)
    left, _ = ix.delete_documents(i.rows, i.lengths, _gone(spark, d))
    return ix.refreshed_terms(i.terms, left)


@query("delete_doc_stats", f"WITH {INDEX}, {_GONE} SELECT count(*) AS total_docs, round(coalesce(avg(doc_length), 0), 6) AS avg_doc_length FROM len WHERE doc_length > 0 AND doc_id NOT IN (SELECT doc_id FROM gone)")
def delete_doc_stats(spark, d):
    left = ix.delete_lengths(ix.open_index(spark, d).lengths, _gone(spark, d))
    return ix.doc_stats(left).select("total_docs", F.round("avg_doc_length", 6).alias("avg_doc_length"))


@query("cascade_delete", f"WITH {_GONE} SELECT count(*) AS embeddings_left FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM gone)")
def cascade_delete(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return maintain.cascade(vectors, _gone(spark, d)).agg(F.count("*").alias("embeddings_left"))


@query(
    "keywords_tfidf",
    f"""WITH {INDEX}, w AS (SELECT doc_id, term, round(tf / doc_length * ln(total_docs / doc_frequency), 9) AS weight FROM post JOIN terms USING (term) JOIN len USING (doc_id), stats),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS rank FROM w)
SELECT doc_id, rank, term, round(weight, 6) AS weight FROM r WHERE rank <= 10""",
)
def tfidf(spark, d):
    return keywords_tfidf(ix.open_index(spark, d)).select("doc_id", F.col("rank").cast("long").alias("rank"), "term", F.round("weight", 6).alias("weight"))


_TITLED = "titled AS (SELECT page_id, url, regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1) AS title FROM pages)"


@query(
    "upsert_by_url",
    """WITH incoming AS (SELECT page_id, 'https://' || regexp_extract(url, '://([^/?#]*)', 1) AS url, length(html)::BIGINT AS size FROM pages WHERE page_id % 2 = 1),
current AS (SELECT page_id, 'https://' || regexp_extract(url, '://([^/?#]*)', 1) AS url, length(html)::BIGINT AS size FROM pages WHERE page_id % 2 = 0),
newest AS (SELECT * FROM incoming QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC) = 1)
SELECT * FROM current WHERE url NOT IN (SELECT url FROM newest) UNION ALL SELECT * FROM newest""",
)
def upsert(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.concat(F.lit("https://"), F.regexp_extract("url", "://([^/?#]*)", 1)).alias("url"), F.length("html").cast("long").alias("size"))
    # two crawls: pages with an odd number came later
    return maintain.upsert_by_url(pages.where("page_id % 2 = 0"), pages.where("page_id % 2 = 1"), ["page_id"])


@query(
    "purge_bad_docs",
    f"""WITH {_TITLED}, bad AS (SELECT * FROM titled WHERE title = 'The' OR contains(title, '&amp;') OR contains(title, '***'))
SELECT 'kept' AS what, count(*) AS n FROM titled WHERE page_id NOT IN (SELECT page_id FROM bad)
UNION ALL SELECT 'requeued', count(DISTINCT url) FROM bad WHERE url <> ''""",
)
def purge_bad_docs(spark, d):
    docs = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "url", F.regexp_extract("html", "<title[^>]*>([^<]*)</title>", 1).alias("title"))
    kept, again = maintain.purge(docs, maintain.bad_documents(docs, ["The"], ["&amp;", "***"]))
    count = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return count(kept, "kept").unionByName(count(again, "requeued"))


@query("metadata_enrich", "SELECT doc_id, lang AS lang_value, md5(lang || ' ' || source) AS original_title_md5, md5(text) AS original_content_md5, 3::BIGINT AS entries FROM documents")
def metadata_enrich(spark, d):
    docs = table(spark, d, "documents")
    meta = maintain.enriched_metadata(F.create_map(F.lit("lang"), F.col("lang")), F.concat_ws(" ", "lang", "source"), F.col("text"))
    m = docs.select("doc_id", meta.alias("m"))
    digest = lambda k: F.md5(F.col("m")[k].cast("binary"))
    return m.select("doc_id", F.col("m")["lang"].alias("lang_value"), digest("original_title").alias("original_title_md5"), digest("original_content").alias("original_content_md5"), F.size("m").cast("long").alias("entries"))


@query(
    "csv_coalesce",
    """SELECT p_partkey AS row_number, coalesce(nullif(CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name END, ''), 'Document ' || p_partkey) AS title,
coalesce(nullif(CASE WHEN p_size % 2 = 0 THEN '' ELSE p_type END, ''), concat_ws(' ', nullif(CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name END, ''), p_brand)) AS content, '' AS url FROM part""",
)
def csv_coalesce(spark, d):
    part = table(spark, d, "part")
    rows = part.select(
        "p_partkey", "p_brand", F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_name")).alias("title"), F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_type")).alias("description")
    )
    return coalesce_columns(rows, F.col("p_partkey"), ["title", "description", "p_brand"])


@query("query_tokens_roundtrip", f"WITH {TOK}, again AS (SELECT doc_id, array_to_string(tokens, ' ') AS text FROM tok), twice AS (SELECT doc_id, {TOKENS} AS tokens FROM again) SELECT doc_id, len(tokens)::BIGINT AS tokens, md5(array_to_string(tokens, ' ')) AS joined_md5 FROM twice")
def query_tokens_roundtrip(spark, d):
    """Tokens of the joined tokens: a query is cut once to be cleaned and once more to be searched."""
    t = ix.tokenised(table(spark, d, "documents"), F.col("text"))
    again = t.select("doc_id", tokens(F.array_join("tokens", " ")).alias("tokens"))
    return again.select("doc_id", F.size("tokens").cast("long").alias("tokens"), F.md5(F.array_join("tokens", " ").cast("binary")).alias("joined_md5"))


def _pairs(step: int) -> str:
    cut = f"list_transform(range(1, greatest(length(run) - 1, 1) + 1, {step}), lambda i: run[i:i + 1])"
    return f"array_to_string(list_filter(flatten(list_transform(runs, lambda run: CASE WHEN run >= '一' THEN {cut} ELSE [run] END)), lambda t: length(t) >= 2), ' ')"


@query(
    "tokenize_han",
    f"""WITH r AS (SELECT doc_id, regexp_extract_all(translate(regexp_replace(lower(text), '{FOUR}', '\\1\\2\\3\\4 ', 'g'), '{AZ}', '{HAN_LETTERS}'), '[一-鿕]+|{TOKEN}') AS runs FROM documents)
SELECT doc_id, md5({_pairs(1)}) AS searched, md5({_pairs(2)}) AS accurate FROM r""",
)
def tokenize_han(spark, d):
    """Tokens of the documents as Han text, four words run together, for searches and cut accurately."""
    docs = table(spark, d, "documents").select("doc_id", as_han(F.col("text")).alias("text"))
    return docs.select("doc_id", *[F.md5(F.array_join(tokens("text", mode), " ").cast("binary")).alias(name) for mode, name in (("search", "searched"), ("accurate", "accurate"))])


@query(
    "tokenize_report",
    f"""WITH {INDEX}, w AS (SELECT doc_id, term, round(tf / doc_length * ln(total_docs / doc_frequency), 9) AS weight FROM post JOIN terms USING (term) JOIN len USING (doc_id), stats),
k AS (SELECT doc_id, string_agg(term, ' ' ORDER BY rank) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS rank FROM w) WHERE rank <= 10 GROUP BY doc_id)
SELECT doc_id, md5(text) AS original_md5, md5(array_to_string(tokens, ' ')) AS tokens_md5, coalesce(keywords, '') AS keywords, len(tokens)::BIGINT AS token_count FROM documents JOIN tok USING (doc_id) LEFT JOIN k USING (doc_id)""",
)
def tokenize_report(spark, d):
    """What the tokeniser makes of each text: the text, its tokens, its keywords, how many tokens there are."""
    best = keywords_tfidf(ix.open_index(spark, d)).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("k")).select("doc_id", F.array_join("k.term", " ").alias("keywords"))
    digest = lambda c: F.md5(c.cast("binary"))
    docs = table(spark, d, "documents").select("doc_id", "text", tokens("text").alias("tokens"))
    # digests and not texts are exchanged
    docs = docs.select("doc_id", digest(F.col("text")).alias("original_md5"), digest(F.array_join("tokens", " ")).alias("tokens_md5"), F.size("tokens").cast("long").alias("token_count"))
    return docs.join(best, "doc_id", "left").select("doc_id", "original_md5", "tokens_md5", F.coalesce("keywords", F.lit("")).alias("keywords"), "token_count")


_TITLED_DOCS = "titled_docs AS (SELECT doc_id, lang || ' ' || source || ' ' || text AS text FROM documents)"


@query("titled_term_stats", f"WITH {_TITLED_DOCS}, {index_of('titled_docs')} SELECT * FROM terms")
def titled_term_stats(spark, d):
    """Statistics where title and content are indexed together."""
    docs = table(spark, d, "documents")
    return ix.term_stats(ix.postings_in(ix.by_document(docs, ix.full_text(F.concat_ws(" ", "lang", "source"), F.col("text")))))


# a later crawl: every fifth document has a new text, every seventh comes under a new id, and German ones are replaced
_LATER = """incoming AS (SELECT doc_id, 'updated ' || lang || ' ' || left(text, 300) AS text FROM documents WHERE doc_id % 5 = 0
UNION ALL SELECT doc_id + 1000000, source || ' arrives anew' FROM documents WHERE doc_id % 7 = 0),
merged AS (SELECT doc_id, text FROM documents WHERE lang <> 'de' AND doc_id NOT IN (SELECT doc_id FROM incoming) UNION ALL SELECT * FROM incoming)"""


def _upserted(spark, d):
    docs = table(spark, d, "documents")
    changed = docs.where("doc_id % 5 = 0").select("doc_id", F.concat_ws(" ", F.lit("updated"), "lang", F.left("text", F.lit(300))).alias("text"))
    new = docs.where("doc_id % 7 = 0").select((F.col("doc_id") + 1000000).alias("doc_id"), F.concat("source", F.lit(" arrives anew")).alias("text"))
    return open_segments(spark, d).upsert(changed.unionByName(new), F.col("text"), replaced=_gone(spark, d)).as_index()


@query("upsert_term_stats", f"WITH {_LATER}, {index_of('merged')}, before AS (SELECT DISTINCT unnest({TOKENS}) AS term FROM documents) SELECT term, coalesce(doc_frequency, 0)::BIGINT AS doc_frequency, coalesce(total_frequency, 0)::BIGINT AS total_frequency FROM before FULL JOIN terms USING (term)")
def upsert_term_stats(spark, d):
    """After an upsert, statistics are those of an index built anew, and terms without documents are still known."""
    return _upserted(spark, d).terms


@query("upsert_postings", f"WITH {_LATER}, {index_of('merged')} SELECT term, doc_id, tf, doc_length, round(avg_doc_length, 6) AS avg_doc_length, total_docs FROM post JOIN len USING (doc_id), stats")
def upsert_postings(spark, d):
    i = _upserted(spark, d)
    return i.rows.select("term", "doc_id", "tf", "doc_length").crossJoin(F.broadcast(i.stats)).withColumn("avg_doc_length", F.round("avg_doc_length", 6))


# segments: the documents in four batches, some of which come again with another text, and some of which go
_STEPS = """steps AS (SELECT doc_id, text FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 4 <> 3 UNION ALL SELECT doc_id, 'again ' || left(text, 200) FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 4 = 3)"""


_steps: dict[tuple[str, str], segments.SegmentedIndex] = {}


def _in_steps(spark, d):
    key = spark.sparkContext.applicationId, d
    if key not in _steps:
        _steps[key] = _made_in_steps(spark, d)
    return _steps[key]


def _made_in_steps(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    index = segments.SegmentedIndex(spark, f"{working_dir(spark)}/steps-{uuid.uuid4().hex[:8]}")
    for k in range(4):
        index = index.upsert(docs.where(F.col("doc_id") % 4 == k), F.col("text"))
    again = docs.where("doc_id % 4 = 3").select("doc_id", F.concat(F.lit("again "), F.left("text", F.lit(200))).alias("text"))
    return index.upsert(again, F.col("text")).delete(docs.where("doc_id % 11 = 0").select("doc_id"))


@query("segments_term_stats", f"WITH {_STEPS}, {index_of('steps')} SELECT * FROM terms")
def segments_term_stats(spark, d):
    """After four upserts that are merged, one that changes documents and one that deletes some."""
    return _in_steps(spark, d).terms().where("doc_frequency > 0")


@query("segments_search", f"WITH {_STEPS}, {index_of('steps')}, {bm25(['the', 'worthless', 'again'])} SELECT doc_id, round(score, 6) AS score FROM bm25 ORDER BY bm25.score DESC, doc_id LIMIT 20")
def segments_search(spark, d):
    return bm25_search(_in_steps(spark, d).as_index(), "the worthless again", 20).select("doc_id", F.round("score", 6).alias("score"))

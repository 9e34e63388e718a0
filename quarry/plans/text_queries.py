"""Queries of the scalar text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import text as x
from quarry.functions.lattice import SCALE, lattice_tokeniser
from quarry.sources.tables import table

from .registry import query

_WHITE = r"[\t\n\x0B\f\r\x1c-\x1f \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _md5(c):
    return F.md5(c.cast("binary"))


@query("snippets", "SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS snippet FROM documents")
def snippets(spark, d):
    return table(spark, d, "documents").select("doc_id", x.snippet(F.col("text")).alias("snippet"))


@query("clean_text", f"SELECT doc_id, md5(trim(regexp_replace(coalesce(text, ''), '{_WHITE}', ' ', 'g'))) AS clean_md5 FROM documents")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", _md5(x.clean(F.col("text"))).alias("clean_md5"))


@query("display_url", "SELECT page_id, CASE WHEN strlen(url) > 8 THEN regexp_replace(url, '^https?://', '') ELSE url END AS display_url FROM pages")
def display_url(spark, d):
    return table(spark, d, "pages").select("page_id", x.display_url(F.col("url")).alias("display_url"))


@query("result_defaults", "SELECT doc_id, coalesce(nullif(CASE WHEN n_chars % 2 = 0 THEN '' ELSE source END, ''), 'text') AS source_type FROM documents")
def result_defaults(spark, d):
    docs = table(spark, d, "documents").withColumn("s", F.when(F.col("n_chars") % 2 == 0, "").otherwise(F.col("source")))
    return docs.select("doc_id", x.filled(F.col("s"), "text").alias("source_type"))


@query("cache_keys", "SELECT p_partkey, 'quarry:summary:' || md5(lower(trim(p_name)) || ':' || array_to_string(list_sort([p_size::BIGINT, p_partkey, 100]), ',')) AS key FROM part")
def cache_keys(spark, d):
    ids = F.array(F.col("p_size").cast("long"), F.col("p_partkey"), F.lit(100).cast("long"))
    return table(spark, d, "part").select("p_partkey", x.cache_key(F.col("p_name"), ids).alias("key"))


_LINES = r"list_slice(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l)), lambda l: length(l) > 10), lambda l: trim(regexp_replace(l, '^[0-9.\-*•]+', ''))), 1, 6)"


@query("question_postprocess", f"SELECT conv_id, turn, md5(array_to_string({_LINES}, '|')) AS questions_md5, len({_LINES})::BIGINT AS questions FROM conversations")
def question_postprocess(spark, d):
    q = table(spark, d, "conversations").select("conv_id", "turn", x.question_lines(F.col("text")).alias("q"))
    return q.select("conv_id", "turn", _md5(F.array_join("q", "|")).alias("questions_md5"), F.size("q").cast("long").alias("questions"))


@query("question_keywords", f"SELECT conv_id, turn, md5(array_to_string(list_slice(list_transform({_LINES}, lambda q: trim(regexp_replace(q, '[?？]', '', 'g'))), 1, 3), '|')) AS keywords_md5 FROM conversations")
def question_keywords(spark, d):
    q = x.question_keywords(x.question_lines(F.col("text")))
    return table(spark, d, "conversations").select("conv_id", "turn", _md5(F.array_join(q, "|")).alias("keywords_md5"))


@query("refined_query", """SELECT conv_id, turn, CASE WHEN length(b) BETWEEN 1 AND 100 THEN b ELSE role END AS refined FROM (SELECT *, trim(regexp_replace(trim('"' || text || ' "'), '^["'']+|["'']+$', '', 'g')) AS b FROM conversations)""")
def refined_query(spark, d):
    quoted = F.concat(F.lit('"'), F.col("text"), F.lit(' "'))
    return table(spark, d, "conversations").select("conv_id", "turn", x.refined_query(quoted, F.col("role")).alias("refined"))


@query("data_uri_payload", "SELECT doc_id, md5(CASE WHEN contains(v, ',') THEN split_part(v, ',', 2) ELSE v END) AS payload_md5 FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'data:image/png;base64,' || base64(encode(text)) ELSE base64(encode(text)) END AS v FROM documents)")
def data_uri_payload(spark, d):
    raw = F.regexp_replace(F.base64(F.col("text").cast("binary")), r"[\r\n]", "")
    v = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("data:image/png;base64,"), raw)).otherwise(raw)
    return table(spark, d, "documents").select("doc_id", _md5(x.data_uri_payload(v)).alias("payload_md5"))


# The Han characters that stand for a to z where documents are to be text without spaces.
HAN_LETTERS = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余"
AZ = "abcdefghijklmnopqrstuvwxyz"
# letters become characters, and four words are run together
FOUR = "([^ ]+) ([^ ]+) ([^ ]+) ([^ ]+) "
_LONGEST, _KNOWN = 8, 5000


def as_han(text: Column) -> Column:
    """A text as Han characters, four words run together."""
    return F.translate(F.regexp_replace(F.lower(text), FOUR, "$1$2$3$4 "), AZ, HAN_LETTERS)


@query(
    "lattice_tokens",
    f"""WITH RECURSIVE w AS (SELECT unnest(regexp_extract_all(translate(lower(text), '{AZ}', '{HAN_LETTERS}'), '[{HAN_LETTERS}]+')) AS word FROM documents),
f AS (SELECT word, count(*) AS n FROM w WHERE length(word) BETWEEN 2 AND {_LONGEST} GROUP BY word ORDER BY n DESC, word LIMIT {_KNOWN}),
total AS MATERIALIZED (SELECT sum(n) AS total FROM f), cost AS MATERIALIZED (SELECT word, floor({SCALE} * (ln(total) - ln(n)) + 0.5)::BIGINT AS c FROM f, total),
docs AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(regexp_replace(lower(text), '{FOUR}', '\\1\\2\\3\\4 ', 'g'), '{AZ}', '{HAN_LETTERS}'), '[一-鿕]+|[a-zA-Z0-9]+(?:\\.[0-9]+)?%?') AS runs FROM documents),
pieces AS MATERIALIZED (SELECT doc_id, unnest(runs) AS run, unnest(range(len(runs))) AS place FROM docs),
han AS MATERIALIZED (SELECT DISTINCT run FROM pieces WHERE run >= '一'),
s(run, i, best, path) AS (SELECT run, 0, [0::BIGINT], [[]::VARCHAR[]] FROM han
 UNION ALL SELECT s.run, any_value(s.i) + 1, list_append(any_value(s.best)[-{_LONGEST - 1}:], min(s.best[len(s.best) + 1 - k] + coalesce(c, floor({SCALE} * ln(total) + 0.5)::BIGINT))),
   list_append(any_value(s.path)[-{_LONGEST - 1}:], arg_min(list_append(s.path[len(s.path) + 1 - k], s.run[s.i + 2 - k:s.i + 1]), 16 * (s.best[len(s.best) + 1 - k] + coalesce(c, floor({SCALE} * ln(total) + 0.5)::BIGINT)) - k))
 FROM s JOIN range(1, {_LONGEST + 1}) t(k) ON k <= len(s.best) LEFT JOIN cost ON cost.word = s.run[s.i + 2 - k:s.i + 1] CROSS JOIN total WHERE s.i < length(s.run) AND (k = 1 OR c IS NOT NULL) GROUP BY s.run),
cut AS (SELECT run, path[-1] AS words FROM s WHERE i = length(run)),
t AS (SELECT doc_id, place, list_filter(coalesce(words, [pieces.run]), lambda x: length(x) >= 2) AS tokens FROM pieces LEFT JOIN cut USING (run))
SELECT doc_id, coalesce(sum(len(tokens)), 0)::BIGINT AS n, md5(coalesce(string_agg(nullif(array_to_string(tokens, ' '), ''), ' ' ORDER BY place), '')) AS joined_md5 FROM documents LEFT JOIN t USING (doc_id) GROUP BY doc_id""",
)
def lattice_tokens(spark, d):
    """Documents whose words have been run together as Han text, cut again by the most frequent of their words."""
    docs = table(spark, d, "documents")
    words = docs.select(F.explode(F.regexp_extract_all(F.expr(f"translate(lower(text), '{AZ}', '{HAN_LETTERS}')"), F.lit(f"[{HAN_LETTERS}]+"), F.lit(0))).alias("word"))
    frequent = words.where(F.length("word").between(2, _LONGEST)).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(_KNOWN)
    cut = lattice_tokeniser({r.word: r.n for r in frequent.collect()}, hidden=False)
    tokens = docs.select("doc_id", cut(as_han(F.col("text"))).alias("tokens"))
    return tokens.select("doc_id", F.size("tokens").cast("long").alias("n"), _md5(F.array_join("tokens", " ")).alias("joined_md5"))

"""Parts that the oracle statements share."""

from __future__ import annotations

TOKENS = r"list_filter(regexp_extract_all(coalesce(text, ''), '[a-zA-Z0-9]+(?:\.[0-9]+)?%?'), lambda t: length(t) >= 2)"


def tok(base: str = "documents") -> str:
    return f"tok AS (SELECT doc_id, {TOKENS} AS tokens FROM {base})"


def index_of(base: str = "documents") -> str:
    """CTEs tok, len, post, terms and stats over a table with doc_id and text."""
    return f"""{tok(base)}, len AS (SELECT doc_id, len(tokens)::BIGINT AS doc_length FROM tok),
post AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM tok) GROUP BY term, doc_id),
terms AS (SELECT term, count(*) AS doc_frequency, sum(tf)::BIGINT AS total_frequency FROM post GROUP BY term),
stats AS (SELECT count(*) AS total_docs, coalesce(avg(doc_length), 0) AS avg_doc_length FROM len WHERE doc_length > 0)"""


TOK, INDEX = tok(), index_of()


def bm25(terms: list[str]) -> str:
    """A CTE bm25 (doc_id, score) of all hits."""
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""bm25 AS (
  SELECT p.doc_id, sum(ln((s.total_docs - t.doc_frequency + 0.5) / (t.doc_frequency + 0.5) + 1)
         * (p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * l.doc_length / s.avg_doc_length)))) AS score
  FROM post p JOIN terms t USING (term) JOIN len l USING (doc_id) CROSS JOIN stats s WHERE p.term IN ({listed}) GROUP BY p.doc_id)"""


VECTOR = """vec AS (
  SELECT e.vec_id AS doc_id, list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])
         / (sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))) AS score
  FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {query}) q)"""


def fused(terms: list[str], k: int) -> str:
    """CTEs vleg, bleg and fused (doc_id, score, vector_score, bm25_score)."""
    scaled = "CASE WHEN max(score) OVER () = min(score) OVER () THEN 1.0 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END"
    return f"""{INDEX}, {bm25(terms)}, {VECTOR.format(query=0)},
vleg AS (SELECT * FROM vec ORDER BY score DESC, doc_id LIMIT {2 * k}),
bleg AS (SELECT * FROM bm25 ORDER BY score DESC, doc_id LIMIT {2 * k}),
vn AS (SELECT doc_id, {scaled} AS v FROM vleg), bn AS (SELECT doc_id, {scaled} AS b FROM bleg),
fused AS (SELECT doc_id, 0.6 * coalesce(v, 0) + 0.4 * coalesce(b, 0) AS score, coalesce(v, 0) AS vector_score, coalesce(b, 0) AS bm25_score
          FROM vn FULL OUTER JOIN bn USING (doc_id) ORDER BY score DESC, doc_id LIMIT {k}),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM fused)"""

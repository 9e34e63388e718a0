"""Search: a term leg, a vector leg, their fusion, pages of results and the trace of a search.

Every ranking ends in the document id, so it is the same each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import display_url, filled, snippet, total_pages
from quarry.functions.tokens import query_terms
from quarry.functions.vectors import cosine
from quarry.operators.index import Index
from quarry.sources.store import MOST_LOOKED_UP
from quarry.sources.tables import keep

# Ranking constants, fusion weights, how many results there are by default.
K1, B = 1.5, 0.75
WEIGHT_BM25, WEIGHT_VECTOR = 0.4, 0.6
TOP_K, LEG_FACTOR, LEAST_FETCHED = 20, 2, 100
#: Terms that are broadcast where all postings meet their statistics.
MOST_FREQUENT = 50_000


def idf(total: Column, df: Column) -> Column:
    return F.log((total - df + 0.5) / (df + 0.5) + 1)


def saturation(tf: Column, length: Column, average: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))


def bm25_scores(index: Index, terms: list[str], k1: float = K1, b: float = B) -> DataFrame:
    """(doc_id, score) of all documents that have one of the terms. The filter reaches the scan of the sorted postings."""
    hits = index.postings.where(F.col("term").isin(terms) if terms else F.lit(False))
    frequencies = index.terms.where(F.col("term").isin(terms) if terms else F.lit(False)).select("term", "doc_frequency")
    stats = index.stats.where("total_docs > 0 and avg_doc_length > 0")
    # a row for each query term, and one row of statistics: both are broadcast by their size
    scored = hits.join(F.broadcast(frequencies), "term").crossJoin(F.broadcast(stats))
    part = idf(F.col("total_docs"), F.col("doc_frequency")) * saturation(F.col("tf"), F.col("doc_length"), F.col("avg_doc_length"), k1, b)
    return summed(scored, terms, part)


def summed(hits: DataFrame, terms: list[str], part: Column) -> DataFrame:
    """(doc_id, score) of hits (term, doc_id and what `part` needs), added up in the order of the query's terms, so that equal documents have equal scores."""
    if not terms:
        return hits.groupBy("doc_id").agg(F.sum(part).alias("score"))
    each = hits.groupBy("doc_id").agg(*[F.coalesce(F.sum(F.when(F.col("term") == t, part)), F.lit(0.0)).alias(f"_{k}") for k, t in enumerate(terms)])
    score = F.col("_0")
    for k in range(1, len(terms)):
        score = score + F.col(f"_{k}")
    return each.select("doc_id", score.alias("score"))


def top(scores: DataFrame, n: int) -> DataFrame:
    return scores.orderBy(F.desc("score"), "doc_id").limit(n)


def bm25_search(index: Index, query: str, top_k: int = 10) -> DataFrame:
    return top(bm25_scores(index, query_terms(query)), top_k)


def vector_scores(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """(doc_id, score) against the one row of `query` (query_vector); there is no threshold."""
    return vectors.crossJoin(F.broadcast(query.limit(1))).select("doc_id", cosine(F.col("embedding"), F.col("query_vector")).alias("score"))


def vector_search(vectors: DataFrame, query: DataFrame, top_k: int = TOP_K) -> DataFrame:
    return top(vector_scores(vectors, query), top_k)


def min_max(leg: DataFrame, out: str) -> DataFrame:
    """Scores of one leg's candidates from 0 to 1; all 1 if they are equal. The leg is a top-k, so one task can hold it."""
    w = Window.partitionBy()
    low, high = F.min("score").over(w), F.max("score").over(w)
    return leg.select("doc_id", F.when(high == low, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low)).alias(out))


def fuse(vector_leg: DataFrame, bm25_leg: DataFrame, top_k: int, w_vector: float = WEIGHT_VECTOR, w_bm25: float = WEIGHT_BM25) -> DataFrame:
    """(doc_id, score, vector_score, bm25_score) of the union of both legs, best first."""
    both = min_max(vector_leg, "vector_score").join(min_max(bm25_leg, "bm25_score"), "doc_id", "full_outer")
    v, b = F.coalesce("vector_score", F.lit(0.0)), F.coalesce("bm25_score", F.lit(0.0))
    return top(both.select("doc_id", (w_vector * v + w_bm25 * b).alias("score"), v.alias("vector_score"), b.alias("bm25_score")), top_k)


def hybrid_search(index: Index, vectors: DataFrame, query: str, query_vector: DataFrame, top_k: int = TOP_K) -> DataFrame:
    legs = LEG_FACTOR * top_k
    return fuse(vector_search(vectors, query_vector, legs), bm25_search(index, query, legs), top_k)


def ranked(results: DataFrame) -> DataFrame:
    """With rank from 1. Results are a top-k."""
    return results.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).cast("long"))


def fetch_count(top_k: int | None, page: int, page_size: int) -> int:
    return top_k if top_k else max(LEAST_FETCHED, page * page_size)


def page_of(results: DataFrame, page: int = 1, page_size: int = 10) -> DataFrame:
    """One page of ranked results, with total and total_pages; total is how many were fetched."""
    page = max(1, page)
    total = F.count("*").over(Window.partitionBy())
    numbered = ranked(results).withColumn("total", total).withColumn("total_pages", total_pages(F.col("total"), page_size))
    return numbered.where(F.col("rank").between((page - 1) * page_size + 1, page * page_size))


def with_documents(results: DataFrame, docs: DataFrame) -> DataFrame:
    """Results with title, url, snippet and source type; those without a document go.

    Results are a top-k, so their ids become a filter that reaches the scan of the documents.
    """
    ids = [r.doc_id for r in results.select("doc_id").limit(MOST_LOOKED_UP + 1).collect()]
    docs = docs.where(F.col("doc_id").isin(ids)) if len(ids) <= MOST_LOOKED_UP else docs
    info = docs.select("doc_id", "title", filled(F.col("url"), "").alias("url"), snippet(F.col("content")).alias("snippet"), filled(F.col("source_type"), "text").alias("source_type"))
    return info.join(F.broadcast(results), "doc_id")


def image_response(results: DataFrame) -> DataFrame:
    """Results of a search by image as one page that holds them all."""
    total = F.count("*").over(Window.partitionBy())
    return ranked(results).select("*", F.lit("[Image Search]").alias("query"), total.alias("total"), F.lit(1).cast("long").alias("page"), total.alias("page_size"), F.lit(1).cast("long").alias("total_pages"))


def clamp_page(page: int, page_size: int) -> tuple[int, int]:
    """Page and page size as a gateway lets them through."""
    return max(1, page), page_size if 1 <= page_size <= 100 else 10


def gateway_rows(page: DataFrame) -> DataFrame:
    return page.select("rank", "title", "url", display_url(F.col("url")).alias("display_url"), "snippet")


def trace(index: Index, vectors: DataFrame, query: str, query_vector: DataFrame, top_k: int = TOP_K, shown: int = 5) -> DataFrame:
    """What each leg gave to each final result: scores of the best of both legs, 0 elsewhere, and how many there were."""
    # a few rows each, scored once and looked at three times
    vector_leg = keep(vector_search(vectors, query_vector, LEG_FACTOR * top_k), "leg")
    bm25_leg = keep(bm25_search(index, query, LEG_FACTOR * top_k), "leg")
    final = ranked(fuse(vector_leg, bm25_leg, top_k)).select("doc_id", "score", "rank")
    v = top(vector_leg, shown).select("doc_id", F.col("score").alias("vector_top"))
    b = top(bm25_leg, shown).select("doc_id", F.col("score").alias("bm25_top"))
    sizes = vector_leg.agg(F.count("*").alias("vector_results")).crossJoin(bm25_leg.agg(F.count("*").alias("bm25_results")))
    out = final.join(F.broadcast(v), "doc_id", "left").join(F.broadcast(b), "doc_id", "left").crossJoin(F.broadcast(sizes))
    return out.fillna(0.0, ["vector_top", "bm25_top"])


def term_weights(index: Index, query: str) -> DataFrame:
    """(term, doc_frequency, idf) of the query's terms that are known."""
    terms = index.terms.where(F.col("term").isin(query_terms(query)) if query_terms(query) else F.lit(False))
    return terms.crossJoin(F.broadcast(index.stats)).select("term", "doc_frequency", idf(F.col("total_docs"), F.col("doc_frequency")).alias("idf"))


def keywords_tfidf(index: Index, n: int = 10) -> DataFrame:
    """(doc_id, rank, term, weight): the terms that tell a document from the corpus, by frequency and rarity.

    Most postings are of a few terms, which are broadcast, so that a document's best of these are chosen where its postings lie;
    postings of the other terms are exchanged.
    """
    terms = index.terms.select("term", "doc_frequency")
    frequent = keep(terms.orderBy(F.desc("doc_frequency"), "term").limit(MOST_FREQUENT), "frequent")
    rows = index.rows.select("term", "doc_id", "tf", "doc_length").join(F.broadcast(frequent), "term", "left")
    rare = rows.where("doc_frequency is null").drop("doc_frequency").join(terms.join(F.broadcast(frequent.select("term")), "term", "left_anti"), "term")
    weight = F.round(F.col("tf") / F.col("doc_length") * F.log(F.col("total_docs") / F.col("doc_frequency")), 9)
    w = Window.partitionBy("doc_id").orderBy(F.desc("weight"), "term")
    best = lambda scored: scored.crossJoin(F.broadcast(index.stats)).select("doc_id", "term", weight.alias("weight")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    both = best(rows.where("doc_frequency is not null")).unionByName(best(rare.select(rows.columns)))
    return both.drop("rank").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


# --- extensions: not part of the searches above ---


def found_by_both(vector_leg: DataFrame, bm25_leg: DataFrame) -> DataFrame:
    return vector_leg.select("doc_id").intersect(bm25_leg.select("doc_id"))


def only_in_first(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc_id").exceptAll(b.select("doc_id"))


def reciprocal_ranks(legs: list[DataFrame], top_k: int, constant: int = 60) -> DataFrame:
    """Fusion by the sum of 1 / (constant + rank) over legs."""
    each = [ranked(leg).select("doc_id", (1.0 / (constant + F.col("rank"))).alias("score")) for leg in legs]
    every = each[0]
    for leg in each[1:]:
        every = every.unionByName(leg)
    return top(every.groupBy("doc_id").agg(F.sum("score").alias("score")), top_k)

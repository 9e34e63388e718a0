import base64
import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from quarry.functions.vectors import encoder
from quarry.operators import analytics, context, crawl, embed, index, maintain, retrieve, suggest
from quarry.sources import csv_documents, samples, tables


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_index_invariants(spark):
    t = index.tokenised(docs(spark, [(1, "red bolt red"), (2, None), (3, "ü !"), (4, "bolt")]), F.col("text"))
    lengths = {r.doc_id: r.doc_length for r in index.doc_lengths(t).collect()}
    assert lengths == {1: 3, 2: 0, 3: 0, 4: 1}
    p = index.postings(t).collect()
    assert {(r.term, r.doc_id, r.tf): r.positions for r in p} == {("red", 1, 2): [0, 2], ("bolt", 1, 1): [1], ("bolt", 4, 1): [0]}
    stats = index.doc_stats(index.doc_lengths(t)).first()
    assert (stats.total_docs, stats.avg_doc_length) == (2, 2.0)
    assert index.doc_stats(index.doc_lengths(t.limit(0))).first().avg_doc_length == 0


def test_deleted_terms(spark):
    t = index.tokenised(docs(spark, [(1, "red bolt"), (4, "bolt")]), F.col("text"))
    post, lengths = index.postings(t), index.doc_lengths(t)
    terms = index.term_stats(post)
    left, _ = index.delete_documents(post, lengths, spark.createDataFrame([(1,)], "doc_id long"))
    assert [r.term for r in index.orphan_terms(terms, left).collect()] == ["red"]
    assert {r.term: r.doc_frequency for r in index.refreshed_terms(terms, left).collect()} == {"red": 0, "bolt": 1}
    assert [r.term for r in index.without_orphans(terms, left).collect()] == ["bolt"]


def test_index_follows_the_table(spark, tmp_path):
    path = str(tmp_path)
    docs(spark, [(1, "red bolt")]).write.parquet(f"{path}/documents.parquet")
    assert index.open_index(spark, path) is index.open_index(spark, path)
    docs(spark, [(2, "green nut")]).write.mode("append").parquet(f"{path}/documents.parquet")
    assert {r.term for r in index.open_index(spark, path).terms.collect()} == {"red", "bolt", "green", "nut"}


def scores(spark, d):
    return spark.createDataFrame(list(d.items()), "doc_id long, score double")


def test_fusion(spark):
    got = {r.doc_id: round(r.score, 9) for r in retrieve.fuse(scores(spark, {1: 0.9, 2: 0.1}), scores(spark, {2: 5.0, 3: 1.0}), 10).collect()}
    assert got == {1: 0.6, 2: 0.4, 3: 0.0}
    assert {r.v for r in retrieve.min_max(scores(spark, {1: 2.0, 2: 2.0}), "v").collect()} == {1.0}
    assert retrieve.min_max(scores(spark, {1: 1.0}).limit(0), "v").count() == 0


def test_bm25_without_hits(spark):
    i = index.build_index(docs(spark, [(1, "red bolt"), (2, "")]), F.col("text"))
    assert retrieve.bm25_search(i, "").count() == 0
    assert retrieve.bm25_search(i, "none such").count() == 0
    assert [r.doc_id for r in retrieve.bm25_search(i, "bolt bolt").collect()] == [1]


def test_paging(spark):
    found = scores(spark, {k: 1.0 for k in range(25)})
    page = retrieve.page_of(found, 3, 10).collect()
    assert sorted(r.doc_id for r in page) == [20, 21, 22, 23, 24] and page[0].total == 25 and page[0].total_pages == 3
    assert retrieve.page_of(found, -1, 10).count() == 10
    assert retrieve.fetch_count(None, 2, 10) == 100 and retrieve.fetch_count(None, 30, 10) == 300 and retrieve.fetch_count(7, 1, 10) == 7
    assert retrieve.clamp_page(0, 1000) == (1, 10)


def test_suggestions(spark):
    k = spark.createDataFrame([("python", 5), ("google maps", 9), ("machine learning tutorial", 1), ("pytho", 2)], "keyword string, count long")
    names = lambda typed, **kw: [r.keyword for r in suggest.suggestions(k, typed, **kw).collect()]
    assert "python" in names("pythn") and "google maps" in names("goolge") and names("machne") == ["machine learning tutorial"]
    assert names("") == []
    assert [r.distance for r in suggest.suggestions(k, "python").where("keyword = 'python'").collect()] == [1]
    assert [r.distance for r in suggest.suggestions(k, "python", compat=False).where("keyword = 'python'").collect()] == [0]


def test_upsert(spark):
    schema = "doc_id long, url string, v int"
    now = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, None, 1)], schema)
    new = spark.createDataFrame([(4, "a", 2), (5, "a", 3), (6, "", 2), (7, None, 2)], schema)
    got = {tuple(r) for r in maintain.upsert_by_url(now, new, ["v"]).collect()}
    assert got == {(2, "b", 1), (3, None, 1), (5, "a", 3), (6, "", 2), (7, None, 2)}


def test_history_and_cache(spark):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    h = spark.createDataFrame([(1, 7, "q", at(1)), (2, 7, "q", at(2)), (3, 8, "q", at(2))], "id long, user_id long, query string, ts timestamp")
    assert sorted(r.id for r in analytics.history_add(h.limit(0), h).collect()) == [2, 3]
    # another user's row is not theirs to delete
    assert analytics.history_delete(h, spark.createDataFrame([(3, 7), (1, 7)], "id long, user_id long")).count() == 2
    entries = spark.createDataFrame([("k", 1, at(0)), ("k", 2, at(30)), ("x", 3, at(0))], "key string, id long, ts timestamp")
    assert [r.id for r in analytics.cache_live(entries, F.lit(at(40)), 20).collect()] == [2]


def test_crawl(spark):
    html = '<a href="https://example.com/page1">1</a><a class="x" href="/relative/page">2</a><a href="image.jpg">3</a><a href="https://other.com/page">4</a>'
    p = spark.createDataFrame([(1, "https://example.com/base", html), (2, "https://example.com/none", None)], "page_id long, url string, html string")
    assert [r.target for r in crawl.crawlable(crawl.links(p)).collect()] == ["https://example.com/page1", "https://example.com/relative/page", "https://other.com/page"]
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    assert {tuple(r) for r in crawl.breadth_first(e, spark.createDataFrame([("a",)], "url string"), 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    q = spark.createDataFrame([("u", 0)], "url string, depth int")
    assert crawl.seeded(q, e.select(F.col("src").alias("url"))).count() == 1 and crawl.seeded(q.limit(0), e.select(F.col("src").alias("url"))).count() == 4


def test_title_and_text(spark):
    page = '<html><head><meta property="og:title" content="OG Test Title"><title>Test Page</title></head><body><h1>Main Title</h1><p>few words</p></body></html>'
    pages = spark.createDataFrame([(1, "u", page), (2, "u", "<title>A &amp;amp; B</title>"), (3, None, None)], "page_id long, url string, html string")
    assert {r.page_id: r.title for r in crawl.titles(pages).collect()} == {1: "OG Test Title", 2: "A &amp; B", 3: ""}
    assert {r.text for r in crawl.main_texts(pages).collect()} == {None}


def test_context(spark):
    t = spark.createDataFrame([(1, 1, "assistant", "Hi! there"), (1, 0, "user", "q"), (1, 2, "assistant", None)], "conv_id long, turn long, role string, text string")
    assert context.transcript(t).first().transcript == "User: q\nAssistant: Hi! there\nAssistant: "
    assert context.shown_turns(t).count() == 1


def test_csv(spark, tmp_path):
    f = tmp_path / "d.csv"
    f.write_text('问题,answer,link\nfirst,"one, two",http://a\n,only content,\n' + "t" * 101 + "," + "c" * 60 + ",\n", encoding="utf-8")
    got = [tuple(r) for r in csv_documents.read_csv_documents(spark, str(f)).collect()]
    assert got == [(1, "first", "one, two", "http://a"), (2, "Document 2", "only content", ""), (3, "c" * 50 + "...", "c" * 60, "")]


def test_tables(spark, tmp_path):
    assert samples.sample_documents(spark).count() == 10
    path = str(tmp_path / "t")
    samples.sample_documents(spark).write.parquet(path)
    assert tables.overwrite_empty(spark, path, samples.sample_documents(spark).schema).count() == 0
    users = spark.createDataFrame([(1, None), (2, "2024-01-01")], "id long, deleted_at string")
    assert [r.id for r in tables.active(users).collect()] == [1]


def test_search_reads_little(spark, sf):
    i = index.open_index(spark, sf)
    plan = retrieve.bm25_search(i, "worthless idiot")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term" in plan and "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan


def test_recreated_tables(spark, tmp_path):
    made = tables.recreate(spark, str(tmp_path / "all"), {"terms": tables.TERMS, "postings": tables.POSTINGS})
    spark.range(3).selectExpr("string(id) AS term", "id AS doc_frequency", "id AS total_frequency").write.mode("append").parquet(str(tmp_path / "all" / "terms"))
    assert {n: spark.read.parquet(str(tmp_path / "all" / n)).count() for n in made} == {"terms": 3, "postings": 0}
    assert {n: df.count() for n, df in tables.recreate(spark, str(tmp_path / "all"), {"terms": tables.TERMS}).items()} == {"terms": 0} and not (tmp_path / "all" / "postings").exists()


def test_a_model_that_fails(spark):
    def lengths(values):
        if any(v == "bad" for v in values):
            raise ValueError("cannot read this")
        return np.array([[len(v), 0.0] for v in values])

    rows = spark.createDataFrame([(1, "abc"), (2, "bad"), (3, None), (4, "")], "id long, v string").coalesce(1)
    assert {r.id: r.e for r in rows.select("id", encoder(lengths)("v").alias("e")).collect()} == {1: [1.0, 0.0], 2: None, 3: None, 4: [0.0, 0.0]}


def test_vectors_of_documents_and_images(spark):
    images = "images array<struct<url: string, base64_data: string, alt_text: string>>"
    data = lambda n: base64.b64encode(b"x" * n).decode()
    rows = [
        (1, "T", "body", [("a", data(3), ""), ("b", None, ""), ("c", "data:image/png;base64," + data(4), ""), ("d", data(99), ""), ("e", data(5), ""), ("f", data(6), "")]),
        (2, None, None, None),
    ]
    docs = spark.createDataFrame(rows, f"doc_id long, title string, content string, {images}")
    seen = lambda values: np.array([[len(v), 0.0] if len(v) < 50 else 1 / 0 for v in values])
    assert [(r.doc_id, r.embedding) for r in embed.document_vectors(docs, seen).orderBy("doc_id").collect()] == [(1, [1.0, 0.0]), (2, [1.0, 0.0])]
    # the image without data does not count, the one that the model fails on is passed over, and the fifth is too many
    assert [(r.doc_id, r.position) for r in embed.image_vectors(docs, seen).orderBy("position").collect()] == [(1, 0), (1, 1), (1, 3)]


def test_stamps(spark):
    now, then = dt.datetime(2024, 5, 1), dt.datetime(2023, 1, 1)
    current = spark.createDataFrame([("a", then, then), (None, then, then)], "url string, created_at timestamp, updated_at timestamp")
    got = {r.url: (r.created_at, r.updated_at) for r in maintain.stamped(current, spark.createDataFrame([("a",), ("b",), (None,)], "url string"), F.lit(now)).collect()}
    assert got == {"a": (then, now), "b": (now, now), None: (now, now)}


def test_unique_keys(spark, sf):
    i = index.open_index(spark, sf)
    assert i.terms.count() == i.terms.select("term").distinct().count()
    assert i.postings.count() == i.postings.select("term", "doc_id").distinct().count()
    assert i.lengths.count() == i.lengths.select("doc_id").distinct().count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    back = i.postings.groupBy("doc_id").agg(F.sum("tf").alias("n")).join(i.lengths, "doc_id").where("n <> doc_length")
    assert back.count() == 0 and i.postings.where("size(positions) <> tf").count() == 0


def test_jdbc(spark):
    """A table of a relational database, whole and in ranges of its key; the embedded database comes with Spark."""
    url = "jdbc:derby:memory:quarry;create=true"
    rows = spark.range(1, 101).select(F.col("id"), F.concat(F.lit("q"), F.col("id") % 7).alias("query"))
    rows.write.format("jdbc").option("url", url).option("driver", "org.apache.derby.jdbc.EmbeddedDriver").option("dbtable", "searches").mode("overwrite").save()
    whole = tables.read_jdbc(spark, url, "searches", driver="org.apache.derby.jdbc.EmbeddedDriver")
    ranged = tables.read_jdbc(spark, url, "searches", "id", 1, 100, 4, driver="org.apache.derby.jdbc.EmbeddedDriver")
    plain = lambda df: sorted(tuple(r) for r in df.collect())
    assert plain(whole) == plain(ranged) == plain(rows) and ranged.rdd.getNumPartitions() == 4


def test_equal_documents_have_equal_scores(spark):
    """Postings of two equal documents come in different orders; rounding must not put one before the other."""
    terms = [f"t{k}" for k in range(12)]
    post = [(t, 1, k + 1, 78, [0]) for k, t in enumerate(terms)] + [(t, 0, k + 1, 78, [0]) for k, t in reversed(list(enumerate(terms)))]
    i = index.Index(
        spark.createDataFrame([(0, 78), (1, 78)], "doc_id long, doc_length long"), spark.createDataFrame(post, "term string, doc_id long, tf long, doc_length long, positions array<int>").coalesce(1),
        spark.createDataFrame([(t, 3 * k + 1, 9) for k, t in enumerate(terms)], "term string, doc_frequency long, total_frequency long"), spark.createDataFrame([(100, 61.3)], "total_docs long, avg_doc_length double"),
    )
    got = retrieve.bm25_search(i, " ".join(terms)).collect()
    assert got[0].score == got[1].score and [r.doc_id for r in got] == [0, 1]


def test_lengths_need_no_postings(spark):
    """What asks for lengths and statistics only makes no postings, and what reads all postings sorts none."""
    i = index.build_index(docs(spark, [(1, "red bolt red"), (2, None), (3, "red 一二三"), (None, "x1 y2")]), F.col("text"))
    assert {(r.doc_id, r.doc_length) for r in i.lengths.collect()} == {(1, 3), (2, 0), (3, 3), (None, 2)} and i.stats.first().total_docs == 3
    assert not i.made("rows") and not i.made("postings") and not i.made("terms")
    assert {r.term: r.total_frequency for r in i.terms.collect()} == {"red": 3, "bolt": 1, "一二": 1, "二三": 1, "x1": 1, "y2": 1} and not i.made("postings")
    plain = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert plain(i.postings) == plain(i.rows) == plain(index.postings(index.tokenised(docs(spark, [(1, "red bolt red"), (3, "red 一二三"), (None, "x1 y2")]), F.col("text"))))


def test_keywords_of_frequent_and_other_terms(spark, sf, monkeypatch):
    """Broadcasting some of the terms, all or none gives the same keywords; texts are not exchanged for them."""
    i = index.open_index(spark, sf)
    plain = lambda: sorted(tuple(r) for r in retrieve.keywords_tfidf(i).select("doc_id", "rank", "term", "weight").collect())
    whole = plain()
    for most in (0, 50):
        monkeypatch.setattr(retrieve, "MOST_FREQUENT", most)
        assert plain() == whole

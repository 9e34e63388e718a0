from pyspark.sql import functions as F

from quarry.functions import text, tokens, urls, vectors


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column).first()[0]


def test_tokens(spark):
    want = ["Machine", "learning", "3.14", "ber"]
    assert tokens.token_list("Machine learning, a 3.14 über") == want
    assert one(spark, tokens.tokens("t"), t="Machine learning, a 3.14 über") == want
    assert one(spark, tokens.tokens("t"), t=None) == []
    assert tokens.query_terms("to be to be") == ["to", "be"]
    for text, search, accurate in (("搜索引擎 test", ["搜索", "索引", "引擎", "test"], ["搜索", "引擎", "test"]), ("中a1国家法x", ["a1", "国家", "家法"], ["a1", "国家"]), ("über 3.14", ["ber", "3.14"], ["ber", "3.14"]), (None, [], [])):
        assert one(spark, tokens.tokens("t"), t=text) == search == tokens.token_list(text)
        assert one(spark, tokens.tokens(F.col("t"), "accurate"), t=text) == accurate == tokens.token_list(text, "accurate")
    words = ["搜索", "引擎", "搜索引擎", "中国"]
    assert one(spark, tokens.dictionary_tokeniser(words)("t"), t="用搜索引擎 abc 中国人们") == ["搜索", "引擎", "搜索引擎", "abc", "中国", "人们"]
    assert one(spark, tokens.dictionary_tokeniser(words, "accurate")("t"), t="搜索引擎") == ["搜索引擎"]


def test_snippet(spark):
    assert one(spark, text.snippet(F.col("t")), t="é" * 200) == "é" * 200
    assert one(spark, text.snippet(F.col("t")), t="é" * 201) == "é" * 200 + "..."


def test_clean(spark):
    assert one(spark, text.clean(F.col("t")), t=" a \n b ") == "a b"
    assert one(spark, text.clean(F.col("t").cast("string")), t=None) == ""


def test_display_url(spark):
    for given, want in (("https://x.io/a", "x.io/a"), ("http://", "http://"), ("", ""), ("HTTP://x.io/a", "HTTP://x.io/a")):
        assert one(spark, text.display_url(F.col("u")), u=given) == want


def test_pages(spark):
    assert one(spark, text.total_pages(F.col("n"), 3), n=100) == 34
    assert one(spark, text.total_pages(F.col("n"), 10), n=0) == 0


def test_questions(spark):
    answer = "1. What is an index?\n\nshort\n- How are scores fused?\n" + "\n".join(f"{k}. Another question {k}?" for k in range(9))
    got = one(spark, text.question_lines(F.col("t")), t=answer)
    assert got[:2] == ["What is an index?", "How are scores fused?"] and len(got) == 6
    assert one(spark, text.question_keywords(text.question_lines(F.col("t"))), t=answer)[0] == "What is an index"


def test_refined_query(spark):
    r = text.refined_query(F.col("a"), F.col("q"))
    assert one(spark, r, a='"spark search"', q="x") == "spark search"
    assert one(spark, r, a="''", q="x") == "x"
    assert one(spark, r, a="w" * 101, q="x") == "x"


def test_cache_key_sorts_numbers(spark):
    k = text.cache_key(F.col("q"), F.array(F.lit(10), F.lit(9)))
    assert one(spark, k, q=" A ") == one(spark, text.cache_key(F.lit("a"), F.array(F.lit(9), F.lit(10))), q="")
    assert one(spark, text.cache_key(F.col("q"), F.array().cast("array<int>")), q="a") == one(spark, text.cache_key(F.col("q")), q="a")


def test_url_validity(spark):
    cases = {"https://www.example.com/": True, "http://example.com/page": True, "ftp://example.com/": False, "https://example.com/image.jpg": False, "https://example.com/doc.pdf": False, "not-a-url": False, "HTTPS://x/A.PDF?q": False}
    for u, want in cases.items():
        assert one(spark, urls.is_valid(F.col("u")), u=u) is want, u
    assert one(spark, urls.is_valid(F.col("u").cast("string")), u=None) is False
    assert one(spark, urls.is_valid(F.col("u"), ("python.org",)), u="https://docs.Python.org/3") is True


def test_url_normalise(spark):
    for u, want in (("http://a/b;x=1", "http://a/b"), ("HTTP://A/B//", "http://A/B"), ("http://a/?q=/", "http://a/?q="), ("http://a/b?#f", "http://a/b")):
        assert one(spark, urls.normalise(F.col("u")), u=u) == want


def test_links_resolve(spark):
    base = "https://example.com/base"
    for href, want in (("https://example.com/page1", "https://example.com/page1"), ("/relative/page", "https://example.com/relative/page"), ("image.jpg", "https://example.com/image.jpg"), ("//other.com/x", "https://other.com/x"), ("?q=1", "https://example.com/base?q=1")):
        assert one(spark, urls.resolve(F.col("b"), F.col("h")), b=base, h=href) == want


def test_vectors(spark):
    v = lambda *x: F.array(*map(F.lit, x))
    assert abs(one(spark, vectors.cosine(v(1.0, 0.0), v(1.0, 1.0)), x=1) - 0.5**0.5) < 1e-12
    assert one(spark, vectors.cosine(v(0.0, 0.0), v(1.0, 1.0)), x=1) is None
    assert one(spark, vectors.unit(v(0.0, 0.0)), x=1) == [0.0, 0.0]


def test_image_addresses(spark):
    for u, want in (("https://x/p.PNG?w=1", True), ("https://x/favicon.png", False), ("https://x/p.bmp", False), ("https://x/page", False)):
        assert one(spark, urls.is_image(F.col("u")), u=u) is want

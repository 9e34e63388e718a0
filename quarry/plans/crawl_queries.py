"""Queries of the crawl over `pages`."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.functions.text import clean
from quarry.functions.urls import EXCLUDED, is_valid, normalise
from quarry.operators import crawl, visited
from quarry.sources import archive
from quarry.sources.tables import keep, table, working_dir

from .registry import query

_URL = r"^([a-zA-Z][a-zA-Z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"


def _part(u: str, k: int) -> str:
    return f"regexp_extract({u}, '{_URL}', {k})"


def _norm(u: str) -> str:
    q = _part(u, 4)
    return f"regexp_replace(lower({_part(u, 1)}) || '://' || {_part(u, 2)} || regexp_replace({_part(u, 3)}, ';[^/]*$', '') || CASE WHEN length({q}) > 1 THEN {q} ELSE '' END, '/+$', '')"


def _valid(u: str) -> str:
    return f"(lower({_part(u, 1)}) IN ('http', 'https') AND {_part(u, 2)} <> '' AND NOT regexp_matches(lower(regexp_replace({_part(u, 3)}, ';[^/]*$', '')), '{EXCLUDED}'))"


_LINKS = f"""links AS (SELECT page_id, url, href, CASE
WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.\\-]*:') THEN href
WHEN starts_with(href, '//') THEN lower({_part('url', 1)}) || ':' || href
WHEN starts_with(href, '/') THEN lower({_part('url', 1)}) || '://' || {_part('url', 2)} || href
ELSE lower({_part('url', 1)}) || '://' || {_part('url', 2)} || CASE WHEN regexp_replace({_part('url', 3)}, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace({_part('url', 3)}, '[^/]*$', '') END || href END AS target
FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1)) AS href FROM pages))"""
_EDGES = f"{_LINKS}, edges AS (SELECT DISTINCT {_norm('url')} AS src, {_norm('target')} AS dst FROM links WHERE {_valid('target')})"


def _pages(spark, d):
    return table(spark, d, "pages")


@query("pages_fetched", "SELECT page_id, length(html)::BIGINT AS size FROM pages WHERE length(html) >= 100")
def pages_fetched(spark, d):
    return crawl.fetched(_pages(spark, d)).select("page_id", F.length("html").cast("long").alias("size"))


@query("archived_pages", "SELECT page_id, url, md5(html) AS html_md5 FROM pages")
def archived_pages(spark, d):
    """Pages written as archives, and read from them in splits."""
    path = f"{working_dir(spark)}/archive-{uuid.uuid4().hex[:8]}"
    archive.write_archive(_pages(spark, d).repartition(2, "page_id"), path)
    return archive.read_archive(spark, path, 1 << 20).select("page_id", "url", F.md5(F.col("html").cast("binary")).alias("html_md5"))


@query("url_normalize", f"SELECT page_id, {_norm('url')} AS normalized FROM pages")
def url_normalize(spark, d):
    return _pages(spark, d).select("page_id", normalise(F.col("url")).alias("normalized"))


_CASES = "unnest([url, url || '/x.JPG', url || '.pdf', 'ftp' || substr(url, 5), 'not-a-url', url || '/;a=b'])"


@query("url_valid", f"SELECT page_id, candidate, {_valid('candidate')} AS valid FROM (SELECT page_id, {_CASES} AS candidate FROM pages)")
def url_valid(spark, d):
    u = F.col("url")
    cases = F.array(u, F.concat(u, F.lit("/x.JPG")), F.concat(u, F.lit(".pdf")), F.concat(F.lit("ftp"), F.substr(u, F.lit(5))), F.lit("not-a-url"), F.concat(u, F.lit("/;a=b")))
    return _pages(spark, d).select("page_id", F.explode(cases).alias("candidate")).select("page_id", "candidate", is_valid(F.col("candidate")).alias("valid"))


@query("link_extract", f"WITH {_LINKS} SELECT page_id, {_norm('target')} AS target, count(*) AS times FROM links WHERE {_valid('target')} GROUP BY ALL")
def link_extract(spark, d):
    return crawl.crawlable(crawl.links(_pages(spark, d))).groupBy("page_id", "target").agg(F.count("*").alias("times"))


@query("crawl_frontier", f"WITH {_LINKS}, c AS (SELECT {_norm('target')} AS url, min(page_id % 3)::BIGINT AS depth FROM links WHERE {_valid('target')} GROUP BY 1) SELECT * FROM c WHERE url NOT IN (SELECT {_norm('url')} FROM pages)")
def crawl_frontier(spark, d):
    candidates = crawl.links(_pages(spark, d)).select(F.col("target").alias("url"), (F.col("page_id") % 3).alias("depth"))
    return crawl.frontier(candidates, _pages(spark, d).select(normalise(F.col("url")).alias("url")))


@query("bloom_frontier", f"WITH {_LINKS}, c AS (SELECT {_norm('target')} AS url, min(page_id % 3)::BIGINT AS depth FROM links WHERE {_valid('target')} GROUP BY 1) SELECT * FROM c WHERE url NOT IN (SELECT {_norm('url')} FROM pages)")
def bloom_frontier(spark, d):
    """The frontier by a filter that two halves of the visited pages have filled."""
    pages = _pages(spark, d).select("page_id", normalise(F.col("url")).alias("url"))
    candidates = crawl.links(_pages(spark, d)).select(F.col("target").alias("url"), (F.col("page_id") % 3).alias("depth"))
    blocks = visited.blocks_for(pages.count())
    known = visited.merged([visited.filled(pages.where(F.col("page_id") % 2 == k), blocks) for k in (0, 1)])
    return crawl.bloom_frontier(candidates, pages, known)


_SEEDS = f"SELECT min({_norm('url')}) AS url FROM pages GROUP BY {_part('url', 2)}"


@query(
    "crawl_bfs",
    f"""WITH RECURSIVE {_EDGES},
walk(url, depth) AS (SELECT url, 0::BIGINT FROM ({_SEEDS}) UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.url WHERE w.depth < 3)
SELECT url, min(depth) AS depth FROM walk GROUP BY url""",
)
def crawl_bfs(spark, d):
    edges = crawl.crawlable(crawl.links(_pages(spark, d))).select(normalise(F.col("url")).alias("src"), F.col("target").alias("dst")).distinct()
    edges = keep(edges, "edges")  # every level meets them
    seeds = _pages(spark, d).groupBy(F.regexp_extract("url", _URL, 2).alias("host")).agg(F.min(normalise(F.col("url"))).alias("url"))
    return crawl.breadth_first(edges, seeds, 3).select("url", F.col("depth").cast("long").alias("depth"))


@query("rate_limit_batches", "SELECT url, page_id AS seq, (row_number() OVER (ORDER BY page_id) - 1) // 10 AS batch FROM pages")
def rate_limit_batches(spark, d):
    return crawl.batches(_pages(spark, d).select("url", F.col("page_id").alias("seq")))


_UNESCAPED = "{0}"
for _name, _char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("apos", "''"), ("nbsp", " "), ("copy", "©"), ("middot", "·")):
    _UNESCAPED = f"replace({_UNESCAPED}, '&{_name};', '{_char}')"
# browsers read this one without its semicolon too
_UNESCAPED = f"regexp_replace({_UNESCAPED}, '&amp;?', '&', 'g')"
_WHITE = r"[\t\n\x0B\f\r\x1c-\x1f \x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+"
_CLEAN = "trim(regexp_replace(coalesce({0}, ''), '" + _WHITE + "', ' ', 'g'))"


@query("page_title", f"SELECT page_id, {_CLEAN.format(_UNESCAPED.format(chr(116)))} AS title FROM (SELECT page_id, coalesce(nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ''), nullif(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '')) AS t FROM pages)")
def page_title(spark, d):
    return crawl.titles(_pages(spark, d))


#: Pages as they are met, and what must be read from them.
_CASES_HTML = [
    (1, "https://example.com/base", '<html><head><title>Test Page</title><meta content="OG Test Title" property="og:title"></head><body><h1>Main</h1><a href="https://example.com/page1">1</a><a href=\'/relative/page\'>2</a><a href=image.jpg>3</a><a href="https://other.com/page">4</a>'),
    (2, "https://example.com/a/b/c.html?x=1", '<article href="/no"><aside href="/no"><!-- <a href="/no">x</a> --><A class="q > r" HREF="../up?a=1&amp;b=2">1</A><a href="./d">2</a><a href="?y=2">3</a><a href="#top">4</a><h1>A <b>bold</b> &#233;nd</h1>'),
    (3, "http://example.com", "<script>var a = '<a href=\"/no\">';</script><title> One \n two &amp;amp; </title><a href='//cdn.example.org/x/'>1</a><a href=' /s p '>2</a><a name=n>3</a><a href='mailto:a@b.c'>4</a>"),
    (4, None, None),
]
_READ = [
    (1, "OG Test Title", "https://example.com/page1 https://example.com/relative/page https://other.com/page"),
    (2, "A bold énd", "https://example.com/a/up?a=1&b=2 https://example.com/a/b/d https://example.com/a/b/c.html?y=2 https://example.com/a/b/c.html?x=1"),
    (3, "One two &amp;", "http://cdn.example.org/x http://example.com/s p"),
    (4, "", ""),
]
_sql_text = lambda x: "'" + x.replace("'", "''") + "'"


def _around_pages(spark, d, cases):
    """Each case with each page of the table in a comment after it, numbered by both."""
    held = F.concat(F.lit("<!-- "), F.translate("html", ">", " "), F.lit(" -->"))
    few = spark.createDataFrame(cases, "k long, case_url string, case_html string")
    both = _pages(spark, d).where("html is not null").crossJoin(F.broadcast(few))  # four cases
    return both.select((F.col("page_id") * 10 + F.col("k")).alias("page_id"), F.col("case_url").alias("url"), F.concat("case_html", held).alias("html"))


@query("page_cases", "SELECT page_id * 10 + k AS page_id, title, targets FROM pages, (VALUES " + ", ".join(f"({i}::BIGINT, {_sql_text(t)}, {_sql_text(u)})" for i, t, u in _READ) + ") AS t(k, title, targets) WHERE html IS NOT NULL")
def page_cases(spark, d):
    """Quotes of all kinds, references, dot segments, comments, scripts: what a page holds, against what is written down here."""
    pages = _around_pages(spark, d, _CASES_HTML)
    each = crawl.read_pages(pages).select("page_id", "title", F.filter(F.transform("links", lambda x: F.when(is_valid(x.target), normalise(x.target))), lambda u: u.isNotNull()).alias("u"))
    return each.select("page_id", clean(F.col("title")).alias("title"), F.array_join("u", " ").alias("targets"))


_DROPPED = "script|style|nav|footer|header|aside|form|title"
_BARE = f"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<({_DROPPED})\\b.*?</({_DROPPED})>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"


@query("page_main_text", f"SELECT page_id, CASE WHEN length(t) >= 100 THEN md5({_CLEAN.format('left(t, 50000)')}) END AS text_md5 FROM (SELECT page_id, {_UNESCAPED.format(_BARE)} AS t FROM pages)")
def page_main_text(spark, d):
    return crawl.main_texts(_pages(spark, d)).select("page_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


# each page of the table has its main text in its only article; white space is let go on both sides
_ARTICLE = "regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '(?s)<[^>]*>', ' ', 'g')"


@query("page_readable_text", f"SELECT page_id, CASE WHEN length(t) >= 100 THEN md5(regexp_replace({_CLEAN.format('t')}, ' ', '', 'g')) END AS text_md5 FROM (SELECT page_id, {_UNESCAPED.format(_ARTICLE)} AS t FROM pages)")
def page_readable_text(spark, d):
    return crawl.readable_texts(_pages(spark, d)).select("page_id", F.md5(F.regexp_replace("text", r"\s", "").cast("binary")).alias("text_md5"))


_LONG = "word " * 30
_TEXT_CASES = [
    (1, f"<body><header><nav>menu</nav> head</header><p>{_LONG}&eacute;&#233; <b title='a > b'>bold</b></p><!-- no --><aside>a<form>f</form>b</aside><p>end</p><footer>foot", f"{_LONG}éé bold end"),
    (2, f"<script>if (a < b) '<p>'</script><STYLE>p {{}}</STYLE >{_LONG}<nav><div>x</nav>y", f"{_LONG}y"),
    (3, "<p>too short</p>", None),
    (4, None, None),
]


@query("text_cases", "SELECT page_id * 10 + k AS page_id, text FROM pages, (VALUES " + ", ".join(f"({i}::BIGINT, {_sql_text(t) if t else 'NULL'})" for i, _, t in _TEXT_CASES) + ") AS t(k, text) WHERE html IS NOT NULL")
def text_cases(spark, d):
    """Nested and unclosed elements, quotes and references, against what is written down here."""
    return crawl.main_texts(_around_pages(spark, d, [(k, "", page) for k, page, _ in _TEXT_CASES]))


@query("image_candidates", "SELECT page_id, 0::BIGINT AS position, 'https://img.example.org/p' || page_id || '.png' AS image_url FROM pages UNION ALL SELECT page_id, 1, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || regexp_extract(url, '://([^/?#]*)', 1) || '/photo.jpg?w=' || page_id FROM pages")
def image_candidates(spark, d):
    """Pages have no images, so each is given some: two that count, one twice, an icon, one without extension."""
    tags = F.concat(
        F.lit('<img src="https://img.example.org/p'), "page_id", F.lit('.png"><img alt="" data-src="/photo.jpg?w='), "page_id", F.lit('"><img src="/favicon.png"><img src="https://img.example.org/p'), "page_id", F.lit('.png"><img src="/none">')
    )
    return crawl.images(_pages(spark, d).withColumn("html", F.concat("html", tags))).select("page_id", F.col("position").cast("long").alias("position"), "image_url")

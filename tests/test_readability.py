"""Main text by scores of paragraphs, on pages whose main words are known."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.functions.html import own_text, read_page
from quarry.functions.readability import density, parse, readable
from quarry.operators import crawl


def made(seed):
    """A page and its main words; words of the main text begin with m, others with x."""
    r = random.Random(seed)
    words = lambda c, n: " ".join(f"{c}{r.randrange(9999)}" + ("," if r.random() < 0.08 else "") for _ in range(n))
    menu = lambda n: "<ul>" + "".join(f'<li><a href="/{k}">{words("x", 2)}</a>' for k in range(n)) + "</ul>"
    main = []
    for _ in range(r.randrange(2, 9)):
        text = words("m", r.randrange(15, 90))
        main.append(r.choice(["<p>{}</p>", "<p>{}", "<p>{} <b>{}</b> <a href=/z>{}</a>.</p>", "<h2>{}</h2><p>{}</p>", "<blockquote><p>{}</p></blockquote>"]).replace("{}", text, 1).replace("{}", words("m", 3)))
    body = "".join(main)
    box = r.choice(["article", "main", "section", 'div class="post-content"', "div id=content", "div"])
    body = f"<{box}>{body}</{box.split()[0]}>"
    if r.random() < 0.5:
        body = f'<div class="wrap">{body}</div>'
    beside = [
        f"<div class={r.choice(['sidebar', 'widget', 'related'])}>{menu(6)}<p>{words('x', 12)}</p></div>", f"<aside><p>{words('x', 40)}</p></aside>", f"<div class='cookie-notice'>{words('x', 30)}</div>",
        f"<div>{menu(9)}</div>", f"<div class=comments><p>{words('x', 25)}<p>{words('x', 30)}</div>", f"<form><p>{words('x', 9)}<input></form>",
    ]
    r.shuffle(beside)
    half = beside[: r.randrange(0, 4)]
    page = f"<html><head><title>{words('x', 4)}</title><script>x = '<p>m1';</script></head><body><nav>{menu(5)}</nav><header>{words('x', 5)}</header>{''.join(half[:1])}{body}{''.join(half[1:])}<!-- <p>x --><footer>{words('x', 12)}</footer></body></html>"
    return page, Counter(w for w in _words(body) if w.startswith("m"))


def _words(page):
    return own_text(page).split()


def test_precision_and_recall():
    right = found = wanted = 0
    for seed in range(300):
        page, main = made(seed)
        got = Counter((readable(page) or "").split())
        right += (got & main).total()
        found += got.total()
        wanted += main.total()
    assert right / found > 0.97 and right / wanted > 0.97


def test_against_a_plain_count():
    """Texts and links below each element, against adding them up one by one."""
    for seed in range(40):
        nodes = parse(made(seed)[0])

        def chars(k, linked, nodes=nodes):
            n, out = nodes[k], 0
            inside = linked or n.tag == "a"
            for x in n.parts:
                if isinstance(x, str):
                    size = len(" ".join(x.split()))
                    out += size if inside or not linked_only else 0
                elif not nodes[x].dropped:
                    out += chars(x, inside)
            return out

        for k in range(len(nodes)):
            linked_only = False
            assert nodes[k].chars == chars(k, False)
            linked_only = True
            above = k
            while above > 0 and nodes[above].tag != "a":
                above = nodes[above].parent
            assert nodes[k].linked == chars(k, above > 0)
            assert 0 <= density(nodes[k]) <= 1


@pytest.mark.parametrize("page", ["", "plain", "<p>short</p>", "<!-->", "<!--", "<a", "<p", "</p></p>", "<script>", "<nav><p>" + "x " * 100])
def test_nothing_to_tell(page):
    assert readable(page) is None


def test_odd_pages():
    long = "Some words, that are read by somebody who reads them. "
    assert readable(f"<p>{long}</p><!--><p>{long}</p><!---><div><p>{long}").split() == long.split() * 3
    assert readable(f"<body><p>{long}<svg><p>no</svg>&eacute;&amp;</p>").split() == [*long.split(), "é&"]
    assert readable(f"<div><div class=ad><p>{long}</p></div><p>{long}{long}</p></div>").split() == long.split() * 2
    for piece in ("<div>", "<p>x", "<ul><li>a, b", "<a href=x>y", "</div>", "<p a=\"b>", "<!--", "<b><p>"):
        took = []
        for n in (20_000, 80_000):
            began = time.process_time()
            readable("<p>" + long + piece * (n // len(piece)))
            took.append(time.process_time() - began)
        assert took[1] < 10 * took[0] + 0.3, (piece, took)
    assert read_page("http://a.b/", "<!--><a href=c>x</a>")[1] == [("c", "http://a.b/c")] and own_text("<!-->a<!---><b>c</b><!-- d --!>e").split() == ["a", "c", "e"]


def test_as_a_table(spark):
    long = "Some words, that are read by somebody who reads them. " * 3
    rows = [(1, f"<nav>menu</nav><p>{long}</p><p>{long}</p>"), (2, None), (3, "<p>short</p>"), (4, f"<nav><p>{long}</p></nav>" + "y " * 80)]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit(1))
    got = {r.page_id: r.text for r in crawl.readable_texts(df).collect()}
    assert got == {1: f"{long.strip()}\n{long.strip()}", 2: None, 3: None, 4: ("y " * 80).strip()}


def test_lengths_are_those_of_the_page(spark):
    """Each tag, comment and declaration counts as one character, added lines as none; nothing is cut from a long text."""
    assert len(own_text("<!DOCTYPE html><!-- c --><p>ab</p>")) == 6
    edge, short = "x" * 98, "<div class=ad>an advert that is quite long, and longer than the text</div>" * 3
    long = "<p>" + "word, " * 30_000 + "</p>"
    pages = [(1, f"<!DOCTYPE html><p>{edge}</p>"), (2, f"<article><h1>{'y' * 46}</h1><p>{'z' * 46}</p></article>"), (3, f"{short}<article><h1>a</h1>b</article>"), (4, f"<body><article>{long}</article></body>")]
    df = spark.createDataFrame(pages, "page_id long, html string")
    main = {r.page_id: r.text for r in crawl.main_texts(df).collect()}
    got = {r.page_id: r.text for r in crawl.readable_texts(df).collect()}
    assert main[1] == edge and got[2] is None and got[3] is None
    assert len(got[4].split()) == 30_000


_CUT = "token = &quot &lt &copy2 &nbsp &amp &ampx; &amp;quot; &quot;a&quot; &eacute;&#233;&#xE9; &nosuch; &"
_CUT_READ = 'token = &quot &lt &copy2 &nbsp & &x; &quot; "a" ééé &nosuch; &'


def test_main_text_keeps_references_that_are_cut(spark):
    """A reference without its semicolon stays as it is written, except `&amp`; others are decoded once."""
    df = spark.createDataFrame([(1, f"<h1>{_CUT}</h1>{'x ' * 60}"), (2, f"{'y' * 96}<b>&quot</b>")], "page_id long, html string")
    assert {r.page_id: r.text for r in crawl.main_texts(df).collect()} == {1: f"{_CUT_READ} {'x ' * 60}".strip(), 2: f"{'y' * 96} &quot"}


def test_readable_text_keeps_references_that_are_cut(spark):
    """The same in the parts that paragraphs choose, where a page's only article is its text, and where there is neither."""
    long, few = "Some words, that are read by somebody who reads them. " * 3, "<p>z y</p>" * 20
    pages = [(1, f"<nav>menu</nav><article><h1>{_CUT}</h1><p>{long}</p></article>"), (2, f"<div class=ad>an advert &quot</div><article><h1>&quot</h1>{few}</article>"), (3, f"&quot {few}")]
    df = spark.createDataFrame(pages, "page_id long, html string")
    got = {r.page_id: " ".join(r.text.split()) for r in crawl.readable_texts(df).collect()}
    assert got == {1: f"{_CUT_READ} {long}".strip(), 2: "&quot" + " z y" * 20, 3: "&quot" + " z y" * 20}


def test_titles_keep_references_that_are_cut(spark):
    """The same in titles and first headings."""
    pages = [(1, "u", f"<title>{_CUT}</title><h1>no</h1>"), (2, "u", f"<title></title><h1>{_CUT}</h1>"), (3, "u", "<title>&quot</title><h1>no</h1>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.page_id: r.title for r in crawl.titles(df).collect()} == {1: _CUT_READ, 2: _CUT_READ, 3: "&quot"}

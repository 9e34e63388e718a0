"""Suggestions from the dictionary against those from all words."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import dictionary, suggest


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_near_words_share_a_remnant():
    r = random.Random(2)
    near = 0
    for _ in range(6000):
        a = "".join(r.choices("abc", k=r.randrange(0, 13)))
        b = list(a)
        for _ in range(r.randrange(0, 5)):
            at = r.randrange(0, len(b) + 1)
            b[at : at + r.randrange(0, 2)] = r.choices("abc", k=r.randrange(0, 2))
        b = "".join(b)
        d = edits(a, b)
        for most in (1, 2, 3):
            if d <= most:
                near += 1
                assert dictionary.remnants(a, most) & dictionary.remnants(b, most), (a, b, d)
    assert near > 3000


@pytest.fixture(scope="module")
def keywords(spark):
    r = random.Random(4)
    words = ["".join(r.choices("abcdé", k=r.randrange(1, 10))) for _ in range(150)]
    rows = {" ".join(r.choices(words, k=r.randrange(1, 4))): r.randrange(1, 9) for _ in range(500)} | {"ab cd": 5, "!!": 3}
    return spark.createDataFrame(list(rows.items()), "keyword string, count long")


def test_equal_to_reading_all_words(spark, keywords):
    known = dictionary.build(keywords)
    plain = lambda df: [tuple(x) for x in df.collect()]
    distinct = {x.word for x in known.words.collect()}
    got = {}
    for x in known.remnants.collect():
        got.setdefault(x.word, set()).add(x.remnant)
    assert got == {w: dictionary.remnants(w, 3) for w in distinct}
    for typed in ("abc", "A", " bcdé ", "zzzzzzz", "", "abcdabcdab"):
        for limit in (1, 5):
            if typed.strip():
                assert sorted(plain(dictionary.fuzzy(known, typed, limit))) == sorted(plain(suggest.fuzzy(keywords, typed, limit)))
                assert sorted(plain(dictionary.prefixed(known, typed, limit))) == sorted(plain(suggest.prefixed(keywords, typed, limit)))
            assert plain(dictionary.suggestions(known, typed, limit, compat=limit == 5)) == plain(suggest.suggestions(keywords, typed, limit, compat=limit == 5))
    with pytest.raises(ValueError, match="edits"):
        dictionary.near_words(known, "abc", 4)


def test_lookups_reach_the_scan(spark, keywords):
    known = dictionary.build(keywords)
    assert "PushedFilters: [In(remnant" in known.remnants.where(F.col("remnant").isin("ab", "abc"))._jdf.queryExecution().toString()
    assert "EqualTo(beginning,ab)" in dictionary.prefixed(known, "ab")._jdf.queryExecution().toString()
    assert "StringStartsWith(word,abcd)" in dictionary.prefixed(known, "abcd")._jdf.queryExecution().toString()
    assert dictionary.build(keywords.limit(0)).words.count() == 0

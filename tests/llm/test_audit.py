"""Quality, divergence audit and vector codes against brute force, plain Lloyd and held-out rows."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import divergence, quality, vector_codes
from quarry.llm.text_statistics import STATISTICS, measure

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def same_as_sql(got, sql, sf, tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(sql).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    tidy = lambda d: d[columns].astype(str).sort_values(columns).reset_index(drop=True)
    pd.testing.assert_frame_equal(tidy(got), tidy(want))


# --- divergence audit ---

TEXTS = ["", "a", "Ab1c é-É", "x" * 50, "ÀB\x00\x7fcd e 漢字 kana", "Z@[`{z", "end", "start"]


@pytest.mark.parametrize("digest", [None, lambda b: 7, lambda b: b[0]])
def test_terms_are_those_of_the_pattern(digest):
    batch = pa.RecordBatch.from_arrays([pa.array(["l", None] * 4), pa.array(["s"] * 8), pa.array(TEXTS)], names=["lang", "source", "text"]).slice(1)
    got = divergence.count_terms(batch, digest) if digest else divergence.count_terms(batch)
    n, docs = Counter(), Counter()
    for lang, text in zip(["", "l"] * 4, TEXTS[1:], strict=False):
        found = TERM.findall(lowered(text))
        n.update((lang, t) for t in found)
        docs.update({(lang, t) for t in found})
    rows = got.to_pylist()
    assert {(r["lang"], r["term"]): (r["n"], r["docs"]) for r in rows if r["term"]} == {k: (v, docs[k]) for k, v in n.items()}
    assert sorted(r["lang"] for r in rows if not r["term"]) == ["", "l"]


def test_probability_is_exact(spark):
    cases = [(0, 10, 3), (7, 7, 1), (10**12, 10**15, 10**9), (0, 0, 1), (3, 10**15, 1)]
    n, total, kinds = (np.array(c, np.int64) for c in zip(*cases, strict=True))
    want = [1 + 10**9 * (c + 2) // (t + 2 * k) for c, t, k in cases]
    assert divergence.probability(n, total, kinds).tolist() == want
    df = spark.createDataFrame(cases, "n long, t long, k long")
    assert [r.p for r in df.select(divergence._probability("n", "t", "k").alias("p")).collect()] == want


def plain_audit(rows, least):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        found = TERM.findall(lowered(text or ""))
        groups.add((lang or "", source or ""))
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        mine = sorted(s for g, s in groups if g == lang)
        whole = Counter({t: sum(counts[lang, s][t] for s in mine) for t in kept})

        def p(c, t, kept=kept):
            return 1 + 10**9 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept))

        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in mine:
            c = counts[lang, s]
            pairs = [(sum(f(p(c, t), p(counts[lang, o], t)) for t in kept), o) for o in mine if o != s]
            terms = [(f(p(c, t), p(whole, t)), t) for t in kept if c[t] and p(c, t) > p(whole, t)]
            for part, found in (("pair", pairs), ("term", terms)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or rank <= divergence.SHOWN:
                        out.add((lang, s, part, item, value, rank))
    return out


def test_audit(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_ROWS", 7)  # many blocks
    monkeypatch.setattr(divergence, "PAIRS", 3)
    r = np.random.default_rng(8)
    words = [f"w{chr(97 + k)}" for k in range(26)] + ["é", "É", "漢"]
    rows = [(" ".join(r.choice(words, r.integers(0, 40), p=np.r_[[0.4], [0.6 / 28] * 28])), ["en", "de", None][k % 3], f"s{r.integers(0, 5)}") for k in range(120)]
    rows += [(None, "en", "only"), ("12 34", "fr", "x"), ("", "fr", "y"), ("rare", "es", None), ("rare", "es", None), ("w" * 5000, "en", "s1")]
    names = ["n", "docs", "term", "value", "rank", "part", "item", "v"]
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({c: F.lit(1) for c in names}).repartition(3)
    got = {tuple(x) for x in divergence.audit(df, least=4).select("lang", "source", "part", "item", "value", "rank").collect()}
    assert got == plain_audit(rows, 4)
    assert any(x[0] == "fr" and x[2] == "pair" and x[4] == 0 for x in got)
    monkeypatch.setattr(divergence, "MOST_BROADCAST", 0)
    assert {tuple(x) for x in divergence.audit(df, least=4).collect()} == got
    assert divergence.audit(df.limit(0)).count() == 0


def test_audit_equals_sql(spark, sf):
    same_as_sql(divergence.op12_divergence(spark, sf).toPandas(), divergence.OP12_SQL, sf, ["documents"])


# --- vector codes ---


def plain_lloyd(rows, width):
    """rows: (id, whole numbers) in order of id."""
    parts = np.array([q for _, q in rows], object).reshape(len(rows), 4, width)
    codes, errors, books = [], [], []
    for k in range(4):
        book = [list(x) for x in parts[: vector_codes.ENTRIES, k]]
        nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(book))
        for _ in range(vector_codes.ROUNDS):
            at = [nearest(x, book)[1] for x in parts[:, k]]
            for j in set(at):
                mine = [x for x, a in zip(parts[:, k], at, strict=True) if a == j]
                book[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
        found = [nearest(x, book) for x in parts[:, k]]
        codes.append([j for _, j in found])
        errors.append([d for d, _ in found])
        books.append(book)
    return ["".join(f"{j:02x}" for j in c) for c in zip(*codes, strict=True)], [sum(e) for e in zip(*errors, strict=True)], books


def test_bounds_leave_the_nearest_and_save_work():
    r = np.random.default_rng(2)
    x = np.concatenate([r.integers(-3, 4, (600, 4)), r.integers(-2000, 2000, (600, 4))]).astype(np.int64)  # many ties, and few
    book = x[r.permutation(len(x))[:60]].copy()
    groups = vector_codes.group_entries(book)
    held, low = np.zeros(len(x), np.int64), np.full((len(x), groups.max() + 1), -1.0)
    work = []
    for _ in range(8):
        held, low, far, computed = vector_codes.assign(x, held, low, book, groups)
        every = vector_codes.squared(x[:, None, :], book[None])
        assert np.array_equal(held, every.argmin(1)) and np.array_equal(far, every.min(1))
        for g in range(low.shape[1]):  # bounds are bounds
            others = np.where((groups == g)[None] & (np.arange(len(book))[None] != held[:, None]), every, np.iinfo(np.int64).max)
            assert (low[:, g] ** 2 <= others.min(1) * (1 + 1e-9)).all()
        work.append(computed)
        new = book.copy()
        for e in set(held.tolist()):
            new[e] = x[held == e].sum(0) // (held == e).sum()
        low = low - vector_codes.moves(book, new, groups)
        book = new
    assert work[-1] < 0.6 * work[0]


def test_vector_codes(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "ENTRIES", 24)
    r = np.random.default_rng(3)
    rows = [(int(i), (r.integers(-4, 5, 8) / 512).tolist(), int(i) % 3 if i % 5 else None) for i in r.permutation(150)]
    rows += [(200 + k, rows[0][1], 9) for k in range(40)] + [(7, rows[3][1], 1), (None, rows[1][1], 1), (300, [-0.7] * 8, 1)]
    odd = [(-5, None, 1), (-4, [float("nan")] + [0.0] * 7, 1), (-3, [None] + [0.0] * 7, 1), (-2, [float("inf")] + [0.0] * 7, 1), (-6, [1.0] * 12, 1), (-7, [1.0] * 7, 1), (-8, [], 1)]
    huge = [(-1, [1e30] + [0.0] * 7, 1)]
    df = spark.createDataFrame(rows + odd + huge, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("id", "q", "code", "low", "slot", "error")}).repartition(3)
    out, books = vector_codes.compress(df)
    whole = lambda v: [int(np.floor(1024 * float(np.float32(x)))) for x in v]
    order = sorted(((i, whole(v)) for i, v, _ in rows), key=lambda x: (x[0] is None, x[0] or 0, np.array(x[1], np.int32).tobytes()))
    codes, errors, want = plain_lloyd(order, 2)
    assert [b.tolist() for b in books] == want
    got = Counter((x.id, x.code, x.error) for x in out.collect())
    assert got == Counter([*((i, c, e) for (i, _), c, e in zip(order, codes, errors, strict=True)), (-1, None, None)])
    few, books = vector_codes.compress(df.where("vec_id in (200, 201, 300)"))
    assert sorted((x.id, x.code, x.error) for x in few.collect()) == [(200, "00000000", 0), (201, "00000000", 0), (300, "02020202", 0)] and [len(b) for b in books] == [3] * 4
    assert vector_codes.compress(df.limit(0))[0].count() == 0 and vector_codes.compress(df.where("vec_id < -1"))[0].where("id <> -6").count() == 0


def test_codes_equal_sql(spark, sf):
    got = vector_codes.op13_vector_codes(spark, sf)
    assert got.where("label_error is null").count() == 0
    same_as_sql(got.toPandas(), vector_codes.OP13_SQL, sf, ["embeddings"])


def test_labels_without_a_value_are_one(spark, tmp_path):
    rows = [(i, [i / 100] * 4, None if i % 2 else 5) for i in range(20)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = vector_codes.op13_vector_codes(spark, str(tmp_path)).collect()
    assert len(got) == 20 and all(r.label_error == 0 and r.error == 0 for r in got)
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(",".join(str(int(np.floor(1024 * float(np.float32(i / 100))))) for _ in range(4) for i in range(20)).encode()).hexdigest()}


# --- quality ---


def plain_statistics(text):
    words, lines = text.split(), [x for x in text.split("\n") if x.split()]
    solid = "".join(words)
    share = lambda test, of: sum(map(test, of)) / max(1, len(of))
    letters = [c for c in solid if c.isalpha()]
    runs = [words[k : k + 256] for k in range(0, len(words), 256)]
    return {
        "characters": np.log2(1 + len(text)), "words": np.log2(max(1, len(words))), "word_length": np.mean([len(w) for w in words]) if words else 0, "longest_word": np.log2(1 + max(map(len, words), default=0)) if words else 0,
        "letters": share(str.isalpha, solid), "capitals": share(str.isupper, letters), "digits": share(str.isnumeric, solid), "bare_words": share(lambda w: not any(c.isalnum() for c in w), words),
        "shouted_words": share(lambda w: w.isupper() and sum(c.isalpha() for c in w) > 1, words), "tailed_words": share(lambda w: len(w) > 2 and not w[-1].isalnum() and not w[-2].isalnum() and any(map(str.isalpha, w)), words),
        "repeated_neighbours": sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, len(words)), "known_words": 1 - sum(len(set(x)) for x in runs) / max(1, len(words)) if words else 0,
        "commonest_word": sum(Counter(x).most_common(1)[0][1] for x in runs) / max(1, len(words)), "repeated_lines": 1 - len({tuple(x.split()) for x in lines}) / len(lines) if lines else 0,
        "ended_lines": share(lambda x: x.split()[-1][-1] in ".!?。", lines), "words_of_line": np.log2(1 + len(words) / len(lines)) if lines else 0,
    }


def test_statistics():
    r = np.random.default_rng(5)
    texts = ["", " \n ", "One", "one one ONE!! two.\n\none one", "| a | b ||\n12 3.4 $$", "Ünï ÇÖDÉ 漢字。\nq?", "a" * 3000, "\ttab  \n x", " ".join(r.choice(["aa", "bb.", "CC", "d\n"], 2000))]
    got = measure(texts)
    for text, row in zip(texts, got, strict=True):
        for name, value in plain_statistics(text).items():
            assert row[STATISTICS.index(name)] == pytest.approx(value), (name, text[:30])
    assert np.allclose(measure(texts[::-1])[::-1], got)  # neighbours do not matter
    assert measure([]).shape == (0, len(STATISTICS))


def test_long_texts_are_counted_whole(monkeypatch):
    text = "some plain words here. " * 700 + "SHOUT SHOUT SHOUT " * 300
    whole = measure([text])
    monkeypatch.setattr("quarry.llm.text_statistics.PIECE", 1000)
    cut = measure([text, "x"])[0]
    for name in ("characters", "words", "word_length", "letters", "capitals", "shouted_words", "longest_word"):
        assert cut[STATISTICS.index(name)] == pytest.approx(whole[0, STATISTICS.index(name)])


def test_lasso_is_optimal():
    r = np.random.default_rng(6)
    x = (r.random((400, 30)) < 0.4).astype(float)
    y = (r.random(400) < 1 / (1 + np.exp(-(2 * x[:, 0] - 3 * x[:, 1])))).astype(float)
    for penalty in (0.1, 0.02, 0.004):
        w, c = quality.lasso(x, y, penalty, steps=5000)
        p = 1 / (1 + np.exp(-(x @ w + c)))
        slope = x.T @ (p - y) / len(y)
        assert (np.abs(slope[w == 0]) <= penalty * 1.01).all() and np.allclose(slope[w != 0], -penalty * np.sign(w[w != 0]), atol=2e-3)
        assert abs((p - y).mean()) < 1e-3
    assert 0 < (w != 0).sum() < 30 and np.abs(w).argmax() in (0, 1)


def test_expression_equals_rules(spark):
    r = np.random.default_rng(7)
    x = r.random((500, len(STATISTICS)))
    y = ((x[:, 2] > 0.5) & (x[:, 7] <= 0.6) | (x[:, 11] > 0.9)).astype(int)
    model = quality.fit(x, y, 0.5)
    assert model.rules and ((model.probability(x) > 0.5) == y).mean() > 0.95
    df = spark.createDataFrame([tuple(map(float, row)) for row in x], ", ".join(f"{s} double" for s in STATISTICS))
    assert np.allclose([v.p for v in df.select(model.column().alias("p")).collect()], model.probability(x))
    assert quality.fit(x, np.ones(500, int)).probability(x).min() > 0.9 and quality.fit(x[:0], y[:0]).probability(x)[0] == 0.5


def test_quality_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op11_quality(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    unseen = got[got.held_out]
    assert (unseen.predicted == unseen.quality).mean() > 0.96
    assert ((unseen.quality == 1) & (unseen.predicted == 0)).sum() <= 2
    assert got.score.between(0, 1).all() and ((got.score >= quality.GOOD) == (got.predicted == 1)).all()


def test_quality_of_odd_rows(spark):
    good, bad = "Plain words in a plain sentence, which ends here. ", "BUY!!! NOW!!! $$$ ### "
    rows = [(i, (good if i % 2 else bad) * (1 + i % 7)) for i in range(300)] + [(None, good), (500, None), (501, ""), (1, good * 2), (502, good * 20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(0) for c in ("score", "own", "words", "quality", "_quality")})
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(None, 1), (3, 0), (4, None), (5, 7)], "doc_id long, quality int")
    got = quality.quality(docs, labels).collect()
    assert len(got) == len(rows)
    told = {r.doc_id: r.predicted for r in got}
    assert told[None] == 1 and told[502] == 1 and told[298] == 0
    assert len({r.score for r in got if r.doc_id in (500, 501)}) == 1
    assert {r.score for r in quality.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality(docs.limit(0), labels).count() == 0

"""De-duplication operators against plain versions, with nulls, ties, repeats, long texts and empty tables."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import exact_dedup as exact
from quarry.llm import minhash
from quarry.llm.components import components
from quarry.llm.exact_dedup import OP2_SQL, drop_copies, exact_dedup
from quarry.llm.minhash import near_duplicates
from quarry.llm.sharding import OP8_SQL, jump_hash, op8_sharding, shard_documents
from quarry.llm.suffix_dedup import anchors, anchors_of, intervals, remove_repeats, without_repeats

SCHEMA = "doc_id long, text string"
#: Other columns with names that the operators use inside.
CLASH = ["id", "n", "rep", "sha", "shard", "_text", "_norm", "_sha", "component", "key", "at", "h"]


def table(spark, rows, clash=True):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(c) for c in CLASH}) if clash else df


LONG = " ".join(f"w{k % 977}x{k}" for k in range(40_000))
ODD = [(1, "Alpha"), (2, "ALPHA"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, LONG), (8, LONG.upper()), (9, "alpha "), (10, "Alpha"), (10, "Alpha"), (None, "solo"), (None, "ALPHA")]


def test_exact_dedup(spark):
    got = {(r[0], r.text_sha256): (r.keep_id, r.group_size, r.kept) for r in exact_dedup(table(spark, ODD)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[(1, sha("alpha"))] == (10, 5, False) and got[(10, sha("alpha"))] == (10, 5, True)
    assert got[(None, sha("alpha"))] == (10, 5, False) and got[(None, sha("solo"))] == (None, 1, True)
    assert got[(3, sha(""))] == (4, 2, False) and got[(4, sha(""))] == (4, 2, True)
    assert got[(5, sha("É"))] == (5, 1, True) and got[(6, sha("é"))] == (6, 1, True)
    assert got[(8, sha(LONG.lower()))] == (8, 2, True)
    assert exact_dedup(table(spark, [])).count() == 0
    assert {r.doc_id for r in exact_dedup(table(spark, ODD), keep="min").where("kept").collect()} == {1, 3, 5, 6, 7, 9, None}


def test_exact_dedup_is_native(spark, sf):
    plan = exact_dedup(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_exact_dedup_sql(spark, sf):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = {tuple(map(str, r)) for r in c.sql(OP2_SQL).fetchall()}
    got = {tuple(map(str, r)) for r in exact_dedup(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert got == want


def test_hot_text_is_split(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    out = exact_dedup(rows).where("group_size > 1")
    assert out.count() == 2000 and [r.doc_id for r in out.where("kept").collect()] == [5997]


@pytest.mark.parametrize("partitions", [1, 4, 24])
def test_groups_over_borders(spark, partitions, monkeypatch):
    """Texts of which ranges hold nothing else, texts with equal openings, and empty ranges; groups are what neighbours say."""
    monkeypatch.setattr(exact, "shuffle_partitions", lambda _: partitions)
    r = random.Random(partitions)
    opening = "the same opening of many texts " * 4
    texts = [opening + str(k) for k in range(12)] + ["B" * 70, "b" * 70, "", None, "Zz", opening]
    rows = [(k, r.choice(texts) if k % 3 else texts[0]) for k in range(900)]
    want = defaultdict(list)
    for k, t in rows:
        want[(t or "").lower()].append(k)
    got = {x.doc_id: (x.keep_id, x.group_size, x.kept) for x in exact_dedup(table(spark, rows)).collect()}
    assert got == {k: (max(g), len(g), k == max(g)) for g in want.values() for k in g}


def test_neighbours_decide(spark, monkeypatch):
    """Without an order there are no neighbours to compare, and so no groups: nothing else makes them."""
    rows = [(k, "same" if k % 2 else f"text {k}") for k in range(200)]
    monkeypatch.setattr(exact, "_lead", lambda text: F.concat(F.left(F.sha2(F.concat(F.uuid(), text), 256), F.lit(8)), F.lit("0" * 64)))
    got = exact_dedup(table(spark, rows)).collect()
    assert max(x.group_size for x in got) < 100


def test_drop_copies(spark):
    kept = drop_copies(table(spark, ODD, clash=False).withColumn("lang", F.lit("x")))
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 4, 5, 6, 8, 9, 10] and kept.columns == ["doc_id", "text", "lang"]


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    inverse, parent = defaultdict(list), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        shared = Counter(j for g in s for j in inverse[g])
        for g in s:
            inverse[g].append(i)
        for j, k in shared.items():
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_rows(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(3))
    rows, k = [], 0
    for _ in range(25):
        base = [word() for _ in range(r.choice([3, 8, 60, 200, 900]))]
        for _ in range(r.randint(1, 14)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 14))):
                w[r.randrange(len(w))] = word()
            rows.append((k, " ".join(w) if r.random() < 0.8 else "\t".join(w).upper()))
            k += 1
    r.shuffle(rows)
    return rows + [(k, None), (k + 1, ""), (k + 2, " \n"), (k + 3, "é"), (k + 4, "É"), (k + 5, LONG), (k + 6, LONG + " more")]


def test_near_duplicates(spark):
    rows = near_rows()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(table(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_odd_rows(spark):
    out = near_duplicates(table(spark, [(None, "a b c"), (5, "a b c"), (5, "a b c"), (2, "A B C"), (9, None), (8, "")])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in out) == [(-1, -1, True), (2, 2, True), (5, 2, False), (5, 2, False), (8, 8, True), (9, 9, True)]
    assert near_duplicates(table(spark, [])).count() == 0


def test_near_duplicates_sql(spark, sf):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = c.sql(minhash.OP1_SQL)
    names = want.columns
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in minhash.op1_minhash(spark, sf).select(names).collect())


def test_one_id_with_two_texts(spark):
    """Links of either text are links of the id, on every run."""
    r = random.Random(12)
    a, b, c = (" ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(300)) for _ in range(3))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " x"), (4, c), (4, a + " y"), (4, a + " y"), (5, c + " z"), (6, "apart from all of them")]
    for _ in range(3):
        r.shuffle(rows)
        got = {(x.doc_id, x.component_id) for x in near_duplicates(table(spark, rows)).collect()}
        assert got == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 6)}


def test_an_id_joins_its_classes(spark):
    """One id has one component, also where its texts are copies of texts of others."""
    r = random.Random(13)
    b, c, d = (" ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(60)) for _ in range(3))
    rows = [(2, b), (5, b), (5, c), (9, c), (9, c), (11, d), (9, d), (12, ""), (12, d)]
    got = {(x.doc_id, x.component_id, x.kept) for x in near_duplicates(table(spark, rows)).collect()}
    assert got == {(2, 2, True), (5, 2, False), (9, 2, False), (11, 2, False), (12, 2, False)}


def test_templates(spark):
    """Texts that share most of their words, but not enough to be linked, meet in blocks; the near copies among them are found."""
    r = random.Random(14)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    frame = [word() for _ in range(300)]
    rows = [(k, " ".join(frame + [word() for _ in range(100)])) for k in range(1500)]
    rows += [(5000 + k, rows[k][1] + " " + word()) for k in range(0, 1500, 50)]
    began = time.time()
    got = {x.doc_id: x.component_id for x in near_duplicates(table(spark, rows)).collect()}
    assert got == {i: i - 5000 if i >= 5000 else i for i, _ in rows}
    assert time.time() - began < 120


def test_blocks_give_links_not_pairs(spark, monkeypatch):
    """A group of near copies that falls into many components: what its blocks give grows with its rows, not with their square."""
    r = random.Random(15)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    frame = [word() for _ in range(60)]
    texts = []
    for _ in range(800):
        words = list(frame)
        for at in r.sample(range(60), 2):
            words[at] = word()
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    counts = Counter()

    def counted(df, name, kept=minhash.store):
        out = kept(df, name)
        counts[name] += out.count()
        return out

    monkeypatch.setattr(minhash, "store", counted)
    monkeypatch.setattr(minhash, "BLOCK", 300)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_duplicates(table(spark, rows)).collect()}
    assert got == brute_components(rows)
    assert counts["crossing"] + counts["pairs"] < 10 * len(rows)


def test_tested_sets_are_linked_as_counted():
    """Sets against one, among them its like, parts of it, larger ones and ones past its end."""
    r = np.random.default_rng(8)
    pool = np.unique(r.integers(0, 1 << 63, 400, dtype=np.uint64))
    s = pool[:100]
    others = [s, s[:75], s[:74], pool[:133], pool[:134], pool[25:100], pool[300:], pool[10:110], pool[:1]]
    want = [100 * len(np.intersect1d(s, t)) >= 75 * len(np.union1d(s, t)) for t in others]
    assert minhash._similar(s, others).tolist() == want and True in want and False in want


def test_blocks_find_what_expressions_find(spark, monkeypatch):
    """The bound over arrays is that of the plan."""
    r = np.random.default_rng(6)
    a, b = r.integers(1, 3000, 400), r.integers(1, 3000, 400)
    df = spark.createDataFrame([([-1] * 16, [int(-1 ^ (1 << 62)) for _ in range(16)], int(p), int(q)) for p, q in zip(a, b, strict=True)], "x array<long>, y array<long>, a long, b long")
    told = [x.v for x in df.select(minhash._alike(*map(F.col, "xyab")).alias("v")).collect()]
    assert told == (minhash._most_bits(a, b) >= 16).tolist()


def test_sketch_bound_lets_links_through(spark):
    """Pairs just similar enough, of sets below and above the sample's size, pass the sketch."""
    r = np.random.default_rng(5)
    rows = []
    for a, b in ((40, 40), (200, 160), (700, 700), (4000, 3200), (9000, 9000)):
        for _ in range(60):
            shared = -(-75 * (a + b) // 175)
            pool = r.integers(0, 1 << 63, a + b - shared, dtype=np.uint64)
            s, t = np.sort(pool[:a]), np.sort(pool[a - shared :])
            rows.append((minhash.odd_sketch(s).tolist(), minhash.odd_sketch(t).tolist(), len(s), len(t)))
    df = spark.createDataFrame(rows, "x array<long>, y array<long>, a long, b long")
    assert df.where(minhash._alike(*map(F.col, "xyab"))).count() == len(rows)
    assert df.withColumn("y", F.transform("y", lambda v: F.bitwise_not(v))).where(minhash._alike(*map(F.col, "xyab"))).count() == 0


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)}


def brute_repeats(texts, length):
    seen = Counter(t[s : s + length] for t in texts for s in range(len(t) - length + 1))
    out = []
    for t in texts:
        covered = np.zeros(len(t), bool)
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                covered[s : s + length] = True
        rest = np.frombuffer(t, np.uint8)[~covered].tobytes()
        out.append((len(t), int(covered.sum()), int((np.diff(np.r_[0, covered.astype(int)]) == 1).sum()), hashlib.sha256(rest).hexdigest()))
    return out


@pytest.mark.parametrize(("seed", "hot"), [(1, 5000), (2, 5000), (3, 5000), (1, 2), (2, 7), (4, 40)])
def test_repeats(spark, seed, hot):
    """Also where most anchors are crowded, and are dealt by blocks up to the last step."""
    r = random.Random(seed)
    phrases = ["".join(r.choice("abc ") for _ in range(r.randint(10, 40))) for _ in range(12)] + ["a" * 30, "é", "ü" * 9]
    rows = [(i, "".join(r.choice(phrases) for _ in range(r.randint(0, 8)))) for i in range(250)]
    rows += [(1000, None), (1001, ""), (1002, "a" * 500), (1003, "ab" * 200), (1004, "x" * 23), (1005, "x" * 23), (1006, "q" * 24)]
    rows += [(2000 + i, f"{i} " + "the same line again\n" * (3 + i % 5) + f"{i}") for i in range(40)]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in remove_repeats(table(spark, rows), 24, 8, hot=hot).collect()}
    assert got == dict(zip([i for i, _ in rows], brute_repeats([(t or "").encode() for _, t in rows], 24), strict=True))


def test_repeats_of_odd_rows(spark):
    long = "".join(random.Random(k).choice("abcdefgh ") for k in range(5000))
    out = remove_repeats(table(spark, [(None, long), (1, long), (1, long), (2, "start " + long[1000:1500] + " end"), (2, "other"), (3, None)])).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans) for r in out) == [(-1, 5000, 5000, 1), (1, 5000, 5000, 1), (1, 5000, 5000, 1), (2, 5, 0, 0), (2, 510, 500, 1), (3, 0, 0, 0)]
    assert remove_repeats(table(spark, [])).count() == 0


def test_texts_without_repeats(spark):
    passage = "é" * 220 + "passage" * 9
    rows = spark.createDataFrame([(1, f"one {passage} two", "x"), (2, f"three {passage}", None), (3, None, "y"), (None, "", "z"), (4, "", "z"), (4, "", "z")], "doc_id long, text string, lang string")
    got = [(r.doc_id, r.text, r.lang) for r in without_repeats(rows).collect()]
    # the passage and what stands before it in both
    assert sorted(got, key=str) == sorted([(1, "on two", "x"), (2, "thre", None), (3, "", "y"), (None, "", "z"), (4, "", "z"), (4, "", "z")], key=str)
    assert without_repeats(rows.limit(0)).count() == 0 and without_repeats(rows).columns == rows.columns


def test_anchors_agree():
    """Equal windows choose the same place, wherever they stand."""
    r = np.random.default_rng(2)
    data = r.integers(97, 101, 9000).astype(np.uint8)
    data[5000:5600] = data[1000:1600]
    at, *_ = anchors(data, np.array([4000, 9000]), 400, 64)
    first, second = ({int(x) - base for x in at if base <= x <= base + 600 - 64} for base in (1000, 5000))
    inside = {x for x in first | second if 336 <= x <= 200 + 64}
    assert first & second and all(x in first and x in second for x in inside)


@pytest.mark.parametrize("words", [0, 12])
def test_anchors_in_parts(words):
    """A long text has the same anchors, with the same reaches, whether it is read whole or in parts."""
    r = random.Random(31)
    word = lambda n: "".join(r.choice("abcd") for _ in range(r.randint(1, n))).encode()
    texts = [b" ".join(word(9) for _ in range(600)), b"", b"x" * 700, b"ab cd " * 300, b"\n\t ".join(word(4) for _ in range(500)), word(900) * 3 + b" " + b" ".join(word(5) for _ in range(90)) + word(900) * 2, b"short"]
    whole = anchors_of(texts, 64, 16, words)
    for chunk in (100, 257, 1000):
        for a, b in zip(whole, anchors_of(texts, 64, 16, words, chunk), strict=True):
            assert (a == b).all(), chunk


def test_intervals():
    assert list(intervals([1, 3, 0, 2])) == [(3, 1, 2), (1, 0, 2), (2, 3, 4), (0, 0, 4)]


def test_jump_hash_moves_only_to_the_new_shard():
    keys = np.arange(20_000, dtype=np.uint64)
    old, new = jump_hash(keys, 40), jump_hash(keys, 41)
    assert set(new[old != new]) == {40} and 300 < (new == 40).sum() < 700
    assert np.bincount(old).min() > 350 and (jump_hash(keys, 1) == 0).all()

    def plain(key, n):  # the paper's loop, one key at a time
        b, j = -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
        return b

    from quarry.llm.common import mix64

    mixed = mix64(keys[:300].copy()).tolist()
    assert [plain(k, 40) for k in mixed] == old[:300].tolist()


def test_sharding_sql(spark, sf):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = c.sql(OP8_SQL)
    names = want.columns
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in op8_sharding(spark, sf).select(names).collect())


def test_sharding(spark):
    out = shard_documents(table(spark, ODD), 5).collect()
    assert len(out) == len(ODD)
    for s in range(5):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
    by = {r.doc_id: r for r in out if r.doc_id}
    assert by[3]["size"] == 16 and by[3].text_crc32 == 0 and by[5]["size"] == 18 and by[5].text_crc32 == zlib.crc32("É".encode())
    assert len({r.shard for r in out if r.doc_id == 10}) == 1
    assert all(r.grown_shard in (r.shard, 5) for r in out)
    assert shard_documents(table(spark, []), 5).count() == 0

"""Segmentation against brute force over all paths and all states."""

import itertools
import random
import time

from pyspark.sql import functions as F

from quarry.functions.lattice import FOLLOWS, STATES, Lattice, lattice_tokeniser


def all_paths(run):
    for cuts in itertools.product([False, True], repeat=len(run) - 1):
        at = [0, *(i for i, c in enumerate(cuts, 1) if c), len(run)]
        yield [run[a:b] for a, b in itertools.pairwise(at)]


def test_path_is_the_cheapest():
    r = random.Random(1)
    for _ in range(150):
        words = {"".join(r.choices("天地人", k=r.randrange(1, 4))): r.randrange(1, 50) for _ in range(7)}
        lattice = Lattice(words, hidden=False)
        run = "".join(r.choices("天地人中", k=r.randrange(1, 9)))
        price = lambda path, known=lattice: sum(known.costs.get(w, known.unknown if len(w) == 1 else 10**12) for w in path)
        got = lattice.path(run)
        assert "".join(got) == run and price(got) == min(map(price, all_paths(run)))
        # of equal paths the one with the longer last word, and so on
        equal = [p for p in all_paths(run) if price(p) == price(got)]
        assert got == max(equal, key=lambda p: [len(w) for w in reversed(p)])


def test_states_are_the_most_probable():
    r = random.Random(2)
    words = {"".join(r.choices("天地人中", k=r.randrange(1, 5))): r.randrange(1, 50) for _ in range(25)}
    hidden = Lattice(words).hidden
    for n in range(1, 7):
        run = "".join(r.choices("天地人中国", k=n))
        valid = [s for s in map("".join, itertools.product(STATES, repeat=n)) if s[0] in "BS" and s[-1] in "ES" and all(b in FOLLOWS[a] for a, b in itertools.pairwise(s))]
        got = hidden.states(run)
        assert got in valid and hidden.score(run, got) >= max(hidden.score(run, s) for s in valid) - 1e-9
        assert "".join(hidden.cut(run)) == run


def test_tokens():
    lattice = Lattice({"搜索": 50, "引擎": 40, "搜索引擎": 30, "中国": 60, "中国人": 20, "国人": 30, "人们": 30, "的": 100, "空": 0}, hidden=True)
    assert lattice.tokens("搜索引擎 abc 中国人们的 3.5%") == ["搜索引擎", "abc", "中国", "人们", "3.5%"]
    assert lattice.tokens("搜索引擎", "search") == ["搜索", "引擎", "搜索引擎"]
    assert lattice.tokens(None) == [] and lattice.tokens("的") == [] and Lattice({}).tokens("天地") == []
    strange = lattice.cut("中国吉祥人们")
    assert strange[0] == "中国" and strange[-1] == "人们" and "".join(strange[1:-1]) == "吉祥"
    long = "搜索引擎中国" * 20000 + "吉" * 5000
    assert "".join(lattice.cut(long)) == long


def test_as_a_column(spark):
    df = spark.createDataFrame([("搜索引擎在中国",), (None,), ("",)], "t string")
    words = {"搜索": 5, "引擎": 5, "中国": 5}
    got = [x.w for x in df.select(lattice_tokeniser(words)(F.col("t")).alias("w")).collect()]
    assert got == [["搜索", "引擎", "中国"], [], []]


def test_runs_together_equal_runs_alone():
    """Runs that are cut together have the paths that each has alone, ties and characters that no word has included, and cost much less."""
    r = random.Random(8)
    letters = "天地玄黄宇宙洪荒"
    words = {"".join(r.choices(letters, k=r.randrange(1, 7))): r.randrange(1, 4) for _ in range(400)}
    lattice = Lattice(words)
    runs = ["".join(r.choices(letters + "日\U00020000", k=r.randrange(1, 60))) for _ in range(500)] + ["天地" * 300, ""]
    got = lattice.paths(runs)
    assert got == {run: lattice.path(run) for run in runs if run}
    many = ["".join(r.choices(letters, k=24)) for _ in range(20_000)]
    took = []
    for cut in (lambda: [lattice.path(run) for run in many], lambda: lattice.paths(many)):
        began = time.process_time()
        cut()
        took.append(time.process_time() - began)
    assert took[1] < took[0] / 2
    assert Lattice({}).paths(["天地"]) == {"天地": ["天", "地"]}

"""The pipeline's stages against plain versions of what each decides."""

import random
import re
import string
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from quarry.llm.common import DOCUMENT_COLUMNS, store, table
from quarry.llm.suffix_dedup import remove_repeats, without_repeats
from quarry.llm.toxicity import toxicity

from .test_dedup import brute_components, brute_repeats


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "suffix_dedup", "packing"]


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    before = {r.doc_id: r.text for r in docs.collect()}
    toxic = {r.doc_id for r in toxicity(docs, table(spark, sf, "labels")).where("predicted = 1").collect()}
    steps = [{i: t for i, t in before.items() if i not in toxic}]
    last = {}
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    for i, t in sorted(steps[0].items()):
        last[(t or "").translate(lower)] = i
    steps.append({i: steps[0][i] for i in last.values()})
    parts = brute_components(list(steps[1].items()))
    steps.append({i: t for i, t in steps[1].items() if parts[i][1] == i})
    for (name, stage), want in zip(corpus_pipeline.STAGES[:3], steps, strict=False):
        docs = store(stage(spark, docs, sf), name)
        assert tuple(docs.columns) == DOCUMENT_COLUMNS
        assert {r.doc_id: r.text for r in docs.collect()} == want, name
    docs = store(corpus_pipeline.STAGES[3][1](spark, docs, sf), "suffix_dedup")
    got = {r.doc_id: r for r in docs.collect()}
    assert {i: r.text for i, r in got.items()} == dict(zip(steps[2], brute_passages([(t or "").encode() for t in steps[2].values()]), strict=True))
    assert all(r.n_chars == len(r.text) for r in got.values())
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, sf).toPandas()
    tokens = {i: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in got.items()}
    assert pieces.groupby("doc_id").length.sum().to_dict() == tokens
    assert corpus_pipeline.run(spark, sf).count() == len(pieces)


def runs_of_words(texts, words):
    """Which words of each text (split at ASCII white space) lie in runs of `words` that occur again with the same bytes between."""
    split = [[(m.start(), m.end()) for m in re.finditer(rb"[^\t-\r ]+", t)] for t in texts]
    grams = [[t[at[i][0] : at[i + words - 1][1]] for i in range(len(at) - words + 1)] for t, at in zip(texts, split, strict=True)]
    seen = Counter(g for gs in grams for g in gs)
    out = []
    for at, gs in zip(split, grams, strict=True):
        covered = set()
        for i, g in enumerate(gs):
            if seen[g] > 1:
                covered |= set(range(at[i][0], at[i + words - 1][1]))
        out.append(covered)
    return out


def brute_passages(texts):
    """The texts without what lies in 400 bytes, or in 51 whole words in a row, that occur again; parts of characters are left out."""
    seen = Counter(t[s : s + 400] for t in texts for s in range(len(t) - 399))
    out = []
    for t, words in zip(texts, runs_of_words(texts, 51), strict=True):
        covered = bytearray(len(t))
        for p in words:
            covered[p] = 1
        for s in range(len(t) - 399):
            if seen[t[s : s + 400]] > 1:
                covered[s : s + 400] = b"\1" * 400
        out.append(bytes(c for c, gone in zip(t, covered, strict=True) if not gone).decode("utf-8", "ignore"))
    return out


def test_passages_of_over_50_words(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    texts, planted = [], {}
    for n in [*range(40, 63)] * 2:
        passage = prose(n)
        planted[len(texts)] = n
        texts += [f"{prose(90)}\n{passage} {prose(70)}", passage + "\n" + prose(80), prose(60) + "\t" + passage]
    texts += [prose(300) for _ in range(20)] + ["x" * 50 + prose(40), "", "a b " * 200]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {x.doc_id: x.text for x in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    crowded = {x.doc_id: x.text for x in without_repeats(docs, words=corpus_pipeline.PASSAGE_WORDS, hot=2).collect()}
    assert crowded == got
    data = [t.encode() for t in texts]
    by_words = runs_of_words(data, 51)
    told = {x.doc_id: x for x in remove_repeats(docs, words=51).collect()}
    for i, plain in enumerate(brute_repeats(data, 400)):  # passages do not change what 400 bytes take out
        assert (told[i].n_bytes, told[i].n_removed, told[i].n_spans, told[i].kept_sha256) == plain
        assert told[i].passage_bytes == len(data[i]) - len(got[i].encode())
    for i, (t, want) in enumerate(zip(texts, by_words, strict=True)):
        seen = Counter(data[j][s : s + 400] for j in (i,) for s in range(len(data[j]) - 399))  # only the last text repeats 400 bytes
        want = want | {p for s in range(len(t) - 399) if seen[data[i][s : s + 400]] > 1 for p in range(s, s + 400)}
        assert got[i] == "".join(c for p, c in enumerate(t) if p not in want), (i, t)
    for i, n in planted.items():
        assert all((got[j] == texts[j]) == (n <= 50) for j in (i, i + 1, i + 2)), n


def test_stages_on_odd_rows(spark, sf):
    """Nulls in all columns, empty and very long texts, ties, repeated rows, clashing names, and empty tables."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    long, near = " ".join(word() for _ in range(60_000)), [word() for _ in range(200)]
    texts = [(1, long), (2, long.upper()), (3, None), (4, ""), (5, " \n "), (6, " ".join(near)), (7, " ".join(near[:-1])), (7, " ".join(near[:-1])), (None, "solo words here"), (None, None), (8, "é"), (9, " ".join(near) + " x"), (8, "other text of eight")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("id", "_id", "_sha", "sha", "at", "h", "key", "score", "predicted", "toxic", "fold", "_own", "_kept", "rep", "component", "kept", "_norm", "_range", "length", "start"):
        docs = docs.withColumn(c, F.lit(c))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = store(stage(spark, docs, sf), name)
        assert tuple(out.columns) == DOCUMENT_COLUMNS and stage(spark, docs.limit(0), sf).count() == 0, name
        kept[name] = sorted(((x.doc_id or -1, (x.text or "")[:20]) for x in out.collect()), key=str)
    every = sorted(((i or -1, (t or "")[:20]) for i, t in texts), key=str)
    cut = lambda rows: sorted([(i, t[:20]) for i, t in rows], key=str)
    assert kept["toxicity"] == every
    assert kept["exact_dedup"] == cut([(2, long.upper()), (5, " \n "), (4, ""), (6, " ".join(near)), (7, " ".join(near[:-1])), (-1, "solo words here"), (8, "é"), (9, " ".join(near)), (8, "other text of eight")])
    assert kept["near_dedup"] == [x for x in every if x[0] not in (2, 7, 9)]
    assert sorted(i for i, _ in kept["suffix_dedup"]) == sorted(i or -1 for i, _ in texts)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).toPandas()
    assert len(pieces[pieces.start == 0]) == len(texts) and corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0

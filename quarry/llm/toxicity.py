"""Toxicity scores from two Kneser-Ney models, one for toxic and one for ordinary texts.

The units are the bytes of a word in UTF-8; a model gives each the probability after the ORDER - 1
bytes before it. All scripts have as many units as they need, and no alphabet has to be chosen. The two classes have discounted counts of their own at the highest order only;
all lower orders are continuation counts that they share. So where a context is new to both, the
two models agree, and a rare expression counts only as far as one class is known to use it.

A word's evidence is the difference of its log-likelihoods. A text's features are that
difference over its whole length, for each character and each word, and over its most telling
words, less what a text of that length shows by chance; a logistic curve fitted to training texts that the models had not seen makes them a score.

The models count the words of all usable labelled texts; only the curve is fitted to a bounded sample of them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, released, store, table

#: Bytes of a gram, the discount, and how many values a byte has.
ORDER, DISCOUNT, UNITS = 8, 0.75, 256
#: The bound of the curve's sample, for each class.
SAMPLE_ROWS = 3000
#: Parts of the labelled texts; the curve sees a text with models from the other parts.
FOLDS = 2
#: How many of a text's most telling words have features of their own.
TOP = 3
#: The evidence that some word has by chance, times the logarithm of the number of words.
BY_CHANCE = 0.5
FEATURES = 2 + TOP
#: Words whose evidence a worker keeps (a cache).
KEPT_WORDS = 200_000
#: As many labelled ids are broadcast at most (64 MB).
MOST_BROADCAST = 2_000_000
#: Bytes of text that are split into words together.
SLICE_BYTES = 1_000_000

_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass
class Evidence:
    """What the two models come to: log-ratios of seen grams, and of contexts for grams that are new after them."""

    grams: np.ndarray
    gram_ratio: np.ndarray
    contexts: np.ndarray
    context_ratio: np.ndarray

    def of_words(self, words: list[str]) -> np.ndarray:
        """log p(word | toxic) - log p(word | ordinary) for each."""
        grams, at = _grams(words)
        out = np.zeros(len(grams))
        if len(self.grams):
            i = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
            j = np.minimum(np.searchsorted(self.contexts, grams >> np.uint64(8)), len(self.contexts) - 1)
            out = np.where(self.contexts[j] == grams >> np.uint64(8), self.context_ratio[j], 0.0)
            out = np.where(self.grams[i] == grams, self.gram_ratio[i], out)
        return np.bincount(at, out, minlength=len(words))


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Each byte of each word, and its end, packed with the bytes before it; the word's number.

    0 stands before a word and 1 for its end; words have neither.
    """
    codes = np.frombuffer("\0".join([*words, ""]).encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint64)
    ends = np.flatnonzero(codes == 0)
    codes[ends] = 1
    lengths = np.diff(ends, prepend=-1)
    at = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    packed = codes.copy()
    for k in range(1, ORDER):
        past = np.zeros_like(codes)
        past[k:] = codes[:-k] if k < len(codes) else 0
        past[place < k] = 0
        packed |= past << np.uint64(8 * k)
    return packed, at


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, where = np.unique(keys, return_inverse=True)
    return found, np.bincount(where, weights, minlength=len(found))


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and how often each comes; `keys` is sorted on the way."""
    keys.sort()
    edge = np.flatnonzero(keys[1:] != keys[:-1]) + 1 if len(keys) else np.zeros(0, np.int64)
    first = np.concatenate([np.zeros(min(1, len(keys)), np.int64), edge])
    return keys[first], np.diff(np.append(first, len(keys))).astype(np.int32)


def _shared(grams: np.ndarray) -> np.ndarray:
    """p(last byte | the ORDER - 2 before it) of each gram, from continuation counts of both classes."""
    levels, longer = [], grams  # distinct; each gives its shortened gram one continuation
    for n in range(ORDER - 1, 0, -1):  # the number of bytes, the predicted one included
        seen, times = _distinct(longer & np.uint64((1 << 8 * n) - 1))
        levels.append((n, seen, times))
        longer = seen
    shorter, p = np.zeros(1, np.uint64), np.full(1, 1.0 / UNITS)
    for n, seen, times in reversed(levels):
        p = p[np.searchsorted(shorter, seen & np.uint64((1 << 8 * (n - 1)) - 1))]
        first = np.flatnonzero(np.diff(seen >> np.uint64(8), prepend=np.uint64(0)))
        first = np.unique(np.append(0, first)) if len(seen) else first
        kinds = np.diff(np.append(first, len(seen)))
        p *= DISCOUNT * np.repeat(kinds, kinds)
        p += np.maximum(times - DISCOUNT, 0)
        p /= np.repeat(np.add.reduceat(times, first), kinds) if len(first) else 1
        shorter = seen
    return p[np.searchsorted(shorter, grams & np.uint64((1 << 8 * (ORDER - 1)) - 1))]


def count_words(split: list[list[str]], toxic: np.ndarray) -> list[dict[str, int]]:
    """The words of ordinary and of toxic texts with their counts."""
    counts: list[dict[str, int]] = [{}, {}]
    for words, c in zip(split, toxic.tolist(), strict=True):
        mine = counts[c]
        for w in words:
            mine[w] = mine.get(w, 0) + 1
    return counts


def train(counts: list[dict[str, int]]) -> Evidence:
    """Fit both models to the words of ordinary and of toxic texts, as they are held in memory."""
    own = []
    for mine in counts:
        grams, at = _grams(list(mine))
        own.append(_summed(grams, np.fromiter(mine.values(), float, len(mine))[at]))
    grams = np.union1d(own[0][0], own[1][0])
    n = np.zeros((2, len(grams)))
    for c, (seen, times) in enumerate(own):
        n[c, np.searchsorted(grams, seen)] = times
    return evidence(grams, n)


def evidence(grams: np.ndarray, n: np.ndarray) -> Evidence:
    """Both models from the sorted grams and how often ordinary (`n[0]`) and toxic texts (`n[1]`) hold them."""
    seen = (n > 0).any(0)
    if not seen.all():
        grams, n = grams[seen], n[:, seen]
    contexts, _ = _distinct(grams >> np.uint64(8))
    place = np.searchsorted(contexts, grams >> np.uint64(8)).astype(np.int32)
    shared = _shared(grams)

    def model(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = np.bincount(place, c, minlength=len(contexts))
        kinds = np.bincount(place[c > 0], minlength=len(contexts))
        # what is left to the shared model after this context; all of it, where the class has not met the context
        left = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        p = np.maximum(c - DISCOUNT, 0)
        p /= np.maximum(total, 1)[place]
        p += left[place] * shared
        return p, left

    ratio, left_ratio = model(n[1])
    p, left = model(n[0])
    ratio /= p
    left_ratio /= left
    return Evidence(grams, np.log(ratio, out=ratio).astype(np.float32), contexts, np.log(left_ratio).astype(np.float32))


class Scorer:
    """Features of texts, with the evidence of words kept from text to text."""

    def __init__(self, evidence: Evidence):
        self.evidence, self.kept = evidence, {}

    def features(self, texts: list[str]) -> np.ndarray:
        return self.features_of([words_of(t) for t in texts])

    def features_of(self, split: list[list[str]]) -> np.ndarray:
        new = set().union(*split) - self.kept.keys() if split else set()
        if len(self.kept) + len(new) > KEPT_WORDS:
            self.kept.clear()
            new = set().union(*split)
        words = list(new)
        self.kept.update(zip(words, self.evidence.of_words(words).tolist(), strict=True))
        get = self.kept.__getitem__
        out = np.zeros((len(split), FEATURES))
        for i, words in enumerate(split):
            if words:
                e = np.fromiter(map(get, words), float, len(words))
                top = np.sort(e if len(e) <= TOP else np.partition(e, len(e) - TOP)[-TOP:])[::-1]
                out[i, 0] = e.sum() / sum(map(len, words))
                out[i, 1] = e.mean()
                # among more words, some are more telling by chance
                out[i, 2 : 2 + len(top)] = np.maximum(top - BY_CHANCE * np.log1p(len(words)), 0)
        return out


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton steps for a logistic curve over standardised features: means, scales, weights (the last is the constant)."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * len(x) / 100 * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (y - p) - ridge * len(x) / 100 * w)
        w += step
        if np.abs(step).max() < 1e-7:
            break
    return mean, scale, w


@dataclass
class Model:
    evidence: Evidence
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def probability(self, features: np.ndarray) -> np.ndarray:
        z = (features - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def labelled_ids(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float | None]:
    """(toxic, fold, _order, doc_id, _own, n) of all usable labels, each text once, as the first of its `n` rows; the toxic share of the labels.

    _own is a hash of the text: an id that two texts share stands for each of them.
    """
    usable = labels.where("toxic in (0, 1) and doc_id is not null and pmod(crc32(cast(cast(doc_id as string) as binary)), 5) != 0").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = usable.agg(F.avg("toxic")).first()[0]
    text = F.coalesce("text", F.lit(""))
    # texts meet as digests, and are not moved
    rows = docs.select("doc_id", F.xxhash64(text).alias("_own"), F.unhex(F.sha2(text, 256)).alias("sha")).join(usable, "doc_id")
    rows = rows.groupBy("sha", "doc_id", "_own", "toxic").agg(F.count("*").alias("n"))
    first = rows.groupBy("sha").agg(F.min(F.struct(F.xxhash64("doc_id").alias("_order"), "doc_id", "toxic", "_own", "n")).alias("m"))
    return store(first.select(F.pmod(F.xxhash64("sha"), F.lit(FOLDS)).cast("int").alias("fold"), "m.*"), "labelled"), share


def labelled_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(toxic, fold, doc_id, text) of `labelled_ids`. So many ids at most are broadcast; beyond that texts are exchanged once."""
    number, most = ids.agg(F.count("*"), F.max("n")).first()
    ids = ids.select("doc_id", "_own", "toxic", "fold")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_own", F.xxhash64("text"))
    rows = rows.join(F.broadcast(ids) if number <= MOST_BROADCAST else ids, ["doc_id", "_own"])
    if (most or 1) > 1:  # rows repeat
        rows = rows.dropDuplicates(["doc_id", "_own"])
    return rows.select("toxic", "fold", "doc_id", "text")


def gram_counts(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of the words of `labelled_texts`, sorted, and their counts by class and fold.

    They are summed by Spark. The driver holds 24 bytes for each (40 where a count needs 64 bits); new ones come ever more rarely, but they do come.
    """

    def summed(counts: dict[int, dict[str, int]]) -> pa.RecordBatch:
        cols = [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64))]
        for kind, mine in counts.items():
            grams, at = _grams(list(mine))
            grams, n = _summed(grams, np.fromiter(mine.values(), float, len(mine))[at])
            cols.append((grams.view(np.int64), np.full(len(grams), kind, np.int32), n.astype(np.int64)))
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*cols, strict=True)], names=["gram", "kind", "n"])

    def run(batches):
        counts: dict[int, dict[str, int]] = {}
        for batch in batches:
            for b in by_bytes(batch, 2, SLICE_BYTES):
                for c, f, t in zip(*(x.to_pylist() for x in b.columns), strict=True):
                    mine = counts.setdefault(c * FOLDS + f, {})
                    for w in words_of(t):
                        mine[w] = mine.get(w, 0) + 1
                if sum(map(len, counts.values())) > KEPT_WORDS:
                    yield summed(counts)
        yield summed(counts)

    counted = labelled.select("toxic", "fold", "text").mapInArrow(released(run), "gram long, kind int, n long")
    kinds = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(2 * FOLDS)]
    counted = store(counted.groupBy("gram").agg(*kinds), "grams")
    size, most = counted.agg(F.count("*"), F.max(F.greatest(*[f"n{k}" for k in range(2 * FOLDS)]))).first()
    grams, n = np.zeros(size, np.uint64), np.zeros((2 * FOLDS, size), np.int32 if (most or 0) < 2**31 else np.int64)
    at = 0
    for part in range(8):  # by and by, so little more than the arrays is held
        got = counted.where(F.pmod(F.xxhash64("gram"), F.lit(8)) == part).toArrow()
        to = slice(at, at + got.num_rows)
        grams[to] = got.column(0).to_numpy().view(np.uint64)
        for k in range(2 * FOLDS):
            n[k, to] = got.column(1 + k).to_numpy()
        at += got.num_rows
        del got
    order = np.argsort(grams)
    for k in range(2 * FOLDS):
        n[k] = n[k][order]
    return grams[order], n.reshape(2, FOLDS, size)


def curve_sample(ids: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Of `labelled_ids` those for the curve: at most `rows` of each class, the first by a hash of the id."""
    parts = [ids.where(F.col("toxic") == c).orderBy("_order", "doc_id", "_own").limit(rows) for c in (0, 1)]
    return parts[0].unionByName(parts[1])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Models on all labelled texts; the curve on features that models without the text's fold give a sample of them.

    The sample has the classes in other shares than the labels, for which the curve is corrected.
    """
    ids, prior = labelled_ids(docs, labels)
    labelled = labelled_texts(docs, ids)
    grams, n = gram_counts(labelled)
    everything = n.sum(1, dtype=np.int64)
    if not len(grams):
        return Model(evidence(grams, everything), np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES + 1))
    sample = store(labelled_texts(docs, store(curve_sample(ids), "sample_ids")), "sample")
    x, toxic = [np.zeros((0, FEATURES))], [np.zeros(0, np.int64)]
    for k in range(FOLDS):
        unseen = docs.sparkSession.sparkContext.broadcast(evidence(grams, everything - n[:, k]))
        got = sample.where(F.col("fold") == k).select("toxic", "text").mapInArrow(released(_features(unseen)), "toxic int, x array<double>").toArrow()
        unseen.destroy()
        if got.num_rows:
            x.append(np.array(got.column(1).to_pylist()))
            toxic.append(got.column(0).to_numpy())
    x, toxic = np.concatenate(x), np.concatenate(toxic)
    # the sum over rows must not depend on the order in which tasks end
    order = np.lexsort((*x.T, toxic))
    x, toxic = x[order], toxic[order]
    mean, scale, w = fit_logistic(x, toxic)
    if prior and 0 < toxic.mean() < 1 and 0 < prior < 1:
        odds = lambda p: np.log(p / (1 - p))
        w[-1] += odds(prior) - odds(toxic.mean())
    return Model(evidence(grams, everything), mean, scale, w)


def _features(model):
    def run(batches):
        scorer = Scorer(model.value)
        for batch in batches:
            for b in by_bytes(batch, 1, SLICE_BYTES):
                x = scorer.features(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["toxic", "x"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", carried: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of `docs`: id, score (0 to 1), predicted (1 if the score is 0.5 or more), and the columns `carried`.

    The score depends on the text only. Null and empty texts have the score of a text without
    evidence; copies of a text have the same score; an empty table gives no rows. Without
    usable labels every score is 0.5. A null id is kept. No other column is looked at.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(fit(source, labels))
    rows = docs.select(id_col, text_col, *(c for c in carried if c != text_col))
    kept = [rows.columns.index(c) for c in carried]  # the text goes to Python once, also where it is carried

    def run(batches):
        scorer = Scorer(model.value.evidence)
        for batch in batches:
            for b in by_bytes(batch, 1, SLICE_BYTES):
                score = model.value.probability(scorer.features([t or "" for t in b.column(1).to_pylist()]))
                cols = [b.column(0), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32)), *(b.column(k) for k in kept)]
                yield pa.RecordBatch.from_arrays(cols, names=schema.fieldNames())

    schema = T.StructType([T.StructField(id_col, rows.schema[0].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), *(rows.schema[c] for c in carried)])
    return rows.mapInArrow(released(run), schema)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    out = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    held_out = F.expr("pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0")
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")

"""Quality scores from a sparse rule ensemble, which runs as Spark column expressions.

Boosted shallow trees are grown over the statistics of labelled texts. Each path from a root to a node is a rule, a conjunction of
bounds on statistics; the rules become indicators, and a logistic lasso gives most of them no weight. What is left is compiled into
one Spark expression over the statistics' columns: a sum of weights of the rules that hold, through a logistic curve.

The texts are read once, for their statistics; labels meet these and not the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, discard, released, store, table
from .text_statistics import STATISTICS, measure

#: The bound of the training sample, for each class of distinct texts.
SAMPLE_ROWS = 4000
#: Trees, their depth, the share of rows each is grown on, how much of a tree is added, the least share of rows in a leaf, and cuts tried for a statistic.
TREES, DEPTH, SHARE, SHRINKAGE, LEAF, CUTS = 60, 3, 0.5, 0.15, 0.005, 48
#: Penalties tried, from the one that gives no rule a weight down to its share LEAST_PENALTY; steps for each.
PENALTIES, LEAST_PENALTY, STEPS = 24, 2e-3, 300
#: A text is good with such a score at least.
GOOD = 0.7
#: Bytes of text that are counted together: a task holds some hundred bytes for each.
SLICE_BYTES = 400_000


@dataclass(frozen=True)
class Rule:
    """Bounds of statistics (number, more than, at most) that must all hold."""

    bounds: tuple[tuple[int, float, float], ...]

    def narrowed(self, statistic: int, low: float, high: float) -> Rule:
        known = {s: (a, b) for s, a, b in self.bounds}
        a, b = known.get(statistic, (-np.inf, np.inf))
        known[statistic] = max(a, low), min(b, high)
        return Rule(tuple((s, *known[s]) for s in sorted(known)))

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for s, a, b in self.bounds:
            out &= (x[:, s] > a) & (x[:, s] <= b)
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for s, a, b in self.bounds:
            if a > -np.inf:
                out = out & (F.col(STATISTICS[s]) > F.lit(float(a)))
            if b < np.inf:
                out = out & (F.col(STATISTICS[s]) <= F.lit(float(b)))
        return out


def cuts_of(x: np.ndarray) -> list[np.ndarray]:
    """Values between which each statistic may be cut: middles of neighbouring quantiles."""
    out = []
    for k in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, k], np.linspace(0, 1, CUTS + 1), method="nearest"))
        out.append((q[1:] + q[:-1]) / 2)
    return out


def grow(binned: np.ndarray, cuts: list[np.ndarray], residual: np.ndarray, weight: np.ndarray, least: int) -> tuple[list[Rule], list[tuple[Rule, float]]]:
    """A tree's rules, one for each node below the root, and its leaves with their steps.

    Each cut is the one that lessens the squares of the residuals most.
    """
    rules, leaves = [], []
    todo = [(Rule(()), np.arange(len(binned)), 0)]
    while todo:
        rule, rows, depth = todo.pop()
        best = None
        if depth < DEPTH and len(rows) >= 2 * least:
            total = residual[rows].sum()
            for k, c in enumerate(cuts):
                if len(c):
                    sums = np.cumsum(np.bincount(binned[rows, k], residual[rows], minlength=len(c) + 1))[:-1]
                    n = np.cumsum(np.bincount(binned[rows, k], minlength=len(c) + 1))[:-1]
                    rest = len(rows) - n
                    gain = np.where((n >= least) & (rest >= least), sums**2 / np.maximum(n, 1) + (total - sums) ** 2 / np.maximum(rest, 1), -np.inf)
                    j = int(gain.argmax())
                    if gain[j] > (best[0] if best else total**2 / len(rows) + 1e-9):
                        best = gain[j], k, j
        if best is None:
            leaves.append((rule, float(residual[rows].sum() / (weight[rows].sum() + 1e-3))))
            continue
        _, k, j = best
        left = binned[rows, k] <= j
        for side, low, high in ((left, -np.inf, cuts[k][j]), (~left, cuts[k][j], np.inf)):
            rules.append(rule.narrowed(k, float(low), float(high)))
            todo.append((rules[-1], rows[side], depth + 1))
    return rules, leaves


def boosted_rules(x: np.ndarray, y: np.ndarray, seed: int = 5) -> list[Rule]:
    """The distinct rules of all trees. Rules that hold for the same rows are one: the first."""
    cuts = cuts_of(x)
    binned = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], 1)
    rng = np.random.default_rng(seed)
    f = np.full(len(x), np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    found: dict[bytes, Rule] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        rows = np.sort(rng.permutation(len(x))[: max(2, int(len(x) * SHARE))])
        rules, leaves = grow(binned[rows], cuts, (y - p)[rows], (p * (1 - p))[rows], max(3, int(LEAF * len(x))))
        for leaf, step in leaves:
            f += SHRINKAGE * np.clip(step, -4, 4) * leaf.holds(x)
        for rule in rules:
            holds = rule.holds(x)
            if holds.any() and not holds.all():
                found.setdefault(np.packbits(holds).tobytes(), rule)
    return list(found.values())


def _descend(a: np.ndarray, y: np.ndarray, penalty: float, z: np.ndarray, steps: int) -> np.ndarray:
    """Accelerated proximal steps from `z`; the last column of `a` is the constant, which has no penalty."""
    n, v = len(a), np.ones(a.shape[1]) / np.sqrt(a.shape[1])
    for _ in range(20):  # the largest curvature, by powers
        u = a.T @ (a @ v)
        v = u / max(np.linalg.norm(u), 1e-12)
    pace = 4 * n / max(v @ (a.T @ (a @ v)) * 1.02, 1e-12)
    old, t = z, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ z, -30, 30)))
        new = z - pace * (a.T @ (p - y)) / n
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - pace * penalty, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        z = new + (before - 1) / t * (new - old)
        moved, old = np.abs(new - old).max(), new
        if moved < 1e-5:
            break
    return old


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, start: tuple[np.ndarray, float] | None = None, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and constant that minimise the mean logistic loss plus `penalty` times the sum of the weights' sizes.

    Only rules with a weight, or whose slope exceeds the penalty, are held; the others are looked at again until none exceeds it.
    """
    n, m = r.shape
    w, c = start if start else (np.zeros(m), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))))
    held = w != 0
    while True:
        p = 1 / (1 + np.exp(-np.clip(r @ w + c, -30, 30)))
        steep = np.abs(r.T @ (p - y)) / n > penalty * (1 + 1e-3)
        if not (steep & ~held).any() and held.any():
            return w, c
        held |= steep
        if not held.any():
            return w, c
        z = _descend(np.c_[r[:, held], np.ones(n)], y, penalty, np.append(w[held], c), steps)
        w, c = np.zeros(m), float(z[-1])
        w[held] = z[:-1]


def loss(r: np.ndarray, y: np.ndarray, w: np.ndarray, c: float) -> np.ndarray:
    z = np.clip(r @ w + c, -30, 30)
    return np.log1p(np.exp(z)) - y * z


@dataclass
class Ensemble:
    """Rules with a weight, and the constant."""

    rules: list[Rule]
    weights: np.ndarray
    constant: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.constant)
        for rule, w in zip(self.rules, self.weights, strict=True):
            z += w * rule.holds(x)
        return 1 / (1 + np.exp(-z))

    def column(self) -> Column:
        """The same over columns named by STATISTICS; terms are added in a tree, so the expression stays shallow."""
        terms = [F.lit(float(self.constant))] + [F.when(rule.column(), F.lit(float(w))).otherwise(F.lit(0.0)) for rule, w in zip(self.rules, self.weights, strict=True)]
        while len(terms) > 1:
            terms = [terms[k] + terms[k + 1] if k + 1 < len(terms) else terms[k] for k in range(0, len(terms), 2)]
        return 1 / (1 + F.exp(-terms[0]))


def fit(x: np.ndarray, y: np.ndarray, share: float | None = None) -> Ensemble:
    """The ensemble of rows of statistics with labels 0 and 1, of which every fifth chooses the penalty.

    Of the penalties whose loss on these is within a standard error of the least, the largest is taken. With labels of one kind, or none, no
    rule has a weight. `share` is that of label 1 among all labels, where the rows have another one.
    """
    if not len(y) or y.min() == y.max():
        return Ensemble([], np.zeros(0), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))))
    rules = boosted_rules(x, y.astype(float))
    r = np.stack([rule.holds(x) for rule in rules], 1).astype(float) if rules else np.zeros((len(y), 0))
    asked = np.arange(len(y)) % 5 == 0
    if rules and len(set(y[~asked])) > 1:
        top = np.abs(r[~asked].T @ (y[~asked] - y[~asked].mean())).max() / (~asked).sum()
        tried, state = [], None
        for penalty in np.geomspace(top, top * LEAST_PENALTY, PENALTIES):
            state = lasso(r[~asked], y[~asked], penalty, state)
            each = loss(r[asked], y[asked], *state)
            tried.append((float(penalty), each.mean(), each.std() / np.sqrt(len(each))))
        low = min(tried, key=lambda t: t[1])
        penalty = next(t[0] for t in tried if t[1] <= low[1] + low[2])
        w, c = lasso(r, y, penalty, state)
    else:
        w, c = np.zeros(len(rules)), float(np.log(y.mean() / (1 - y.mean())))
    if share is not None and 0 < share < 1:
        odds = lambda p: np.log(p / (1 - p))
        c += float(odds(share) - odds(y.mean()))
    used = np.flatnonzero(w)
    return Ensemble([rules[k] for k in used], w[used], c)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, own, one column for each of STATISTICS) of each row; `own` is a hash of the text. Null texts are empty."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("own", F.xxhash64("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("own", T.LongType()), *(T.StructField(s, T.DoubleType()) for s in STATISTICS)])

    def run(batches):
        for batch in batches:
            for b in by_bytes(batch, 1, SLICE_BYTES):
                x = measure(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(np.ascontiguousarray(c)) for c in x.T)], names=schema.fieldNames())

    return rows.mapInArrow(released(run), schema)


def training_sample(counted: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray, float | None]:
    """Statistics and labels of at most `rows` distinct texts of each label, the first by a hash, and the share of label 1 among all labelled texts.

    Only labels 0 and 1 of ids whose crc32 mod 4 is not 2 are used. An id or a text with both labels counts as what it has more of (of as many: 1).
    """
    usable = labels.where("quality in (0, 1) and doc_id is not null and pmod(crc32(cast(cast(doc_id as string) as binary)), 4) != 2")
    usable = usable.groupBy("doc_id").agg(F.avg("quality").alias("_quality"))
    labelled = counted.join(usable, "doc_id").groupBy("own").agg(F.avg("_quality").alias("_quality"), *(F.first(s).alias(s) for s in STATISTICS))
    labelled = store(labelled.withColumn("_quality", (F.col("_quality") >= 0.5).cast("int")), "labelled")
    share = labelled.agg(F.avg("_quality")).first()[0]
    parts = [labelled.where(F.col("_quality") == c).orderBy(F.xxhash64("own"), "own").limit(rows) for c in (0, 1)]
    got = parts[0].unionByName(parts[1]).orderBy(F.xxhash64("own"), "own").toPandas()
    discard(labelled)
    return got[list(STATISTICS)].to_numpy(float), got["_quality"].to_numpy(int), share


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", good: float = GOOD) -> DataFrame:
    """One row for each row of `docs`: doc_id, score (0 to 1), predicted (1 if the score is `good` or more).

    The score depends on the text only. Null and empty texts have the score of statistics that are all 0; copies of a text have the same
    score; null ids are kept; an empty table gives no rows. Without usable labels every score is 0.5. No other column is looked at.
    """
    counted = store(statistics(docs, id_col, text_col), "statistics")
    model = fit(*training_sample(counted, labels))
    return counted.select("doc_id", model.column().alias("score")).select("doc_id", "score", (F.col("score") >= good).cast("int").alias("predicted"))


def op11_quality(spark, sf_dir: str) -> DataFrame:
    out = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.expr("pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2").alias("held_out"), "score", "predicted")

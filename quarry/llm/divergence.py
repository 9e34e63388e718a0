"""Which sources of a language use its terms differently, and by which terms each stands out.

A lookup table over the joined UTF-8 bytes of many texts finds where terms begin and end; no text is decoded. xxhash groups
the slices, and each slice is compared byte for byte with the first of its group, so a collision cannot merge two terms.
Counts of (language, source, term) are summed by Spark.

Blocks of terms then become CSR matrices (rows are terms, columns are sources). The divergence of two sources is a sum over
all kept terms, also those that neither has; it is taken apart so that only terms that both have are looked at together:

    sum over all terms = sum over terms of both (f(a, b) - f(a, 0) - f(0, b) + f(0, 0))
                       + sum over terms of a f(a, 0) + sum over terms of b f(0, b) + (V - |a| - |b|) f(0, 0)

The first sum is made by `reduceat` over the pairs of entries of a block's rows, the others from how many terms have which count.
All arithmetic is in whole numbers.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, discard, store, table

#: Documents of a language that a kept term is in, at least; what is added to each count; the sum of probabilities; how many terms a group shows.
LEAST_DOCUMENTS, ADDED, SCALE, SHOWN = 10, 2, 1_000_000_000, 10
#: Bytes of text that are cut into terms together.
SLICE_BYTES = 6_000_000
#: Rows (source, term) of a block, on average, and pairs of them that are held at a time.
BLOCK_ROWS, PAIRS = 25_000, 500_000
#: As many sources are broadcast at most (about 16 MB); beyond that they are joined by a shuffle.
MOST_BROADCAST = 100_000

#: What each byte counts as: 0 parts terms, A-Z are a-z, all other bytes of letters are themselves.
_LOWER = np.zeros(256, np.uint8)
_LOWER[128:] = np.arange(128, 256)
_LOWER[list(string.ascii_lowercase.encode())] = _LOWER[list(string.ascii_uppercase.encode())] = list(string.ascii_lowercase.encode())


def cut_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The lowered bytes, and where each term begins, ends, and in which row it is; row i has the bytes offsets[i] to offsets[i + 1]."""
    low = _LOWER[data]
    inside = low != 0
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    border[0] = border[-1] = True
    before = np.append(False, inside[:-1]) if len(data) else inside
    after = np.append(inside[1:], False) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | border[:-1]))
    ends = np.flatnonzero(inside & (~after | border[1:])) + 1
    return low.tobytes(), starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def group_terms(low: bytes, starts: np.ndarray, ends: np.ndarray, digest: Callable = xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """A code for each slice, equal where the bytes are equal, and a slice for each code.

    Slices of one digest are compared with the first of them; those that differ get codes by their bytes.
    """
    bounds = zip(starts.tolist(), ends.tolist(), strict=True)
    digests = np.fromiter((digest(low[s:e]) for s, e in bounds), np.uint64, len(starts))
    _, first, code = np.unique(digests, return_index=True, return_inverse=True)
    size = ends - starts
    other = first[code]
    wrong = size != size[other]
    same = np.flatnonzero(~wrong)
    if len(same):
        n = size[same]
        begin = np.cumsum(n) - n
        within = np.arange(n.sum()) - np.repeat(begin, n)
        raw = np.frombuffer(low, np.uint8)
        differs = raw[np.repeat(starts[same], n) + within] != raw[np.repeat(starts[other[same]], n) + within]
        wrong[same] = np.logical_or.reduceat(differs, begin)
    if wrong.any():
        first, codes = first.tolist(), {}
        for i in np.flatnonzero(wrong).tolist():
            term = low[starts[i] : ends[i]]
            if term not in codes:
                codes[term] = len(first)
                first.append(i)
            code[i] = codes[term]
    return code, np.asarray(first, np.int64)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The joined bytes of a text column without nulls, and where its rows begin in them."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def count_terms(batch: pa.RecordBatch, digest: Callable = xxhash.xxh3_64_intdigest) -> pa.RecordBatch:
    """(lang, source, term, n, docs) of a batch (lang, source, text); a row with an empty term says that the group occurs."""
    lang, source, text = (pc.fill_null(c, "") for c in batch.columns)
    lang, source = lang.dictionary_encode(), source.dictionary_encode()
    width = len(source.dictionary)
    group = lang.indices.to_numpy().astype(np.int64) * width + source.indices.to_numpy()
    data, offsets = _bytes_of(text)
    low, starts, ends, row = cut_terms(data, offsets)
    code, first = group_terms(low, starts, ends, digest)
    # occurrences in a row first, then rows of a group
    kinds = max(1, len(first))
    in_row, n = np.unique(row * kinds + code, return_counts=True)
    key = group[in_row // kinds] * kinds + in_row % kinds
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(n, begin) if len(key) else np.zeros(0, np.int64)
    docs = np.diff(np.append(begin, len(key)))
    there = np.unique(group)
    owner = np.concatenate([key[begin] // kinds, there])
    terms = pa.array([*(low[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)), b""], pa.binary()).cast(pa.string())
    which = np.concatenate([key[begin] % kinds, np.full(len(there), len(first), np.int64)])
    none = np.zeros(len(there), np.int64)
    columns = [lang.dictionary.take(pa.array(owner // width)), source.dictionary.take(pa.array(owner % width)), terms.take(pa.array(which)), pa.array(np.append(total, none)), pa.array(np.append(docs, none))]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def probability(n: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (n + ADDED) / (total + ADDED * kinds)), by long division, so that 64 bits are enough up to 9 * 10^15 occurrences."""
    by = total + ADDED * kinds
    rest, out = n + ADDED, np.zeros_like(n)
    for _ in range(3):  # three digits at a time
        rest = rest * 1000
        out = out * 1000 + rest // by
        rest = rest % by
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _probability(n: str, total: str, kinds: str) -> Column:
    """The same in the plan; null where there are no terms."""
    by = f"nullif({total} + {ADDED} * {kinds}, 0)"
    first = f"(({n} + {ADDED}) * 1000)"
    second = f"(({first} % {by}) * 1000)"
    third = f"(({second} % {by}) * 1000)"
    return F.expr(f"({first} div {by}) * 1000000 + ({second} div {by}) * 1000 + {third} div {by} + 1")


def _divergence(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _pairs(term: np.ndarray, source: np.ndarray, p: np.ndarray, zero: np.ndarray, kinds: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sums for pairs of sources (lower * kinds + higher) over the terms that both have; rows are sorted by term and source.

    `zero` is p of each row's source for a term that it does not have.
    """
    edge = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
    indptr = np.append(edge, len(term))  # of the CSR matrix: its columns are `source`, its values `p`
    last = np.repeat(indptr[1:], np.diff(indptr))
    later = last - np.arange(len(term)) - 1  # entries of the same row that come after this one
    upto = np.cumsum(later)
    at = 0
    while at < len(term):
        past = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, side="right")))
        n = later[at:past]
        i = np.repeat(np.arange(at, past), n)
        at = past
        if not len(i):
            continue
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        f = divergence(p[i], p[j]) - divergence(p[i], zero[j]) - divergence(zero[i], p[j]) + divergence(zero[i], zero[j])
        key = source[i] * kinds + source[j]
        order = np.argsort(key, kind="stable")
        key, f = key[order], f[order]
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        yield key[begin], np.add.reduceat(f, begin)


def compare_block(block: pa.Table) -> pa.Table:
    """What a block of terms of one language says: for pairs of sources their part of the sum over common terms (both ways), and
    for each source its SHOWN most telling terms."""
    term, source = (block[c].combine_chunks().dictionary_encode() for c in ("term", "source"))
    at, of = term.indices.to_numpy().astype(np.int64), source.indices.to_numpy().astype(np.int64)
    order = np.lexsort((of, at))
    at, of = at[order], of[order]
    n, total, n_source, n_lang, kinds = (block[c].to_numpy()[order] for c in ("n", "total", "n_source", "n_lang", "v"))
    p, q = probability(n, n_source, kinds), probability(total, n_lang, kinds)
    names = source.dictionary
    key, value = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, v in _pairs(at, of, p, probability(np.zeros_like(n), n_source, kinds), len(names)):
        key.append(k)
        value.append(v)
    key, value = np.concatenate(key), np.concatenate(value)
    a, b = key // len(names), key % len(names)
    # a block's most telling terms of each source, by value and bytes
    told = np.flatnonzero(p > q)
    f = divergence(p[told], q[told])
    words = pc.array_sort_indices(term.dictionary.cast(pa.binary())).to_numpy()
    place = np.empty(len(words), np.int64)
    place[words] = np.arange(len(words))
    best = np.lexsort((place[at[told]], -f, of[told]))
    told, f = told[best], f[best]
    owner = of[told]
    rank = np.arange(len(told)) - np.searchsorted(owner, owner)
    told, f, owner = told[rank < SHOWN], f[rank < SHOWN], owner[rank < SHOWN]
    sources = names.take(pa.array(np.concatenate([a, b, owner])))
    items = pa.concat_arrays([names.take(pa.array(np.concatenate([b, a]))).cast(pa.string()), term.dictionary.take(pa.array(at[told])).cast(pa.string())])
    parts = pa.array(["pair"] * (2 * len(a)) + ["term"] * len(told), pa.string())
    langs = pa.array([block["lang"][0].as_py()] * len(parts), pa.string())
    return pa.table([langs, sources.cast(pa.string()), parts, items, pa.array(np.concatenate([value, value, f]))], names=["lang", "source", "part", "item", "value"])


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group (lang, source) its distance to every other source of the language
    (part `pair`), and its SHOWN most telling terms (part `term`).

    Null texts, languages and sources are empty ones. A group whose texts have no terms is a group; where a language keeps no term,
    all its distances are 0. A language with one source has no pairs. Each row is a document, also a repeated one. Of equal values the
    smaller item comes first. An empty table gives no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            for b in by_bytes(batch, 2, SLICE_BYTES):
                yield count_terms(b)

    each = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    counted = store(each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counted")
    terms = counted.where("term <> ''")
    kept = store(terms.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs"), "kept")
    known = store(terms.drop("docs").join(kept, ["lang", "term"]), "known")
    by_source = known.groupBy("lang", "source").agg(F.sum("n").alias("n_source"), F.count("*").alias("held"))
    by_lang = kept.groupBy("lang").agg(F.sum("total").alias("n_lang"), F.count("*").alias("v"))
    sources = counted.where("term = ''").select("lang", "source").join(by_source, ["lang", "source"], "left").join(by_lang, "lang", "left").fillna(0)
    sources = store(sources.withColumn("zero", _probability("0L", "n_source", "v")), "sources")
    told = F.broadcast(sources) if sources.count() <= MOST_BROADCAST else sources

    blocks = max(1, known.count() // BLOCK_ROWS)
    dealt = known.join(told.select("lang", "source", "n_source", "n_lang", "v"), ["lang", "source"]).withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int"))
    compared = store(dealt.groupBy("lang", "block").applyInArrow(compare_block, "lang string, source string, part string, item string, value long"), "compared")

    # how far a source's own terms are from those that another source does not have: by how many terms have which count
    other = told.select("lang", F.col("source").alias("item"), F.col("zero").alias("zero_item"), F.col("held").alias("held_item"))
    counts = known.groupBy("lang", "source", "n").agg(F.count("*").alias("m")).join(told.select("lang", "source", "n_source", "v"), ["lang", "source"])
    alone = counts.withColumn("p", _probability("n", "n_source", "v")).join(other, "lang").where("source <> item")
    alone = alone.select("lang", "source", "item", (F.col("m") * _divergence("p", "zero_item")).alias("value"))
    alone = alone.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both_ways = alone.unionByName(alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    neither = sources.join(other, "lang").where("source <> item")
    missing = F.coalesce((F.col("v") - F.col("held") - F.col("held_item")) * _divergence("zero", "zero_item"), F.lit(0).cast("long"))
    every = neither.select("lang", "source", "item", missing.alias("value")).unionByName(both_ways).unionByName(compared.where("part = 'pair'").drop("part"))
    pairs = every.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    in_order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(in_order))
    best = compared.where("part = 'term'").withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= SHOWN)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    out = store(pairs.select(*columns).unionByName(best.select(*columns)), "audit")
    discard(counted, kept, known, sources, compared)
    return out


def op12_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


#: The same with every kept term of every group written out.
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
      regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
t AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
sizes AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.n, 0) + 2 * l.v) AS p,
      1 + (1000000000::HUGEINT * (k.total + 2)) // (l.n + 2 * l.v) AS q
      FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN sizes s USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM (SELECT a.lang, a.source, b.source AS item FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source) LEFT JOIN pairs USING (lang, source, item)
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every) WHERE part = 'pair' OR rank <= 10
"""

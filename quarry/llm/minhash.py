"""Near-duplicate documents: MinHash bands propose pairs, odd sketches sift them, full sets confirm them.

An odd sketch folds a document's bottom-k MinHash sample (its KEPT smallest shingle hashes) into a bitmap of parities.
The exclusive or of two bitmaps is the sketch of what the samples do not share, so its population count gives
the similarity, the more exactly the higher it is; a set of at most KEPT shingles is its own sample, and then
nothing but collisions in the bitmap blurs it. A sketch costs a few words for each document.

Documents with the same set are one class, of which only the one with the smallest id goes on. In a bucket
of a band, every class is paired with the bucket's smallest. Once the confirmed links have been joined
to components, those that stray from the component of their bucket's smallest are held against all others of the bucket
that are in another component, in blocks. A pair within a component needs no test, so no bucket is expanded
into all its pairs, and no two classes that share a bucket and end in different components go untested.
A block tells which of its classes have a likely pair; the full sets of these meet in the block again, where pairs are tested
until its components are joined. It gives the links that join them, so fewer than it has classes, never its pairs.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, discard, mix64, released, store, table
from .components import components

SHINGLE, BANDS, ROWS = 5, 32, 4
SAMPLES = BANDS * ROWS
#: Bits of a sketch, and hashes folded into it.
SKETCH_BITS, KEPT = 1024, 512
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Deviations by which a pair's sketches may differ more than those of a pair just similar enough.
MARGIN = 5.0
#: As many ids are broadcast at most (16 MB); beyond that they are joined by a shuffle.
MOST_BROADCAST = 2_000_000
#: Bytes of text that are shingled together.
SLICE_BYTES = 4_000_000
#: Strays of a bucket that are held against as many members of it at a time, and bytes of their sets, on average, where these meet.
BLOCK, BLOCK_BYTES = 2048, 16_000_000

_rng = np.random.default_rng(20240229)
_MULTIPLY = (_rng.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_PLACE = (_rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_BAND = (_rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The sorted set of 64-bit hashes of a text's word shingles."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    width = min(n, SHINGLE)
    out = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        out += h[k : n - width + 1 + k] * _PLACE[k]
    return np.unique(mix64(out + np.uint64(SHINGLE - width)))


def minhash(s: np.ndarray) -> np.ndarray:
    """SAMPLES minima of a set that is not empty."""
    low = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 2048):
        v = _MULTIPLY[:, None] * low[None, k : k + 2048]
        v += _ADD[:, None]
        np.minimum(out, v.min(1), out=out)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    wide = mix64(m.astype(np.uint64) + np.uint64(1)).reshape(BANDS, ROWS)
    return mix64((wide * _BAND).sum(1) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def odd_sketch(s: np.ndarray) -> np.ndarray:
    bit = s[:KEPT] % np.uint64(SKETCH_BITS)
    return np.packbits((np.bincount(bit.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)).view(np.int64)


def set_keys(s: np.ndarray) -> tuple[int, int]:
    """Two sums over the hashes of a set."""
    return int(s.sum(dtype=np.uint64).view(np.int64)), int(mix64(s ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64).view(np.int64))


def _signatures(rows: DataFrame) -> DataFrame:
    def run(batches):
        for b in (x for batch in batches for x in by_bytes(batch, 1, SLICE_BYTES)):
            n, k1, k2, bands, sketches = [], [], [], [], []
            for text in b.column(1).to_pylist():
                s = shingles(text)
                n.append(len(s))
                for k, x in zip((k1, k2), set_keys(s), strict=True):
                    k.append(x)
                m = minhash(s) if len(s) else None
                bands.append(None if m is None else band_keys(m))
                sketches.append(None if m is None else odd_sketch(s))
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n", "k1", "k2", "bands", "sketch"])

    return rows.mapInArrow(released(run), "id long, n long, k1 long, k2 long, bands array<long>, sketch array<long>")


def _alike(x: Column, y: Column, a: Column, b: Column) -> Column:
    """Whether sketches `x` and `y` of sets of `a` and `b` shingles allow the similarity that a link needs."""
    bits = F.lit(0)
    for k in range(SKETCH_BITS // 64):
        bits += F.bit_count(x[k].bitwiseXOR(y[k]))
    a, b = a.cast("double"), b.cast("double")
    n = float(SKETCH_BITS)
    shared = (a + b) * (PERCENT / (100.0 + PERCENT))  # of the full sets, at least
    larger = F.greatest(a, b)
    share, taken = shared / larger, F.least(F.lit(1.0), KEPT / larger)
    kept = F.least(a, F.lit(float(KEPT))) + F.least(b, F.lit(float(KEPT)))
    apart = kept - 2 * shared * taken  # of the samples, on average at most
    drawn = 4 * larger * taken * share * F.greatest(1 - share, F.lit(0.0)) * (1 - taken)  # variance by sampling
    gone = F.exp(apart * -2 / n)
    folded = n / 4 * (1 - F.exp(apart * float(np.log1p(-4 / n)))) + n * n / 4 * (F.exp(apart * float(np.log1p(-4 / n))) - F.exp(apart * (2 * float(np.log1p(-2 / n)))))
    most = n / 2 * (1 - gone) + MARGIN * F.sqrt(F.greatest(folded, F.lit(0.0)) + gone * gone * drawn) + 3
    most = F.when(larger <= KEPT, F.least(most, apart)).otherwise(most)  # a bitmap of whole sets has no more bits than these differ by
    return (shared <= F.least(a, b)) & (bits <= most)


def _most_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By how many bits sketches of sets of `a` and `b` shingles may differ, as `_alike` has it; -1 where the sizes rule a link out."""
    n = float(SKETCH_BITS)
    a, b = a.astype(float), b.astype(float)
    shared = (a + b) * (PERCENT / (100.0 + PERCENT))
    larger = np.maximum(a, b)
    share, taken = shared / larger, np.minimum(1.0, KEPT / larger)
    apart = np.minimum(a, KEPT) + np.minimum(b, KEPT) - 2 * shared * taken
    drawn = 4 * larger * taken * share * np.maximum(1 - share, 0.0) * (1 - taken)
    gone = np.exp(apart * -2 / n)
    once = np.exp(apart * np.log1p(-4 / n))
    folded = n / 4 * (1 - once) + n * n / 4 * (once - np.exp(apart * (2 * np.log1p(-2 / n))))
    most = n / 2 * (1 - gone) + MARGIN * np.sqrt(np.maximum(folded, 0.0) + gone * gone * drawn) + 3
    most = np.where(larger <= KEPT, np.minimum(most, apart), most)
    return np.where(shared <= np.minimum(a, b), np.floor(most), -1)


def _likely(at: tuple, left: pa.Table, right: pa.Table):
    """For each of a block of strays that has some: its place, and those of the members that are of another component and have a sketch like its own, the likest first.

    A pair is given at the first of the buckets that it shares, and once where both stray.
    """
    if not left.num_rows or not right.num_rows:
        return
    x, y = (np.stack(t["sketch"].to_pylist()).astype(np.int64).view(np.uint64) for t in (left, right))
    rep, other, again = left["rep"].to_numpy(), right["rep"].to_numpy(), right["strays"].to_numpy()
    component, of_other = left["component"].to_numpy(), right["component"].to_numpy()
    bands, other_bands = (np.stack(t["bands"].to_pylist()).astype(np.int64) for t in (left, right))
    kinds, n = np.unique(left["n"].to_numpy(), return_inverse=True)
    other_kinds, m = np.unique(right["n"].to_numpy(), return_inverse=True)
    for k in range(0, len(x), 256):
        bits = np.zeros((len(x[k : k + 256]), len(y)), np.uint16)
        for w in range(x.shape[1]):
            bits += np.bitwise_count(x[k : k + 256, w, None] ^ y[None, :, w])
        most = _most_bits(kinds[:, None], other_kinds[None])[n[k : k + 256, None], m[None]] if len(kinds) * len(other_kinds) <= bits.size else _most_bits(kinds[n[k : k + 256]][:, None], other_kinds[m][None])
        alike = (bits <= most) & (component[k : k + 256, None] != of_other[None]) & ~(again[None] & (other[None] < rep[k : k + 256, None]))
        for i in np.nonzero(alike.any(1))[0]:
            to = np.nonzero(alike[i])[0]
            to = to[bands[k + i, (bands[k + i] == other_bands[to]).argmax(1)] == at[0].as_py()]
            if len(to):
                yield k + i, to[np.argsort(bits[i, to], kind="stable")]


def _involved(at: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """The strays and the members of a block that are in likely pairs, and which of the two each is."""
    strays, members = np.zeros(left.num_rows, bool), np.zeros(right.num_rows, bool)
    for i, to in _likely(at, left, right):
        strays[i] = members[to] = True
    names = ["key", "rep", "component", "strays"]
    out = [t.select(names).filter(pa.array(some)) for t, some in ((left, strays), (right, members)) if some.any()]
    held = [np.concatenate([t[c].to_numpy() for t in out] or [np.zeros(0, bool if c == "strays" else np.int64)]) for c in names]
    return pa.table([pa.array(x) for x in (*held, np.repeat([True, False], [strays.sum(), members.sum()]))], names=[*names, "left"])


def _similar(s: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of the other sets are linked with `s`; none is empty."""
    sizes = np.fromiter(map(len, others), np.int64, len(others))
    every = np.concatenate(others)
    both = np.add.reduceat(s[np.minimum(np.searchsorted(s, every), len(s) - 1)] == every, np.cumsum(sizes) - sizes, dtype=np.int64)
    return 100 * both >= PERCENT * (len(s) + sizes - both)


def _joining(at: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Links (a < b) that join the components of a block as far as its likely pairs do, tested on full sets."""
    if not left.num_rows or not right.num_rows:
        return pa.table([pa.array([], pa.int64())] * 2, names=["a", "b"])
    rep, other = left["rep"].to_numpy(), right["rep"].to_numpy()
    component, of_other = left["component"].to_numpy().copy(), right["component"].to_numpy().copy()
    sets, other_sets = ([np.frombuffer(v.as_buffer(), np.uint64) for v in t["s"]] for t in (left, right))
    found = []
    for i, to in _likely(at, left, right):
        taken = 1
        while len(to := to[of_other[to] != component[i]]):
            now, to = to[:taken], to[taken:]
            for j in now[_similar(sets[i], [other_sets[j] for j in now])]:
                if (joined := of_other[j]) != component[i]:
                    found.append(sorted((int(rep[i]), int(other[j]))))
                    component[component == joined] = of_other[of_other == joined] = component[i]
            taken = min(2 * taken, 256)
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _met(rows: DataFrame, of_left: Column, of_right: Column, columns: list[str], run, schema: str) -> DataFrame:
    """Rows of either side of a bucket are dealt into `high` and `wide` blocks; each block of one side meets each of the other in a task of its own."""
    h = F.xxhash64("rep")
    left = rows.where(of_left).select(F.pmod(h, "high").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("wide") - 1)).alias("j"), *columns)
    again = [F.col(c).alias(c) for c in columns]  # columns of their own, as both sides are of one table
    right = rows.where(of_right).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("high") - 1)).alias("i"), F.pmod(h, "wide").alias("j"), *again)
    at = ["key", "i", "j"]
    return left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(run, schema)


def _sets(rows: DataFrame) -> DataFrame:
    """id, k1, k2 and the set of each row."""

    def run(batches):
        for batch in batches:
            for b in by_bytes(batch, 1, SLICE_BYTES):
                found = [shingles(t) for t in b.column(1).to_pylist()]
                k1, k2 = zip(*map(set_keys, found), strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["id", "k1", "k2", "s"])

    return rows.mapInArrow(released(run), "id long, k1 long, k2 long, s binary").dropDuplicates(["id", "k1", "k2"])


def _among(rows: DataFrame, needed: DataFrame) -> DataFrame:
    """Rows with one of the stored ids."""
    return rows.join(F.broadcast(needed) if needed.count() <= MOST_BROADCAST else needed, "id", "left_semi")


def _confirmed(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""

    def check(batches):
        for b in batches:
            keep = []
            for k, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):  # read where they are, not copied
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(s), len(t)) >= PERCENT * max(len(s), len(t)):
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    if 100 * both >= PERCENT * (len(s) + len(t) - both):
                        keep.append(k)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).take(pa.array(keep, pa.int64()))

    pairs = store(pairs, "pairs")
    ids = store(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "needed")
    # an id that several texts share brings the set of each, and is linked by any of them
    held = store(_sets(_among(rows, ids)).select("id", "s"), "sets")
    with_a = pairs.join(held.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    full = with_a.join(held.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b").select("a", "b", "sa", "sb")
    confirmed = store(full.mapInArrow(released(check), "a long, b long"), "confirmed")
    discard(pairs, ids, held)
    return confirmed


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: id, n_shingles, class_id, component_id, kept.

    Null and empty texts have an empty set and are linked with nothing; so have rows with a null id,
    which keep a null class and component and stay. A repeated id and text gives the same row again; one id with several texts
    is one document of the links: whatever is like one of them is linked with it, and all its rows have one component. Sets are held as 64-bit hashes of their shingles, and
    are equal if size and two 64-bit sums over these agree. An empty table gives no rows; other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = store(_signatures(rows), "signatures")
    linked = signed.where("n > 0 and id is not null")
    classes_stored = store(linked.groupBy("k1", "k2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).where("copies > 1"), "classes")
    classes = classes_stored.select("k1", "k2", "n", "rep")
    members = store(signed.select("id", "n", "k1", "k2").join(classes, ["k1", "k2", "n"], "left").select("id", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("rep", "id")).otherwise(F.col("id")).alias("rep")), "members")
    reps = signed.join(classes, ["k1", "k2", "n"], "left").where("n > 0 and id is not null")
    chosen = reps.where("rep = id").dropDuplicates(["id", "k1", "k2", "n"])
    sketches = store(reps.where("rep is null").unionByName(chosen).select("id", "n", "k1", "k2", "sketch", "bands"), "sketches")
    # an id whose texts are of several classes is one document, which links these
    several = members.where("id is not null").groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where("a != last").select("id", "a")
    shared = store(members.join(several, "id").where("rep != a").select("a", F.col("rep").alias("b")).distinct(), "shared")
    discard(signed, classes_stored)

    banded = sketches.select(F.explode("bands").alias("key"), F.col("id").alias("rep"))
    buckets = banded.groupBy("key").agg(F.min("rep").alias("center"), F.max("rep").alias("last")).where("center != last").select("key", "center")
    hits = store(banded.join(buckets, "key"), "hits")

    def sketch_of(name: str) -> DataFrame:
        return sketches.select(F.col("id").alias(name), F.col("sketch").alias(f"sketch_{name}"), F.col("n").alias(f"n_{name}"))

    stars = hits.where("rep != center").select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct()
    sifted = stars.join(sketch_of("b"), "b").join(sketch_of("a"), "a").where(_alike(*map(F.col, ("sketch_a", "sketch_b", "n_a", "n_b")))).select("a", "b")
    links = _confirmed(sifted, rows).unionByName(shared)
    labels = components(links)

    label_of = lambda name: labels.select(F.col("node").alias(name), F.col("component").alias(f"label_{name}"))
    placed = hits.join(label_of("rep"), "rep", "left").join(label_of("center"), "center", "left").select("key", "rep", F.coalesce("label_rep", "rep").alias("component"), (F.coalesce("label_rep", "rep") != F.coalesce("label_center", "center")).alias("strays"))
    placed = store(placed, "placed")
    discard(hits)
    told = sketches.select(F.col("id").alias("rep"), "sketch", "bands", "n")
    # strays and all members of their buckets meet in blocks
    sizes = placed.groupBy("key").agg(F.ceil(F.count_if("strays") / BLOCK).alias("high"), F.ceil(F.count("*") / BLOCK).alias("wide")).where("high > 0")
    columns = ["key", "rep", "component", "strays", "sketch", "bands", "n"]
    members_of = placed.join(sizes, "key").join(told, "rep")
    involved = _met(members_of, F.col("strays"), F.lit(True), columns, _involved, "key long, rep long, component long, strays boolean, left boolean")
    involved = store(involved.distinct(), "involved")
    if not involved.isEmpty():
        ids = store(involved.select(F.col("rep").alias("id")).distinct(), "needed")
        # of an id that several texts share, the sets that stand for a class; `shared` links the others
        held = store(_sets(_among(rows, ids)).join(sketches, ["id", "k1", "k2"]).select(F.col("id").alias("rep"), "n", "sketch", "bands", "s"), "sets")
        again = involved.join(held, "rep")
        blocks = lambda side: F.ceil(F.greatest(F.count_if(side) / BLOCK, F.sum(F.when(side, 8 * F.col("n"))) / BLOCK_BYTES))
        sizes = again.groupBy("key").agg(blocks(F.col("left")).alias("high"), blocks(~F.col("left")).alias("wide"))
        crossing = store(_met(again.join(sizes, "key"), F.col("left"), ~F.col("left"), [*columns, "s"], _joining, "a long, b long").distinct(), "crossing")
        discard(ids, held)
        if not crossing.isEmpty():
            labels = components(links.unionByName(crossing))

    out = members.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
    component = F.coalesce("component", "rep")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("rep").alias("class_id"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op1_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Every pair of texts that share a shingle, counted in full; and what can be reached over links.
OP1_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
      ELSE list_sort(list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')))) END AS g FROM w),
c AS (SELECT doc_id, len(g)::BIGINT AS n, CASE WHEN len(g) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY g) END AS class_id, g FROM s),
e AS (SELECT doc_id, n, unnest(g) AS x FROM c WHERE class_id = doc_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
two_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM two_ways UNION SELECT r.a, t.b FROM reach r JOIN two_ways t ON r.b = t.a),
component AS (SELECT a AS class_id, least(a, min(b)) AS component_id FROM reach GROUP BY a)
SELECT doc_id, n AS n_shingles, class_id, coalesce(component_id, class_id) AS component_id, doc_id = coalesce(component_id, class_id) AS kept
FROM c LEFT JOIN component USING (class_id)
"""

"""Near-duplicate detection by b-bit MinHash.

Signatures keep the low ``BITS`` bits of ``BANDS * ROWS`` minima, packed; band keys come from the whole minima.  Documents
with equal shingle sets form a class, and only one row of it goes on.  Candidate pairs are scored by bit counts,
corrected for chance collisions, and those within ERRORS standard errors of the threshold are confirmed on full sets.

A bucket is never expanded into all its pairs: its rows are first held against two pivots; what that joins is contracted,
and only rows of different components still meet, in bounded blocks that are dealt to tasks by salt.

Nulls and texts without words have empty sets, are linked with nothing and stand for themselves.  Rows go by a number of their
own: rows that share an id are one vertex, linked with whatever any of their texts is near to.  A null id is no vertex: its row
comes back with a null component and is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.textcore import U, Words, cut, mix, pieces, stream
from engram.llm.workspace import Workspace, attach_min, components, dealt, fetched

BANDS, ROWS, BITS = 40, 6, 4
BLOCK = 128
#: Blocks of a bucket that one task holds against each other block.
SPAN = 32
SKETCH = 1024
#: A pair is turned down by an estimate only if that is so many standard errors below the threshold: a chance of 4e-11 for a
#: pair at the threshold, far less than that of no shared band.
ERRORS = 6.5
_MUL = stream(101, BANDS * ROWS) | U(1)
_ADD = stream(103, BANDS * ROWS)
_SEEDS = stream(107, BANDS)
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def shingle_sets(w: Words, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each document; with fewer words than ``size`` the whole sequence is the one shingle."""
    grams, _ = w.grams(size)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(grams[a : b - size + 1])
        elif b > a:
            yield w.range_hash(np.array([a]), np.array([b]))
        else:
            yield np.zeros(0, U)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function, 32 bits each."""
    low = np.full(BANDS * ROWS, ~U(0))
    for i in range(0, len(shingles), 512):
        np.minimum(low, (_MUL[:, None] * shingles[None, i : i + 512] + _ADD[:, None]).min(axis=1), out=low)
    return low >> U(32)


def pack(low: np.ndarray) -> bytes:
    kept = (low & U((1 << BITS) - 1)).astype(np.uint8)
    return (kept[0::2] << 4 | kept[1::2]).tobytes()


def band_keys(low: np.ndarray) -> np.ndarray:
    keys = _SEEDS.copy()
    for column in low.reshape(BANDS, ROWS).T:
        keys = mix(keys ^ column)
    return keys.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard of packed signatures (last axis: bytes): share of equal fields, less the share that chance gives."""
    x = a ^ b
    different = ((x & 0xF0) != 0).sum(axis=-1, dtype=np.int32) + ((x & 0x0F) != 0).sum(axis=-1, dtype=np.int32)
    chance = 0.5**BITS
    return (1 - different / (BANDS * ROWS) - chance) / (1 - chance)


def cutoff(threshold: float) -> float:
    """ERRORS standard errors of the estimate below the threshold."""
    return threshold - ERRORS * (threshold * (1 - threshold) / (BANDS * ROWS)) ** 0.5 / (1 - 0.5**BITS)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, set_key, sig, bands for (doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            ids, hashes, texts = batch.columns
            for low, high, buf, bounds in pieces(texts):
                out, seen = [], {}
                for s in shingle_sets(cut(buf, bounds, lower=True), size):
                    if not len(s):
                        out.append((0, None, None, None))
                        continue
                    key = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    if key not in seen:
                        m = minima(s)
                        seen[key] = (len(s), key, pack(m), band_keys(m))
                    out.append(seen[key])
                yield pa.record_batch([ids.slice(low, high - low), hashes.slice(low, high - low), *[pa.array(x, t.type) for x, t in zip(zip(*out, strict=True), list(schema)[2:], strict=True)]], schema=schema)

    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    return keyed.mapInArrow(run, "doc_id long, th long, n_shingles long, set_key binary, sig binary, bands array<long>")


def _sets(rows: DataFrame, size: int) -> DataFrame:
    """uid, shingles for (uid, text)."""
    schema = pa.schema([("uid", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for low, high, buf, bounds in pieces(batch.column(1)):
                sets = [s.view(np.int64) for s in shingle_sets(cut(buf, bounds, lower=True), size)]
                yield pa.record_batch([batch.column(0).slice(low, high - low), pa.array(sets, schema[1].type)], schema=schema)

    return rows.mapInArrow(run, "uid long, shingles array<long>")


def _estimated(pairs: DataFrame, cards: DataFrame, percent: int) -> DataFrame:
    """Of dealt pairs (a, b), those whose sizes and bit counts allow the similarity."""
    least = cutoff(percent / 100)
    x, y = (cards.select(F.col("uid").alias(k), F.col("n_shingles").alias(f"n{k}"), F.col("sig").alias(f"s{k}")) for k in "ab")
    sized = fetched(fetched(pairs, pairs, "a", x), pairs, "b", y).filter(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")

    def run(batches):
        for t in batches:
            if t.num_rows:
                a, b = (np.frombuffer(b"".join(t.column(i).to_pylist()), np.uint8).reshape(t.num_rows, -1) for i in (2, 3))
                keep = pa.array(similarity(a, b) >= least)
                yield pa.RecordBatch.from_arrays([t.column(0).filter(keep), t.column(1).filter(keep)], names=["a", "b"])

    return sized.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _confirmed(ws: Workspace, pairs: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """Those of the pairs (a, b) whose full sets reach the similarity."""
    pairs = dealt(ws, pairs, name, "a", "b")
    x, y = (sets.select(F.col("uid").alias(k), F.col("shingles").alias(f"s{k}")) for k in "ab")
    both = fetched(fetched(pairs, pairs, "a", x), pairs, "b", y).select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("shared"))
    return both.filter(f"100 * shared >= {percent} * (na + nb - shared)").select("a", "b")


def _sketched(a: np.ndarray, n: int, others: list[np.ndarray], sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether the sketches of a document of n shingles and of others allow the similarity; exact where neither is cut off."""
    far = np.int64(1) << 62
    end = np.minimum(a[-1] if n > SKETCH else far, np.where(sizes > SKETCH, [x[-1] for x in others], far))
    flat, owner = np.concatenate(others), np.repeat(np.arange(len(others)), [len(x) for x in others])
    at = np.searchsorted(a, flat)
    inside = flat <= end[owner]
    equal = inside & (a[np.minimum(at, len(a) - 1)] == flat)
    shared = np.bincount(owner[equal], minlength=len(others))
    union = np.bincount(owner[inside], minlength=len(others)) + np.searchsorted(a, end, "right") - shared
    slack = np.where(end < far, 100 * ERRORS * np.sqrt(percent / 100 * (1 - percent / 100) / np.maximum(union, 1)), 0)
    return 100 * shared >= (percent - slack) * union


def _crossing(rows: DataFrame, percent: int, best: bool) -> DataFrame:
    """Pairs of one bucket and different components that the estimate admits; best: for each row only the best of a block.

    rows: key, uid, component, n_shingles, sig, least, group_rows, low (the bucket's first component).  Rows outside that
    component meet all others in blocks of about BLOCK rows, and SPAN blocks of the others in a task.  ``least`` holds the
    SKETCH smallest shingles (31 bits of each): all of them for most documents, so that hardly any pair is emitted that the
    confirmation then turns down.
    """
    least = cutoff(percent / 100)
    blocks = F.ceil(F.col("group_rows") / BLOCK)
    spans = F.ceil(blocks / SPAN).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("uid"), blocks).cast("int")).withColumn("spans", spans)
    packed = F.collect_list(F.struct("uid", "component", "n_shingles", "sig", "least"))
    few = rows.filter("component <> low").groupBy("key", "block").agg(packed.alias("few"), F.first("spans").alias("spans"))
    few = few.select("key", "few", F.explode(F.sequence(F.lit(0), F.col("spans") - 1)).alias("span"))
    many = rows.groupBy("key", "block").agg(packed.alias("many"), F.first("spans").alias("spans"))
    many = many.select("key", "many", F.pmod("block", "spans").alias("span"))

    def columns(x):
        return (np.asarray(x.field(i)) for i in range(3)), np.frombuffer(b"".join(x.field(3).to_pylist()), np.uint8).reshape(len(x), -1), [np.asarray(v) for v in (x.field(4)[i].values for i in range(len(x)))]

    def run(batches):
        for t in batches:
            found = set()
            for i in range(t.num_rows):
                (d, c, n), s, f = columns(t.column(0)[i].values)
                (e, k, m), r, g = columns(t.column(1)[i].values)
                fit = (c[:, None] != k[None]) & (100 * np.minimum(n[:, None], m[None]) >= percent * np.maximum(n[:, None], m[None]))
                p, q = np.nonzero(fit)
                if len(p):
                    score = similarity(s[p], r[q])
                    ok = score >= least
                    for a in np.unique(p[ok]).tolist():
                        own = np.flatnonzero(ok & (p == a))
                        ok[own] = _sketched(f[a], int(n[a]), [g[j] for j in q[own]], m[q[own]], percent)
                    if best:
                        order = np.lexsort((-score, p))
                        ok[order[np.flatnonzero(p[order][1:] == p[order][:-1]) + 1]] = False
                    x, y = d[p[ok]], e[q[ok]]
                    found.update(zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist(), strict=True))
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return few.join(many, ["key", "span"]).select("few", "many").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: components of documents linked at Jaccard >= percent / 100.

    docs needs doc_id and text; other columns are ignored.  Each row of docs gives a row.
    """
    ws = Workspace(spark, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    feats = ws.table(signatures(docs, shingle_words).withColumn("uid", F.monotonically_increasing_id()), "features")
    # The row of a class that goes on has the smallest id; ids are nodes' names at the end only.
    first = attach_min(feats.filter("doc_id is not null").select("uid", "doc_id", "n_shingles", "set_key"), "set_key", "uid", {"first": F.struct("doc_id", "uid")})
    classed = ws.table(first.select("uid", "doc_id", "n_shingles", F.coalesce("first.uid", "uid").alias("rep")), "classes")
    cards = ws.table(feats.filter("n_shingles > 0").join(classed.filter("uid = rep").select("uid"), "uid", "left_semi"), "cards")
    nameless = ws.table(feats.filter("doc_id is null").select("doc_id", "n_shingles"), "nameless")
    ws.drop("features")

    banded = cards.select("uid", F.explode("bands").alias("key"))
    pivots = attach_min(banded, "key", "uid", {"p": F.col("uid"), "q": F.struct(F.xxhash64("uid").alias("h"), F.col("uid").alias("d"))}).filter("group_rows > 1")
    buckets = ws.table(pivots.select("key", "uid", "group_rows", "p", F.col("q.d").alias("q")), "buckets")
    pairs = buckets.select("uid", F.explode(F.array("p", "q")).alias("x")).filter("uid <> x").select(F.least("uid", "x").alias("a"), F.greatest("uid", "x").alias("b")).distinct()
    slim = cards.select("uid", "n_shingles", "sig")
    tried = ws.table(_estimated(dealt(ws, pairs, "met", "a", "b"), slim, percent), "pairs")
    # A row's text is read again by its id and hash.  The hint keeps one plan at every size: without it, small inputs are
    # broadcast and large ones are not.
    known = cards.select("doc_id", "th", "uid").join(buckets.select("uid").distinct(), "uid", "left_semi")
    met = docs.withColumn("th", F.xxhash64("text")).join(known.hint("merge"), ["doc_id", "th"]).dropDuplicates(["doc_id", "th"])
    sets = ws.table(_sets(met.select("uid", "text"), shingle_words), "sets")
    named = attach_min(classed.filter("n_shingles > 0"), "doc_id", "uid", {"one": F.col("rep")}).filter("one <> rep").select(F.col("one").alias("a"), F.col("rep").alias("b")).distinct()
    links = ws.table(_confirmed(ws, tried, sets, percent, "first").unionByName(named), "links")
    ws.release()
    found = components(ws, links, "components-0")
    # Once with the best partners only, which joins most of what belongs together; then with all that are still apart.
    mixed = None
    for turn, best in ((1, True), (2, False)):
        if mixed is None:
            ws.release()
            labelled = buckets.select("key", "uid").join(found.withColumnRenamed("id", "uid"), "uid", "left").withColumn("component", F.coalesce("component", "uid"))
            mixed = attach_min(labelled, "key", "uid", {"low": F.col("component"), "high": -F.col("component")}).filter("low <> -high").drop("high")
            mixed = ws.table(mixed, f"mixed-{turn}")
        if mixed.isEmpty():
            break
        sketch = sets.select("uid", F.transform(F.slice("shingles", 1, SKETCH), lambda x: F.shiftrightunsigned(x, 33).cast("int")).alias("least"))
        rows = mixed.join(slim, "uid").join(sketch, "uid")
        rest = ws.table(_crossing(rows, percent, best).join(tried, ["a", "b"], "left_anti"), f"pairs-{turn}")
        if rest.isEmpty():
            continue
        more = ws.table(_confirmed(ws, rest, sets, percent, f"more-{turn}"), f"links-{turn}")
        tried = tried.unionByName(rest)
        if more.isEmpty():
            continue
        ws.drop(f"mixed-{turn}")
        mixed = None
        ws.release()
        found = components(ws, found.toDF("a", "b").unionByName(more), f"components-{turn}")
    ws.release()

    joined = classed.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("uid", "doc_id", "n_shingles", F.coalesce("component", "rep").alias("component"))
    named = attach_min(joined, "component", "uid", {"least": F.col("doc_id")}).select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))
    both = named.unionByName(nameless.withColumn("component_id", F.lit(None).cast("long")))
    return both.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))

"""Benchmark decontamination by greedy string tiling.

Test items are the patterns.  Seeds of SEED words (items with fewer words: all their words) that a document shares with an item
bring the two together; tiles are then the longest common runs of words that no tile holds yet, found with running
Karp-Rabin hashes and marked greedily, again and again.  An item whose tiles cover enough of its words contaminates the
document, in whatever order the tiles stand there.

1. A sieve of fixed size, made of all items' seeds, lets few words of the documents through.
2. Seeds of documents and items are joined, dealt by salt.  An item of which enough words are covered shares so many of its
   seeds that its commonest ones need not be joined: what is shared beyond them is counted, and too little is turned down.
3. Each pair that is left is tiled; one pair is one row.

Letters A-Z count as a-z.  Null and empty items and texts match nothing; repeated items give a row each; a repeated document
gives rows each time; columns besides those named are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.llm.textcore import U, Words, cut, pieces, ranges
from engram.llm.workspace import EACH, Workspace, attach, dealt, fetched

SEED = 5
SIEVE_BITS = 23


def _free(mask: np.ndarray) -> np.ndarray:
    """How many free words follow one another from each place on."""
    n = len(mask)
    taken = np.where(mask, n, np.arange(n))
    return np.minimum.accumulate(taken[::-1])[::-1] - np.arange(n)


def tiles(item: list[int], text: list[int | None], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (item start, text start, length) of non-overlapping common runs of ``least`` words or more.

    Longer runs are marked first; among equals the earlier in the item, then in the text.  A None in text matches nothing.
    The greatest length of which two free runs have equal hashes is sought by halves, and only lengths up to it later.
    """
    a, b = np.array(item, U), np.array([x or 0 for x in text], U)
    free_a, free_b = np.ones(len(a), bool), np.array([x is not None for x in text], bool)
    hash_a, hash_b, found, high = ranges(a), ranges(b), [], min(len(a), len(b))

    def runs(k: int):
        """Places and hashes of the free runs of k words of both that the other has too."""
        i, j = np.flatnonzero(_free(free_a) >= k), np.flatnonzero(_free(free_b) >= k)
        x, y = hash_a(i, i + k), hash_b(j, j + k)
        p, q = np.isin(x, y), np.isin(y, x)
        return i[p], x[p], j[q], y[q]

    while high >= least:
        low = least - 1
        while low < high:
            middle = high if low == least - 1 and high > least and len(runs(high)[0]) else (low + high + 1) // 2
            low, high = (middle, high) if len(runs(middle)[0]) else (low, middle - 1)
        if low < least:
            break
        marked, (i, x, j, y) = False, runs(low)
        order = np.argsort(y, kind="stable")
        j, y = j[order], y[order]
        at = {}  # of each hash, the first place in the text that may still be free
        for start, h in zip(i.tolist(), x.tolist(), strict=True):
            if not free_a[start : start + low].all():
                continue
            k = at.get(h)
            if k is None:
                k = int(np.searchsorted(y, U(h)))
            while k < len(y) and y[k] == h and not (free_b[j[k] : j[k] + low].all() and (a[start : start + low] == b[j[k] : j[k] + low]).all()):
                k += 1
            at[h] = k
            if k < len(y) and y[k] == h:
                free_a[start : start + low] = free_b[j[k] : j[k] + low] = False
                found.append((start, int(j[k]), low))
                marked = True
        high = low if marked else low - 1
    return sorted(found)


def _item_seeds(items: DataFrame) -> DataFrame:
    """iid, words, size (of its seeds), seed, times: the distinct seeds of each item (iid, text)."""
    schema = pa.schema([("iid", pa.int64()), ("words", pa.int64()), ("size", pa.int64()), ("seed", pa.int64()), ("times", pa.int64())])

    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for low, high, buf, bounds in pieces(batch.column(1)):
                w = cut(buf, bounds, lower=True)
                for d in range(high - low):
                    a, b = int(w.first[d]), int(w.first[d + 1])
                    size = min(SEED, b - a)
                    if size:
                        at = np.arange(a, b - size + 1)
                        seeds, times = np.unique(w.range_hash(at, at + size).view(np.int64), return_counts=True)
                        n = len(seeds)
                        yield pa.record_batch([pa.array(np.full(n, v, np.int64)) for v in (ids[low + d], b - a, size)] + [pa.array(seeds), pa.array(times.astype(np.int64))], schema=schema)

    return items.select("iid", "text").mapInArrow(run, "iid long, words long, size long, seed long, times long")


def _sieve(seeds: DataFrame) -> np.ndarray:
    """1 << SIEVE_BITS flags: the low bits of all seeds.  The driver gets no more than 1 << (SIEVE_BITS - 6) rows."""
    slot = F.col("seed").bitwiseAND(F.lit((1 << SIEVE_BITS) - 1))
    rows = seeds.select(F.shiftright(slot, 6).cast("int").alias("k"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int")).alias("v")).groupBy("k").agg(F.bit_or("v").alias("v")).collect()
    words = np.zeros(1 << (SIEVE_BITS - 6), np.int64)
    for r in rows:
        words[r.k] = r.v
    return np.unpackbits(words.view(np.uint8), bitorder="little").astype(bool)


def _met(docs: DataFrame, sieve, sizes: list[int]) -> DataFrame:
    """doc_id, text, seeds: texts with words that the sieve lets through, and the distinct hashes of those."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("seeds", pa.list_(pa.int64()))])
    mask = U((1 << SIEVE_BITS) - 1)

    def run(batches):
        flags = sieve.value
        for batch in batches:
            for low, high, buf, bounds in pieces(batch.column(1)):
                w = cut(buf, bounds, lower=True)
                at, seeds = [], []
                for size in sizes:
                    grams, ok = w.grams(size)
                    k = np.flatnonzero(ok & flags[(grams & mask).astype(np.int64)])
                    at.append(np.searchsorted(w.first, k, "right") - 1)
                    seeds.append(grams[k].view(np.int64))
                rows = np.unique(np.stack([np.concatenate(at), np.concatenate(seeds)], 1), axis=0)
                own, first = np.unique(rows[:, 0], return_index=True)
                if len(own):
                    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(rows)), pa.int32()), pa.array(rows[:, 1]))
                    part = batch.slice(low, high - low).take(pa.array(own))
                    yield pa.record_batch([part.column(0), part.column(1).cast(pa.string()), lists], schema=schema)

    return docs.mapInArrow(run, "doc_id long, text string, seeds array<long>")


def _tiled(w: Words, d: int, item: np.ndarray, seeds: np.ndarray, share: float) -> tuple[int, int]:
    """Number of tiles and of item words they cover, for document d and an item with its sorted seeds."""
    least, a, b = min(SEED, len(item)), int(w.first[d]), int(w.first[d + 1])
    words = w.hashes[a:b]
    if b - a < least:
        return 0, 0
    at = np.arange(b - a - least + 1)
    at = at[np.isin(ranges(words)(at, at + least), seeds)]
    near = np.zeros(b - a + 1, np.int32)
    np.add.at(near, at, 1)
    np.add.at(near, at + least, -1)
    close = np.cumsum(near[:-1]) > 0
    if close.sum() < share * len(item):  # tiles lie within the shared seeds
        return 0, 0
    index = np.flatnonzero(close)
    text: list[int | None] = []
    for k, v in zip(index.tolist(), words[index].tolist(), strict=True):
        if text and k != last + 1:
            text.append(None)
        text.append(v)
        last = k
    found = tiles(item.tolist(), text, least)
    return len(found), sum(n for *_, n in found)


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, share: float = 0.8) -> DataFrame:
    """doc_id, item_id, n_item_words, n_tiles, n_covered of each item of which ``share`` or more of the words are tiled."""
    ws = Workspace(spark, "decontam")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item")).filter("item is not null")
    items = ws.table(items.withColumn("iid", F.monotonically_increasing_id()), "items")
    seeds = ws.table(_item_seeds(items.select("iid", F.col("item").alias("text"))), "seeds")
    sizes = sorted(r[0] for r in seeds.select("size").distinct().collect())
    sieve = spark.sparkContext.broadcast(_sieve(seeds))
    met = _met(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), sieve, sizes) if sizes else spark.createDataFrame([], "doc_id long, text string, seeds array<long>")
    met = ws.table(met.withColumn("uid", F.monotonically_increasing_id()), "met")

    shared = attach(met.select("uid", F.explode("seeds").alias("seed")).join(seeds.select("seed").distinct(), "seed", "left_semi"), "seed", "uid", {}, F.min)
    shared = ws.table(shared.select("uid", "seed", F.col("group_rows").alias("docs")), "shared")
    # An item covered enough shares ``needed`` places of its seeds at least: each tile of n words has n - size + 1 of them.
    needed = F.ceil(F.ceil(F.col("words") * share - 1e-9) / F.col("size"))
    common = Window.partitionBy("iid").orderBy(F.desc("docs"), "seed")
    counted = seeds.join(shared.groupBy("seed").agg(F.max("docs").alias("docs")), "seed").withColumn("needed", needed).withColumn("cum", F.sum("times").over(common))
    # The commonest, of fewer than ``needed`` places together, are left out; what is left must be shared in the rest.
    kept = counted.withColumn("left_out", F.coalesce(F.max(F.when(F.col("cum") < F.col("needed"), F.col("cum"))).over(Window.partitionBy("iid")), F.lit(0))).filter("cum >= needed")
    of = F.ceil(F.col("docs") / EACH).cast("int")
    wanted = kept.select("seed", "iid", "times", (F.col("needed") - F.col("left_out")).alias("rest"), F.explode(F.sequence(F.lit(0), of - 1)).alias("_s"))
    spread = shared.withColumn("_s", F.pmod(F.xxhash64("uid"), of).cast("int"))
    pairs = spread.join(wanted, ["seed", "_s"]).groupBy("uid", "iid").agg(F.sum("times").alias("n"), F.max("rest").alias("rest")).filter("n >= rest").select("uid", "iid")
    pairs = dealt(ws, pairs, "pairs", "uid", "iid")
    rows = fetched(fetched(pairs, pairs, "iid", items), pairs, "uid", met.select("uid", "doc_id", "text")).select("doc_id", "item_id", "text", "item")
    schema = pa.schema([(k, pa.int64()) for k in ("doc_id", "item_id", "n_item_words", "n_tiles", "n_covered")])

    def run(batches):
        for batch in batches:
            docs_, items_ = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for low, high, buf, bounds in pieces(batch.column(2)):
                w, out = cut(buf, bounds, lower=True), []
                for _, _, other, edges in pieces(batch.column(3).slice(low, high - low), 1 << 62):
                    v = cut(other, edges, lower=True)
                for d in range(high - low):
                    item = v.hashes[v.first[d] : v.first[d + 1]]
                    at = np.arange(len(item) - min(SEED, len(item)) + 1)
                    n, covered = _tiled(w, d, item, np.unique(ranges(item)(at, at + min(SEED, len(item)))), share)
                    if n and covered >= share * len(item):
                        out.append((docs_[low + d], items_[low + d], len(item), n, covered))
                if out:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)

    return rows.mapInArrow(run, "doc_id long, item_id long, n_item_words long, n_tiles long, n_covered long")


def keep_clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, share: float = 0.8) -> DataFrame:
    """Rows of docs that hold no item, with their own columns; a null id is kept, and of rows that share an id all go if one does."""
    dirty = contamination(spark, docs, benchmark, share).select("doc_id").distinct()
    return docs.join(dirty, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])

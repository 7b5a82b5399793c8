"""Substring deduplication by relative Lempel-Ziv parsing.

Every document is parsed against reference blocks from all documents with smaller ids.  A block is what one anchor stands for:
the run of WINDOW-word windows that have the same minimal GRAM-word hash.  The choice depends on a window's words only, so
equal windows always meet at equal anchors, and only about one word in twenty is an anchor.

1. Index: (anchor, block, place) of each document; anchors of one document only drop out.
2. Look-up: a block that a smaller id has too gives a hit, its place here and its first place there.  Where an anchor has
   several blocks (a shared passage ends, or was edited inside), the first document of each block gives the block's windows,
   and those that a smaller id has are hits as well.
3. Extension: with both texts at hand, each hit grows word by word in both directions, as far as the documents agree.  Of each
   reference the matches that a parse against it alone takes go on, their words compared byte by byte.
4. Parse: from left to right, the match that reaches farthest becomes a factor, and the parse goes on behind it.  A match
   that began before a factor's end counts from there, so what two copies cover together is found whole.

A null text is empty.  A null id is never smaller nor larger than another: nothing is removed.  Rows that share an id are not
held against each other.  Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.textcore import CHUNK_BYTES, Words, cut, mix
from engram.llm.workspace import Workspace, attach_min, dealt, fetched

WINDOW, GRAM = 50, 8


def sliding_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost minimum of each run of ``width`` values."""
    at, low, size = np.arange(len(values)), values, 1
    while size < width:
        step = min(size, width - size)
        right = low[step:] < low[:-step]
        at, low = np.where(right, at[step:], at[:-step]), np.where(right, low[step:], low[:-step])
        size += step
    return at


def blocks(w: Words, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start, anchor hash and block hash of each block of a run of documents, in order."""
    z = np.zeros(0, np.int64)
    m = len(w.hashes)
    if m < window:
        return z, z, z, z
    gram = min(GRAM, window)
    grams, _ = w.grams(gram)
    at = sliding_minima(grams[: m - gram + 1], window - gram + 1)
    ends = np.repeat(w.first[1:], np.diff(w.first))
    starts = np.flatnonzero(np.arange(len(at)) + window <= ends[: len(at)])
    if not len(starts):
        return z, z, z, z
    anchor = at[starts]
    edge = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    low, high, anchor = starts[edge], starts[np.append(edge[1:], len(starts)) - 1], anchor[edge]
    block = mix(w.range_hash(low, high + window) ^ (anchor - low).astype(np.uint64))
    return low, high, grams[anchor].view(np.int64), block.view(np.int64)


def _index(texts: DataFrame, window: int) -> DataFrame:
    """uid, doc_id, at, n, anchor, block: each block of each text (uid, doc_id, z), from word ``at``, of n windows."""
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("anchor", pa.int64()), ("block", pa.int64())])

    def run(batches):
        for batch in batches:
            ids, names = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for rows, w in _texts(batch.column(2)):
                low, high, anchor, block = blocks(w, window)
                doc = np.searchsorted(w.first, low, "right") - 1
                at = (low - w.first[doc]).astype(np.int32)
                columns = ids[rows.start + doc], names[rows.start + doc], at, (high - low + 1).astype(np.int32), anchor, block
                yield pa.record_batch([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

    return texts.filter("doc_id is not null").select("uid", "doc_id", "z").mapInArrow(run, "uid long, doc_id long, at int, n int, anchor long, block long")


def _squeezed(docs: DataFrame) -> DataFrame:
    """doc_id, z: the text as a zstd frame, a third of the size to shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("z", pa.binary())])

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3, write_content_size=True).compress
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                yield pa.record_batch([part.column(0), pa.array([squeeze((t or "").encode()) for t in part.column(1).to_pylist()], pa.binary())], schema=schema)

    return docs.mapInArrow(run, "doc_id long, z binary")


def _texts(*columns: pa.Array, size: int = CHUNK_BYTES):
    """Row ranges of about ``size`` bytes of unpacked texts: range, and Words of each column."""
    unpack = zstandard.ZstdDecompressor().decompress
    low, total, held = 0, 0, [[] for _ in columns]
    n = len(columns[0])
    for i in range(n):
        for h, c in zip(held, columns, strict=True):
            h.append(unpack(c[i].as_py()))
            total += len(h[-1])
        if total >= size or i == n - 1:
            yield range(low, i + 1), *[cut(np.frombuffer(b"".join(h), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in h])])) for h in held]
            low, total, held = i + 1, 0, [[] for _ in columns]


def _boundary_windows(open_blocks: DataFrame, texts: DataFrame, window: int) -> DataFrame:
    """uid, doc_id, at, win: place and hash of each window of the open blocks (uid, at, n)."""
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("win", pa.int64())])
    listed = open_blocks.groupBy("uid").agg(F.collect_list(F.struct("at", "n")).alias("open"))

    def run(batches):
        for batch in batches:
            ids, names, lists = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(3)
            for rows, w in _texts(batch.column(2)):
                grams, _ = w.grams(window)
                own = lists.slice(rows.start, len(rows))
                flat, owner = own.flatten(), np.repeat(np.arange(len(rows)), np.asarray(pc.list_value_length(own)))
                low, n = np.asarray(flat.field(0)).astype(np.int64), np.asarray(flat.field(1)).astype(np.int64)
                at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
                doc = np.repeat(owner, n)
                columns = ids[rows.start + doc], names[rows.start + doc], at.astype(np.int32), grams[w.first[doc] + at].view(np.int64)
                yield pa.record_batch([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

    return texts.join(listed.hint("merge"), "uid").select("uid", "doc_id", "z", "open").mapInArrow(run, "uid long, doc_id long, at int, win long")


def reach(equal, length: np.ndarray) -> np.ndarray:
    """For each pair of places the largest length for which they agree; equal(k): whether they do over k words."""
    low, high = np.zeros_like(length), length.copy()
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = equal(middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def extended(w: Words, r: Words, row: np.ndarray, at: np.ndarray, there: np.ndarray, window: int) -> np.ndarray:
    """Rows (document, start, end, start there) of the longest runs of words around the hits, each once.

    Hits are places ``at`` in document ``row`` of w and ``there`` in document ``row`` of r; what does not hold is left out.
    """
    a, b = w.first[row] + at, r.first[row] + there
    x, y = w.ranges(), r.ranges()
    on = reach(lambda k: x(a, a + k) == y(b, b + k), np.minimum(w.first[row + 1] - a, r.first[row + 1] - b))
    back = reach(lambda k: x(a - k, a) == y(b - k, b), np.minimum(at, there))
    found = np.stack([row, at - back, at + on, there - back], axis=1)
    return np.unique(found[on + back >= window], axis=0)


def parsed(matches: list[tuple]) -> list[tuple]:
    """The greedy parse by matches (start, end, ...) sorted by start: (from, match) of each factor, which goes to the match's end.

    At each place the match that reaches farthest is taken (the first of several); where none lies, the next start is next.
    """
    out, place, k, best = [], 0, 0, None
    while True:
        while k < len(matches) and matches[k][0] <= place:
            if best is None or matches[k][1] > best[1]:
                best = matches[k]
            k += 1
        if best is not None and best[1] > place:
            out.append((place, best))
            place = best[1]
        elif k < len(matches):
            place = matches[k][0]
        else:
            return out


def _same(w: Words, raw: bytes, a: int, b: int, r: Words, raw_r: bytes, c: int) -> bool:
    """Whether the words a:b of w and those of r from c on are the same bytes."""
    d = c + b - a
    if raw[w.starts[a] : w.ends[b - 1]] == raw_r[r.starts[c] : r.ends[d - 1]]:
        return True
    one, two = zip(w.starts[a:b].tolist(), w.ends[a:b].tolist(), strict=True), zip(r.starts[c:d].tolist(), r.ends[c:d].tolist(), strict=True)
    return all(raw[i:j] == raw_r[k:m] for (i, j), (k, m) in zip(one, two, strict=True))


_MATCH = "uid long, start int, stop int, reference long, reference_start int"


def _matches(met: DataFrame, window: int) -> DataFrame:
    """Matches of each text with one reference: rows (uid, reference, hits, z, rz)."""
    schema = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.int32()) for c in _MATCH.split(", ")])

    def run(batches):
        for batch in batches:
            ids, names, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for rows, w, r in _texts(batch.column(3), batch.column(4)):
                own = lists.slice(rows.start, len(rows))
                flat, row = own.flatten(), np.repeat(np.arange(len(rows)), np.asarray(pc.list_value_length(own)))
                found = extended(w, r, row, np.asarray(flat.field(0)).astype(np.int64), np.asarray(flat.field(1)).astype(np.int64), window)
                raw, raw_r, out = w.buf.tobytes(), r.buf.tobytes(), []
                edges = np.searchsorted(found[:, 0], np.arange(len(rows) + 1))
                for d in range(len(rows)):
                    for _, (a, b, c) in parsed([tuple(m) for m in found[edges[d] : edges[d + 1], 1:].tolist()]):
                        if _same(w, raw, int(w.first[d]) + a, int(w.first[d]) + b, r, raw_r, int(r.first[d]) + c):
                            out.append((ids[rows.start + d], a, b, names[rows.start + d], c))
                if out:
                    yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return met.select("uid", "reference", "hits", "z", "rz").mapInArrow(run, _MATCH)


def parse(spark: SparkSession, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words left, joined by one space), factors of each row.

    A factor (start, length, reference, reference_start): these words stand in the text of that smaller id from that word on.
    """
    ws = Workspace(spark, "rlz")
    squeezed = _squeezed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).withColumn("uid", F.monotonically_increasing_id())
    texts = ws.bucketed(squeezed, "texts", "uid")
    index = ws.table(_index(texts, window), "index")
    ends = {"first": F.col("doc_id"), "last": -F.col("doc_id"), "least": F.col("block"), "most": F.bitwise_not("block")}
    met = attach_min(index, "anchor", "uid", ends).filter("group_rows > 1 and first <> -last")
    met = ws.table(met.select("uid", "doc_id", "at", "n", "block", (F.col("least") != F.bitwise_not("most")).alias("several")), "met")
    ws.drop("index")
    first = F.struct("doc_id", "uid", "at")
    seen = attach_min(met, "block", "uid", {"first": first}).select("uid", "doc_id", "at", "n", "several", F.coalesce("first", first).alias("first"))
    seen = ws.table(seen, "seen")
    ws.drop("met")
    open_blocks = seen.filter("first.doc_id = doc_id and several").select("uid", "at", "n")
    wins = ws.table(_boundary_windows(open_blocks, texts, window), "windows")
    across = attach_min(wins, "win", "uid", {"first": first})
    hits = seen.select("uid", "doc_id", "at", "first").unionByName(across.select("uid", "doc_id", "at", "first")).filter("first.doc_id < doc_id")
    pairs = hits.select("uid", F.col("first.uid").alias("ref"), F.col("first.doc_id").alias("reference"), F.struct("at", F.col("first.at").alias("there")).alias("hit"))
    pairs = dealt(ws, pairs.groupBy("uid", "ref").agg(F.first("reference").alias("reference"), F.collect_list("hit").alias("hits")), "pairs", "uid", "ref")
    ws.drop("seen", "windows")
    with_ref = fetched(pairs, pairs, "ref", texts.select(F.col("uid").alias("ref"), F.col("z").alias("rz")))
    matches = _matches(with_ref.join(texts.select("uid", "z").hint("merge"), "uid"), window)
    listed = ws.table(matches.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("start", F.negative("stop").alias("stop"), "reference", "reference_start"))).alias("matches")), "matches")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("factors", pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "reference", "reference_start")])))])

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            for rows, w in _texts(batch.column(1)):
                raw, out = w.buf.tobytes(), []
                for d in range(len(rows)):
                    a, b = int(w.first[d]), int(w.first[d + 1])
                    keep, factors = np.ones(b - a, bool), []
                    for place, (start, stop, reference, there) in parsed([(m["start"], -m["stop"], m["reference"], m["reference_start"]) for m in lists[rows.start + d].as_py() or ()]):
                        keep[place:stop] = False
                        factors.append({"start": place, "length": stop - place, "reference": reference, "reference_start": there + place - start})
                    s, e = w.starts[a:b][keep].tolist(), w.ends[a:b][keep].tolist()
                    out.append((b - a, int((~keep).sum()), b" ".join([raw[i:j] for i, j in zip(s, e, strict=True)]).decode(), factors))
                yield pa.record_batch([batch.column(0).slice(rows.start, len(rows)), *[pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), list(schema)[1:], strict=True)]], schema=schema)

    joined = texts.join(listed.hint("merge"), "uid", "left").select("doc_id", "z", "matches")
    factor = "array<struct<start:long,length:long,reference:long,reference_start:long>>"
    return joined.mapInArrow(run, f"doc_id long, n_words long, n_removed long, kept string, factors {factor}")

"""Packing along a space-filling curve.

A document's hashed token counts are projected to DIMENSIONS fixed random directions and quantised; its key is its place on a
Hilbert curve through that cube.  Documents are range-sorted by (key, doc_id) as small records, a prefix sum over partitions
gives each its place in one endless stream, and the stream is cut every ``length`` ids: neighbours on the curve share sequences
and only the last sequence is not full.

Null texts are empty documents of one id, the end id.  Repeated and null doc_ids are packed each time they occur.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.llm.textcore import U, mix, stream
from engram.llm.tokens import default_path, encoder
from engram.llm.workspace import Workspace

DIMENSIONS, LEVEL_BITS, BUCKETS = 4, 8, 256
_DIRECTIONS = (stream(401, BUCKETS * DIMENSIONS).reshape(BUCKETS, DIMENSIONS) >> U(11)).astype(float) / (1 << 53) * 2 - 1
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points [rows, dimensions] with ``bits`` bits a coordinate."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    step = 1 << (bits - 1)
    while step > 1:  # undo the rotations of the cells, coarse to fine
        low = step - 1
        for d in range(dims):
            flip = (x[d] & step) != 0
            swap = np.where(flip, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[d] ^= swap
        step >>= 1
    for d in range(1, dims):  # Gray code
        x[d] ^= x[d - 1]
    carry = np.zeros_like(x[0])
    step = 1 << (bits - 1)
    while step > 1:
        carry = np.where(x[-1] & step, carry ^ (step - 1), carry)
        step >>= 1
    x ^= carry
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = key << 1 | (x[d] >> b & 1)
    return key


@lru_cache(maxsize=2)
def _buckets(size: int) -> np.ndarray:
    return (mix(np.arange(size, dtype=U) + U(7)) % U(BUCKETS)).astype(np.int64)


def curve_points(ids: list[np.ndarray], vocabulary: int) -> np.ndarray:
    """Quantised projections of the hashed, log-scaled and normalised counts of each document's ids."""
    counts = np.zeros((len(ids), BUCKETS))
    table = _buckets(vocabulary)
    for row, x in zip(counts, ids, strict=True):
        row += np.bincount(table[x], minlength=BUCKETS)
    v = np.log1p(counts)
    v -= v.mean(axis=1, keepdims=True)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    side = 1 << LEVEL_BITS
    return np.clip(((v @ _DIRECTIONS) / 2 + 0.5) * side, 0, side - 1).astype(np.int64)


def pieces(g: int, n: int, length: int) -> list[tuple[int, int, int, int]]:
    """(start, length, sequence, offset) of the pieces of n ids from place g of the stream on."""
    out, start = [], 0
    while start < n:
        sequence, offset = divmod(g + start, length)
        size = min(length - offset, n - start)
        out.append((start, size, sequence, offset))
        start += size
    return out


def tokenised(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, ids (little-endian 16 bits, or 32 for large vocabularies; end id included), n_tokens, key."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("n_tokens", pa.int64()), ("key", pa.int64())])

    def run(batches):
        enc = encoder(path)
        size = max(enc.size, end_id + 1)
        width = "<u2" if size <= 1 << 16 else "<u4"
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                ids = [np.append(enc.ids(t or ""), np.uint32(end_id)) for t in part.column(1).to_pylist()]
                keys = hilbert_key(curve_points(ids, size), LEVEL_BITS)
                yield pa.record_batch([part.column(0), pa.array([x.astype(width).tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64()), pa.array(keys)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary, n_tokens long, key long")


def places(ws: Workspace, tokens: DataFrame) -> DataFrame:
    """(uid, g): the place in the stream of the first id of each row of (uid, doc_id, key, n_tokens), along the curve."""
    parts = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = tokens.select("uid", "doc_id", "key", "n_tokens").repartitionByRange(parts, "key", "doc_id", "uid").withColumn("pid", F.spark_partition_id())
    ordered = ws.table(ordered, "ordered")
    base, at = [], 0
    for r in ordered.groupBy("pid").agg(F.sum("n_tokens").alias("n")).orderBy("pid").collect():  # one row a partition
        base.append((r.pid, at))
        at += r.n
    base = ws.spark.createDataFrame(base, "pid int, base long")
    before = F.sum("n_tokens").over(Window.partitionBy("pid").orderBy("key", "doc_id", "uid").rowsBetween(Window.unboundedPreceding, -1))
    return ordered.withColumn("before", F.coalesce(before, F.lit(0))).join(F.broadcast(base), "pid").select("uid", (F.col("base") + F.col("before")).alias("g"))


def pack(spark: SparkSession, docs: DataFrame, length: int = 2048, path: str | None = None, end_id: int = 1) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    ws = Workspace(spark, "packing")
    raw = tokenised(docs, path or default_path(), end_id).withColumn("uid", F.monotonically_increasing_id())
    raw.write.option("compression", "zstd").parquet(f"{ws.path}/tokens")
    tokens = spark.read.schema(raw.schema).parquet(f"{ws.path}/tokens")
    placed = tokens.select("uid", "doc_id", "ids", "n_tokens").join(places(ws, tokens).hint("merge"), "uid").select("doc_id", "ids", "n_tokens", "g")
    schema = pa.schema([(c.split()[0], pa.int64()) for c in _PIECE.split(", ")])

    def run(batches):
        for batch in batches:
            out = []
            for doc, raw_ids, n, g in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ids = np.frombuffer(raw_ids, f"<u{len(raw_ids) // n}").astype("<u4")
                for start, size, sequence, offset in pieces(g, n, length):
                    out.append((doc, start, size, zlib.crc32(ids[start : start + size].tobytes()), n, sequence, offset))
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)

    return placed.mapInArrow(run, _PIECE)

"""Token counts of documents in flat, unindexed token files.

A file is nothing but little-endian ids of 16 bits (32 for vocabularies beyond 65,536); a document ends with the end id.  Each file is cut into blocks; in a block a
vectorised search finds the end ids, which gives the lengths between them and the open rests at both sides.  A prefix scan
over the blocks of a file, in order, numbers the documents and stitches what crosses block borders.

Empty documents count as such (the end id alone), null texts are empty.  Ids after the last end id of a file make a last, open
document.  The string of a special token in a text is text: no text holds the end id.  Files know no document ids; ``placed``
gives back those of documents that were written from a table, by their place in it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.llm.tokens import default_path, encoder
from engram.llm.workspace import Workspace

BLOCK_IDS = 1 << 20
#: A file is read whole by one task, so a large partition becomes several files: of so many documents at most, and fewer if
#: a partition could fill more than FILE_BYTES.
FILE_DOCUMENTS, FILE_BYTES = 1 << 14, 1 << 28


def width(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def places(docs: DataFrame) -> DataFrame:
    """doc_id, part, at, text_bytes: the partition of each row of docs and its place there.

    docs must be a scan of files, whose partitions and order are the same each time.
    """
    uid = F.monotonically_increasing_id()
    return docs.select("doc_id", F.octet_length("text").alias("text_bytes"), uid.alias("uid")).select("doc_id", F.shiftright("uid", 33).cast("int").alias("part"), F.col("uid").bitwiseAND(F.lit((1 << 33) - 1)).alias("at"), F.coalesce("text_bytes", F.lit(0)).cast("long").alias("text_bytes"))


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 50256, file_documents: int = FILE_DOCUMENTS) -> str:
    """Writes the ids of the texts, each followed by the end id, as flat files of ``file_documents`` at most.

    The text writer copies the bytes of a string as they are and ends each row with the separator: here, the end id.
    Returns the ids' format.
    """
    tokenizer = tokenizer or default_path()
    kind = width(max(encoder(tokenizer, True).size, end_id + 1))

    def run(batches):
        enc = encoder(tokenizer, True)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                ids = [enc.ids(t or "") for t in batch.column(0).slice(low, 256).to_pylist()]
                if any((x == end_id).any() for x in ids):
                    raise ValueError(f"a text holds the end id {end_id}")
                yield pa.record_batch([pa.array([x.astype(kind).tobytes() for x in ids], pa.binary())], names=["b"])

    separator = np.array(end_id, kind).tobytes().decode("latin-1")
    raw = docs.select("text").mapInArrow(run, "b binary").select(F.col("b").cast("string").alias("value"))
    raw.write.option("encoding", "ISO-8859-1").option("lineSep", separator).option("maxRecordsPerFile", file_documents).text(path)
    return kind


def file_documents(where: DataFrame, id_bytes: int = 2) -> int:
    """Documents a file, from places(): FILE_DOCUMENTS, or what surely fits FILE_BYTES if a partition could be larger."""
    parts = where.groupBy("part").agg(F.sum(F.col("text_bytes") + 1).alias("all"), F.max("text_bytes").alias("most"))
    row = parts.agg(F.max("all"), F.max("most")).first()
    if not row[0] or row[0] * id_bytes <= FILE_BYTES:
        return FILE_DOCUMENTS
    return max(1, min(FILE_DOCUMENTS, FILE_BYTES // (id_bytes * (row[1] + 1))))


def placed(where: DataFrame, counted: DataFrame, documents: int) -> DataFrame:
    """doc_id, n_tokens of each row of places(), from the counts of the files that ``write`` made of the same scan.

    A file's name tells its partition and which of that partition's files it is.  A count that cannot be its document's raises.
    """
    name = lambda k: F.regexp_extract("file", r"^part-(\d+)-.*?(?:-c(\d+))?\.\w+$", k)
    part, file = name(1).cast("int"), F.coalesce(F.try_to_number(F.nullif(name(2), F.lit("")), F.lit("999999")).cast("long"), F.lit(0))
    there = counted.select(part.alias("part"), (file * documents + F.col("ordinal")).alias("at"), "n_tokens")
    bad = F.col("n_tokens").isNull() | (F.col("n_tokens") > F.col("text_bytes")) | ((F.col("n_tokens") == 0) != (F.col("text_bytes") == 0))
    n = F.when(bad, F.raise_error(F.lit("files and table do not fit together")).cast("long")).otherwise(F.col("n_tokens"))
    return where.join(there, ["part", "at"], "left").select("doc_id", n.alias("n_tokens"))


def scan(data: np.ndarray, end_id: int) -> tuple[np.ndarray, int, int]:
    """Lengths of the pieces that end in this block (the end id not counted), how many end here, and the open rest."""
    ends = np.flatnonzero(data == end_id)
    if not len(ends):
        return ends, 0, len(data)
    return np.diff(ends, prepend=-1) - 1, len(ends), len(data) - int(ends[-1]) - 1


def count(spark: SparkSession, path: str, end_id: int = 50256, kind: str = "<u2", block_ids: int = BLOCK_IDS) -> DataFrame:
    """file, ordinal (from 0 in its file), n_tokens (without the end id), closed: one row a document of the files under path."""
    ws = Workspace(spark, "tokencount")
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("lengths", pa.list_(pa.int64())), ("ends", pa.int64()), ("rest", pa.int64())])

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(content.as_buffer(), kind)
                for k in range(0, len(ids), block_ids):
                    lengths, ends, rest = scan(ids[k : k + block_ids], end_id)
                    yield pa.record_batch([pa.array([name]), pa.array([k // block_ids], pa.int64()), pa.array([lengths], schema[2].type), pa.array([ends], pa.int64()), pa.array([rest], pa.int64())], schema=schema)

    files = spark.read.format("binaryFile").load(path).filter("length > 0").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "content")
    blocks = ws.table(files.mapInArrow(run, "file string, block long, lengths array<long>, ends long, rest long"), "blocks")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    slim = blocks.select("file", "block", "ends", "rest").withColumn("first", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    # A piece without an end in its block, and the rest after a block's last end, belong to the document that the next end closes.
    total = F.sum("ends").over(Window.partitionBy("file"))
    carried = slim.withColumn("total", total).select("file", (F.col("first") + F.col("ends")).alias("ordinal"), F.col("rest").alias("n"), "total")
    carried = carried.filter("n > 0").groupBy("file", "ordinal").agg(F.sum("n").alias("carried"), F.max("total").alias("total"))
    closed = blocks.select("file", "block", "lengths").join(slim.select("file", "block", "first"), ["file", "block"]).select("file", "first", F.posexplode("lengths").alias("at", "n"))
    closed = closed.select("file", (F.col("first") + F.col("at")).alias("ordinal"), "n")
    both = closed.join(carried.select("file", "ordinal", "carried"), ["file", "ordinal"], "left").select("file", "ordinal", (F.col("n") + F.coalesce("carried", F.lit(0))).alias("n_tokens"), F.lit(True).alias("closed"))
    opened = carried.filter("ordinal = total").select("file", "ordinal", F.col("carried").alias("n_tokens"), F.lit(False).alias("closed"))
    return both.unionByName(opened)

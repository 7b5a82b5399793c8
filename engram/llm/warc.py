"""WARC archives without repeated payloads.

Headers are shuffled by payload digest; of equal payloads of LEAST bytes or more the one with the smallest id stays a response,
and the others become revisit records that name it.  Each record is a gzip member of its own, written by Spark's own text
writer, whose committer survives lost executors.  Archives are read whole (they are written in parts of about PART_BYTES) and
parsed by content length, so payloads may hold anything.

A null payload is empty.  Rows that share an id and a payload are written each time; a null id is written without one, and is
never the one that stays while another has an id.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.workspace import EACH, Workspace, attach_min

LEAST, PART_BYTES = 100, 16 << 20
#: A record's end, as a gzip member.
END = gzip.compress(b"\r\n\r\n", mtime=0)
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_HEADER = "id long, uri string, record_type string, payload_digest string, refers_to long, block_bytes long, payload_bytes long, intact boolean"


def headers(records: DataFrame, ws: Workspace) -> DataFrame:
    """records (id, uri, payload) with payload_bytes, payload_digest, record_type and refers_to.

    Only headers (id, digest, size) are written and shuffled to find what repeats; payloads move once, by (id, digest) and as
    many salts as the most repeated pair needs (one, where ids are unique), so such rows may be any share of all.
    """
    df = records.withColumn("payload", F.coalesce("payload", F.lit(""))).withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    heads = ws.table(df.select("id", "payload_digest", "payload_bytes"), "heads")
    total, most = heads.groupBy("id", "payload_digest").agg(F.sum(F.col("payload_bytes") + 600).alias("b"), F.count(F.lit(1)).alias("n")).agg(F.sum("b"), F.max("n")).first()
    parts = max(1, -(-(total or 0) // PART_BYTES))
    salts = max(1, min(parts, -(-(most or 0) // EACH)))
    long = heads.filter((F.col("payload_bytes") >= LEAST) & F.col("id").isNotNull()).select("id", "payload_digest").distinct()
    revisits = attach_min(long, "payload_digest", "id", {"refers_to": F.col("id")}).filter("refers_to < id").select("id", "payload_digest", "refers_to").distinct()
    own = revisits.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = df.withColumn("_s", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")).repartition(parts, "id", "payload_digest", "_s")
    met = dealt.join(own.hint("merge"), ["id", "payload_digest", "_s"], "left").drop("_s")
    return met.withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))


def record(date: str) -> Column:
    """The text of a record, without what ends it, from the columns of headers()."""
    urn = lambda c: F.concat(F.lit("<urn:record:"), c.cast("string"), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    is_revisit = F.col("record_type") == "revisit"
    clean = lambda c: F.translate(F.coalesce(c, F.lit("")), "\r\n", "")
    http = F.concat(F.lit(_HTTP), line("Content-Length", F.col("payload_bytes").cast("string")), F.lit("\r\n"))
    block = F.when(is_revisit, http).otherwise(F.concat(http, F.col("payload")))
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), F.coalesce(line("WARC-Record-ID", urn(F.col("id"))), F.lit("")), line("WARC-Target-URI", clean(F.col("uri"))),
        F.lit(f"WARC-Date: {date}\r\nContent-Type: application/http; msgtype=response\r\n"), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(is_revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"), line("WARC-Refers-To", urn(F.col("refers_to"))))).otherwise(""),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block,
    )


def write(records: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes records (id, uri, payload), deduplicated, as archives of about PART_BYTES before compression.

    Each record is a gzip member of its own and can be read from where it begins; the end of a record, a member too, is the
    text writer's line separator, and its bytes go through a one-byte encoding unchanged.
    """
    ws = Workspace(records.sparkSession, "warc-heads")

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                yield pa.record_batch([pa.array([gzip.compress(t.encode(), 6, mtime=0) for t in batch.column(0).slice(low, 256).to_pylist()], pa.binary())], names=["b"])

    members = headers(records, ws).select(record(date).alias("value")).mapInArrow(run, "b binary").select(F.col("b").cast("string").alias("value"))
    members.write.option("encoding", "ISO-8859-1").option("lineSep", END.decode("latin-1")).text(path)
    ws.end()


def member(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """What the gzip member at a place holds, and where the next one begins."""
    inflate, out = zlib.decompressobj(31), []
    while not inflate.eof:
        part = data[at : at + (1 << 16)]
        if not part:
            raise ValueError("an archive ends within a record")
        out.append(inflate.decompress(part))
        at += len(part)
    return b"".join(out), at - len(inflate.unused_data)


def records_in(data: bytes):
    """(fields, block) of each record of an archive."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        yield fields, memoryview(data)[stop + 4 : stop + 4 + size]
        at = stop + 4 + size + 4


def read(spark: SparkSession, path: str) -> DataFrame:
    """Headers of all records under path, with what was measured on their blocks; intact: a response's digest holds."""
    schema = pa.schema([("id", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("block_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("intact", pa.bool_())])
    number = lambda s: int(s.rsplit(":", 1)[1][:-1]) if s else None

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                out = []
                raw = data.as_buffer().to_pybytes()
                for f, block in records_in(gzip.GzipFile(fileobj=io.BytesIO(raw)).read() if raw[:2] == b"\x1f\x8b" else raw):
                    body = bytes(block).partition(b"\r\n\r\n")[2]
                    kind, digest = f["WARC-Type"], f["WARC-Payload-Digest"].removeprefix("sha256:")
                    response = kind == "response"
                    out.append((number(f.get("WARC-Record-ID")), f["WARC-Target-URI"], kind, digest, number(f.get("WARC-Refers-To")), len(block), len(body) if response else None, hashlib.sha256(body).hexdigest() == digest if response else None))
                    if len(out) == 4096:
                        yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out = []
                if out:
                    yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("content")
    return files.mapInArrow(run, _HEADER)


def resolve(found: DataFrame) -> DataFrame:
    """found (headers as read) with the payload size of each revisit's original, joined by payload digest.

    Responses that share an id and a payload count once here, and keep a row each; a revisit whose original is not there keeps nulls.
    """
    responses = found.filter("record_type = 'response'")
    revisits = found.filter("record_type = 'revisit'").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(16)).cast("int"))
    whole = responses.filter(F.col("payload_bytes") >= LEAST).select("payload_digest", F.col("id").alias("refers_to"), F.col("payload_bytes").alias("original_bytes")).dropDuplicates(["payload_digest", "refers_to"])
    originals = whole.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    met = revisits.join(originals, ["payload_digest", "refers_to", "_salt"], "left").withColumn("payload_bytes", F.col("original_bytes"))
    return responses.unionByName(met.select(*responses.columns))


def deduplicated(spark: SparkSession, records: DataFrame, path: str | None = None) -> DataFrame:
    """Writes records (id, uri, payload) as deduplicated archives, and returns their resolved headers as read back."""
    ws = Workspace(spark, "warc")
    path = path or f"{ws.path}/archives"
    write(records.select(F.col("id").cast("long").alias("id"), "uri", "payload"), path)
    return resolve(ws.table(read(spark, path), "headers"))

import gzip
import hashlib
import json
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from engram.llm import tokencount, warc
from engram.llm.queries import ORACLE_SQL, QUERIES
from engram.llm.tokens import default_path


def test_warc_query(spark):
    d = "/root/testdata/sf0.01"
    got = {tuple(r) for r in QUERIES["op2_warc"](spark, d).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()}
    db = duckdb.connect()
    db.sql(f"create view pages as select * from '{d}/pages.parquet'")
    assert got == set(db.sql(ORACLE_SQL["op2_warc"]).fetchall())


def test_archives_round_trip(spark, tmp_path):
    long = "p" * 100
    pages = [(1, "u\r\nX: y", None), (2, "u", ""), (3, None, long), (4, "u", long), (5, "u", "é" * 49), (6, "u", "é" * 49), (7, "u", "a\r\n\r\nWARC/1.1\r\n\r\n" * 40), (8, "u", "x" * 300000), (0, "u", "é" * 50), (9, "u", "é" * 50), (None, "u", long), (10, "u", long)]
    df = spark.createDataFrame(pages, "id long, uri string, payload string")
    path = f"file://{tmp_path}/w"
    rows = warc.deduplicated(spark, df, path).collect()
    got = {r.id: (r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in rows}
    for i, _, p in pages:
        b = (p or "").encode()
        expected = {4: 3, 10: 3, 9: 0}.get(i)
        assert got[i] == ("revisit" if expected is not None else "response", expected, len(b), hashlib.sha256(b).hexdigest())
    assert all(r.intact for r in rows if r.record_type == "response")
    names = [p for p in (tmp_path / "w").iterdir() if p.name.startswith("part")]
    texts = {bytes(block) for p in names for f, block in warc.records_in(gzip.decompress(p.read_bytes())) if f["WARC-Type"] == "response"}
    assert any(t.endswith(b"x" * 300000) for t in texts)
    assert warc.deduplicated(spark, df.limit(0)).count() == 0


def test_repeated_rows_of_pages(spark, tmp_path):
    p = "p" * 200
    rows = [(3, "u", p), (3, "u", p), (4, "u", p), (4, "u", p), (None, "u", p), (None, "u", p), (3, "u", "short"), (3, "u", "short")]
    df = spark.createDataFrame(rows, "id long, uri string, payload string").withColumn("payload_digest", F.lit("x"))
    got = warc.deduplicated(spark, df, f"file://{tmp_path}/w").collect()
    kinds = Counter((r.id, r.record_type, r.refers_to, r.payload_bytes) for r in got)
    assert kinds == {(3, "response", None, 200): 2, (4, "revisit", 3, 200): 2, (None, "response", None, 200): 2, (3, "response", None, 5): 2}


def test_records_are_read_from_where_they_begin(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", f"page {i} é" * 30) for i in range(20)], "id long, uri string, payload string")
    warc.write(df, f"file://{tmp_path}/w")
    seen = 0
    for p in (tmp_path / "w").glob("part*"):
        data, at = p.read_bytes(), 0
        while at < len(data):
            record, at = warc.member(data, at)
            end, at = warc.member(data, at)
            assert record.startswith(b"WARC/1.1\r\n") and end == b"\r\n\r\n" and len(list(warc.records_in(record))) == 1
            seen += 1
    assert seen == 20


def test_hot_page(spark, monkeypatch):
    monkeypatch.setattr(warc, "EACH", 4)
    monkeypatch.setattr(warc, "PART_BYTES", 4096)
    rows = [(1, "u", "q" * 300)] + [(2, "u", "q" * 300)] * 50
    got = warc.deduplicated(spark, spark.createDataFrame(rows, "id long, uri string, payload string")).collect()
    assert Counter((r.id, r.record_type, r.refers_to) for r in got) == {(1, "response", None): 1, (2, "revisit", 1): 50}


def plain_counts(texts):
    """Numbers of ids when no special token is known."""
    with open(default_path(), encoding="utf-8") as f:
        t = Tokenizer.from_str(json.dumps(json.load(f) | {"added_tokens": []}))
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


def test_token_counts_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = QUERIES["op6_token_counts"](spark, sf_dir).collect()
    assert {r.doc_id: r.n_tokens for r in got} == dict(zip([r.doc_id for r in docs], plain_counts([r.text for r in docs]), strict=True)) and len(got) == len(docs)


@pytest.mark.parametrize("documents", [1, 3, 100])
def test_odd_table_through_files(spark, tmp_path, documents):
    texts = ["a <|endoftext|> b", "plain text", None, "", "x" * 5000 + "<|endoftext|>", "<|endoftext|>", "é", "plain text"]
    rows = [(i if i < 6 else 5, t, 1) for i, t in enumerate(texts)] + [(None, "n", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, part int").repartition(3).write.parquet(f"file://{tmp_path}/docs")
    docs = spark.read.parquet(f"file://{tmp_path}/docs")
    where = tokencount.places(docs)
    tokencount.write(docs, f"file://{tmp_path}/flat", file_documents=documents)
    got = tokencount.placed(where, tokencount.count(spark, f"file://{tmp_path}/flat"), documents).collect()
    expected = Counter(zip([r[0] for r in rows], plain_counts([r[1] for r in rows]), strict=True))
    assert Counter((r.doc_id, r.n_tokens) for r in got) == expected


def test_file_bounds(spark, monkeypatch):
    where = spark.createDataFrame([(1, 0, 0, 1000), (2, 0, 1, 10), (3, 1, 0, 5)], "doc_id long, part int, at long, text_bytes long")
    assert tokencount.file_documents(where) == tokencount.FILE_DOCUMENTS and tokencount.file_documents(where.limit(0)) == tokencount.FILE_DOCUMENTS
    monkeypatch.setattr(tokencount, "FILE_BYTES", 2002)
    assert tokencount.file_documents(where) == 1


@pytest.mark.parametrize("block", [1, 2, 3, 7, 100])
def test_blocks_are_stitched(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    expected = set()
    for f in range(4):
        ids = rng.integers(0, 4, 60).astype("<u4") if f else np.array([1, 1, 1], "<u4")
        (tmp_path / f"f{f}").write_bytes(ids.tobytes())
        docs = " ".join("E" if x == 0 else "x" for x in ids).replace(" ", "").split("E")
        expected |= {(f"f{f}", k, len(x), k < len(docs) - 1) for k, x in enumerate(docs) if k < len(docs) - 1 or x}
    (tmp_path / "empty").write_bytes(b"")
    got = {(r.file, r.ordinal, r.n_tokens, r.closed) for r in tokencount.count(spark, f"file://{tmp_path}", 0, "<u4", block).collect()}
    assert got == expected


def test_odd_texts_as_flat_files(spark, tmp_path):
    texts = [None, "", "one two", "é\n\n😀", "", "PÄ"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    tokencount.write(df, f"file://{tmp_path}/t")
    got = tokencount.count(spark, f"file://{tmp_path}/t").orderBy("file", "ordinal").collect()
    assert [r.n_tokens for r in got] == plain_counts(texts)
    tokencount.write(df.limit(0), f"file://{tmp_path}/e")
    assert tokencount.count(spark, f"file://{tmp_path}/e").count() == 0

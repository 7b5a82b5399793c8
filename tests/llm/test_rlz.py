import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from engram.llm import rlz
from engram.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, window=50):
    words = {i: WORD.findall(t or "") for i, t in docs.items()}
    first = {}
    for i in sorted(i for i in words if i is not None):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_query(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op4_rlz"](spark, d).collect()}
    assert got == brute(docs)
    assert sum(x[1] for x in got.values()) > 0


def test_edited_and_joined_passages(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(300)}"
    passages = [[word() for _ in range(rng.choice([8, 10, 14, 25, 40]))] for _ in range(6)]
    docs = {}
    for i in range(120):
        w = []
        for _ in range(rng.randrange(6)):
            part = list(rng.choice(passages))
            if rng.random() < 0.5:
                part[rng.randrange(len(part))] = word()
            w += part + [word() for _ in range(rng.choice([0, 0, 3, 12]))]
        docs[i * 3 - 50] = rng.choice([" ", "\n", " \t"]).join(w)
    docs |= {900: None, 901: "", 902: "a " * 400, 903: "a " * 300, 904: " ".join(passages[0]), None: "a " * 300}
    df = spark.createDataFrame([(i, t, 1) for i, t in docs.items()], "doc_id long, text string, block int")
    for window in (10, 20):
        got = rlz.parse(spark, df, window).withColumn("sha", F.sha2("kept", 256)).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.sha) for r in got} == brute(docs, window)
        assert all(sum(f.length for f in r.factors) == r.n_removed for r in got)
        words = {i: WORD.findall(t or "") for i, t in docs.items()}
        for r in got:
            for f in r.factors:
                assert f.reference < r.doc_id and f.length > 0
                assert words[r.doc_id][f.start : f.start + f.length] == words[f.reference][f.reference_start : f.reference_start + f.length]
    assert rlz.parse(spark, df.limit(0)).count() == 0


def test_factors_are_whole(spark):
    w = [f"w{i}" for i in range(200)]
    docs = [(1, " ".join(w[60:120])), (2, " ".join([*w[0:50], "z", "z", "z", *w[1:51]])), (3, " ".join(w[:51])), (4, " ".join(w)), (5, "\n".join(["q", *w])), (5, " ".join(w[:60])), (5, " ".join(w[:60])), (6, " ".join(w[100:]))]
    got = rlz.parse(spark, spark.createDataFrame(docs, "doc_id long, text string").withColumn("uid", F.lit(1))).collect()
    found = sorted((r.doc_id, r.n_words, [tuple(f) for f in r.factors]) for r in got)
    # A block's reference is the first document that holds it.  Words 0 to 50 stand in document 2 in two parts only; document 5
    # is one factor of document 4, although parts of it stand in earlier ones.
    assert found == [(1, 60, []), (2, 103, []), (3, 51, [(0, 50, 2, 0), (50, 1, 2, 102)]), (4, 200, [(0, 50, 2, 0), (50, 1, 2, 102), (60, 60, 1, 0)]), (5, 60, [(0, 60, 4, 0)]), (5, 60, [(0, 60, 4, 0)]), (5, 201, [(1, 200, 4, 0)]), (6, 100, [(0, 100, 4, 100)])]


def test_parsed_takes_what_reaches_farthest():
    rng = random.Random(2)
    for _ in range(300):
        m = sorted((a, a + rng.randrange(1, 9)) for a in (rng.randrange(40) for _ in range(rng.randrange(12))))
        out = rlz.parsed(m)
        covered = {k for a, (_, b) in out for k in range(a, b)}
        assert covered == {k for a, b in m for k in range(a, b)} and sum(b - a for a, (_, b) in out) == len(covered)
        assert all(b == max(e for s, e in m if s <= a < e) for a, (_, b) in out)


def test_sliding_minima():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 5, 60).astype(np.uint64)
    for width in (1, 2, 5, 33, 60):
        assert rlz.sliding_minima(x, width).tolist() == [k + int(np.argmin(x[k : k + width])) for k in range(60 - width + 1)]

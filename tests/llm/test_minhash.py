import gc
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from engram.llm import minhash, workspace
from engram.llm.minhash import near_duplicates
from engram.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute(docs, size, percent):
    sets, parent = {}, {}
    for i, text in docs.items():
        w = WORD.findall((text or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)]) if w else frozenset()
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[:k]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in docs}


def rows(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_groups_of_near_copies(spark, size, percent):
    rng = random.Random(size)
    vocabulary = [f"w{i}" for i in range(500)]
    docs = {}
    for g in range(4):
        base = [rng.choice(vocabulary) for _ in range(120)]
        for k in range(60):
            w = list(base)
            for _ in range(rng.randrange(9)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            docs[1000 * g + k] = " ".join(w) if k % 7 else " \n".join(base).upper()
    docs |= {9001: None, 9002: "", 9003: " \t ", 9004: "a", 9005: "A", 9006: "a b", 9007: "é x", 9008: "É x", 9009: "z " * 30000, 9010: "Z " * 29000}
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in docs.items()], "doc_id long, text string, n_shingles int, key string")
    assert rows(near_duplicates(spark, df, size, percent)) == brute(docs, size, percent)


def test_repeated_and_null_ids(spark):
    rng = random.Random(3)
    a, b = ([f"w{rng.randrange(900)}" for _ in range(300)] for _ in range(2))
    near = lambda w, k: " ".join(w[:k] + ["changed"] + w[k + 1 :])
    docs = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a, 50)), (3, near(b, 50)), (1, " ".join(a)), (None, " ".join(a)), (None, None), (7, None), (7, "one word")]
    for rows_ in (docs, docs[::-1]):
        got = near_duplicates(spark, spark.createDataFrame(rows_, "doc_id long, text string").withColumn("uid", F.lit(0)), 3, 85).collect()
        kinds = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str)
        assert kinds == sorted([(1, 298, 1, True)] * 3 + [(2, 298, 1, False), (3, 298, 1, False), (None, 298, None, True), (None, 0, None, True), (7, 0, 7, True), (7, 1, 7, True)], key=str)
    # An id whose texts belong to two groups joins them under the smallest id, whatever its own is.
    moved = [(5, docs[0][1]), (5, docs[1][1]), *docs[2:4]]
    got = near_duplicates(spark, spark.createDataFrame(moved, "doc_id long, text string"), 3, 85).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(2, 2), (3, 2), (5, 2), (5, 2)]


def test_hot_bucket_in_many_tasks(spark, monkeypatch):
    """Documents of one template that are near to few others: one bucket, dealt to several tasks, loses no link."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "SPAN", 2)
    monkeypatch.setattr(workspace, "EACH", 4)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(200)]
    docs, k = {}, 0
    for _ in range(25):
        own = [f"o{rng.randrange(10**6)}" for _ in range(25)]
        for _ in range(4):
            w = base + own
            for _ in range(rng.randrange(1, 4)):
                w = [*w[:205], *w[205:-1], f"x{rng.randrange(10**6)}"]
            docs[k] = " ".join(w)
            k += 1
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert rows(near_duplicates(spark, df, 3, 90)) == brute(docs, 3, 90)


def test_fetched_deals_hot_keys(spark):
    pairs = spark.range(1000).select(F.when(F.col("id") < 900, 0).otherwise(F.col("id")).alias("a"), F.col("id").alias("b"))
    table = spark.range(990).select(F.col("id").alias("a"), (F.col("id") * 2).alias("v"))
    own = workspace.dealt(workspace.Workspace(spark, "t"), pairs, "p", "a", "b", each=50)
    assert own.groupBy("a", "_s_a").count().agg(F.max("count")).first()[0] < 120 and own.filter("a > 0 and _of_a > 1").count() == 0
    got = workspace.fetched(own, own, "a", table)
    assert {(r.a, r.b, r.v) for r in got.collect()} == {(0 if i < 900 else i, i, 0 if i < 900 else 2 * i) for i in range(990)} and got.count() == 990


def jobs_of(spark, group, work):
    spark.sparkContext.setJobGroup(group, "")
    try:
        out = work()
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_no_jobs_for_rows_that_cannot_meet(spark):
    """The driver's memory goes with the number of jobs: groups that the pivots join whole take no turns and no second components."""
    rng = random.Random(5)
    docs = {}
    for g in range(3):
        base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        docs |= {10 * g: " ".join(base), 10 * g + 1: " ".join([*base[:99], "end"])}
    got, jobs = jobs_of(spark, "whole", lambda: rows(near_duplicates(spark, spark.createDataFrame(list(docs.items()), "doc_id long, text string"))))
    assert got == brute(docs, 5, 80) and jobs < 120
    edges = spark.createDataFrame([], "a long, b long")
    got, jobs = jobs_of(spark, "no edges", lambda: workspace.components(workspace.Workspace(spark, "t"), edges, "c").count())
    assert got == 0 and jobs < 8


def test_components_in_few_and_many_steps(spark):
    for edges in ([(1, 2), (1, 3)], [(i, i + 1) for i in range(40)] + [(50, 60), (60, 70)], [(3, 3)]):
        parent = {x: {x} for e in edges for x in e}
        for a, b in edges:
            both = parent[a] | parent[b]
            parent |= dict.fromkeys(both, both)
        got = workspace.components(workspace.Workspace(spark, "t"), spark.createDataFrame(edges, "a long, b long"), "c").collect()
        assert {r.id: r.component for r in got} == {x: min(own) for x, own in parent.items() if x > min(own)}


def test_release_lets_go_of_garbage(spark):
    ref = spark.sparkContext._jvm.java.lang.ref.WeakReference(spark.sparkContext._jvm.java.lang.Object())
    gc.collect()
    for _ in range(20):  # the gateway's own hold on the object ends a moment later
        workspace.Workspace(spark, "t").release()
        if ref.get() is None:
            return
        gc.collect()
        time.sleep(0.2)
    raise AssertionError("still held")


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert rows(QUERIES["op8_minhash"](spark, sf_dir)) == brute(docs, 3, 85)


def test_empty_table(spark):
    assert near_duplicates(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0

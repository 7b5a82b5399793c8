"""Operators on small hand-made tables."""

import math
import threading
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from engram.functions import text, vectors
from engram.metrics import Metrics
from engram.operators import consolidate, context, embed, graph, lifecycle, mutate, retrieval, stats

from engram.plans import search
from engram.plans.queries import QUERIES
from engram.schema import EDGES, MEMORIES, Config, ConfigError, Consolidation, ConsolidationError, Embedder, EmbeddingError, Forgetting, MemoryNotFound, StorageError, ValidationError
from engram.sources.index import CellIndex
from engram.sources.store import Store
from engram.streaming import jobs

T0 = datetime(2024, 1, 1)


def memory(i, level=2, embedding=None, weight=1.0, accessed=T0, count=0, pending=True, content=None, category="general", updated=T0):
    return (i, content or f"content of {i}", "", category, weight, level, pending, embedding, "{}", T0, updated, accessed, count)


def memories(spark, *rows):
    return spark.createDataFrame([r if isinstance(r, tuple) else memory(r) for r in rows], MEMORIES)


def edges(spark, *rows):
    """rows: source, target, weight, type, relation."""
    return spark.createDataFrame([(k, s, t, w, (rest or ["r"])[0], kind, T0, T0) for k, (s, t, w, kind, *rest) in enumerate(rows)], EDGES)


def tags(spark, *rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id bigint, memory_id string, key string, value string")


def stamp(t):
    return F.lit(t).cast("timestamp_ntz")


# --- vectors -------------------------------------------------------------------------------------------------------


def test_cosine_of_odd_vectors(spark):
    rows = [([1.0, 0.0], [1.0, 1.0], math.sqrt(0.5)), ([0.0, 0.0], [1.0, 1.0], 0.0), ([1.0], [1.0, 1.0], 0.0), ([3.0, 4.0], [-3.0, -4.0], -1.0)]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>, c double").withColumn("got", vectors.cosine(F.col("a"), F.col("b")))
    assert all(math.isclose(r.got, r.c, abs_tol=1e-12) for r in df.collect())
    assert spark.range(1).select(vectors.from_distance(F.lit(0.0)).alias("x"), vectors.from_distance(F.lit(3.0)).alias("y")).first() == (1.0, -1.0)


def test_top_k_orders_ties_by_id(spark):
    m = memories(spark, memory("b", embedding=[1.0, 0.0]), memory("a", embedding=[2.0, 0.0]), memory("c", embedding=[0.0, 1.0]), memory("z"))
    assert [r.id for r in retrieval.top_k(m, [1.0, 0.0], 10).collect()] == ["a", "b", "c"]
    assert [r.id for r in retrieval.top_k(m, [1.0, 0.0], 1).collect()] == ["a"]


def test_batch_equals_single(spark):
    import random

    rng = random.Random(1)
    m = memories(spark, *[memory(f"m{i:03}", embedding=[rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)]) for i in range(200)], memory("short", embedding=[1.0]))
    asked = {f"q{i}": [rng.choice([-1.0, 1.0, 2.0]) for _ in range(4)] for i in range(5)}
    got = {}
    for r in retrieval.top_k_batch(spark, m, asked, 7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, round(r.score, 9)))
    for q, v in asked.items():
        assert [x for _, x in got[q]] == [round(r.score, 9) for r in retrieval.top_k(m, v, 7).collect()]
    assert retrieval.top_k_batch(spark, m, {}, 3).count() == 0


def test_cells_recall(spark):
    """Every fiftieth vector of the query, and 1,000 queries at the production number of cells and probes, against exact search."""
    d = "/root/testdata/sf0.1"
    m = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("id"), "embedding").cache()
    rows = m.collect()
    centres = retrieval.cell_model(m, int(len(rows) ** 0.5))
    probes = retrieval.calibrated_probes(m, centres)
    asked = {r.id: list(r.embedding) for r in rows[:1000]}
    exact, near = (
        {(r.query_id, r.id) for r in found.collect()}
        for found in (retrieval.top_k_batch(spark, m, asked, 10), retrieval.top_k_cells_batch(spark, retrieval.with_cells(m, centres), centres, asked, 10, probes))
    )
    print("recall", len(exact & near) / len(exact), "probes", probes, "of", len(centres))
    assert len(exact) == 10_000 and len(exact & near) >= 0.9 * len(exact)
    one = retrieval.top_k_cells(retrieval.with_cells(m, centres), centres, list(rows[0].embedding), 10, probes).collect()
    assert {r.id for r in one} == {i for q, i in near if q == rows[0].id}
    got = {(r.query_id, r.id) for r in QUERIES["vector_topk_cells"](spark, d).collect()}
    want = {(r.query_id, r.id) for r in QUERIES["vector_topk_batch_all"](spark, d).collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_one_rule_for_odd_vectors(spark):
    nan = float("nan")
    m = memories(spark, memory("a", embedding=[1.0, 0.0]), memory("n", embedding=[nan, 1.0]), memory("z", embedding=[0.0, 0.0]), memory("s", embedding=[1.0]), memory("e", embedding=None), memory("b", embedding=[-1.0, 0.0]))
    expected = [("a", 1.0), ("s", 0.0), ("z", 0.0), ("b", -1.0)]
    assert [(r.id, r.score) for r in retrieval.top_k(m, [2.0, 0.0], 9).collect()] == expected
    assert [(r.id, r.score) for r in retrieval.top_k_batch(spark, m, {"q": [2.0, 0.0]}, 9).orderBy("rank").collect()] == expected
    assert [(r.id, r.score) for r in retrieval.scored(m, [2.0, 0.0]).orderBy(F.desc("score"), "id").collect()] == expected
    assert retrieval.top_k(m, [nan, 1.0], 9).count() == retrieval.top_k_batch(spark, m, {"q": [nan, 1.0]}, 9).count() == 2  # those of no such product
    assert [r.id for r in retrieval.top_k(m.drop("embedding").withColumn("embedding", F.lit(None).cast("array<float>")), [1.0], 3).collect()] == []


def test_index_follows_the_store(spark, tmp_path):
    import random

    rng = random.Random(3)
    store = Store(spark, f"file://{tmp_path}/s", buckets=4)
    index = CellIndex(store, cells=8)
    vector = lambda: [rng.gauss(0, 1) for _ in range(6)]
    store.commit({"memories": memories(spark, *[memory(f"m{i:03}", embedding=vector()) for i in range(200)])}, 0)
    assert not index.refresh() and len(index) == 0  # too few rows for an index, exact search all the same
    q = vector()
    exact = lambda: [r.id for r in retrieval.top_k(store.table("memories"), q, 5).collect()]
    assert [r.id for r in index.nearest(q, 5).collect()] == exact()
    store.commit({}, 1, add={"memories": memories(spark, *[memory(f"n{i:03}", embedding=vector()) for i in range(100)])})
    assert index.refresh() and not index.refresh() and len(index) == 8
    old = index.state()
    assert [r.id for r in index.nearest(q, 5, probes=8).collect()] == exact()
    new = memories(spark, memory("best", embedding=q))
    store.commit({}, 2, add={"memories": new})
    assert [r.id for r in index.nearest(q, 1, probes=1).collect()] == ["best"]  # not indexed yet, found all the same
    assert index.refresh() and len(index) == 9 and old["centres"] == index.state()["centres"]
    assert all(index.state()["parts"][p] == at for p, at in old["parts"].items())
    assert [r.id for r in index.nearest(q, 1, probes=1).collect()] == ["best"]
    assert [r.id for r in index.nearest(q, 5, probes=8, version=2).collect()] != ["best"] and index.refresh(rebuild=True)


# --- search --------------------------------------------------------------------------------------------------------


def test_window_is_cut_before_filters(spark):
    m = memories(spark, *[memory(f"m{i:02}", embedding=[1.0, i / 100], category="a" if i < 15 else "b", level=-1 if i % 5 == 0 else 2) for i in range(60)])
    q = search.Query([1.0, 0.0], limit=5, category="b", threshold=-2)
    assert search.search(spark, m, None, None, q).count() == 0  # of the 20 nearest, those alive are cut to 10, m01 to m12, none of which is in b
    free = search.search(spark, m, None, None, search.Query([1.0, 0.0], limit=5, category="b", threshold=-2, windowed=False)).collect()
    assert len(free) == 5 and free[0].total == 36


def test_boost_lifts_over_the_threshold(spark):
    m = memories(spark, memory("a", embedding=[0.0, 1.0]), memory("b", embedding=[0.0, 1.0]))
    t = tags(spark, ("a", "k", "old"), ("a", "k", "v"), ("a", "n", ""), ("b", "k", "x"))
    q = search.Query([1.0, 0.0], context=text.parse_context('{"k": "v", "n": 3}'), threshold=0.15)
    rows = search.search(spark, m, t, None, q).collect()
    assert [(r.id, r.score, r.total) for r in rows] == [("a", 0.2, 1)]
    assert text.parse_context("[1]") == text.parse_context("{") == text.parse_context(None) == {}


def test_nan_scores_and_bad_modes(spark):
    m = memories(spark, memory("n", embedding=[float("nan"), 1.0]), memory("a", embedding=[1.0, 0.0]))
    assert [r.id for r in search.search(spark, m, None, None, search.Query([1.0, 0.0], threshold=-2)).collect()] == ["a"]
    with pytest.raises(ValidationError):
        search.Query([1.0], mode="wide").checked()
    assert search.Query([1.0], limit=10**6, depth=9, degree_limit=0).checked().__dict__.items() >= {"limit": 1000, "depth": 5, "degree_limit": 1}.items()
    assert text.parse_levels(" Full, nope,archived ") == [2, -1]
    assert search.search(spark, m, None, None, search.Query([1.0, 0.0], levels=[], threshold=-2)).count() == 0
    assert text.parse_time("2024-01-01T02:00:00+02:00") == T0
    with pytest.raises(ValidationError):
        text.parse_time("2024-01-01")


# --- graph ---------------------------------------------------------------------------------------------------------


def walk(alive, links, seeds, depth, limit):
    """Simple paths by plain search."""
    steps = [(s, t, w) for s, t, w, *_ in links] + [(t, s, w) for s, t, w, kind, *_ in links if kind == "auto"]
    front, rows = {(s, 1.0, (s,)) for s in seeds}, []
    for d in range(1, depth + 1):
        front = {(t, w * x, (*p, t)) for i, w, p in front for s, t, x in steps if s == i and t not in p}
        rows += [(d, -w, ",".join(p), i) for i, w, p in front if i in alive]
    out = {}
    for d, w, _, i in sorted(rows)[:limit]:
        out.setdefault(i, (d, -w, 0.5**d * -w))
    return out


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcde"), st.sampled_from("abcde"), st.sampled_from([0.5, 1.0, 2.0]), st.sampled_from(["auto", "manual"])), max_size=8), st.sets(st.sampled_from("abcdex"), max_size=3), st.integers(0, 3), st.integers(1, 6))
def test_diffusion_by_plain_search(spark, links, seeds, depth, limit):
    m = memories(spark, *[memory(i, level=-1 if i == "c" else 2) for i in "abcde"])
    e = edges(spark, *links)
    got = {r.id: (r.d, r.weight, r.score) for r in graph.expand(spark, m, e, sorted(seeds), depth, limit).collect()}
    assert got == walk(set("abde"), links, seeds, depth, limit)


def test_chain_archived_middle_and_parallel_edges(spark):
    m = memories(spark, "a", memory("b", level=-1), "c")
    e = edges(spark, ("a", "b", 1.0, "auto"), ("b", "c", 0.5, "auto"), ("b", "c", 0.5, "auto", "s"), ("b", "c", 0.25, "auto", "t"))
    assert [(r.id, r.d, r.weight) for r in graph.expand(spark, m, e, ["a"], 2, 20).collect()] == [("c", 2, 0.5)]
    near, around = graph.neighbourhood(spark, m, e, "a", 2, 10)
    assert near.count() == 1 and around.count() == 4
    assert graph.neighbourhood(spark, m, e, "unknown", 2, 10)[1].count() == 0
    members = spark.createDataFrame([("b",), ("c",)], "member_id string")
    assert graph.incident(e, members).count() == 7


def test_hub_ends_the_search(spark):
    """A hub of a million edges: its first level fills the limit, so the paths behind it are never made."""
    n = 1_000_000
    e = spark.range(n).select("id", F.when(F.col("id") % 2 == 0, "hub").otherwise(F.concat(F.lit("x"), "id")).alias("source_id"), F.when(F.col("id") % 2 == 1, "hub").otherwise(F.concat(F.lit("x"), "id")).alias("target_id"), F.lit(1.0).alias("weight"), F.lit("r").alias("relation"), F.lit("auto").alias("edge_type"), stamp(T0).alias("created_at"), stamp(T0).alias("updated_at"))
    m = spark.range(n).select(F.concat(F.lit("x"), "id").alias("id"), F.lit(2).alias("level"))
    for seed in ("hub", "x5"):
        got = graph.expand(spark, m, e, [seed], 5, 100).collect()
        assert len(got) == 100 and {r.d for r in got} == ({1} if seed == "hub" else {2})
    assert sorted(r.id for r in got)[:2] == ["x0", "x1"] and "x5" not in {r.id for r in got}


# --- retention -----------------------------------------------------------------------------------------------------


def weight_of(spark, conf, **kw):
    rows = memories(spark, memory("m", **kw))
    return lifecycle.decisions(rows, stamp(T0 + timedelta(days=10)), conf).first()


def test_decay_values(spark):
    day = 86_400.0
    ten = T0 + timedelta(days=10)
    assert math.isclose(weight_of(spark, Forgetting(half_life_seconds=10 * day)).new_weight, 0.5)
    assert weight_of(spark, Forgetting(half_life_seconds=day)).new_weight < 0.01
    assert weight_of(spark, Forgetting(), accessed=ten + timedelta(days=5)).new_weight == 1.0
    assert 2.9 < weight_of(spark, Forgetting(), accessed=ten, count=10_000_000).new_weight <= 3.0
    assert weight_of(spark, Forgetting(half_life_seconds=0.0)).new_weight == 1.0
    down = weight_of(spark, Forgetting(half_life_seconds=30 * day, threshold_to_l1=0.5), weight=0.4)
    assert (down.action, down.new_level) == ("downgrade", 1)
    assert weight_of(spark, Forgetting(), level=2).action == "archive"
    assert weight_of(spark, Forgetting(half_life_seconds=30 * day), level=0).action == "keep"


def test_tick_purges_only_while_something_lives(spark):
    old = T0 - timedelta(days=100)
    dead = memories(spark, memory("x", level=-1, updated=old))
    none = edges(spark, ("x", "y", 1.0, "auto")), tags(spark, ("x", "k", "v"))
    now = stamp(T0)
    assert lifecycle.tick(dead, *none, now, Forgetting()).summary.first() == (0, 0, 0)
    both = memories(spark, memory("x", level=-1, updated=old), "y")
    t = lifecycle.tick(both, *none, now, Forgetting())
    assert t.summary.first() == (0, 0, 1) and t.memories.count() == 1 and t.edges.count() == 0 and t.tags.count() == 0
    edge_case = memories(spark, memory("x", level=-1, updated=T0 - timedelta(days=30)), "y")
    assert lifecycle.tick(edge_case, *none, now, Forgetting()).summary.first().cleaned == 0


# --- mutations -----------------------------------------------------------------------------------------------------


def test_update_touch_and_marks(spark):
    m = memories(spark, memory("a", embedding=[1.0], pending=False), memory("b", pending=False))
    later = T0 + timedelta(hours=1)
    u = spark.createDataFrame([("a", "new", None), ("nobody", "x", [1.0])], "id string, content string, embedding array<float>")
    a = {r.id: r for r in mutate.update_memories(m, u, stamp(later)).collect()}
    assert a["a"].content == "new" and a["a"].embedding is None and a["a"].pending_consolidation and a["a"].updated_at == later and a["a"].level == 2
    assert a["b"].content == "content of b" and len(a) == 2
    log = spark.createDataFrame([("a", later), ("a", T0 - timedelta(days=1))], "id string, ts timestamp_ntz")
    t = {r.id: r for r in mutate.touch(m, log).collect()}
    assert (t["a"].accessed_at, t["a"].access_count, t["b"].access_count) == (later, 2, 0)
    s = {r.id: r for r in mutate.set_levels(m, spark.createDataFrame([("b", 0)], "id string, new_level int"), stamp(later)).collect()}
    assert (s["b"].level, s["b"].updated_at, s["a"].level) == (0, later, 2)
    p = memories(spark, "a")
    assert not mutate.mark_consolidated(p, spark.createDataFrame([("a",)], "id string")).first().pending_consolidation
    assert mutate.exists(m, "a") and not mutate.exists(m, "zz") and "embedding" not in mutate.get(m, "a").columns


def test_writes_and_edges(spark):
    items = spark.createDataFrame([(0, "ok", {"k": "v"}), (1, "", None), (2, "x" * 65_537, None), (3, "é" * 32_768, {})], "idx int, content string, context map<string,string>")
    marked = mutate.validate_writes(items)
    assert {r.idx: r.error_code for r in marked.collect()} == {0: None, 1: "BAD_REQUEST", 2: "BAD_REQUEST", 3: None}
    fresh = mutate.new_memories(marked.filter("error_code is null"), stamp(T0), F.concat(F.lit("mem_"), "idx")).cache()
    assert mutate.insert_memories(memories(spark, "a"), fresh).count() == 3
    assert [tuple(r) for r in mutate.new_tags(fresh, 10).collect()] == [(11, "mem_0", "k", "v")]
    m = memories(spark, "a", "b")
    want = spark.createDataFrame([(0, "a", "b", "r"), (1, "a", "b", "r"), (2, "a", "a", "r"), (3, "a", "zz", "r"), (4, "b", "a", None)], "idx int, source_id string, target_id string, relation string")
    assert {r.idx: r.error_code for r in mutate.validate_edges(want, m).collect()} == {0: None, 1: None, 2: "BAD_REQUEST", 3: "NOT_FOUND", 4: None}
    got = {(r.source_id, r.target_id, r.relation, r.edge_type) for r in mutate.insert_edges(edges(spark, ("b", "a", 1.0, "auto")), want, m, stamp(T0)).collect()}
    assert got == {("a", "b", "r", "manual"), ("a", "a", "r", "manual"), ("b", "a", "related", "manual")}


def test_context_maps(spark):
    t = tags(spark, ("a", "k", "1"), ("a", "k", "2"), ("b", "x", "y"))
    assert {r.id: r.context for r in context.with_context(memories(spark, "a", "c"), t).collect()} == {"a": {"k": "2"}, "c": {}}
    assert {r.memory_id for r in context.matching(t, [("k", "1"), ("x", "z")]).collect()} == {"a"}
    assert context.matching(t, []).count() == 0
    assert stats.by_level(memories(spark, "a", memory("b", level=7))).filter("name = 'archived'").count() == 1


# --- consolidation, embedding, config ------------------------------------------------------------------------------


def test_language_model_answers(spark):
    for reply in ('{"memories": []}', '```json\n{"memories": []}\n```', 'Here: {"memories": []} as asked'):
        assert consolidate.language_model(lambda _, r=reply: r)([("a", "x")]) == {"memories": []}
        row = spark.createDataFrame([(reply,)], "s string").select(text.json_object(F.col("s"))).first()
        assert row[0] == '{"memories": []}'
    with pytest.raises(ConsolidationError):
        consolidate.language_model(lambda _: "none")([("a", "x")])
    m = memories(spark, "a", "b", memory("c", pending=False))
    answer = {"memories": [{"id": "a", "abstract": "A"}, {"id": "ghost", "abstract": "G"}], "edges": [{"source_id": "a", "target_id": "b"}, {"source_id": "a", "target_id": "a"}, {"source_id": "a", "target_id": "c"}]}
    done = consolidate.run_once(spark, m, edges(spark), lambda batch: answer, stamp(T0))
    assert {(r.kind, r.accepted, r.rejected) for r in done.summary.collect()} == {("abstract", 1, 1), ("edge", 1, 2)}
    assert {r.id: (r.abstract, r.pending_consolidation) for r in done.memories.collect()} == {"a": ("A", False), "b": ("", True), "c": ("", False)}
    assert [(r.source_id, r.target_id, r.edge_type) for r in done.new_edges.collect()] == [("a", "b", "auto")]
    assert consolidate.run_once(spark, m.filter("id = 'c'"), edges(spark), consolidate.no_consolidator, stamp(T0)) is None


def test_embedders(spark):
    df = spark.createDataFrame([("hello",), ("hello",), ("",)], "t string")
    rows = [r.e for r in df.select(embed.hash_embedding(F.col("t"), 16).alias("e")).collect()]
    assert rows[0] == rows[1] != rows[2] and all(math.isclose(sum(x * x for x in r), 1) and len(r) == 16 for r in rows)
    with pytest.raises(EmbeddingError):
        embed.hash_embedding(F.col("t"), 0)
    got = embed.embedded(df, "t", lambda ts: [[float(len(t)), 1.0] for t in ts], batch=2).collect()
    assert [list(r.embedding) for r in got] == [[5.0, 1.0], [5.0, 1.0], [0.0, 1.0]]
    with pytest.raises(Exception, match="vectors for"):
        embed.embedded(df, "t", lambda ts: []).collect()
    with pytest.raises(EmbeddingError):
        embed.http_encoder(Embedder(type="nope"))


def test_encoders(spark):
    df = spark.createDataFrame([(1, [1.0, -2.5]), (2, None), (3, [])], "id int, v array<float>")
    raw = vectors.to_bytes(df, "v")
    assert [r.v for r in raw.orderBy("id").collect()] == [bytearray(b"\x00\x00\x80?\x00\x00 \xc0"), None, bytearray()]
    assert [r.v for r in vectors.from_bytes(raw, "v").orderBy("id").collect()] == [[1.0, -2.5], None, []]
    rows = spark.createDataFrame([('{"a":1,"b":"x\\"y","c":[1,{"d":null}]}',), ("nonsense",), (None,)], "m string")
    again = rows.select(text.metadata_map(F.col("m")).alias("m")).select(text.metadata_json(F.col("m")).alias("m")).collect()
    assert again[1].m == again[2].m == "{}"
    times = spark.createDataFrame([("2024-01-01T02:00:00+02:00",), ("2024-01-01T00:00:00.25Z",), ("2024-01-01",), ("x",), (None,)], "t string")
    got = times.select(text.time_or(F.col("t"), stamp(T0 - timedelta(days=1))).alias("t")).collect()
    assert [r.t for r in got] == [T0, T0 + timedelta(milliseconds=250), *[T0 - timedelta(days=1)] * 3]
    assert spark.range(1).select(text.format_time(stamp(T0)).alias("t")).first().t == "2024-01-01T00:00:00.000000+00:00"
    assert text.parse_time("2024-01-01T00:00:00.000000+00:00") == T0


def test_metrics():
    m = Metrics()
    with m.request("search", "fast"):
        pass
    with pytest.raises(ValidationError), m.request("search", 'a"b'):
        raise ValidationError("x")
    m.record("search", "fast", "OK", 0.02)
    said = m.text({"total_memories": 3}).splitlines()
    assert 'engram_requests_total{method="search",path="fast",status="OK"} 2' in said and "engram_total_memories 3" in said
    assert 'engram_requests_total{method="search",path="a\\"b",status="BAD_REQUEST"} 1' in said
    assert 'engram_request_seconds_bucket{method="search",path="fast",status="OK",le="0.025"} 2' in said
    assert 'engram_request_seconds_bucket{method="search",path="fast",status="OK",le="0.01"} 1' in said


def test_plugins_by_configuration(spark):
    assert consolidate.chosen(Consolidation()) is consolidate.no_consolidator and consolidate.chosen(Consolidation(type="unheard")) is consolidate.no_consolidator
    with pytest.raises(ConsolidationError):
        consolidate.chosen(Consolidation(type="openai", url="http://127.0.0.1:9"))([("a", "b")])
    row = embed.with_embedding(spark.range(1).select(F.lit("x").alias("t")), "t", Embedder(type="random", dim=4)).first()
    assert abs(sum(x * x for x in row.embedding) - 1) < 1e-6


def test_config(tmp_path):
    f = tmp_path / "c.json"
    f.write_text('{"retrieval": {"score_threshold": 0.5}}')
    c = Config.load(str(f), {"ENGRAM__RETRIEVAL__SCORE_THRESHOLD": "0.1", "ENGRAM__FORGETTING__ARCHIVE_DAYS": "7", "OTHER": "x"})
    assert c.retrieval.score_threshold == 0.5 and c.forgetting.archive_days == 7
    with pytest.raises(ConfigError):
        Config.load(None, {"ENGRAM__EMBEDDER__DIM": "0"})


# --- store and streams ---------------------------------------------------------------------------------------------


def test_store_commits(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.version() == 0 and store.table("edges").count() == 0
    assert store.commit({"memories": memories(spark, "a")}, 0) == 1
    assert store.commit({"memories": memories(spark, "a", "b")}, 1) == 2
    with pytest.raises(StorageError):
        store.commit({"memories": memories(spark)}, 1)
    with pytest.raises(StorageError):
        store.commit({"memories": memories(spark, "a", "a")}, 2)
    assert store.table("memories").count() == 2 and store.table("memories", 1).count() == 1 and store.migrate() == 2


def test_two_writers(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    for base in range(3):
        gate, won, lost = threading.Barrier(4), [], []

        def write(k, base=base, gate=gate, won=won, lost=lost):
            rows = memories(spark, memory(f"m{base}-{k}"))
            gate.wait()
            try:
                won.append((k, store.commit({}, base, add={"memories": rows})))
            except StorageError:
                lost.append(k)

        threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
        [t.start() for t in threads]
        [t.join() for t in threads]
        assert len(won) == 1 and won[0][1] == base + 1 and len(lost) == 3
    assert store.table("memories").count() == 3 and store.versions() == [1, 2, 3]


def test_small_changes_write_few_files(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", buckets=8)
    store.commit({"memories": memories(spark, *[memory(f"m{i}") for i in range(100)])}, 0)
    parts = store.manifest()["tables"]["memories"]
    assert len(parts) == 8 and store.listing().filter("table = 'memories'").count() == 8
    new = spark.createDataFrame([("m7", "changed", None)], "id string, content string, embedding array<float>")
    store.commit({}, 1, change={"memories": (new, lambda part: mutate.update_memories(part, new, F.lit(T0).cast("timestamp_ntz")))})
    after = store.manifest()["tables"]["memories"]
    assert sum(parts[b] != after[b] for b in parts) == 1 and store.table("memories").count() == 100
    assert store.table("memories").filter("id = 'm7'").first().content == "changed" and store.table("memories", 1).filter("id = 'm7'").first().content != "changed"
    # Accesses rewrite no memory, and are settled with the bucket that is written next.
    jobs.fold_accesses(store, spark.createDataFrame([("m7", T0 + timedelta(days=1)), ("m7", T0), ("m8", T0)], jobs.ACCESS))
    assert store.manifest()["tables"]["memories"] == after
    row = store.table("memories").filter("id = 'm7'").first()
    assert (row.access_count, row.accessed_at) == (2, T0 + timedelta(days=1))
    store.commit({}, 3, change={"memories": (new, lambda part: mutate.update_memories(part, new, F.lit(T0).cast("timestamp_ntz")))})
    assert {r.id: r.access_count for r in store.table("memories").filter("access_count > 0").collect()} == {"m7": 2, "m8": 1}


def test_stream_batch_counts_once_wherever_it_fails(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.commit({"memories": memories(spark, "a")}, 0)
    batch = spark.createDataFrame([("a", T0)], jobs.ACCESS)
    publish = store._publish

    def broken(after):
        def run(*args):
            if after:
                publish(*args)
            raise OSError("lost")

        return run

    for after in (False, True):  # a stop before the manifest, and one right behind it
        store._publish = broken(after)
        with pytest.raises(OSError):
            jobs.fold_batch(store, "s", batch, 0)
    store._publish = publish
    jobs.fold_batch(store, "s", batch, 0)
    jobs.fold_batch(store, "s", batch, 1)
    assert store.table("memories").first().access_count == 2 and store.mark("s") == 1 and store.mark("t") == -1


def test_migration_of_an_old_store(spark, tmp_path):
    memories(spark, "a", "b").write.parquet(f"file://{tmp_path}/s/tables/memories/x")
    (tmp_path / "s" / "manifests").mkdir()
    (tmp_path / "s" / "manifests" / "1.json").write_text('{"schema_version": 1, "tables": {"memories": "tables/memories/x"}}')
    store = Store(spark, f"file://{tmp_path}/s")
    with pytest.raises(StorageError):
        store.commit({"memories": memories(spark, "a")}, 1)
    assert store.migrate() == 2 and store.migrate() == 2 and store.table("memories").count() == 2
    store.commit({}, 2, add={"memories": memories(spark, "c")})
    assert store.table("memories").count() == 3


def test_marking_unknown_ids(spark):
    with pytest.raises(MemoryNotFound):
        mutate.mark_consolidated(memories(spark, "a"), spark.createDataFrame([("a",), ("z",)], "id string"), strict=True)
    assert not mutate.mark_consolidated(memories(spark, "a"), spark.createDataFrame([("a",), ("a",)], "id string"), strict=True).first().pending_consolidation


def test_failing_job_is_run_again():
    ran, done = [], threading.Event()

    def bad():
        ran.append(1)
        if len(ran) >= 3:
            done.set()
        raise StorageError("lost")

    s = jobs.Scheduler([(0.0, 0.01, bad)]).start()
    assert done.wait(10)
    s.stop()
    assert s.failures >= 2


def test_jobs_on_a_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.commit({"memories": memories(spark, memory("a", accessed=T0), memory("b", weight=0.01)), "edges": edges(spark, ("a", "b", 1.0, "auto"))}, 0)
    log = f"{tmp_path}/log"
    for k in range(3):
        spark.createDataFrame([("a", T0 + timedelta(hours=k)), ("ghost", T0)], jobs.ACCESS).coalesce(1).write.mode("append").parquet(log)
    for _ in range(2):
        q = jobs.access_stream(spark, store, log, f"file://{tmp_path}/cp", once=True, max_files=1)
        q.awaitTermination(120)
    row = store.table("memories").filter("id = 'a'").first()
    assert (row.access_count, row.accessed_at) == (3, T0 + timedelta(hours=2))
    report = jobs.consolidate_once(store, lambda b: {"memories": [{"id": "a", "abstract": "A"}], "edges": [{"source_id": "b", "target_id": "a"}]}, T0)
    assert report == {"memories_processed": 2, "edges_created": 1, "errors": 0} and store.table("consolidate_log").count() == 1 and store.table("edges").count() == 2
    assert jobs.forget_once(store, T0 + timedelta(hours=2), Forgetting()) == (1, 0, 0)
    assert store.table("memories").filter("id = 'b'").first().level == -1
    assert jobs.consolidate_once(store, lambda b: (_ for _ in ()).throw(ConsolidationError("x")), T0) is None


def test_forgetting_writes_its_buckets_only(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", buckets=8)
    rows = [memory(f"m{i}", accessed=T0) for i in range(60)] + [memory("weak", weight=0.01), memory("old", level=-1, updated=T0 - timedelta(days=90))]
    store.commit({"memories": memories(spark, *rows), "edges": edges(spark, ("old", "m1", 1.0, "auto"), ("m1", "m2", 1.0, "auto")), "context_tags": tags(spark, ("old", "k", "v"), ("m1", "k", "v"))}, 0)
    before = store.manifest()["tables"]["memories"]
    assert jobs.forget_once(store, T0 + timedelta(seconds=1), Forgetting()) == (1, 0, 1)
    after = store.manifest()["tables"]["memories"]
    assert 1 <= sum(before[b] != after.get(b) for b in before) <= 2
    got = {r.id: r.level for r in store.table("memories").collect()}
    assert len(got) == 61 and got["weak"] == -1 and "old" not in got
    assert [r.source_id for r in store.table("edges").collect()] == ["m1"] and [r.memory_id for r in store.table("context_tags").collect()] == ["m1"]


def test_windowed_access_counts(spark, tmp_path):
    spark.createDataFrame([("a", T0), ("a", T0 + timedelta(minutes=5)), ("a", T0 + timedelta(hours=2))], jobs.ACCESS).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(jobs.ACCESS).parquet(f"{tmp_path}/in")
    q = jobs.access_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.n for r in spark.table("counted").collect()) == [1, 2]


def test_scheduler_runs_jobs_in_turn():
    ran, done = [], threading.Event()

    def job(name):
        ran.append(name)
        if len(ran) >= 6:
            done.set()

    s = jobs.Scheduler([(0.0, 0.01, lambda: job("a")), (0.0, 0.01, lambda: job("b"))]).start()
    assert done.wait(10)
    s.stop()
    assert {"a", "b"} <= set(ran)

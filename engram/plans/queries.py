"""The engine's queries on the test tables, with the same in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.operators import consolidate, context, graph, lifecycle, mutate, retrieval, stats
from engram.operators.embed import hash_embedding
from engram.plans import search
from engram.schema import Forgetting
from engram.sources.fixtures import duckdb, load

NOW = "TIMESTAMP '2024-01-31 00:00:00'"
SEEDS = [f"mem_{i}" for i in range(5)]
CONF = Forgetting(half_life_seconds=604_800.0, archive_days=28, batch_size=500)
Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f: Run) -> Run:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = duckdb(sql)
        return f

    return register


def now():
    return F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'")


def vector(spark: SparkSession, d: str, i: int = 0) -> list[float]:
    """The embedding of one row: what a caller would bring along."""
    return list(spark.read.parquet(f"{d}/embeddings.parquet").filter(F.col("vec_id") == i).first()["embedding"])


def quoted(items: list[str]) -> str:
    return ", ".join(f"'{x}'" for x in items)


# --- scans ---------------------------------------------------------------------------------------------------------


@query("""
SELECT m.id, CAST(length(content) AS BIGINT) AS content_len, category, level, pending_consolidation AS pending, count(DISTINCT t.key) AS n_tags
FROM memories m LEFT JOIN context_tags t ON t.memory_id = m.id WHERE m.id = 'mem_50' GROUP BY ALL""")
def get_memory(s, d):
    row = context.with_context(mutate.get(load(s, d, "memories"), "mem_50"), load(s, d, "context_tags"), bounded=True)
    return row.select("id", F.length("content").cast("bigint").alias("content_len"), "category", "level", F.col("pending_consolidation").alias("pending"), F.size("context").cast("bigint").alias("n_tags"))


ASKED = ["mem_0", "mem_5", "mem_5", "mem_99999999", "nobody"]


@query(f"SELECT id FROM memories WHERE id IN ({quoted(ASKED)})")
def memory_exists_batch(s, d):
    return mutate.existing(load(s, d, "memories"), s.createDataFrame([(i,) for i in ASKED], "id string"))


@query("SELECT id, created_at FROM memories WHERE pending_consolidation ORDER BY created_at, id LIMIT 20")
def list_pending(s, d):
    return consolidate.pending(load(s, d, "memories"), 20).select("id", "created_at")


@query("SELECT id, accessed_at FROM memories WHERE level >= 0 ORDER BY accessed_at, id LIMIT 20")
def list_for_forgetting(s, d):
    return lifecycle.candidates(load(s, d, "memories"), 20).select("id", "accessed_at")


_EDGE = ["source_id", "target_id", "weight", "relation", "edge_type"]


@query("SELECT id AS edge_id, source_id, target_id, weight, relation, edge_type FROM edges WHERE source_id = 'mem_1' OR target_id = 'mem_1'")
def get_edges(s, d):
    return graph.edges_of(load(s, d, "edges"), "mem_1").select(F.col("id").alias("edge_id"), *_EDGE)


@query(f"""
SELECT i.member_id, e.id AS edge_id, source_id, target_id, weight, relation, edge_type
FROM edges e JOIN (SELECT unnest([{quoted(SEEDS)}]) AS member_id) i ON e.source_id = i.member_id OR e.target_id = i.member_id""")
def get_edges_batch(s, d):
    members = F.broadcast(s.createDataFrame([(i,) for i in SEEDS], "member_id string"))
    return graph.incident(load(s, d, "edges"), members).select("member_id", F.col("id").alias("edge_id"), *_EDGE)


@query("SELECT memory_id, key, arg_max(value, id) AS value FROM context_tags GROUP BY memory_id, key")
def context_map(s, d):
    return context.last_values(load(s, d, "context_tags"))


@query("SELECT DISTINCT memory_id FROM context_tags WHERE (key = 'lang' AND value = 'fr') OR (key = 'quality' AND value = '0')")
def search_by_context(s, d):
    return context.matching(load(s, d, "context_tags"), [("lang", "fr"), ("quality", "0")])


# --- retrieval -----------------------------------------------------------------------------------------------------


def _dot(a: str, b: str) -> str:
    return f"list_inner_product({a}::DOUBLE[], {b}::DOUBLE[])"


def _cosine(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) <> len({b}) OR {_dot(a, a)} = 0 OR {_dot(b, b)} = 0 THEN 0.0D ELSE {_dot(a, b)} / (sqrt({_dot(a, a)}) * sqrt({_dot(b, b)})) END"


_SCORED = f"""scored AS (
  SELECT m.*, {_cosine("m.embedding", "q.embedding")} AS score
  FROM memories m CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE m.embedding IS NOT NULL)"""


@query(f"WITH {_SCORED} SELECT id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, id LIMIT 10")
def vector_topk(s, d):
    return retrieval.nearest(load(s, d, "memories"), vector(s, d), 10).withColumn("score", F.round("score", 6))


@query(f"""
WITH hits AS (
  SELECT concat('q', q.vec_id) AS query_id, m.id, {_cosine("m.embedding", "q.embedding")} AS score
  FROM memories m CROSS JOIN (SELECT * FROM embeddings WHERE vec_id < 20) q WHERE m.embedding IS NOT NULL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM hits)
SELECT query_id, rank, id, round(score, 6) AS score FROM r WHERE rank <= 5""")
def vector_topk_batch(s, d):
    asked = {f"q{r.vec_id}": list(r.embedding) for r in s.read.parquet(f"{d}/embeddings.parquet").filter("vec_id < 20").collect()}
    return retrieval.top_k_batch(s, load(s, d, "memories"), asked, 5).withColumn("score", F.round("score", 6))


@query(f"""
WITH hits AS (
  SELECT concat('q', q.vec_id) AS query_id, m.id, {_cosine("m.embedding", "q.embedding")} AS score
  FROM memories m CROSS JOIN (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q WHERE m.embedding IS NOT NULL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM hits)
SELECT query_id, rank, id, round(score, 6) AS score FROM r WHERE rank <= 5""")
def vector_topk_batch_all(s, d):
    """As vector_topk_batch; the queries grow with the table."""
    asked = {f"q{r.vec_id}": list(r.embedding) for r in s.read.parquet(f"{d}/embeddings.parquet").filter("vec_id % 50 = 0").collect()}
    return retrieval.top_k_batch(s, load(s, d, "memories"), asked, 5).withColumn("score", F.round("score", 6))


@query()
def vector_topk_cells(s, d):
    """As vector_topk_batch_all through cells, of which each query reads the nearest: approximate, so its recall is tested instead."""
    asked = {f"q{r.vec_id}": list(r.embedding) for r in s.read.parquet(f"{d}/embeddings.parquet").filter("vec_id % 50 = 0").collect()}
    rows = load(s, d, "memories").select("id", "embedding").filter("embedding is not null")
    centres = retrieval.cell_model(rows, max(2, int(rows.count() ** 0.5)))
    return retrieval.top_k_cells_batch(s, retrieval.with_cells(rows, centres), centres, asked, 5, retrieval.calibrated_probes(rows, centres)).withColumn("score", F.round("score", 6))


def _page_sql(rows: str, where: str = "true", lift: str = "0.0D", threshold: str = "-2.0D", limit: int = 10, offset: int = 0, columns: str = "id, score, weight, level, category") -> str:
    """Ranking in SQL on a relation with memory columns and score."""
    return f"""
lifted AS (SELECT * REPLACE (score + {lift} AS score) FROM {rows} r WHERE {where}),
ok AS (SELECT *, count(*) OVER () AS total FROM lifted WHERE score >= {threshold} AND NOT isnan(score)),
page AS (SELECT * FROM ok ORDER BY score DESC, id LIMIT {limit} OFFSET {offset})
SELECT {columns.replace("score", "round(score, 6) AS score")} FROM page"""


def _nearest_sql(limit: int) -> str:
    return f"""WITH {_SCORED},
nearest AS (SELECT * FROM (SELECT * FROM scored ORDER BY score DESC, id LIMIT {2 * limit}) WHERE level >= 0 ORDER BY score DESC, id LIMIT {limit}),"""


def _fast_sql(limit: int = 10, **kw) -> str:
    return _nearest_sql(2 * limit) + _page_sql("nearest", limit=limit, **kw)


_PAGE = ["id", "score", "weight", "level", "category"]


def _fast(s, d, columns=_PAGE, tags: bool = False, **kw):
    q = search.Query(vector(s, d), **({"threshold": -2.0} | kw))
    page = search.search(s, load(s, d, "memories"), load(s, d, "context_tags") if tags else None, None, q)
    return page.withColumn("score", F.round("score", 6)).select(*columns)


@query(_fast_sql())
def search_fast(s, d):
    return _fast(s, d)


@query(_fast_sql(where="level IN (2, 1)"))
def search_level_filter(s, d):
    return _fast(s, d, levels=[2, 1])


@query(_fast_sql(limit=40, where="category = 'src0'"))
def search_category_filter(s, d):
    return _fast(s, d, limit=40, category="src0")


@query(_fast_sql(limit=20, where="created_at >= TIMESTAMP '2024-01-01 06:00:00' AND created_at <= TIMESTAMP '2024-01-02 00:00:00'"))
def search_date_range(s, d):
    return _fast(s, d, limit=20, after=datetime(2024, 1, 1, 6), before=datetime(2024, 1, 2))


@query(_fast_sql(threshold="0.2D"))
def search_threshold(s, d):
    return _fast(s, d, threshold=0.2)


_MATCHES = """(SELECT count(*) FROM (SELECT memory_id, key, arg_max(value, id) AS value FROM context_tags GROUP BY memory_id, key) t
  WHERE t.memory_id = r.id AND ((t.key = 'lang' AND t.value = 'en') OR (t.key = 'source' AND t.value = 'src1')))"""


@query(_fast_sql(lift=f"CASE {_MATCHES} WHEN 0 THEN 0.0D WHEN 1 THEN 0.1D ELSE 0.2D END", threshold="0.25D"))
def search_context_boost(s, d):
    return _fast(s, d, tags=True, context={"lang": "en", "source": "src1"}, threshold=0.25)


@query(_fast_sql(limit=7, offset=5, columns="id, score, weight, level, category, total"))
def search_paginated(s, d):
    return _fast(s, d, [*_PAGE, "total"], limit=7, offset=5)


@query(_fast_sql().rpartition("SELECT")[0] + """SELECT e.source_id, e.target_id, e.weight, e.relation, e.edge_type
FROM edges e JOIN page p ON e.source_id = p.id OR e.target_id = p.id""")
def search_include_graph(s, d):
    return search.page_edges(load(s, d, "edges"), _fast(s, d)).select(*_EDGE)


# --- graph ---------------------------------------------------------------------------------------------------------


def _expand_sql(seeds: str, depth: int, limit: int) -> str:
    return f"""
a AS (SELECT source_id AS src, target_id AS dst, weight AS w FROM edges UNION ALL SELECT target_id, source_id, weight FROM edges WHERE edge_type = 'auto'),
bfs(id, d, w, path) AS (
  SELECT id, 0, 1.0D, [id] FROM (SELECT DISTINCT id FROM ({seeds}))
  UNION
  SELECT a.dst, bfs.d + 1, bfs.w * a.w, list_append(bfs.path, a.dst) FROM bfs JOIN a ON a.src = bfs.id
  WHERE bfs.d < {depth} AND NOT list_contains(bfs.path, a.dst)),
first AS (SELECT b.id, b.d, b.w, array_to_string(b.path, ',') AS path FROM bfs b JOIN memories m ON m.id = b.id
  WHERE b.d > 0 AND m.level >= 0 ORDER BY b.d, b.w DESC, array_to_string(b.path, ',') LIMIT {limit}),
reached AS (SELECT id, d, w AS weight, pow(0.5D, d) * w AS score
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, w DESC, path) AS r FROM first) WHERE r = 1)"""


@query(f"WITH RECURSIVE {_expand_sql(f'SELECT unnest([{quoted(SEEDS)}]) AS id', 3, 20)} SELECT id, d, weight, score FROM reached")
def graph_expand(s, d):
    return graph.expand(s, load(s, d, "memories"), load(s, d, "edges"), SEEDS, 3, 20)


@query(f"""WITH RECURSIVE {_expand_sql("SELECT 'mem_0' AS id", 2, 10)}
SELECT DISTINCT e.id AS edge_id, source_id, target_id FROM edges e JOIN (SELECT id FROM reached UNION SELECT 'mem_0') n ON e.source_id = n.id OR e.target_id = n.id""")
def graph_neighborhood(s, d):
    return graph.neighbourhood(s, load(s, d, "memories"), load(s, d, "edges"), "mem_0", 2, 10)[1].select(F.col("id").alias("edge_id"), "source_id", "target_id")


@query(_nearest_sql(10).replace("WITH ", "WITH RECURSIVE ", 1) + _expand_sql("SELECT id FROM nearest", 2, 30) + """,
deep AS (SELECT m.* REPLACE (r.weight AS weight), r.score FROM reached r JOIN memories m ON m.id = r.id),"""
       + _page_sql("deep", threshold="0.3D", columns="id, score, weight"))
def search_deep(s, d):
    q = search.Query(vector(s, d), mode="deep", degree_limit=30)
    page = search.search(s, load(s, d, "memories"), None, load(s, d, "edges"), q)
    return page.select("id", F.round("score", 6).alias("score"), "weight")


# --- retention -----------------------------------------------------------------------------------------------------

_DECIDED = f"""aged AS (SELECT *, greatest(date_sub('second', accessed_at, {NOW}), 0) AS age_seconds FROM memories WHERE level >= 0),
weighed AS (SELECT *, weight * exp(-CAST(age_seconds AS DOUBLE) * ln(2.0D) / 604800.0D) * least(1.0D + 0.1D * ln(1.0D + access_count) / ln(2.0D), 3.0D) AS new_weight FROM aged),
decided AS (SELECT *, CASE WHEN new_weight < 0.1D THEN 'archive' WHEN (level = 2 AND new_weight < 0.3D) OR (level = 1 AND new_weight < 0.2D) THEN 'downgrade' ELSE 'keep' END AS action FROM weighed)"""
_TICK = f"""{_DECIDED},
batch AS (SELECT * FROM decided ORDER BY accessed_at, id LIMIT 500),
next AS (SELECT m.id, CASE b.action WHEN 'archive' THEN -1 WHEN 'downgrade' THEN m.level - 1 ELSE m.level END AS level,
                CASE WHEN b.action IN ('archive', 'downgrade') THEN {NOW} ELSE m.updated_at END AS updated_at
         FROM memories m LEFT JOIN batch b ON b.id = m.id),
gone AS (SELECT id FROM next WHERE level = -1 AND updated_at < {NOW} - INTERVAL 28 DAY)"""


@query(f"WITH {_DECIDED} SELECT id, CAST(age_seconds AS BIGINT) AS age_seconds, round(new_weight, 9) AS new_weight FROM weighed")
def decay_weight(s, d):
    rows = lifecycle.decisions(lifecycle.candidates(load(s, d, "memories"), None), now(), CONF)
    return rows.select("id", "age_seconds", F.round("new_weight", 9).alias("new_weight"))


@query(f"WITH {_DECIDED} SELECT id, level, action, CAST(CASE action WHEN 'archive' THEN -1 WHEN 'downgrade' THEN level - 1 ELSE level END AS INTEGER) AS new_level FROM decided")
def forget_decide(s, d):
    return lifecycle.decisions(lifecycle.candidates(load(s, d, "memories"), None), now(), CONF).select("id", "level", "action", "new_level")


def _tick(s, d):
    return lifecycle.tick(load(s, d, "memories"), load(s, d, "edges"), load(s, d, "context_tags"), now(), CONF)


@query(f"WITH {_TICK} SELECT id, CAST(level AS INTEGER) AS level FROM next WHERE id NOT IN (SELECT id FROM gone)")
def forget_apply(s, d):
    return _tick(s, d).memories.select("id", "level")


@query(f"""WITH {_TICK} SELECT count(*) FILTER (action = 'archive') AS archived, count(*) FILTER (action = 'downgrade') AS downgraded, (SELECT count(*) FROM gone) AS cleaned FROM batch""")
def forget_summary(s, d):
    return _tick(s, d).summary


_GONE = f"gone AS (SELECT id FROM memories WHERE level = -1 AND updated_at < {NOW} - INTERVAL 28 DAY)"
_REST = """SELECT 'memories' AS table_name, count(*) AS n FROM memories WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'edges', count(*) FROM edges WHERE source_id NOT IN (SELECT id FROM gone) AND target_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'context_tags', count(*) FROM context_tags WHERE memory_id NOT IN (SELECT id FROM gone)"""


def _counts(tables):
    parts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("table_name"), "n") for k, t in zip(("memories", "edges", "context_tags"), tables, strict=True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {_GONE} {_REST}")
def purge_archived(s, d):
    m = load(s, d, "memories")
    return _counts(mutate.delete(m, load(s, d, "edges"), load(s, d, "context_tags"), lifecycle.expired(m, now(), 28)))


# --- mutations -----------------------------------------------------------------------------------------------------


@query("""SELECT m.id, greatest(m.accessed_at, coalesce(a.t, m.accessed_at)) AS accessed_at, access_count + coalesce(a.n, 0) AS access_count
FROM memories m LEFT JOIN (SELECT concat('mem_', user_id) AS id, max(ts) AS t, count(*) AS n FROM events GROUP BY user_id) a ON a.id = m.id""")
def touch_access(s, d):
    log = s.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("mem_"), "user_id").alias("id"), "ts")
    return mutate.touch(load(s, d, "memories"), log).select("id", "accessed_at", "access_count")


def _items(s, d):
    talk = s.read.parquet(f"{d}/conversations.parquet")
    odd = s.createDataFrame([("x0", ""), ("x1", "x" * 65_536), ("x2", "é" * 32_769), ("x3", None)], "idx string, content string")
    return talk.select(F.concat_ws("-", "conv_id", "turn").alias("idx"), F.col("text").alias("content"), F.create_map(F.lit("role"), "role").alias("context")).unionByName(odd, allowMissingColumns=True)


_ITEMS = """items AS (SELECT concat(conv_id, '-', turn) AS idx, text AS content FROM conversations
UNION ALL SELECT 'x0', '' UNION ALL SELECT 'x1', repeat('x', 65536) UNION ALL SELECT 'x2', repeat('é', 32769) UNION ALL SELECT 'x3', NULL),
marked AS (SELECT *, CASE WHEN content IS NULL OR content = '' OR octet_length(encode(content)) > 65536 THEN 'BAD_REQUEST' END AS error_code FROM items)"""


@query(f"WITH {_ITEMS} SELECT content, 'general' AS category, 1.0D AS weight, 2 AS level, true AS pending FROM marked WHERE error_code IS NULL")
def insert_memories(s, d):
    good = mutate.validate_writes(_items(s, d)).filter("error_code IS NULL")
    rows = mutate.insert_memories(load(s, d, "memories").limit(0), mutate.new_memories(good, now()))
    return rows.select("content", "category", "weight", "level", F.col("pending_consolidation").alias("pending"))


@query(f"WITH {_ITEMS} SELECT idx, error_code FROM marked")
def validate_writes(s, d):
    return mutate.validate_writes(_items(s, d)).select("idx", "error_code")


@query("""SELECT m.id, CASE WHEN doc_id % 10 = 0 THEN concat('new ', doc_id) ELSE content END AS content, CASE WHEN doc_id % 10 = 0 THEN true ELSE pending_consolidation END AS pending,
       CASE WHEN doc_id % 10 = 0 THEN doc_id % 20 = 0 ELSE m.embedding IS NULL END AS embedding_is_null
FROM memories m JOIN documents d ON m.id = concat('mem_', doc_id)""")
def update_memory(s, d):
    new = s.read.parquet(f"{d}/documents.parquet").filter("doc_id % 10 = 0").select(
        F.concat(F.lit("mem_"), "doc_id").alias("id"), F.concat(F.lit("new "), "doc_id").alias("content"), F.when(F.col("doc_id") % 20 != 0, F.array(F.lit(1.0).cast("float"))).alias("embedding")
    )
    return mutate.update_memories(load(s, d, "memories"), new, now()).select("id", "content", F.col("pending_consolidation").alias("pending"), F.col("embedding").isNull().alias("embedding_is_null"))


@query(f"WITH gone AS (SELECT unnest([{quoted(SEEDS)}]) AS id) {_REST}")
def delete_cascade(s, d):
    gone = s.createDataFrame([(i,) for i in SEEDS], "id string")
    return _counts(mutate.delete(load(s, d, "memories"), load(s, d, "edges"), load(s, d, "context_tags"), gone))


def _wanted(s, d):
    rows = s.read.parquet(f"{d}/lineitem.parquet").filter("l_quantity = 3")
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return rows.select(key.alias("idx"), F.concat(F.lit("mem_"), F.col("l_orderkey") % 1200).alias("source_id"), F.concat(F.lit("mem_"), F.col("l_partkey") % 1200).alias("target_id"), F.col("l_discount").alias("weight"), F.col("l_returnflag").alias("relation"))


_WANTED = """wanted AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, concat('mem_', l_orderkey % 1200) AS source_id,
  concat('mem_', l_partkey % 1200) AS target_id, l_discount AS weight, l_returnflag AS relation FROM lineitem WHERE l_quantity = 3)"""


@query(f"""WITH {_WANTED},
fresh AS (SELECT *, row_number() OVER (PARTITION BY source_id, target_id, relation ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r FROM wanted
  WHERE source_id IN (SELECT id FROM memories) AND target_id IN (SELECT id FROM memories))
SELECT source_id, target_id, relation, weight FROM fresh f WHERE r = 1
AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.source_id = f.source_id AND e.target_id = f.target_id AND e.relation = f.relation)""")
def insert_edges(s, d):
    return mutate.insert_edges(load(s, d, "edges"), _wanted(s, d), load(s, d, "memories"), now()).select("source_id", "target_id", "relation", "weight")


@query(f"""WITH {_WANTED} SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, l_partkey, CASE WHEN source_id = target_id THEN 'BAD_REQUEST'
  WHEN source_id NOT IN (SELECT id FROM memories) OR target_id NOT IN (SELECT id FROM memories) THEN 'NOT_FOUND' END AS error_code FROM wanted""")
def validate_edges(s, d):
    return mutate.validate_edges(_wanted(s, d), load(s, d, "memories")).select("idx.l_orderkey", "idx.l_partkey", "error_code")


def _all_wanted(s, d):
    """All of lineitem as candidates; one id in six lies beyond the documents."""
    n = s.read.parquet(f"{d}/documents.parquet").count() * 6 // 5
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    end = lambda c, name: F.concat(F.lit("mem_"), F.col(c) % n).alias(name)
    return s.read.parquet(f"{d}/lineitem.parquet").select(key.alias("idx"), end("l_orderkey", "source_id"), end("l_partkey", "target_id"), F.col("l_discount").alias("weight"), F.col("l_returnflag").alias("relation"))


_ALL_WANTED = """wanted AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, concat('mem_', l_orderkey % n) AS source_id,
  concat('mem_', l_partkey % n) AS target_id, l_discount AS weight, l_returnflag AS relation FROM lineitem CROSS JOIN (SELECT count(*) * 6 // 5 AS n FROM documents))"""


@query(f"""WITH {_ALL_WANTED},
fresh AS (SELECT *, row_number() OVER (PARTITION BY source_id, target_id, relation ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r FROM wanted
  WHERE source_id IN (SELECT id FROM memories) AND target_id IN (SELECT id FROM memories))
SELECT source_id, target_id, relation, weight FROM fresh f WHERE r = 1
AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.source_id = f.source_id AND e.target_id = f.target_id AND e.relation = f.relation)""")
def insert_edges_all(s, d):
    return mutate.insert_edges(load(s, d, "edges"), _all_wanted(s, d), load(s, d, "memories"), now()).select("source_id", "target_id", "relation", "weight")


@query(f"""WITH {_ALL_WANTED} SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, l_partkey, CASE WHEN source_id = target_id THEN 'BAD_REQUEST'
  WHEN source_id NOT IN (SELECT id FROM memories) OR target_id NOT IN (SELECT id FROM memories) THEN 'NOT_FOUND' END AS error_code FROM wanted""")
def validate_edges_all(s, d):
    return mutate.validate_edges(_all_wanted(s, d), load(s, d, "memories")).select("idx.l_orderkey", "idx.l_partkey", "error_code")


# --- consolidation -------------------------------------------------------------------------------------------------


def _answer(s, d):
    """A stub's answer on the pending memories: first letters, links to the fifth next id, and inventions."""
    batch = consolidate.pending(load(s, d, "memories"), 300).select("id", "content")
    n = F.substring("id", 5, 20).cast("bigint")
    notes = batch.select("id", F.substring("content", 1, 40).alias("abstract")).unionByName(s.createDataFrame([("mem_x", "invented"), ("mem_y", "invented")], "id string, abstract string"))
    links = batch.select(n.cast("int").alias("idx"), F.col("id").alias("source_id"), F.concat(F.lit("mem_"), F.when(n % 7 == 0, n).otherwise(n + 5)).alias("target_id"), F.lit("follows").alias("relation"), F.lit(0.5).alias("weight"))
    return batch, notes, links


_ANSWER = """batch AS (SELECT id, content, CAST(substr(id, 5) AS BIGINT) AS n FROM memories WHERE pending_consolidation ORDER BY created_at, id LIMIT 300),
links AS (SELECT n AS idx, id AS source_id, concat('mem_', CASE WHEN n % 7 = 0 THEN n ELSE n + 5 END) AS target_id FROM batch),
good AS (SELECT * FROM links WHERE target_id IN (SELECT id FROM batch) AND source_id <> target_id)"""


@query(f"""WITH {_ANSWER} SELECT 'abstract' AS kind, (SELECT count(*) FROM batch) AS accepted, CAST(2 AS BIGINT) AS rejected
UNION ALL SELECT 'edge', (SELECT count(*) FROM good), (SELECT count(*) FROM links) - (SELECT count(*) FROM good)""")
def consolidate_validate(s, d):
    return consolidate.checked(*_answer(s, d)).summary


@query(f"WITH {_ANSWER} SELECT m.id, CASE WHEN b.id IS NULL THEN m.abstract ELSE substr(m.content, 1, 40) END AS abstract, m.pending_consolidation AND b.id IS NULL AS pending FROM memories m LEFT JOIN batch b ON b.id = m.id")
def consolidate_apply(s, d):
    done = consolidate.apply(load(s, d, "memories"), load(s, d, "edges"), consolidate.checked(*_answer(s, d)), now())
    return done.memories.select("id", "abstract", F.col("pending_consolidation").alias("pending"))


# --- counts and embedding ------------------------------------------------------------------------------------------


@query("SELECT (SELECT count(*) FROM memories) AS total_memories, (SELECT count(*) FROM edges) AS total_edges, (SELECT count(*) FROM memories WHERE pending_consolidation) AS pending_consolidation", name="stats")
def _stats(s, d):
    return stats.stats(load(s, d, "memories"), load(s, d, "edges"))


@query("SELECT level, count(*) AS n, CASE level WHEN 2 THEN 'full' WHEN 1 THEN 'summary' WHEN 0 THEN 'title' ELSE 'archived' END AS name FROM memories GROUP BY level")
def stats_by_level(s, d):
    return stats.by_level(load(s, d, "memories"))


@query("SELECT * FROM consolidate_log ORDER BY id DESC LIMIT 20")
def consolidation_log(s, d):
    return stats.latest(load(s, d, "consolidate_log"))


@query("""WITH raw AS (SELECT id, list_transform(range(8), lambda i: ('0x' || substr(sha256(sha256(content) || ':' || i), 1, 8))::UBIGINT::DOUBLE / 2147483648.0D - 1.0D) AS v FROM memories)
SELECT id, round(v[1] / n, 6) AS c0, round(v[2] / n, 6) AS c1, round(v[3] / n, 6) AS c2, round(v[4] / n, 6) AS c3 FROM (SELECT id, v, sqrt(list_inner_product(v, v)) AS n FROM raw)""", name="hash_embedding")
def _hash_embedding(s, d):
    e = load(s, d, "memories").select("id", hash_embedding(F.col("content"), 8).alias("e"))
    return e.select("id", *[F.round(F.get("e", F.lit(i)), 6).alias(f"c{i}") for i in range(4)])

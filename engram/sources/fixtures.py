"""Engine tables from the driver's test tables, in SQL that runs in Spark and, by rule, in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

MEMORIES = """
SELECT concat('mem_', d.doc_id) AS id, d.text AS content, '' AS abstract, d.source AS category, 0.4D + 0.1D * (d.doc_id % 7) AS weight,
       CASE d.doc_id % 8 WHEN 5 THEN 1 WHEN 6 THEN 0 WHEN 7 THEN -1 ELSE 2 END AS level, l.doc_id IS NULL AS pending_consolidation,
       e.embedding AS embedding, concat('{"lang":"', d.lang, '","n_chars":', d.n_chars, '}') AS metadata,
       c.ts AS created_at, u.ts AS updated_at, a.ts AS accessed_at, coalesce(n.n, 0) AS access_count
FROM documents d
LEFT JOIN labels l ON l.doc_id = d.doc_id
LEFT JOIN embeddings e ON e.vec_id = d.doc_id
JOIN events c ON c.event_id = d.doc_id
JOIN events u ON u.event_id = d.doc_id * 2
JOIN events a ON a.event_id = d.doc_id * 5
LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) n ON n.user_id = d.doc_id % (SELECT max(user_id) + 1 FROM events)"""
CONTEXT_TAGS = """
SELECT doc_id * 10 AS id, concat('mem_', doc_id) AS memory_id, 'lang' AS key, lang AS value FROM documents
UNION ALL SELECT doc_id * 10 + 1, concat('mem_', doc_id), 'source', source FROM documents
UNION ALL SELECT doc_id * 10 + 2, concat('mem_', doc_id), 'quality', CAST(quality AS STRING) FROM labels
UNION ALL SELECT doc_id * 10 + 3, concat('mem_', doc_id), 'lang', 'override' FROM documents WHERE doc_id % 50 = 0"""
EDGES = """
SELECT CAST(row_number() OVER (ORDER BY source_id, target_id, relation) AS BIGINT) AS id, source_id, target_id, weight, relation, edge_type,
       created_at, created_at AS updated_at
FROM (
  SELECT *, row_number() OVER (PARTITION BY source_id, target_id, relation ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn
  FROM (
    SELECT concat('mem_', l_orderkey % n.n) AS source_id, concat('mem_', l_partkey * 7 % n.n) AS target_id, 1.0D - l_discount AS weight,
           l_returnflag AS relation, CASE WHEN l_linestatus = 'F' THEN 'auto' ELSE 'manual' END AS edge_type, l_shipdate AS created_at,
           l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
    FROM lineitem CROSS JOIN (SELECT count(*) AS n FROM documents) n WHERE l_quantity <= 2)
  WHERE source_id <> target_id)
WHERE rn = 1"""
LOG = """
SELECT CAST(row_number() OVER (ORDER BY min(ts)) AS BIGINT) AS id, min(ts) AS started_at, max(ts) AS finished_at, count(*) AS memories_processed,
       count(CASE WHEN event_type = 'purchase' THEN 1 END) AS edges_created, count(CASE WHEN event_type = 'error' THEN 1 END) AS errors
FROM events GROUP BY date_trunc('day', ts)"""
TABLES = {"memories": MEMORIES, "context_tags": CONTEXT_TAGS, "edges": EDGES, "consolidate_log": LOG}
_SOURCES = ("documents", "labels", "embeddings", "events", "lineitem")


_WRITTEN: dict[str, str] = {}


def materialise(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Writes the engine tables of sf_dir below a folder, from which load() reads them from then on."""
    for name in TABLES:
        load(spark, sf_dir, name).write.mode("overwrite").parquet(f"{folder}/{name}")
    _WRITTEN[sf_dir] = folder


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An engine table over the parquet files of sf_dir."""
    if sf_dir in _WRITTEN:
        return spark.read.parquet(f"{_WRITTEN[sf_dir]}/{name}")
    query = TABLES[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _SOURCES if re.search(rf"\b{t}\b", query)}
    sql = re.sub(rf"\b(FROM|JOIN) ({'|'.join(used)})\b", r"\1 {\2}", query).replace('{"lang":"', '{{"lang":"').replace("'}'", "'}}'")
    return spark.sql(sql, **used)


def duckdb(query: str) -> str:
    """The query in DuckDB's words, with the engine tables in front."""
    views = ", ".join(f"{k} AS ({v})" for k, v in TABLES.items() if re.search(rf"\b{k}\b", query))
    recursive = "RECURSIVE " if "RECURSIVE" in query else ""
    query = query.strip().removeprefix("WITH RECURSIVE").removeprefix("WITH")
    joint = "," if re.match(r"\s*\w+(\([^)]*\))? AS \(", query) else ""
    text = f"WITH {recursive}{views}{joint} {query}" if views else f"{'WITH ' + recursive if joint else ''}{query}"
    return re.sub(r"\b(\d+\.\d+)D\b", r"\1::DOUBLE", text).replace("AS STRING", "AS VARCHAR")

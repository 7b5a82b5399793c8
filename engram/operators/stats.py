"""Counts and the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.functions.text import level_name


def stats(memories: DataFrame, edges: DataFrame) -> DataFrame:
    """total_memories, total_edges, pending_consolidation in one row."""
    m = memories.agg(F.count(F.lit(1)).alias("total_memories"), F.count_if("pending_consolidation").alias("pending_consolidation"))
    return m.join(F.broadcast(edges.agg(F.count(F.lit(1)).alias("total_edges"))), how="cross").select("total_memories", "total_edges", "pending_consolidation")


def by_level(memories: DataFrame) -> DataFrame:
    return memories.groupBy("level").agg(F.count(F.lit(1)).alias("n")).withColumn("name", level_name(F.col("level")))


def latest(log: DataFrame, limit: int = 20) -> DataFrame:
    """Log rows, newest first; the limit is held within 1 and 1000."""
    return log.orderBy(F.desc("id")).limit(max(1, min(limit, 1000)))


#: Upper ends of the latency classes, in seconds.
LATENCY_ENDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


def requests(log: DataFrame) -> DataFrame:
    """Counts and latency classes by method, path and status of a request log (method, path, status, seconds)."""
    at_most = [F.count_if(F.col("seconds") <= e).alias(f"le_{e:g}") for e in LATENCY_ENDS]
    return log.groupBy("method", "path", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("seconds").alias("seconds"), *at_most)

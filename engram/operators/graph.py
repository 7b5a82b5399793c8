"""Edges and bounded graph diffusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.schema import MAX_DEGREE, MAX_DEPTH


def adjacency(edges: DataFrame) -> DataFrame:
    """src, dst, step: every edge forward, and automatic ones backward too, so that one equi-join takes the place of an OR."""
    end = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), F.col("weight").alias("step"))
    forward, back = end("source_id", "target_id"), end("target_id", "source_id")
    return edges.select(F.explode(F.when(F.col("edge_type") == "auto", F.array(forward, back)).otherwise(F.array(forward))).alias("e")).select("e.*")


def incident(edges: DataFrame, members: DataFrame) -> DataFrame:
    """member_id and each edge that touches it; an edge between two members comes twice.  members: member_id, distinct."""
    ends = [edges.withColumn("member_id", F.col(c)) for c in ("source_id", "target_id")]
    ends[1] = ends[1].filter("source_id <> target_id")
    return ends[0].unionByName(ends[1]).join(members, "member_id", "left_semi")


def edges_of(edges: DataFrame, member: str) -> DataFrame:
    return edges.filter((F.col("source_id") == member) | (F.col("target_id") == member))


def expand(spark: SparkSession, memories: DataFrame, edges: DataFrame, seeds: DataFrame | list[str], depth: int, row_limit: int) -> DataFrame:
    """id, d, weight, score of what diffusion from the seeds reaches.

    Paths are simple, run through archived memories but do not end there.  The limit (MAX_DEGREE at most) holds for path rows,
    nearest and heaviest first, and of each id the first row stays, so fewer ids may come out.  The score halves with each step.

    One job a level: nearer rows come first, so the search ends at the level where the limit is reached, and of each level only
    rows within the limit come to the driver.  Paths of deeper levels are never made.
    """
    depth, row_limit = min(depth, MAX_DEPTH), min(row_limit, MAX_DEGREE)
    start = spark.createDataFrame([(s,) for s in seeds], "id string") if isinstance(seeds, list) else seeds.select("id")
    front = start.distinct().select("id", F.lit(1.0).alias("w"), F.array("id").alias("path"))
    alive, adjacent = memories.filter("level >= 0").select("id"), adjacency(edges)
    found, held = {}, []
    left = row_limit if seeds or not isinstance(seeds, list) else 0
    for d in range(1, depth + 1):
        if left <= 0:
            break
        step = front.join(adjacent, F.col("id") == F.col("src")).filter(~F.array_contains("path", F.col("dst")))
        front = step.select(F.col("dst").alias("id"), (F.col("w") * F.col("step")).alias("w"), F.array_append("path", F.col("dst")).alias("path")).distinct()
        if d < depth:
            front = front.persist()
            held.append(front)
        rows = front.join(alive, "id").select("id", "w", F.array_join("path", ",").alias("path")).orderBy(F.desc("w"), "path").limit(left).collect()
        left -= len(rows)
        for r in rows:
            found.setdefault(r.id, (r.id, d, r.w, 0.5**d * r.w))
    for df in held:
        df.unpersist()
    return spark.createDataFrame(list(found.values()), "id string, d int, weight double, score double")


def neighbourhood(spark: SparkSession, memories: DataFrame, edges: DataFrame, centre: str, depth: int, row_limit: int) -> tuple[DataFrame, DataFrame]:
    """What diffusion from the centre reaches, and the distinct edges that touch it or the centre."""
    near = expand(spark, memories, edges, [centre], max(1, depth), row_limit)
    members = near.select(F.col("id").alias("member_id")).unionByName(spark.createDataFrame([(centre,)], "member_id string")).distinct()
    return near, incident(edges, F.broadcast(members)).drop("member_id").dropDuplicates(["id"])

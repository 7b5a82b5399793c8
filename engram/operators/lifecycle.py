"""Retention: candidates, decisions, application and purge."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions.retention import action, age_seconds, new_level, retained
from engram.operators import mutate
from engram.schema import Forgetting


def candidates(memories: DataFrame, limit: int | None) -> DataFrame:
    """Memories that are not archived, those not seen for longest first."""
    alive = memories.filter("level >= 0")
    return alive if limit is None else alive.orderBy("accessed_at", "id").limit(limit)


def decisions(rows: DataFrame, now: Column, conf: Forgetting) -> DataFrame:
    """id, level, age_seconds, new_weight, action, new_level."""
    weighed = rows.select("id", "level", age_seconds(now).alias("age_seconds"), retained(now, conf).alias("new_weight"))
    decided = weighed.withColumn("action", action(F.col("new_weight"), conf))
    return decided.withColumn("new_level", new_level(F.col("action")))


def expired(memories: DataFrame, now: Column, days: int) -> DataFrame:
    """id of archived memories not updated for more than ``days``."""
    return memories.filter((F.col("level") == -1) & (F.col("updated_at") < now - F.make_dt_interval(F.lit(days)))).select("id")


@dataclass
class Tick:
    memories: DataFrame
    edges: DataFrame
    tags: DataFrame
    summary: DataFrame
    levels: DataFrame
    gone: DataFrame


def tick(memories: DataFrame, edges: DataFrame, tags: DataFrame, now: Column, conf: Forgetting, batch: int | None = None) -> Tick:
    """One forgetting tick: decide on a batch, apply, purge with cascade.

    If nothing is left to decide on, nothing is purged either.  summary: archived, downgraded, cleaned.  levels (id, new_level)
    and gone (id) say what changes.
    """
    batch = conf.batch_size if batch is None else batch
    decided = decisions(candidates(memories, batch), now, conf)
    levels = decided.filter("action <> 'keep'").select("id", "new_level")
    changed = mutate.set_levels(memories, levels, now)
    any_alive = memories.filter("level >= 0").agg((F.count(F.lit(1)) > 0).alias("alive"))
    gone = expired(changed, now, conf.archive_days).join(F.broadcast(any_alive.filter("alive")), how="cross").select("id")
    rest = mutate.delete(changed, edges, tags, gone)
    counts = decided.agg(F.count_if(F.col("action") == "archive").alias("archived"), F.count_if(F.col("action") == "downgrade").alias("downgraded"))
    summary = counts.join(F.broadcast(gone.agg(F.count(F.lit(1)).alias("cleaned"))), how="cross")
    return Tick(*rest, summary, levels, gone)

"""Context tags: key/value rows of memories, the last row of a key winning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_values(tags: DataFrame) -> DataFrame:
    """memory_id, key, value: of each memory's keys the value with the largest row id."""
    return tags.groupBy("memory_id", "key").agg(F.max_by("value", "id").alias("value"))


def maps(tags: DataFrame) -> DataFrame:
    """memory_id, context: one map a memory.  Keys are unique by then, so no policy for repeated keys is needed."""
    return last_values(tags).groupBy("memory_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("context"))


def with_context(memories: DataFrame, tags: DataFrame, bounded: bool = False) -> DataFrame:
    """memories with ``context`` (empty where there are no tags).  bounded: memories are a page; only their tags are gathered."""
    own = tags.join(F.broadcast(memories.select(F.col("id").alias("memory_id")).distinct()), "memory_id", "left_semi") if bounded else tags
    found = maps(own).withColumnRenamed("memory_id", "id")
    return memories.join(found, "id", "left").withColumn("context", F.coalesce("context", F.create_map().cast("map<string,string>")))


def matching(tags: DataFrame, wanted: list[tuple[str, str]]) -> DataFrame:
    """memory_id of memories with any of the wanted (key, value) pairs; nothing wanted matches nothing."""
    if not wanted:
        return tags.select("memory_id").limit(0)
    any_of = reduce(lambda a, b: a | b, [(F.col("key") == k) & (F.col("value") == v) for k, v in wanted])
    return tags.filter(any_of).select("memory_id").distinct()


def insert_tag(tags: DataFrame, new: DataFrame) -> DataFrame:
    """tags with new rows (id, memory_id, key, value); repeated keys are allowed."""
    return tags.unionByName(new)

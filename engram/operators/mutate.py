"""Mutations as pure functions: tables in, next tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.schema import MAX_CONTENT_BYTES, MemoryNotFound


def content_error(content: Column) -> Column:
    """'BAD_REQUEST' for empty (or null) and over-long contents, else null."""
    bad = content.isNull() | (content == "") | (F.octet_length(content) > MAX_CONTENT_BYTES)
    return F.when(bad, F.lit("BAD_REQUEST"))


def validate_writes(items: DataFrame) -> DataFrame:
    """items with ``error_code`` of each."""
    return items.withColumn("error_code", content_error(F.col("content")))


def new_memories(items: DataFrame, now: Column, make_id: Column | None = None) -> DataFrame:
    """Rows to insert from items (content; optionally category, embedding, metadata, context).

    Ids are random unless given: write the result once before it is read twice.
    """
    have = set(items.columns)
    pick = lambda c, default, kind: F.coalesce(F.col(c).cast(kind), default) if c in have else default
    out = items.select(
        (F.concat(F.lit("mem_"), F.uuid()) if make_id is None else make_id).alias("id"), "content", F.lit("").alias("abstract"), pick("category", F.lit("general"), "string").alias("category"),
        F.lit(1.0).alias("weight"), F.lit(2).alias("level"), F.lit(True).alias("pending_consolidation"), (F.col("embedding") if "embedding" in have else F.lit(None).cast("array<float>")).alias("embedding"),
        pick("metadata", F.lit("{}"), "string").alias("metadata"), now.alias("created_at"), now.alias("updated_at"), now.alias("accessed_at"), F.lit(0).cast("bigint").alias("access_count"),
        *(["context"] if "context" in have else []),
    )
    return out


def new_tags(inserted: DataFrame, after: int) -> DataFrame:
    """Tag rows of inserted memories (id, context), numbered from ``after`` on.

    Each partition counts its rows first (one row each reaches the driver) and then numbers them from its own offset, so
    ``inserted`` must come in the same partitions each time, as a scan or a list does.
    """
    flat = inserted.select(F.col("id").alias("memory_id"), F.explode(F.map_entries("context")).alias("e")).select("memory_id", "e.key", "e.value")
    numbered = flat.withColumn("_u", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_u", 33).cast("int"))
    at, bases = after + 1, []
    for r in numbered.groupBy("_p").count().orderBy("_p").collect():
        bases.append((r["_p"], at))
        at += r["count"]
    base = inserted.sparkSession.createDataFrame(bases, "_p int, _base bigint")
    place = F.col("_base") + F.col("_u").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.join(F.broadcast(base), "_p").select(place.alias("id"), "memory_id", "key", "value")


def insert_memories(memories: DataFrame, inserted: DataFrame) -> DataFrame:
    return memories.unionByName(inserted.select(*memories.columns))


def update_memories(memories: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """updates: id, content, embedding (null removes it).  Other columns stay, but the rows are pending again."""
    u = updates.select("id", F.col("content").alias("_c"), F.col("embedding").alias("_e"), F.lit(True).alias("_hit"))
    changed = {"content": F.col("_c"), "embedding": F.col("_e"), "pending_consolidation": F.lit(True), "updated_at": now}
    return _patched(memories, u, changed)


def _patched(memories: DataFrame, patch: DataFrame, changed: dict[str, Column]) -> DataFrame:
    joined = memories.join(patch, "id", "left")
    hit = F.col("_hit").isNotNull()
    return joined.select(*[F.when(hit, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in memories.columns])


def replaced(memories: DataFrame, rows: DataFrame) -> DataFrame:
    """memories with ``rows`` (a batch, as small as its caller's limit) in place of those with their ids."""
    return memories.join(F.broadcast(rows.select("id")), "id", "left_anti").unionByName(rows.select(*memories.columns))


def set_levels(memories: DataFrame, levels: DataFrame, now: Column) -> DataFrame:
    """levels: id, new_level; unknown ids do nothing."""
    patch = levels.select("id", F.col("new_level").alias("_l"), F.lit(True).alias("_hit"))
    return _patched(memories, patch, {"level": F.col("_l").cast("int"), "updated_at": now})


def set_abstracts(memories: DataFrame, abstracts: DataFrame, now: Column) -> DataFrame:
    """abstracts: id, abstract."""
    patch = abstracts.select("id", F.col("abstract").alias("_a"), F.lit(True).alias("_hit"))
    return _patched(memories, patch, {"abstract": F.col("_a"), "updated_at": now})


def mark_consolidated(memories: DataFrame, ids: DataFrame, strict: bool = False) -> DataFrame:
    """No longer pending; updated_at stays.  strict: MemoryNotFound if an id is unknown; else such ids do nothing."""
    if strict:
        unknown = ids.select("id").distinct().join(memories.select("id"), "id", "left_anti").first()
        if unknown is not None:
            raise MemoryNotFound(unknown.id)
    return _patched(memories, ids.select("id").distinct().withColumn("_hit", F.lit(True)), {"pending_consolidation": F.lit(False)})


def touch(memories: DataFrame, accesses: DataFrame) -> DataFrame:
    """Folds an access log (id, ts) in: the latest access, and one count each."""
    folded = accesses.groupBy("id").agg(F.max("ts").alias("_t"), F.count(F.lit(1)).alias("_n")).withColumn("_hit", F.lit(True))
    return _patched(memories, folded, {"accessed_at": F.greatest("accessed_at", "_t"), "access_count": F.col("access_count") + F.col("_n")})


def delete(memories: DataFrame, edges: DataFrame, tags: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables without the memories of ids (id), their edges and their tags."""
    gone = ids.select("id")
    as_ = lambda c: gone.select(F.col("id").alias(c))
    rest = edges.join(as_("source_id"), "source_id", "left_anti").join(as_("target_id"), "target_id", "left_anti").select(*edges.columns)
    return memories.join(gone, "id", "left_anti"), rest, tags.join(as_("memory_id"), "memory_id", "left_anti").select(*tags.columns)


def validate_edges(candidates: DataFrame, memories: DataFrame) -> DataFrame:
    """candidates (idx, source_id, target_id, ...) with ``error_code``: self edges first, then unknown sources, then targets."""
    known = memories.select("id").distinct()
    s, t = (known.select(F.col("id").alias(c), F.lit(True).alias(f"_{c}")) for c in ("source_id", "target_id"))
    code = F.when(F.col("source_id") == F.col("target_id"), "BAD_REQUEST").when(F.col("_source_id").isNull() | F.col("_target_id").isNull(), "NOT_FOUND")
    return candidates.join(s, "source_id", "left").join(t, "target_id", "left").withColumn("error_code", code).select(*candidates.columns, "error_code")


def insert_edges(edges: DataFrame, new: DataFrame, memories: DataFrame, now: Column, order: str = "idx") -> DataFrame:
    """Rows that new edges (order, source_id, target_id; optionally weight, relation, edge_type) add to edges, without ids.

    Ends must exist; of one (source, target, relation) the first writer wins.
    """
    have = set(new.columns)
    default = lambda c, v: F.coalesce(F.col(c), F.lit(v)) if c in have else F.lit(v)
    full = new.select(order, "source_id", "target_id", default("weight", 1.0).cast("double").alias("weight"), default("relation", "related").alias("relation"), default("edge_type", "manual").alias("edge_type"))
    known = memories.select("id").distinct()
    for c in ("source_id", "target_id"):
        full = full.join(known.select(F.col("id").alias(c)), c, "left_semi")
    key = ["source_id", "target_id", "relation"]
    first = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    fresh = full.filter(F.col("edge_type").isin("auto", "manual")).withColumn("_r", first).filter("_r = 1").join(edges.select(*key), key, "left_anti")
    return fresh.select("source_id", "target_id", "weight", "relation", "edge_type", now.alias("created_at"), now.alias("updated_at"))


def existing(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """Those of ids (id) that are there."""
    return ids.select("id").distinct().join(memories.select("id"), "id", "left_semi")


def exists(memories: DataFrame, id_: str) -> bool:
    return not memories.filter(F.col("id") == id_).isEmpty()


def get(memories: DataFrame, id_: str) -> DataFrame:
    """The memory without its embedding."""
    return memories.filter(F.col("id") == id_).drop("embedding")

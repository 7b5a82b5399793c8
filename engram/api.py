"""One object for all of the engine's requests on a store."""

from __future__ import annotations

import time
from dataclasses import replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from engram.functions.text import parse_context, parse_levels, parse_time
from engram.metrics import Metrics
from engram.operators import consolidate, context, graph, mutate, stats
from engram.operators.embed import with_embedding
from engram.plans import search
from engram.schema import MAX_BATCH, MAX_DEGREE, MAX_DEPTH, Config, MemoryNotFound, ValidationError
from engram.sources.index import CellIndex
from engram.sources.store import Store
from engram.streaming import jobs


def utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


class Engine:
    """Requests as methods.  Those that change something are one commit each; those that only read return DataFrames."""

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None, consolidator: consolidate.Consolidator | None = None):
        self.spark, self.config = spark, config or Config()
        self.consolidator = consolidator or consolidate.chosen(self.config.consolidation)
        self.requests = Metrics()
        self.store, self._since = Store(spark, path), time.monotonic()
        self.index = CellIndex(self.store)

    def _tables(self, base: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        return tuple(self.store.table(t, base) for t in ("memories", "edges", "context_tags"))

    def _next_id(self, table: str, base: int) -> int:
        return (self.store.table(table, base).agg(F.max("id")).first()[0] or 0) + 1

    # --- writes ---

    def write(self, content: str, tags: dict[str, str] | None = None, category: str = "general") -> str:
        done = self.write_batch([{"content": content, "context": tags or {}, "category": category}])
        if done[0]["error"]:
            raise ValidationError(done[0]["error"])
        return done[0]["id"]

    def write_batch(self, items: list[dict]) -> list[dict]:
        """id or error code of each item (content; optionally context, category, metadata), in order."""
        if len(items) > MAX_BATCH:
            raise ValidationError(f"more than {MAX_BATCH} items")
        rows = [(i, x.get("content"), x.get("category"), x.get("metadata"), x.get("context") or {}) for i, x in enumerate(items)]
        df = self.spark.createDataFrame(rows, "idx int, content string, category string, metadata string, context map<string,string>")
        return [{"index": r.idx, "id": r.id, "error": r.error_code} for r in self.write_table(df).orderBy("idx").collect()]

    def write_table(self, items: DataFrame) -> DataFrame:
        """As write_batch for a DataFrame of any size: idx, id, error_code of each item.

        Ids follow from the commit and idx, so a lost task makes them again alike.
        """
        base, now = self.store.version(), F.lit(utc_now()).cast("timestamp_ntz")
        marked = mutate.validate_writes(items)
        salt = self.spark.sql("SELECT uuid()").first()[0]
        named = marked.withColumn("_id", F.when(F.col("error_code").isNull(), F.concat(F.lit("mem_"), F.sha2(F.concat(F.lit(salt), F.lit(":"), F.col("idx").cast("string")), 224))))
        embedded = with_embedding(named.filter("error_code IS NULL"), "content", self.config.embedder)
        fresh = mutate.new_memories(embedded, now, F.col("_id"))
        self.store.commit({}, base, add={"memories": fresh, "context_tags": mutate.new_tags(fresh, self._next_id("context_tags", base) - 1)})
        return named.select("idx", F.col("_id").alias("id"), "error_code")

    def update(self, id_: str, content: str) -> None:
        base = self.store.version()
        new = with_embedding(self.spark.createDataFrame([(id_, content)], "id string, content string"), "content", self.config.embedder)
        if not mutate.exists(self.store.table("memories", base), id_):
            raise MemoryNotFound(id_)
        now = F.lit(utc_now()).cast("timestamp_ntz")
        self.store.commit({}, base, change={"memories": (new, lambda part: mutate.update_memories(part, new, now))})

    def delete(self, id_: str) -> None:
        base = self.store.version()
        memories, edges, tags = self._tables(base)
        if not mutate.exists(memories, id_):
            raise MemoryNotFound(id_)
        gone = self.spark.createDataFrame([(id_,)], "id string")
        owned = gone.withColumnRenamed("id", "memory_id")
        change = {"memories": (gone, lambda part: part.join(F.broadcast(gone), "id", "left_anti")), "context_tags": (owned, lambda part: part.join(F.broadcast(owned), "memory_id", "left_anti").select(*tags.columns))}
        linked = not graph.edges_of(edges, id_).isEmpty()
        self.store.commit({"edges": mutate.delete(memories, edges, tags, gone)[1]} if linked else {}, base, change=change)

    def relate(self, source: str, target: str, relation: str = "related", weight: float = 1.0) -> None:
        error = self.relate_batch([{"source_id": source, "target_id": target, "relation": relation, "weight": weight}])[0]
        if error:
            raise (ValidationError if error == "BAD_REQUEST" else MemoryNotFound)(f"{source} -> {target}")

    def relate_batch(self, items: list[dict]) -> list[str | None]:
        """Adds manual edges; the error code of each item, or None (also where the edge was there already)."""
        if len(items) > MAX_BATCH:
            raise ValidationError(f"more than {MAX_BATCH} items")
        base = self.store.version()
        memories, edges, _ = self._tables(base)
        df = self.spark.createDataFrame([(i, x["source_id"], x["target_id"], x.get("relation"), x.get("weight")) for i, x in enumerate(items)], "idx int, source_id string, target_id string, relation string, weight double")
        marked = mutate.validate_edges(df, memories)
        good = marked.filter("error_code IS NULL")
        fresh = mutate.insert_edges(edges, good, memories, F.lit(utc_now()).cast("timestamp_ntz")).collect()
        if fresh:
            first = self._next_id("edges", base)
            rows = [(first + i, *r) for i, r in enumerate(fresh)]
            self.store.commit({}, base, add={"edges": self.spark.createDataFrame(rows, edges.schema)})
        return [r.error_code for r in marked.orderBy("idx").collect()]

    # --- reads ---

    def get(self, id_: str) -> Row:
        memories, _, tags = self._tables(self.store.version())
        row = context.with_context(mutate.get(memories, id_), tags, bounded=True).first()
        if row is None:
            raise MemoryNotFound(id_)
        return row

    def query(self, text: str, *, levels: str | None = None, after: str | None = None, before: str | None = None, context: str | None = None, threshold: float | None = None, **kw) -> search.Query:
        """A Query from request texts: what to look for, level names, RFC 3339 dates, and wished tags as a JSON object."""
        if not text:
            raise ValidationError("nothing to look for")
        row = with_embedding(self.spark.createDataFrame([(text,)], "content string"), "content", self.config.embedder).first()
        r = self.config.retrieval
        kw = {"limit": r.fast_default_limit, "depth": r.default_depth, "degree_limit": r.default_degree_limit} | kw
        return search.Query(
            list(row.embedding), levels=None if levels is None else parse_levels(levels), after=parse_time(after) if after else None, before=parse_time(before) if before else None,
            context=parse_context(context), threshold=r.score_threshold if threshold is None else threshold, **kw,
        )

    def search(self, query: search.Query) -> DataFrame:
        memories, edges, tags = self._tables(self.store.version())
        return search.search(self.spark, memories, tags, edges, query)

    def touch(self, query: search.Query) -> None:
        """Counts an access of every memory that the vector search of a query saw, not of its page alone."""
        memories = self.store.table("memories")
        q = replace(query).checked()
        seen = search.nearest(memories, q.vector, q.limit if q.mode == "deep" else 2 * q.limit)
        jobs.fold_accesses(self.store, seen.select("id", F.lit(utc_now()).cast("timestamp_ntz").alias("ts")))

    def page_edges(self, page: DataFrame) -> DataFrame:
        return search.page_edges(self.store.table("edges"), page)

    def graph(self, id_: str, depth: int = 2, degree_limit: int = 10) -> tuple[DataFrame, DataFrame]:
        memories, edges, _ = self._tables(self.store.version())
        return graph.neighbourhood(self.spark, memories, edges, id_, max(1, min(depth, MAX_DEPTH)), max(1, min(degree_limit, MAX_DEGREE)))

    def by_context(self, wanted: list[tuple[str, str]]) -> DataFrame:
        return context.matching(self.store.table("context_tags"), wanted)

    def status(self) -> dict:
        memories, edges, _ = self._tables(self.store.version())
        levels = {r.name: r.n for r in stats.by_level(memories).collect()}
        return stats.stats(memories, edges).first().asDict() | {"by_level": levels}

    def log(self, limit: int = 20) -> DataFrame:
        return stats.latest(self.store.table("consolidate_log"), limit)

    def health(self) -> dict:
        try:
            return {"status": "ok", "version": self.store.version(), "dim": self.config.embedder.dim, "uptime_seconds": int(time.monotonic() - self._since)}
        except Exception as e:  # the report is the answer
            return {"status": "error", "error": str(e), "dim": self.config.embedder.dim, "uptime_seconds": int(time.monotonic() - self._since)}

    def metrics(self) -> str:
        """Requests since the start, and sizes, as text exposition."""
        s = self.status()
        return self.requests.text({"uptime_seconds": self.health()["uptime_seconds"]} | {k: s[k] for k in ("total_memories", "total_edges", "pending_consolidation")})

    def similar(self, query: search.Query, probes: int | None = None) -> DataFrame:
        """id, score of the nearest memories by the index; approximate where it covers them."""
        q = query.checked()
        return self.index.nearest(q.vector, q.limit, probes)

    # --- jobs ---

    def refresh_index(self) -> bool:
        return self.index.refresh()

    def forget(self) -> tuple[int, int, int]:
        return jobs.forget_once(self.store, utc_now(), self.config.forgetting)

    def consolidate(self) -> dict[str, int] | None:
        return jobs.consolidate_once(self.store, self.consolidator, utc_now(), self.config.consolidation.batch_size)

    def scheduler(self) -> jobs.Scheduler:
        """All jobs in turn: consolidation first after five seconds, forgetting at once, and the index behind them."""
        c, f = self.config.consolidation, self.config.forgetting
        return jobs.Scheduler([(5.0, c.interval_seconds, self.consolidate), (0.0, f.interval_seconds, self.forget), (10.0, c.interval_seconds, self.refresh_index)])

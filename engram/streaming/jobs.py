"""Periodic and streaming jobs on a store."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from engram.operators import consolidate, lifecycle, mutate
from engram.schema import ConsolidationError, Forgetting
from engram.sources.store import Store

ACCESS = "id string, ts timestamp_ntz"
log = logging.getLogger(__name__)


def fold_accesses(store: Store, accesses: DataFrame, marks: dict[str, int] | None = None) -> None:
    """One commit for a batch of accesses (id, ts): a small row an id, which reading memories folds in.  Unknown ids do nothing."""
    new = accesses.filter("id is not null").groupBy("id").agg(F.max("ts").alias("accessed_at"), F.count(F.lit(1)).alias("n"))
    store.commit({}, store.version(), add={"touches": new}, marks=marks)


def access_stream(spark: SparkSession, store: Store, folder: str, checkpoint: str, once: bool = False, interval: str = "30 seconds", max_files: int = 100) -> StreamingQuery:
    """Folds access-log files (parquet, ACCESS) into memories as they come.

    The number of a batch is published in the same manifest as its accesses, so a batch that is run again after a failure, at
    whatever point that came, is not counted twice.
    """
    source = spark.readStream.schema(ACCESS).option("maxFilesPerTrigger", max_files).parquet(folder)
    writer = source.writeStream.foreachBatch(lambda batch, number: fold_batch(store, checkpoint, batch, number)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def fold_batch(store: Store, stream: str, batch: DataFrame, number: int) -> None:
    if number > store.mark(stream):
        fold_accesses(store, batch, {stream: number})


def access_counts(accesses: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Running count and latest access of each id and hour of a stream (id, ts); the watermark bounds what is remembered."""
    timed = accesses.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", "1 hour"), "id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))


def forget_once(store: Store, now, conf: Forgetting) -> tuple[int, int, int]:
    """A forgetting tick as one commit: archived, downgraded, cleaned."""
    base = store.version()
    tables = [store.table(t, base) for t in ("memories", "edges", "context_tags")]
    done = lifecycle.tick(*tables, F.lit(now).cast("timestamp_ntz"), conf)
    counts = tuple(done.summary.first())
    if not any(counts):
        return counts
    # Only buckets of what changes are written again: a batch of levels, and what is purged.
    stamp = F.lit(now).cast("timestamp_ntz")
    levels = store.spark.createDataFrame(done.levels.collect(), "id string, new_level int")
    owned = done.gone.withColumnRenamed("id", "memory_id")
    change = {"memories": (levels.select("id").union(done.gone), lambda part: mutate.set_levels(part, levels, stamp).join(done.gone, "id", "left_anti"))}
    if counts[2]:
        change["context_tags"] = (owned, lambda part: part.join(owned, "memory_id", "left_anti").select(*part.columns))
    store.commit({"edges": done.edges} if counts[2] else {}, base, change=change)
    return counts


def consolidate_once(store: Store, consolidator: consolidate.Consolidator, now, limit: int = 10) -> dict[str, int] | None:
    """A consolidation tick as one commit with a log row; None if nothing waits or the consolidator fails."""
    spark, base = store.spark, store.version()
    memories, edges = store.table("memories", base), store.table("edges", base)
    stamp = F.lit(now).cast("timestamp_ntz")
    try:
        done = consolidate.run_once(spark, memories, edges, consolidator, stamp, limit)
    except ConsolidationError:
        return None
    if done is None:
        return None
    counts = {r.kind: (r.accepted, r.rejected) for r in done.summary.collect()}
    processed = consolidate.pending(memories, limit).count()
    first = (edges.agg(F.max("id")).first()[0] or 0) + 1
    # The links of one batch are few; numbering them takes one task.
    fresh = spark.createDataFrame(done.new_edges.orderBy("source_id", "target_id", "relation").collect(), done.new_edges.schema)
    numbered = fresh.coalesce(1).withColumn("id", F.monotonically_increasing_id() + first)
    number = (store.table("consolidate_log", base).agg(F.max("id")).first()[0] or 0) + 1
    report = {"memories_processed": processed, "edges_created": counts["edge"][0], "errors": counts["abstract"][1] + counts["edge"][1]}
    row = spark.createDataFrame([(number, now, now, *report.values())], "id bigint, started_at timestamp_ntz, finished_at timestamp_ntz, memories_processed bigint, edges_created bigint, errors bigint")
    # Only buckets of the batch are written again; new links are added.
    ids = consolidate.pending(memories, limit).select("id")
    batch = spark.createDataFrame(done.memories.join(F.broadcast(ids), "id", "left_semi").collect(), memories.schema)
    store.commit({}, base, row, add={"edges": numbered.select(*edges.columns)}, change={"memories": (batch, lambda part: mutate.replaced(part, batch))})
    return report


class Scheduler:
    """Runs jobs in turn, never two at once, each when its interval is over; stop() lets the current one end.

    A job that fails is logged, counted in ``failures`` and run again when its interval is over.
    """

    def __init__(self, jobs: list[tuple[float, float, Callable[[], object]]]):
        """jobs: (first delay, interval, job) in seconds."""
        import threading

        self.failures = 0
        self.jobs, self._stop, self._thread = jobs, threading.Event(), threading.Thread(target=self._run, daemon=True)

    def start(self) -> Scheduler:
        self._thread.start()
        return self

    def _run(self) -> None:
        import time

        due = [time.monotonic() + delay for delay, _, _ in self.jobs]
        while due and not self._stop.wait(max(0.0, min(due) - time.monotonic())):
            k = due.index(min(due))
            try:
                self.jobs[k][2]()
            except Exception:  # whatever it was, the next tick may go well
                self.failures += 1
                log.exception("a job failed")
            due[k] = time.monotonic() + self.jobs[k][1]

    def stop(self) -> None:
        self._stop.set()
        self._thread.join()

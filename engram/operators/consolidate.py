"""Consolidation: a batch of pending memories, a consolidator, and what its answer changes."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions.text import ASK
from engram.operators import mutate
from engram.operators.embed import post
from engram.schema import Consolidation, ConsolidationError

#: A batch of (id, content) to {"memories": [{id, abstract}], "edges": [{source_id, target_id, relation, weight}]}.
Consolidator = Callable[[list[tuple[str, str]]], dict]
ABSTRACTS, LINKS = "id string, abstract string", "idx int, source_id string, target_id string, relation string, weight double"


def pending(memories: DataFrame, limit: int) -> DataFrame:
    """The oldest memories that wait, archived ones too."""
    return memories.filter("pending_consolidation").orderBy("created_at", "id").limit(limit)


def no_consolidator(batch: list[tuple[str, str]]) -> dict:
    return {"memories": [], "edges": []}


def language_model(complete: Callable[[str], str]) -> Consolidator:
    """A consolidator that asks a language model (prompt to reply)."""

    def run(batch: list[tuple[str, str]]) -> dict:
        reply = complete(ASK + json.dumps([{"id": i, "content": c} for i, c in batch], ensure_ascii=False))
        low, high = reply.find("{"), reply.rfind("}")
        try:
            return json.loads(reply[low : high + 1] if 0 <= low <= high else reply)
        except ValueError as e:
            raise ConsolidationError(f"no JSON in the reply: {e}") from e

    return run


def http_model(conf: Consolidation, timeout: float = 60.0) -> Callable[[str], str]:
    """Prompt to reply through a chat service."""

    def run(prompt: str) -> str:
        body = {"model": conf.model, "messages": [{"role": "user", "content": prompt}], "temperature": 0}
        try:
            return post(f"{conf.url.rstrip('/')}/chat/completions", body, {"Authorization": f"Bearer {conf.api_key}"}, timeout)["choices"][0]["message"]["content"]
        except (OSError, KeyError, IndexError, ValueError) as e:
            raise ConsolidationError(f"no reply: {e}") from e

    return run


def chosen(conf: Consolidation) -> Consolidator:
    """The consolidator that the configuration names; an unknown name is none."""
    return language_model(http_model(conf)) if conf.type == "openai" else no_consolidator


def answer_tables(spark: SparkSession, answer: dict) -> tuple[DataFrame, DataFrame]:
    """abstracts and links of an answer, which is as small as its batch."""
    notes = [(str(m["id"]), str(m["abstract"])) for m in answer.get("memories", [])]
    links = [(i, str(e["source_id"]), str(e["target_id"]), e.get("relation"), None if e.get("weight") is None else float(e["weight"])) for i, e in enumerate(answer.get("edges", []))]
    return spark.createDataFrame(notes, ABSTRACTS), spark.createDataFrame(links, LINKS)


@dataclass
class Checked:
    abstracts: DataFrame
    links: DataFrame
    summary: DataFrame


def checked(batch: DataFrame, abstracts: DataFrame, links: DataFrame) -> Checked:
    """What of an answer speaks of the batch: invented ids and self links are rejected and counted.

    summary: kind, accepted, rejected.  Of repeated abstracts of an id one stays.
    """
    ids = batch.select("id")
    good = abstracts.join(ids, "id", "left_semi")
    ends = links
    for c in ("source_id", "target_id"):
        ends = ends.join(ids.select(F.col("id").alias(c)), c, "left_semi")
    ends = ends.filter("source_id <> target_id").select(*links.columns)
    rows = []
    for kind, all_, kept in (("abstract", abstracts, good), ("edge", links, ends)):
        flags = all_.select(F.lit(0).alias("ok")).unionByName(kept.select(F.lit(1).alias("ok")))
        n, ok = F.count_if(F.col("ok") == 0), F.count_if(F.col("ok") == 1)
        rows.append(flags.agg(ok.alias("accepted"), (n - ok).alias("rejected")).select(F.lit(kind).alias("kind"), "accepted", "rejected"))
    return Checked(good.groupBy("id").agg(F.max("abstract").alias("abstract")), ends, rows[0].unionByName(rows[1]))


@dataclass
class Outcome:
    memories: DataFrame
    new_edges: DataFrame
    summary: DataFrame


def apply(memories: DataFrame, edges: DataFrame, found: Checked, now: Column) -> Outcome:
    """Sets abstracts and ends the wait of exactly those memories; adds links as automatic edges."""
    changed = mutate.mark_consolidated(mutate.set_abstracts(memories, found.abstracts, now), found.abstracts)
    links = found.links.withColumn("edge_type", F.lit("auto"))
    return Outcome(changed, mutate.insert_edges(edges, links, memories, now), found.summary)


def run_once(spark: SparkSession, memories: DataFrame, edges: DataFrame, consolidator: Consolidator, now: Column, limit: int = 10) -> Outcome | None:
    """One consolidation tick, or None if nothing waits.  The batch (``limit`` rows) comes to the driver; an error changes nothing."""
    batch = pending(memories, limit).select("id", "content").collect()
    if not batch:
        return None
    answer = consolidator([tuple(r) for r in batch])
    abstracts, links = answer_tables(spark, answer)
    return apply(memories, edges, checked(spark.createDataFrame(batch, "id string, content string"), abstracts, links), now)

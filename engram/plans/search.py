"""Search plans: fast and deep retrieval, and ranking."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.operators import context, graph, retrieval
from engram.schema import MAX_DEGREE, MAX_DEPTH, MAX_SEARCH_LIMIT, Retrieval, ValidationError

BOOST = 0.1


@dataclass(frozen=True)
class Query:
    """A search.  windowed: filters see only the best 2 * limit rows, as a page of nearest memories; else they come first."""

    vector: list[float]
    mode: str = "fast"
    limit: int = Retrieval.fast_default_limit
    offset: int = 0
    levels: list[int] | None = None
    category: str | None = None
    after: datetime | None = None
    before: datetime | None = None
    threshold: float = Retrieval.score_threshold
    context: dict[str, str] = field(default_factory=dict)
    depth: int = Retrieval.default_depth
    degree_limit: int = Retrieval.default_degree_limit
    windowed: bool = True

    def checked(self) -> Query:
        if self.mode not in ("fast", "deep"):
            raise ValidationError(f"no mode {self.mode}")
        values = self.__dict__ | {"limit": max(1, min(self.limit, MAX_SEARCH_LIMIT)), "depth": max(0, min(self.depth, MAX_DEPTH)), "degree_limit": max(1, min(self.degree_limit, MAX_DEGREE)), "offset": max(0, self.offset)}
        return Query(**values)


def nearest(memories: DataFrame, vector: list[float], limit: int) -> DataFrame:
    """The ``limit`` nearest memories that are not archived, among the 2 * limit nearest of all."""
    hits = retrieval.top_k(memories, vector, 2 * limit)
    return hits.filter("level >= 0").orderBy(F.desc("score"), "id").limit(limit)


def _filtered(rows: DataFrame, q: Query) -> DataFrame:
    if q.levels is not None:
        rows = rows.filter(F.col("level").isin(q.levels) if q.levels else F.lit(False))
    if q.category is not None:
        rows = rows.filter(F.col("category") == q.category)
    if q.after is not None:
        rows = rows.filter(F.col("created_at") >= F.lit(q.after).cast("timestamp_ntz"))
    if q.before is not None:
        rows = rows.filter(F.col("created_at") <= F.lit(q.before).cast("timestamp_ntz"))
    return rows


def ranked(rows: DataFrame, tags: DataFrame, q: Query) -> DataFrame:
    """Filters, then lifts by wished tags, then the threshold; the page with ``total``, the number of rows before paging.

    A window of nearest rows (at most 2 * limit) lies in one task anyway, which counts as it goes; all rows are counted apart.
    """
    rows = _filtered(rows, q)
    if q.context:
        rows = context.with_context(rows, tags, bounded=q.windowed)
        # Added up one by one, as three times a tenth is not three tenths.
        hits = [F.when(F.element_at("context", k) == v, BOOST).otherwise(0.0) for k, v in q.context.items()]
        lift = F.aggregate(F.filter(F.array(*hits), lambda x: x > 0), F.lit(0.0), lambda s, x: s + x)
        rows = rows.withColumn("score", F.col("score") + lift)
    rows = rows.filter((F.col("score") >= q.threshold) & ~F.isnan("score"))
    if q.windowed or q.mode == "deep":
        counted = rows.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy()))
        return counted.orderBy(F.desc("score"), "id").offset(q.offset).limit(q.limit)
    page = rows.orderBy(F.desc("score"), "id").offset(q.offset).limit(q.limit)
    return page.join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total"))), how="cross")


def search(spark: SparkSession, memories: DataFrame, tags: DataFrame, edges: DataFrame, query: Query) -> DataFrame:
    """id, content, abstract, score, weight, level, category, created_at, total of the page."""
    q = query.checked()
    keep = ["id", "content", "abstract", "score", "weight", "level", "category", "created_at"]
    if q.mode == "fast":
        rows = nearest(memories, q.vector, 2 * q.limit) if q.windowed else retrieval.scored(_filtered(memories.filter("level >= 0"), q), q.vector)
        rows = rows.select(*keep)
    else:
        seeds = nearest(memories, q.vector, q.limit).select("id")
        found = graph.expand(spark, memories, edges, seeds, q.depth, q.degree_limit)
        rows = found.select("id", "weight", "score").join(memories.drop("weight"), "id").select(*keep)
    return ranked(rows, tags, q)


def page_edges(edges: DataFrame, page: DataFrame) -> DataFrame:
    """Edges that touch the page; one between two of its memories comes twice."""
    return graph.incident(edges, F.broadcast(page.select(F.col("id").alias("member_id")).distinct()))

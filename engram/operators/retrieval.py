"""Vector retrieval: exact top-k for one query or many, and an optional clustered layout."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.functions.vectors import cosine, literal, norm
from engram.schema import ValidationError

QUERY_BLOCK, PASS_BYTES = 512, 64 << 20


def scored(memories: DataFrame, query: list[float]) -> DataFrame:
    """Rows that have an embedding, with their cosine to the query as ``score``; rows whose cosine is no number are left out."""
    size = float(sum(float(np.float32(x)) ** 2 for x in query) ** 0.5)
    own = F.col("norm") if "norm" in memories.columns else norm(F.col("embedding"))
    rows = memories.filter("embedding is not null").withColumn("score", cosine(F.col("embedding"), literal(query), own, F.lit(size)))
    return rows.filter(~F.isnan("score"))


def _matrix(lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors of this length, and their unit vectors (0 where the norm is)."""
    fits = np.flatnonzero(np.diff(np.asarray(lists.offsets)) == dim)
    x = np.asarray(lists.take(pa.array(fits)).flatten().fill_null(0)).astype(np.float64).reshape(len(fits), dim)
    size = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return fits, np.where(size > 0, x / np.where(size > 0, size, 1), 0 * x)


def nearest(rows: DataFrame, query: list[float], k: int) -> DataFrame:
    """id, score of the k best rows of (id, embedding) by score, then id: a block product a batch, a partial top-k a task."""
    q = np.array(query, np.float32).astype(np.float64)
    q /= max(float(np.sqrt(q @ q)), 1e-300)

    def run(batches):
        for batch in batches:
            ids, score = batch.column(0), np.zeros(batch.num_rows)
            fits, x = _matrix(batch.column(1), len(q))
            own = np.einsum("ij,j->i", x, q)  # row by row, so equal vectors get equal scores
            score[fits] = np.where(np.isnan(own) & ~x.any(axis=1), 0, own)
            at = np.flatnonzero(~np.isnan(score))
            if len(at) > k > 0:  # ties at the border stay in
                at = at[score[at] >= -np.partition(-score[at], k - 1)[k - 1]]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(score[at])], names=["id", "score"])

    slim = rows.filter("embedding is not null").select("id", F.col("embedding").cast("array<float>").alias("embedding"))
    return slim.mapInArrow(run, "id string, score double").orderBy(F.desc("score"), "id").limit(k)


def top_k(memories: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k best rows by score, then id; other columns than id and embedding are read for these rows only.

    Rows whose cosine is no number (a NaN in the vector) are no hits, here and in all other searches.
    """
    hits = nearest(memories, query, k)
    return memories.join(F.broadcast(hits), "id").select(*memories.columns, "score").orderBy(F.desc("score"), "id")


def _in_passes(spark: SparkSession, queries: dict[str, list[float]], k: int, rows: DataFrame, scores) -> DataFrame:
    """query_id, rank, id, score: the k best rows of each query, all rows against QUERY_BLOCK queries at a time.

    scores(batch, queries) gives triples (places of queries, places of rows, scores); a task keeps the k best of each of its
    batches, so at most k rows a query and batch are shuffled.  One pass over the rows serves PASS_BYTES of queries.
    """
    if len({len(v) for v in queries.values()}) > 1:
        raise ValidationError("queries differ in length")
    names, out = sorted(queries), None
    if not names:
        return spark.createDataFrame([], "query_id string, rank int, id string, score double")
    each = max(QUERY_BLOCK, PASS_BYTES // (4 * max(1, len(queries[names[0]]))))
    for at in range(0, len(names), each):
        held = spark.sparkContext.broadcast((names[at : at + each], np.array([queries[n] for n in names[at : at + each]], np.float32)))

        def run(batches, held=held):
            own, vectors = held.value
            blocks = [(low, _unit(vectors[low : low + QUERY_BLOCK])) for low in range(0, len(own), QUERY_BLOCK)]
            for batch in batches:
                for low, q in blocks:
                    for qi, ri, score in scores(batch, low, q):
                        yield pa.RecordBatch.from_arrays([pa.array([own[low + i] for i in qi], pa.string()), batch.column(0).take(pa.array(ri)), pa.array(score)], names=["query_id", "id", "score"])

        part = rows.mapInArrow(run, "query_id string, id string, score double")
        out = part if out is None else out.unionByName(part)
    # Rank-limit windows are cut before the shuffle too (WindowGroupLimit).
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def _unit(q: np.ndarray) -> np.ndarray:
    q = q.astype(np.float64)
    return q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)


def _best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best numbers of each row; ties at the border stay in, for the window to settle by id."""
    score = np.where(np.isnan(score), -np.inf, score)
    best = min(k, score.shape[1])
    if best <= 0:
        return np.zeros(0, int), np.zeros(0, int)
    border = -np.partition(-score, best - 1, axis=1)[:, best - 1]
    return np.nonzero((score >= border[:, None]) & (score > -np.inf))


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of unit queries and unit vectors; 0 for vectors without a length."""
    score = q @ x.T
    return np.where(np.isnan(score) & ~x.any(axis=1), 0, score)


def top_k_batch(spark: SparkSession, memories: DataFrame, queries: dict[str, list[float]], k: int) -> DataFrame:
    """query_id, rank, id, score for a stated set of queries against all rows."""

    def scores(batch, low, q):
        score = np.zeros((len(q), batch.num_rows))
        fits, x = _matrix(batch.column(1), q.shape[1])
        score[:, fits] = _products(q, x)
        qi, ri = _best(score, k)
        yield qi, ri, score[qi, ri]

    slim = memories.filter("embedding is not null").select("id", F.col("embedding").cast("array<float>").alias("embedding"))
    return _in_passes(spark, queries, k, slim, scores)


def cell_model(memories: DataFrame, cells: int, sample_rows: int = 50_000, seed: int = 1) -> np.ndarray:
    """Centres of a clustered layout on the unit sphere, fitted on at most about ``sample_rows`` rows (id, embedding)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector

    rows = memories.filter("embedding is not null")
    share = min(1.0, sample_rows / max(1, rows.count()))
    rows = rows.sample(fraction=share, seed=seed) if share < 1 else rows
    unit = Normalizer(inputCol="v", outputCol="features").transform(rows.select(array_to_vector("embedding").alias("v")))
    return np.stack(KMeans(k=cells, seed=seed, maxIter=10).fit(unit).clusterCenters())


def with_cells(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """id, embedding, cell of all rows that have an embedding: its nearest centre, -1 for other lengths."""

    def run(batches):
        for batch in batches:
            cell = np.full(batch.num_rows, -1, np.int32)
            fits, x = _matrix(batch.column(1), centres.shape[1])
            cell[fits] = ((centres**2).sum(axis=1) - 2 * (np.nan_to_num(x) @ centres.T)).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell)], names=["id", "embedding", "cell"])

    slim = rows.filter("embedding is not null").select(F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
    return slim.mapInArrow(run, "id string, embedding array<float>, cell int")


def probed(centres: np.ndarray, query: list[float], probes: int) -> list[int]:
    """The ``probes`` cells nearest to a query."""
    q = np.array(query, np.float64)
    q /= max(float(np.linalg.norm(q)), 1e-300)
    return np.argsort(((centres - q) ** 2).sum(axis=1), kind="stable")[:probes].tolist()


def calibrated_probes(rows: DataFrame, centres: np.ndarray, recall: float = 0.95, k: int = 10, sample_rows: int = 4000, queries: int = 400, seed: int = 2) -> int:
    """Probes that find this share of the k nearest, measured on at most about ``sample_rows`` rows (id, embedding).

    Among fewer rows neighbours lie farther off, so more probes are chosen than all rows need; vectors without any clusters need
    about half of the cells.
    """
    known = rows.filter("embedding is not null")
    share = min(1.0, sample_rows / max(1, known.count()))
    known = known.sample(fraction=share, seed=seed) if share < 1 else known
    x = np.array([v for r in known.select("embedding").collect() if len(v := r[0]) == centres.shape[1]], np.float64)
    x = x[np.isfinite(x).all(axis=1)] if len(x) else x
    if not len(x):
        return len(centres)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    distance = (centres**2).sum(axis=1) - 2 * (x @ centres.T)
    cell = distance.argmin(axis=1)
    q = np.random.default_rng(seed).permutation(len(x))[:queries]
    best = np.argsort(-(x[q] @ x.T), axis=1, kind="stable")[:, :k]
    rank = distance[q].argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")
    needed = np.sort(rank[np.arange(len(q))[:, None], cell[best]].ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


def top_k_cells(celled: DataFrame, centres: np.ndarray, query: list[float], k: int, probes: int) -> DataFrame:
    """id, score of the k best rows of the cells nearest to the query: approximate.  Partitioned by cell, others are not read."""
    near = probed(centres, query, probes)
    return nearest(celled.filter(F.col("cell").isin(near)), query, k)


def top_k_cells_batch(spark: SparkSession, celled: DataFrame, centres: np.ndarray, queries: dict[str, list[float]], k: int, probes: int) -> DataFrame:
    """As top_k_batch, but each query meets only the rows of its nearest cells."""
    names = sorted(queries)
    near = [probed(centres, queries[n], probes) for n in names]
    held = spark.sparkContext.broadcast({c: np.array([i for i, own in enumerate(near) if c in own]) for c in {c for own in near for c in own}})

    def scores(batch, low, q):
        cells = np.asarray(batch.column(2))
        fits, x = _matrix(batch.column(1), q.shape[1])
        for c in np.unique(cells[fits]).tolist():
            asks, rows = held.value.get(c, np.zeros(0, int)) - low, np.flatnonzero(cells[fits] == c)
            asks = asks[(asks >= 0) & (asks < len(q))]
            if len(asks):
                score = _products(q[asks], x[rows])
                qi, ri = _best(score, k)
                yield asks[qi], fits[rows[ri]], score[qi, ri]

    return _in_passes(spark, queries, k, celled.select("id", "embedding", "cell").filter(F.col("cell").isin(sorted(held.value))), scores)

"""Embedders: a deterministic hash in SQL, and HTTP services called by batches on the executors."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.schema import Embedder, EmbeddingError

OPENAI_BATCH = 512


def random_embedding(dim: int) -> Column:
    """A unit vector that is another one each time: for load tests only, as a lost task gives other values."""
    if dim <= 0:
        raise EmbeddingError("dim must be positive")
    raw = F.array(*[F.randn() for _ in range(dim)])
    return F.get(F.transform(F.array(raw), lambda v: F.transform(v, lambda x: x / F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, y: s + y * y)))), F.lit(0))


def hash_embedding(text: Column, dim: int) -> Column:
    """Unit vector of uniform values in [-1, 1) from SHA-256 of the text's digest and the place; e0 if the norm is 0.

    One-element arrays bind the digest and the norm, which a lambda would else work out anew for each place.
    """
    if dim <= 0:
        raise EmbeddingError("dim must be positive")
    part = lambda h, i: F.conv(F.substring(F.sha2(F.concat(h, F.lit(":"), i.cast("string")), 256), 1, 8), 16, 10).cast("double") / 2147483648.0 - 1.0
    raw = F.transform(F.array(F.sha2(text, 256)), lambda h: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: part(h, i)))
    sized = F.transform(raw, lambda v: F.struct(v.alias("v"), F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)).alias("n")))
    unit = F.transform(sized, lambda s: F.transform(s.v, lambda x, i: F.when(s.n == 0, F.when(i == 0, 1.0).otherwise(0.0)).otherwise(x / s.n)))
    return F.get(unit, F.lit(0))


def post(url: str, body: dict, headers: dict[str, str], timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | headers)
    with urllib.request.urlopen(request, timeout=timeout) as reply:
        return json.load(reply)


def http_encoder(conf: Embedder, timeout: float = 30.0) -> Callable[[list[str]], list[list[float]]]:
    """Texts to vectors through a service; its answer must have a vector for each text."""

    def ollama(texts):
        return post(f"{conf.url.rstrip('/')}/api/embed", {"model": conf.model, "input": texts}, {}, timeout)["embeddings"]

    def openai(texts):
        out = []
        for i in range(0, len(texts), OPENAI_BATCH):
            data = post(f"{conf.url.rstrip('/')}/embeddings", {"model": conf.model, "input": texts[i : i + OPENAI_BATCH]}, {"Authorization": f"Bearer {conf.api_key}"}, timeout)["data"]
            out += [x["embedding"] for x in sorted(data, key=lambda x: x["index"])]
        return out

    kinds = {"ollama": ollama, "openai": openai}
    if conf.type not in kinds:
        raise EmbeddingError(f"no embedder of type {conf.type}")
    return kinds[conf.type]


def embedded(df: DataFrame, column: str, encode: Callable[[list[str]], list[list[float]]], batch: int = 256) -> DataFrame:
    """df with ``embedding`` from encode, called for ``batch`` texts at a time in each task."""
    names = df.columns
    at = names.index(column)

    def run(batches):
        for whole in batches:
            for low in range(0, whole.num_rows, batch):
                part = whole.slice(low, batch)
                texts = [t or "" for t in part.column(at).to_pylist()]
                vectors = encode(texts)
                if len(vectors) != len(texts):
                    raise EmbeddingError(f"{len(vectors)} vectors for {len(texts)} texts")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*names, "embedding"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{schema}, embedding array<float>")


def with_embedding(df: DataFrame, column: str, conf: Embedder) -> DataFrame:
    if conf.type == "random":
        return df.withColumn("embedding", random_embedding(conf.dim).cast("array<float>"))
    if conf.type in ("hash", "noop"):
        return df.withColumn("embedding", hash_embedding(F.col(column), conf.dim).cast("array<float>"))
    return embedded(df, column, http_encoder(conf))

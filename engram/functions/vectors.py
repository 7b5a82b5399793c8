"""Vector arithmetic as column expressions, in double precision and in element order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products; of the shorter length if lengths differ."""
    products = F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0 if lengths differ or a norm is 0.  Norms that are stored can be given."""
    x, y = (norm(a) if norm_a is None else norm_a), (norm(b) if norm_b is None else norm_b)
    return F.when((F.size(a) != F.size(b)) | (x == 0) | (y == 0), F.lit(0.0)).otherwise(dot(a, b) / (x * y))


def from_distance(d: Column) -> Column:
    """Cosine of two unit vectors from their Euclidean distance."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - F.pow(d, F.lit(2.0)) / 2))


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)).cast("float") for x in vector])


def from_bytes(df: DataFrame, column: str) -> DataFrame:
    """df with the column's little-endian 32-bit floats as an array: vectors of foreign files.  A null stays null."""
    names = df.columns
    at = names.index(column)

    def run(batches):
        for batch in batches:
            vectors = [None if b is None else np.frombuffer(b, "<f4") for b in batch.column(at).to_pylist()]
            columns = [pa.array(vectors, pa.list_(pa.float32())) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = [f"`{f.name}` {'array<float>' if f.name == column else f.dataType.simpleString()}" for f in df.schema.fields]
    return df.mapInArrow(run, ", ".join(kinds))


def to_bytes(df: DataFrame, column: str) -> DataFrame:
    """df with the column's vector as little-endian 32-bit floats: the reverse of from_bytes."""
    names = df.columns
    at = names.index(column)

    def run(batches):
        for batch in batches:
            raw = [None if v is None else np.array(v, "<f4").tobytes() for v in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary()) if i == at else c for i, c in enumerate(batch.columns)], names=names)

    kinds = [f"`{f.name}` {'binary' if f.name == column else f.dataType.simpleString()}" for f in df.schema.fields]
    return df.mapInArrow(run, ", ".join(kinds))

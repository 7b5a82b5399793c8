"""Table schemas, limits, configuration and errors."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any

from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "bigint": T.LongType(), "boolean": T.BooleanType(), "timestamp_ntz": T.TimestampNTZType(), "array<float>": T.ArrayType(T.FloatType())}


def _schema(text: str) -> T.StructType:
    """From "name type, ..."; a ? after a type allows nulls."""
    parts = [x.split() for x in text.split(",")]
    return T.StructType([T.StructField(name, _KINDS[kind.rstrip("?")], kind.endswith("?")) for name, kind in parts])


MEMORIES = _schema(
    "id string, content string, abstract string?, category string, weight double, level int, pending_consolidation boolean, embedding array<float>?, "
    "metadata string, created_at timestamp_ntz, updated_at timestamp_ntz, accessed_at timestamp_ntz, access_count bigint"
)
EDGES = _schema("id bigint, source_id string, target_id string, weight double, relation string, edge_type string, created_at timestamp_ntz, updated_at timestamp_ntz")
CONTEXT_TAGS = _schema("id bigint, memory_id string, key string, value string")
CONSOLIDATE_LOG = _schema("id bigint, started_at timestamp_ntz, finished_at timestamp_ntz?, memories_processed bigint, edges_created bigint, errors bigint")
TOUCHES = _schema("id string, accessed_at timestamp_ntz, n bigint")
TABLES = {"memories": MEMORIES, "edges": EDGES, "context_tags": CONTEXT_TAGS, "consolidate_log": CONSOLIDATE_LOG, "touches": TOUCHES}
SCHEMA_VERSION = 2

# Levels, edge types and hard limits of the data model.
LEVELS = {"full": 2, "summary": 1, "title": 0, "archived": -1}
EDGE_TYPES = ("auto", "manual")
MAX_SEARCH_LIMIT, MAX_DEPTH, MAX_DEGREE, MAX_BATCH, MAX_CONTENT_BYTES = 1000, 5, 100, 500, 65_536


class EngineError(Exception):
    code = "INTERNAL_ERROR"


class MemoryNotFound(EngineError):
    code = "NOT_FOUND"


class ValidationError(EngineError):
    code = "BAD_REQUEST"


class EmbeddingError(EngineError):
    code = "EMBED_FAILED"


class StorageError(EngineError):
    pass


class ConfigError(EngineError):
    pass


class ConsolidationError(EngineError):
    pass


@dataclass(frozen=True)
class Retrieval:
    fast_default_limit: int = 10
    score_threshold: float = 0.3
    default_depth: int = 2
    default_degree_limit: int = 10


@dataclass(frozen=True)
class Consolidation:
    interval_seconds: int = 60
    batch_size: int = 10
    type: str = "none"
    url: str = ""
    model: str = ""
    api_key: str = ""


@dataclass(frozen=True)
class Forgetting:
    interval_seconds: int = 300
    batch_size: int = 100
    archive_days: int = 30
    half_life_seconds: float = 86_400.0
    access_boost: float = 0.1
    threshold_to_l1: float = 0.3
    threshold_to_l0: float = 0.2
    threshold_archive: float = 0.1


@dataclass(frozen=True)
class Embedder:
    type: str = "hash"
    dim: int = 384
    url: str = ""
    model: str = ""
    api_key: str = ""


@dataclass(frozen=True)
class Config:
    retrieval: Retrieval = field(default_factory=Retrieval)
    consolidation: Consolidation = field(default_factory=Consolidation)
    forgetting: Forgetting = field(default_factory=Forgetting)
    embedder: Embedder = field(default_factory=Embedder)

    @classmethod
    def load(cls, path: str | None = None, env: dict[str, str] | None = None, prefix: str = "ENGRAM__") -> Config:
        """Defaults, then environment (SECTION__KEY after the prefix), then the YAML or JSON file, which wins."""
        layers: list[dict[str, Any]] = [{}]
        for k, v in (os.environ if env is None else env).items():
            section, _, key = k.removeprefix(prefix).lower().partition("__")
            if k.startswith(prefix) and key:
                layers[0].setdefault(section, {})[key] = v
        if path:
            layers.append(_read(os.path.expanduser(path)))
        out = cls()
        for layer in layers:
            out = _merged(out, layer)
        out.validate()
        return out

    def validate(self) -> None:
        f, r = self.forgetting, self.retrieval
        for ok, text in (
            (f.half_life_seconds > 0, "half_life_seconds must be positive"),
            (f.archive_days >= 0, "archive_days must not be negative"),
            (self.embedder.dim > 0, "dim must be positive"),
            (-1 <= r.score_threshold <= 1, "score_threshold must be from -1 to 1"),
        ):
            if not ok:
                raise ConfigError(text)


def _read(path: str) -> dict[str, Any]:
    with open(path) as f:
        text = f.read()
    try:
        import yaml
    except ImportError:
        import json

        return json.loads(text) or {}
    return yaml.safe_load(text) or {}


def _merged(old, layer: dict[str, Any]):
    changes = {}
    for f in fields(old):
        if f.name in layer:
            value, v = getattr(old, f.name), layer[f.name]
            changes[f.name] = _merged(value, v) if is_dataclass(value) else type(value)(v)
    return replace(old, **changes)

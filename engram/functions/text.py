"""Names, metadata and language-model texts."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from engram.schema import LEVELS, ValidationError


def level_name(level: Column) -> Column:
    """Unknown integers count as archived."""
    out = F.lit("archived")
    for name, value in LEVELS.items():
        out = F.when(level == value, name).otherwise(out)
    return out


def parse_levels(text: str) -> list[int]:
    """Comma-separated level names; unknown ones are skipped."""
    return [LEVELS[x] for x in (t.strip().lower() for t in text.split(",")) if x in LEVELS]


def parse_context(text: str | None) -> dict[str, str]:
    """A JSON object of wanted tags; bad JSON and other values are no wish, and a value that is no string is an empty one."""
    try:
        found = json.loads(text) if text else None
    except ValueError:
        return {}
    return {k: v if isinstance(v, str) else "" for k, v in found.items()} if isinstance(found, dict) else {}


def parse_time(text: str) -> datetime:
    """RFC 3339 with an offset, as naive UTC."""
    try:
        t = datetime.fromisoformat(text.replace("z", "Z").replace("Z", "+00:00"))
    except ValueError as e:
        raise ValidationError(f"bad date: {text}") from e
    if t.tzinfo is None or "T" not in text.upper() and " " not in text:
        raise ValidationError(f"bad date: {text}")
    return t.astimezone(timezone.utc).replace(tzinfo=None)


def json_object(text: Column) -> Column:
    """From the first { to the last } of a reply, else the trimmed reply."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found).otherwise(F.trim(text))


def metadata_map(metadata: Column) -> Column:
    """Metadata as a map of JSON texts; what cannot be parsed is an empty map."""
    return F.coalesce(F.from_json(metadata, "map<string,string>", {"mode": "PERMISSIVE"}), F.create_map().cast("map<string,string>"))


def metadata_json(metadata: Column) -> Column:
    """A map of JSON texts as one JSON object; null is an empty one."""
    members = F.transform(F.array_sort(F.map_entries(F.coalesce(metadata, F.create_map().cast("map<string,string>")))), lambda e: F.concat(F.to_json(F.array(e.key)).substr(F.lit(2), F.length(F.to_json(F.array(e.key))) - 2), F.lit(":"), F.coalesce(e.value, F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))


def format_time(t: Column) -> Column:
    """A time without a zone (UTC) as RFC 3339 with microseconds."""
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def time_or(text: Column, fallback: Column) -> Column:
    """RFC 3339 texts as naive UTC; the fallback where there is none or it cannot be read."""
    zoned = text.rlike(r"(?i)^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$")
    naive = F.to_utc_timestamp(F.try_to_timestamp(F.upper(text)), F.current_timezone()).cast("timestamp_ntz")
    return F.coalesce(F.when(zoned, naive), fallback)


#: A request to summarise memories and to relate them, to be followed by their ids and contents as JSON.
ASK = 'Summarise each memory in one sentence and name links between them. Answer with JSON only: {"memories": [{"id", "abstract"}], "edges": [{"source_id", "target_id", "relation", "weight"}]}.\n\nMemories:\n'


def prompt(rows: Column) -> Column:
    """ASK for an array of (id, content)."""
    return F.concat(F.lit(ASK), F.to_json(rows))

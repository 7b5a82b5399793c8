"""Five tools on a store for language-model clients: JSON-RPC requests by line on standard input, answers on standard output."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable, Iterator

from engram.api import Engine
from engram.schema import EngineError

_TEXT, _NUMBER = {"type": "string"}, {"type": "number"}
#: name: (what it does, its parameters, those it needs)
TOOLS = {
    "write_memory": ("Store a memory.", {"content": _TEXT, "tags": {"type": "object"}}, ["content"]),
    "search_memory": ("Find the memories nearest to a text.", {"query": _TEXT, "limit": _NUMBER, "mode": _TEXT}, ["query"]),
    "get_memory": ("Read a memory.", {"id": _TEXT}, ["id"]),
    "delete_memory": ("Delete a memory with its edges and tags.", {"id": _TEXT}, ["id"]),
    "relate": ("Link two memories.", {"source_id": _TEXT, "target_id": _TEXT, "relation": _TEXT, "weight": _NUMBER}, ["source_id", "target_id"]),
}


def call(engine: Engine, name: str, a: dict):
    if name == "write_memory":
        return {"id": engine.write(a["content"], a.get("tags"))}
    if name == "search_memory":
        query = engine.query(a["query"], limit=int(a.get("limit", 10)), mode=a.get("mode", "fast"))
        return [r.asDict() for r in engine.search(query).collect()]
    if name == "get_memory":
        return engine.get(a["id"]).asDict(recursive=True)
    if name == "delete_memory":
        engine.delete(a["id"])
        return {"deleted": a["id"]}
    if name == "relate":
        engine.relate(a["source_id"], a["target_id"], a.get("relation", "related"), float(a.get("weight", 1.0)))
        return {"related": [a["source_id"], a["target_id"]]}
    raise KeyError(name)


def answer(engine: Engine, request: dict) -> dict | None:
    """The reply to one request; None to a notification."""
    method, params = request.get("method"), request.get("params") or {}
    if "id" not in request:
        return None
    reply: dict = {"jsonrpc": "2.0", "id": request["id"]}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "engram", "version": "1"}}}
    if method == "tools/list":
        return reply | {"result": {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": need}} for n, (d, p, need) in TOOLS.items()]}}
    if method != "tools/call":
        return reply | {"error": {"code": -32601, "message": f"no method {method}"}}
    try:
        with engine.requests.request("tools/call", str(params["name"])):
            out, failed = call(engine, params["name"], params.get("arguments") or {}), False
    except KeyError as e:
        return reply | {"error": {"code": -32602, "message": f"missing or unknown: {e}"}}
    except EngineError as e:
        out, failed = {"code": e.code, "message": str(e)}, True
    return reply | {"result": {"content": [{"type": "text", "text": json.dumps(out, default=str, ensure_ascii=False)}], "isError": failed}}


def serve(engine: Engine, lines: Iterable[str] = sys.stdin) -> Iterator[str]:
    for line in lines:
        try:
            reply = answer(engine, json.loads(line))
        except ValueError as e:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
        if reply is not None:
            yield json.dumps(reply, ensure_ascii=False)

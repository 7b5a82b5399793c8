"""python -m engram PATH COMMAND ...: requests on a store from the command line."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from engram import tools
from engram.api import Engine
from engram.schema import Config


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="engram")
    p.add_argument("path")
    p.add_argument("--config")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("health", "status", "consolidate", "forget", "migrate", "tools"):
        sub.add_parser(name)
    s = sub.add_parser("search")
    s.add_argument("text")
    s.add_argument("--limit", type=int, default=10)
    s.add_argument("--mode", default="fast")
    s.add_argument("--threshold", type=float)
    sub.add_parser("write").add_argument("content")
    sub.add_parser("delete").add_argument("id")
    g = sub.add_parser("graph")
    g.add_argument("id")
    g.add_argument("--depth", type=int, default=2)
    a = p.parse_args(argv)
    engine = Engine(SparkSession.builder.getOrCreate(), a.path, Config.load(a.config))
    if a.command == "tools":
        for line in tools.serve(engine):
            print(line, flush=True)
        return 0
    rows = lambda df: [r.asDict() for r in df.collect()]
    out = {
        "health": engine.health, "status": engine.status, "consolidate": engine.consolidate, "forget": engine.forget, "migrate": engine.store.migrate,
        "search": lambda: rows(engine.search(engine.query(a.text, limit=a.limit, mode=a.mode, threshold=a.threshold))),
        "write": lambda: engine.write(a.content), "delete": lambda: engine.delete(a.id),
        "graph": lambda: [rows(x) for x in engine.graph(a.id, a.depth)],
    }[a.command]()
    print(json.dumps(out, default=str, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

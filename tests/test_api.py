import json

import pytest

from engram import tools
from engram.__main__ import main
from engram.api import Engine
from engram.functions import vectors
from engram.operators import stats
from engram.schema import Config, Embedder, MemoryNotFound, ValidationError


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/s", Config(embedder=Embedder(dim=16)), lambda batch: {"memories": [{"id": batch[0][0], "abstract": "short"}], "edges": []})


def test_a_day_in_the_life(engine, spark):
    a = engine.write("first", {"lang": "en"})
    done = engine.write_batch([{"content": "second"}, {"content": ""}])
    b = done[0]["id"]
    assert done[1]["error"] == "BAD_REQUEST" and a.startswith("mem_") and a != b
    with pytest.raises(ValidationError):
        engine.write("")
    row = engine.get(a)
    assert row.content == "first" and row.context == {"lang": "en"} and row.access_count == 0
    engine.relate(a, b, weight=0.8)
    assert engine.relate_batch([{"source_id": a, "target_id": a}, {"source_id": a, "target_id": "mem_x"}, {"source_id": a, "target_id": b, "relation": "related"}]) == ["BAD_REQUEST", "NOT_FOUND", None]
    q = engine.query("first", threshold=-1.0)
    page = engine.search(q)
    assert [r.id for r in page.collect()][0] == a and engine.page_edges(page).count() == 2
    deep = engine.search(engine.query("first", mode="deep", limit=1, threshold=0.0)).collect()
    assert [(r.id, r.score) for r in deep] == [(b, 0.4)]
    engine.touch(q)
    assert engine.get(a).access_count == 1
    near, around = engine.graph(a)
    assert near.count() == 1 and around.count() == 1
    assert engine.status() == {"total_memories": 2, "total_edges": 1, "pending_consolidation": 2, "by_level": {"full": 2}}
    assert engine.consolidate()["memories_processed"] == 2 and engine.log().count() == 1 and engine.status()["pending_consolidation"] == 1
    assert engine.forget() == (0, 0, 0) and engine.health()["status"] == "ok"
    engine.update(a, "changed")
    assert engine.get(a).content == "changed"
    assert engine.by_context([("lang", "en")]).count() == 1
    engine.delete(a)
    assert engine.by_context([("lang", "en")]).count() == 0 and engine.status()["total_edges"] == 0
    for call in (lambda: engine.get(a), lambda: engine.update(a, "x"), lambda: engine.delete(a), lambda: engine.relate(a, b)):
        with pytest.raises(MemoryNotFound):
            call()
    with pytest.raises(ValidationError):
        engine.query("")


def test_command_line(spark, tmp_path, capsys):
    path = f"file://{tmp_path}/s"
    main([path, "write", "hello"])
    made = json.loads(capsys.readouterr().out)
    main([path, "search", "hello"])
    assert json.loads(capsys.readouterr().out)[0]["id"] == made
    main([path, "status"])
    assert json.loads(capsys.readouterr().out)["total_memories"] == 1


def test_tools(engine):
    import struct

    ask = lambda i, method, **params: json.dumps({"jsonrpc": "2.0", "id": i, "method": method, "params": params})
    use = lambda i, name, **a: ask(i, "tools/call", name=name, arguments=a)
    said = [json.loads(x) for x in tools.serve(engine, [ask(1, "initialize"), '{"jsonrpc": "2.0", "method": "notifications/initialized"}', ask(2, "tools/list"), use(3, "write_memory", content="one"), "{", ask(5, "nope"), use(6, "get_memory", id="mem_x"), use(7, "get_memory")])]
    assert len(said) == 7 and len(said[1]["result"]["tools"]) == 5
    made = json.loads(said[2]["result"]["content"][0]["text"])["id"]
    assert [x.get("error", {}).get("code") for x in said[3:]] == [-32700, -32601, None, -32602] and said[5]["result"]["isError"]
    other = json.loads(json.loads(next(tools.serve(engine, [use(1, "write_memory", content="two")])))["result"]["content"][0]["text"])["id"]
    said = [json.loads(json.loads(x)["result"]["content"][0]["text"]) for x in tools.serve(engine, [use(1, "relate", source_id=made, target_id=other), use(2, "search_memory", query="one", limit=1), use(3, "get_memory", id=made), use(4, "delete_memory", id=made)])]
    assert said[1][0]["id"] == made and said[2]["content"] == "one" and said[3] == {"deleted": made}
    df = engine.spark.createDataFrame([(1, bytearray(struct.pack("<3f", 1, 2, 3))), (2, None)], "id int, v binary")
    assert [None if r.v is None else list(r.v) for r in vectors.from_bytes(df, "v").collect()] == [[1.0, 2.0, 3.0], None]
    log = engine.spark.createDataFrame([("GET", "/a", 200, 0.02), ("GET", "/a", 200, 3.0)], "method string, path string, status int, seconds double")
    row = stats.requests(log).first()
    assert (row.n, row["le_0.025"], row["le_5"]) == (2, 1, 2)

import json
import os

import pytest

from codestrata import cli
from codestrata.engine import Engine
from codestrata.enrich import HttpProvider, StubProvider, retried
from codestrata.errors import NotFound

A = "export function greet(n: string) { return trim(n); }\nexport function hello() { return greet('x'); }\n"
B = "export class Box {\n  size = 1;\n  open() { return hello(); }\n}\n"


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "src"
    (root / "node_modules").mkdir(parents=True)
    (root / "a.ts").write_text(A)
    (root / "b.ts").write_text(B)
    (root / "node_modules" / "c.ts").write_text(A)
    (root / "note.txt").write_text("x")
    return root


def shape(engine):
    t = engine.tables
    return (
        sorted(tuple(r) for r in t["symbols"].select("symbol_id", "qualified_name", "start_line").collect()),
        sorted(tuple(r) for r in t["calls"].select("caller_symbol_id", "callee_symbol_id", "site_start_line").collect()),
        sorted(tuple(r) for r in t["symbol_references"].select("to_symbol_id", "ref_kind", "from_start_line", "from_start_col").collect()),
    )


def test_index_query_and_refresh(spark, tree, tmp_path):
    e = Engine(spark, str(tmp_path / "store"), str(tree), languages=["ts"])
    with pytest.raises(NotFound):
        e.tables
    assert e.index(now=1).count() == 0
    assert {r.path for r in e.tables["files"].collect()} == {"a.ts", "b.ts"}
    by = {r.qualified_name: r.symbol_id for r in e.tables["symbols"].collect()}
    assert set(by) == {"greet", "hello", "Box", "Box.size", "Box.open"}
    assert e.find_symbol("greet").first().symbol_id == by["greet"]
    assert e.find_symbols("greet").first().location.path == "a.ts"
    chain = sorted(e.call_chain(by["Box.open"]).collect(), key=lambda r: r.preorder)
    assert [r.node_id for r in chain] == [by["Box.open"], by["hello"], by["greet"]]
    assert {r.name for r in e.object_properties("Box").collect()} == {"size", "open"}
    assert e.references(by["greet"]).where("ref_kind = 'call'").count() == 1
    assert {r.name: r.rows for r in e.stats().collect()}["symbols"] == 5

    got = e.summarize(StubProvider(), retries=0)
    assert got.where("error is null").count() == 5
    e.embed(StubProvider(), "m", retries=0)
    assert e.tables["symbol_embeddings"].count() == 5
    best = e.semantic_search("Describe", "m", StubProvider(), top_k=3, min_similarity=0.0).collect()
    assert len(best) == 3 and best[0].similarity >= best[1].similarity

    (tree / "a.ts").write_text("export function first() { return 1; }\n" + A)
    e.index(now=2)
    again = Engine(spark, str(tmp_path / "other"), str(tree), languages=["ts"])
    again.index("full", now=2)
    assert shape(e) == shape(again)
    moved = {r.qualified_name: r.chunk_summary for r in e.tables["symbols"].collect()}
    assert moved["first"] is None and moved["hello"] is not None
    assert e.tables["symbol_embeddings"].count() == 5
    before = shape(e)
    e.rebuild()
    assert shape(e) == before
    (tree / "b.ts").unlink()
    e.index(now=3)
    assert {r.path for r in e.tables["files"].collect()} == {"a.ts"}
    e.delete_paths(["a.ts"])
    assert e.tables["symbols"].count() == 0


def test_a_file_that_does_not_parse_is_tried_again(spark, tmp_path):
    root = tmp_path / "py"
    root.mkdir()
    (root / "x.py").write_text("def f(:\n")
    (root / "y.py").write_text("def g():\n    return 1\n")
    e = Engine(spark, str(tmp_path / "store"), str(root), languages=["python"])
    assert [r.path for r in e.index().collect()] == ["x.py"]
    (root / "x.py").write_text("def f():\n    return g()\n")
    assert e.index().count() == 0
    assert {r.name for r in e.tables["symbols"].collect()} == {"f", "g"}


def test_watch_stream(spark, tree, tmp_path):
    e = Engine(spark, str(tmp_path / "store"), str(tree), languages=["ts"])
    e.index()
    (tree / "a.ts").write_text(A + "export function third() { return 3; }\n")
    events = tmp_path / "events"
    events.mkdir()
    rows = [{"path": "a.ts", "event": "change", "ts": "2024-01-01T00:00:00Z", "mtime": 2.0, "size": 9, "lines": 30}, {"path": "b.ts", "event": "unlink", "ts": "2024-01-01T00:00:01Z", "mtime": 0.0, "size": 0, "lines": 0}]
    (events / "1.json").write_text("\n".join(map(json.dumps, rows)))
    from codestrata.streaming.events import EVENT

    w = e.watch(spark.readStream.schema(EVENT).json(str(events)), once=True)
    with pytest.raises(RuntimeError):
        e.watch(None)
    w.query.awaitTermination()
    e.stop_watching()
    assert {r.name for r in e.tables["symbols"].collect()} == {"greet", "hello", "third"}


def test_command_line(spark, tree, tmp_path):
    said = []
    run = lambda *a: cli.main(["--root", str(tree), "--store", str(tmp_path / "s"), *a], spark, said.append)
    assert run("index", "--languages", "ts") == 0
    assert run("symbol", "greet", "--json") == 0
    assert json.loads(said[-1])["qualified_name"] == "greet"
    assert run("call-chain", "--from", "2") == 0
    assert said[-1] == "└── greet"
    assert run("properties", "Box") == 0 and said[-1] == "2 found"
    assert run("embed", "--stub") == 2
    assert cli.main(["--root", str(tmp_path), "init"], say=said.append) == 0
    assert cli.main(["--root", str(tmp_path), "init"], say=said.append) == 1
    assert os.path.exists(tmp_path / "strata.config.json")


def test_retries_and_answers():
    calls, waits = [], []

    def fails():
        calls.append(1)
        raise ValueError("no")

    with pytest.raises(ValueError):
        retried(fails, 3, waits.append)
    assert len(calls) == 4 and waits == [1.0, 2.0, 3.0]
    p = HttpProvider("http://x", dimension=8)
    assert "dimensions" not in p.body(["a"], "bge-m3") and p.body(["a"], "other")["dimensions"] == 8
    assert p.vectors([[1.0]]) == p.vectors({"embedding": [1.0]}) == p.vectors({"data": [{"embedding": [1.0]}]}) == [[1.0]]

"""Command line: init, index, rebuild, watch, symbol, call-chain, summarize, properties, embed, search."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from . import config
from .operators import graph, members


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codestrata", description=__doc__)
    p.add_argument("--root", dest="rootDir")
    p.add_argument("--store")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("init", help="write a default configuration file")
    for name in ("index", "rebuild"):
        s = sub.add_parser(name)
        s.add_argument("--languages", nargs="*")
        s.add_argument("--include", nargs="*")
        s.add_argument("--exclude", nargs="*")
        s.add_argument("--nested", type=int, dest="maxNestedStructDepth")
    s = sub.add_parser("watch", help="follow the tree, or a folder of JSON event files")
    s.add_argument("events", nargs="?")
    s.add_argument("--poll", type=float, default=2.0, help="seconds between two listings of the tree")
    s.add_argument("--batch", type=float)
    s.add_argument("--min-lines", type=int)
    s.add_argument("--debounce", type=int)
    s.add_argument("--once", action="store_true")
    s = sub.add_parser("symbol")
    s.add_argument("name")
    s.add_argument("--language")
    s.add_argument("--kind")
    s.add_argument("--in-file")
    s.add_argument("--all", action="store_true")
    s = sub.add_parser("call-chain")
    s.add_argument("--from", dest="symbol", type=int, required=True)
    s.add_argument("--direction", choices=["forward", "backward"], default="forward")
    s.add_argument("--depth", type=int, default=5)
    s = sub.add_parser("properties")
    s.add_argument("object")
    s.add_argument("--language")
    for name in ("summarize", "embed"):
        s = sub.add_parser(name)
        s.add_argument("--model")
        s.add_argument("--stub", action="store_true", help="deterministic answers without a network")
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--model")
    s.add_argument("--top-k", type=int, default=10)
    s.add_argument("--min-similarity", type=float, default=0.7)
    s.add_argument("--language")
    s.add_argument("--kind")
    s.add_argument("--stub", action="store_true")
    for s in sub.choices.values():
        s.add_argument("--json", action="store_true")
    return p


def _provider(settings: dict, stub: bool):
    from .enrich import HttpProvider, StubProvider

    return StubProvider() if stub else HttpProvider(settings["apiEndpoint"], settings["apiKey"], settings.get("dimension"))


def _show(df, as_json: bool, say) -> None:
    """Prints row after row; of the result one partition at a time is on the driver."""
    n = 0
    for r in (df.select(F.to_json(F.struct("*"))) if as_json else df).toLocalIterator():
        say(r[0] if as_json else "  ".join(str(x) for x in r))
        n += 1
    if not as_json:
        say(f"{n} found")


def main(argv: list[str] | None = None, spark=None, say=print) -> int:
    a = _parser().parse_args(argv)
    if a.command == "init":
        try:
            say(str(config.write_default(a.rootDir or ".")))
        except FileExistsError:
            say("a configuration file exists already")
            return 1
        return 0
    given = {k: getattr(a, k, None) for k in ("rootDir", "store", "languages", "include", "exclude", "maxNestedStructDepth")}
    c = config.load(a.rootDir or ".", given)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("codestrata").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    from .engine import Engine

    with Engine(spark, c["store"], c["rootDir"], c["include"], c["exclude"], c["languages"], c["maxNestedStructDepth"], say) as e:
        if a.command in ("index", "rebuild"):
            failed = (e.rebuild() if a.command == "rebuild" else e.index()).collect()
            for r in failed:
                say(f"{r.path}: {r.error}")
            _show(e.stats(), a.json, say)
        elif a.command == "watch":
            from .streaming.events import EVENT

            w = c["watcher"]
            pick = lambda x, k: w[k] if x is None else x
            tree = None if a.events else e.tree_events()
            if tree:
                tree.poll()
            events = tree.stream() if tree else spark.readStream.schema(EVENT).json(a.events)
            watcher = e.watch(events, batch_minutes=pick(a.batch, "batchIntervalMinutes"), least_lines=pick(a.min_lines, "minChangeLines"), debounce_ms=pick(a.debounce, "debounceMs"), once=a.once)
            while tree and not a.once and not watcher.query.awaitTermination(max(1, round(a.poll))):
                tree.poll()
            watcher.query.awaitTermination()
            e.stop_watching()
        elif a.command == "symbol":
            found = e.find_symbols(a.name, a.language, a.kind) if a.all else e.find_symbol(a.name, a.language, a.in_file, a.kind)
            _show(found.select("symbol_id", "kind", "qualified_name", "start_line", "end_line"), a.json, say)
        elif a.command == "call-chain":
            rows = e.call_chain(a.symbol, a.direction, a.depth).collect()
            ids = [r.node_id for r in rows]
            names = {r.symbol_id: r.qualified_name for r in e.tables["symbols"].where(e.tables["symbols"].symbol_id.isin(ids)).select("symbol_id", "qualified_name").collect()}
            tree = graph.nested(rows, names)
            for line in [json.dumps(tree)] if a.json else graph.drawn(tree) if tree else ["no such symbol"]:
                say(line)
        elif a.command == "properties":
            _show(members.displayed(e.object_properties(a.object, a.language)).select("symbol_id", "kind", "tail", "depth"), a.json, say)
        elif a.command in ("summarize", "embed"):
            s = c["summarizer" if a.command == "summarize" else "embedding"]
            model = a.model or s["model"]
            if not model:
                say("a model is required")
                return 2
            run = e.summarize if a.command == "summarize" else e.embed
            got = run(_provider(s, a.stub), model, s["concurrency"], s["maxRetries"])
            failed = got.where("error is not null").count()
            say(f"{got.count() - failed} done, {failed} failed")
        elif a.command == "search":
            s = c["embedding"]
            model = a.model or s["defaultModel"] or s["model"]
            if not model:
                say("a model is required")
                return 2
            found = e.semantic_search(a.query, model, _provider(s, a.stub), a.top_k, a.language, a.kind, a.min_similarity)
            _show(found.select("similarity", "kind", "qualified_name", "path"), a.json, say)
    return 0


if __name__ == "__main__":
    sys.exit(main())

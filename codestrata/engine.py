"""The public interface: one engine over one source tree and one store of snapshots."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import enrich, schema
from .operators import graph, lookup, members, resolve, search, store, worklists
from .sources import files as source


class Engine:
    """Indexes a tree of source files and answers questions about it; results are DataFrames.

    An incremental run extracts only files whose hash changed and keeps the items of all others, so it ends in the
    same tables as a full one; a file that can't be parsed keeps its old row and is tried again.
    """

    def __init__(self, spark: SparkSession, path: str, root: str = ".", include=("**/*",), exclude=source.EXCLUDE, languages=None, nested: int = 3, log: Callable[[str], None] | None = None, progress: Callable[[int, int], None] | None = None):
        self.spark, self.root, self.path = spark, root, path.rstrip("/")
        self.include, self.exclude, self.languages, self.nested = list(include), list(exclude), languages, nested
        self.store = store.Store(spark, path)
        self.log = log or (lambda message: None)
        self.progress = progress  # called with the files indexed and the files that had changed
        self._tables: dict[str, DataFrame] | None = None

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self._tables = None

    @property
    def tables(self) -> dict[str, DataFrame]:
        """The current snapshot, opened at first use; NotFound if there is none."""
        if self._tables is None:
            self._tables = self.store.read()
        return self._tables

    def _stored(self, df: DataFrame, name: str) -> DataFrame:
        at = f"{self.path}/work/{name}-{time.time_ns()}"
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def _items(self) -> DataFrame | None:
        at = f"{self.path}/{self.store.current()}/items" if self.store.exists() else None
        return self.spark.read.schema(schema.ITEMS).parquet(at) if at else None

    def index(self, mode: str = "incremental", prune: bool = True, paths: list[str] | None = None, now: int | None = None) -> DataFrame:
        """Indexes the tree and returns (path, error) of files that failed. mode "full" starts anew; paths restricts
        an incremental run to these relative paths; prune drops files that are no longer there."""
        if mode not in ("incremental", "full"):
            raise ValueError("mode is incremental or full")
        now = int(time.time()) if now is None else now
        how = (self.include, self.exclude, self.languages)
        found = source.scan(self.spark, self.root, *how) if paths is None else source.read(self.spark, self.root, paths, *how)
        old = self.store.read() if self.store.exists() else self.store.empty()
        known = old["files"] if mode == "incremental" else self.store.empty()["files"]
        new = self._stored(source.changed(found, known), "changed")
        fresh = self._stored(source.extract(new, self.nested), "items")
        failed = fresh.where("item = 'error'").select("path", "error")
        good = new.join(failed, "path", "left_anti").drop("content")
        done, total = good.count(), new.count()
        self.log(f"{total} files changed")
        if self.progress:
            self.progress(done, total)
        gone = source.vanished(source.listed(self.spark, self.root, *how), known) if prune and paths is None else known.limit(0)
        base = known.join(gone.select("path"), "path", "left_anti")
        listed = self._stored(store.upsert_files(base, good, now, f"{self.path}/work/ids-{time.time_ns()}"), "files")
        kept = self._items() if mode == "incremental" else None
        items = fresh.where("item != 'error'")
        if kept is not None:
            items = items.unionByName(kept.join(new.select("path"), "path", "left_anti").unionByName(kept.join(failed, "path", "left_semi")).join(listed.select("path"), "path", "left_semi"))
        items = self._stored(items, "all")
        built = resolve.tables(items, listed, f"{self.path}/work/{time.time_ns()}")
        symbols = self._carried(built["symbols"], listed, old) if mode == "incremental" else built["symbols"]
        symbols = self._stored(symbols, "symbols")
        embeddings = self._moved(old, listed, symbols) if mode == "incremental" else self.store.empty()["symbol_embeddings"]
        name = self.store.commit({"files": listed, **built, "symbols": symbols, "symbol_embeddings": self._stored(embeddings, "embeddings")})
        items.write.parquet(f"{self.path}/{name}/items")
        self._tables = None
        return failed

    @staticmethod
    def _places(symbols: DataFrame, files: DataFrame) -> DataFrame:
        """Symbols under a name that outlives renumbering: path, qualified name and kind, and the order among equals."""
        from pyspark.sql.window import Window

        by = Window.partitionBy("path", "qualified_name", "kind").orderBy("symbol_id")
        return symbols.join(files.select("file_id", "path"), "file_id").withColumn("nth", F.row_number().over(by))

    def _carried(self, symbols: DataFrame, files: DataFrame, old: dict[str, DataFrame]) -> DataFrame:
        """Summaries of symbols that were there before; a changed chunk shows by its hash."""
        keys = ["path", "qualified_name", "kind", "nth"]
        extra = ["chunk_hash", "chunk_summary", "summary_tokens", "summarized_at"]
        before = self._places(old["symbols"], old["files"]).where("chunk_hash is not null").select(*keys, *extra)
        return self._places(symbols.drop(*extra), files).join(before, keys, "left").select(schema.SYMBOLS.names)

    def _moved(self, old: dict[str, DataFrame], files: DataFrame, symbols: DataFrame) -> DataFrame:
        keys = ["path", "qualified_name", "kind", "nth"]
        before = self._places(old["symbols"], old["files"]).select(*keys, F.col("symbol_id").alias("old_id"))
        now = self._places(symbols, files).select(*keys, "symbol_id")
        pairs = before.join(now, keys).select("old_id", "symbol_id")
        return old["symbol_embeddings"].withColumnRenamed("symbol_id", "old_id").join(pairs, "old_id").select(schema.EMBEDDINGS.names)

    def rebuild(self) -> DataFrame:
        """Indexes everything anew and removes older snapshots."""
        failed = self._stored(self.index("full"), "failed")
        items = self._stored(self._items(), "kept")
        name = self.store.vacuum()
        items.write.parquet(f"{self.path}/{name}/items")
        self._tables = None
        return failed

    def clean(self) -> None:
        """Deletes the working folder; DataFrames that earlier calls have returned may read from it."""
        self.store.fs.delete(self.store._path("work"), True)

    def update_files(self, paths: list[str]) -> DataFrame:
        return self.index("incremental", prune=False, paths=paths)

    def delete_paths(self, paths: list[str] = (), directories: list[str] = ()) -> None:
        """Drops files and whole directories from the index, with all that hangs on them."""
        t, kept = self.tables, self._items()
        wrong = F.col("path").isin(list(paths))
        for d in directories:
            wrong = wrong | store.below(F.col("path"), d)
        left = store.delete_by_file(t, t["files"].where(wrong))
        name = self.store.commit(left)
        kept.where(~wrong).write.parquet(f"{self.path}/{name}/items")
        self._tables = None

    def find_symbols(self, name: str, language: str | None = None, kind: str | None = None) -> DataFrame:
        if not name:
            raise ValueError("name is required")
        t = self.tables
        hits = lookup.find_symbols(t["symbols"], name, language, kind)
        return hits.join(lookup.definition(hits, t["files"]).select("symbol_id", "location"), "symbol_id", "left")

    def find_symbol(self, name: str, language: str | None = None, in_file: str | None = None, kind: str | None = None) -> DataFrame:
        if not name:
            raise ValueError("name is required")
        return lookup.find_symbol(self.tables["symbols"], self.tables["files"], name, language, in_file, kind)

    def object_properties(self, name: str, language: str | None = None) -> DataFrame:
        return members.object_properties(self.tables["symbols"], self.tables["files"], name, language)

    def definition(self, symbol_id: int) -> DataFrame:
        return lookup.definition(self.tables["symbols"], self.tables["files"], symbol_id)

    def references(self, symbol_id: int) -> DataFrame:
        return lookup.references(self.tables["symbol_references"], self.tables["files"], symbol_id)

    def call_chain(self, symbol_id: int, direction: str = "forward", depth: int = 5, mode: str = "dfs") -> DataFrame:
        roots = self.spark.createDataFrame([(symbol_id,)], "root bigint")
        return graph.call_chain(self.tables["calls"], self.tables["symbols"], roots, self._stored, direction, depth, mode)

    def implementations(self, symbol_id: int) -> DataFrame:
        """Declared for completeness; always empty."""
        return self.tables["symbols"].limit(0)

    def match_snippet(self, code: str, language: str | None = None) -> DataFrame:
        """Declared for completeness; always empty."""
        return self.tables["symbols"].limit(0)

    def stats(self) -> DataFrame:
        return lookup.stats({k: v for k, v in self.tables.items() if k != "symbol_embeddings"})

    def _contents(self) -> DataFrame:
        return source.scan(self.spark, self.root, self.include, self.exclude, self.languages)

    def _commit(self, **changed: DataFrame) -> None:
        tables, items = self.tables, self._items()
        name = self.store.commit({**tables, **changed})
        items.write.parquet(f"{self.path}/{name}/items")
        self._tables = None

    def summarize(self, provider, model: str = "gpt-4o-mini", size: int = 5, retries: int = 3) -> DataFrame:
        """Summaries for all symbols that need one; returns what each attempt gave."""
        t = self.tables
        got = self._stored(enrich.summarize(t["symbols"], t["files"], self._contents(), provider, model, size, retries), "summaries")
        self._commit(symbols=self._stored(store.update_summaries(t["symbols"], got.where("error is null"), int(time.time())), "symbols"))
        return got

    def embed(self, provider, model: str, size: int = 5, retries: int = 3) -> DataFrame:
        """Embeddings for all symbols without one for their present chunk; returns what each attempt gave."""
        t = self.tables
        todo = worklists.needs_embedding(t["symbols"], t["symbol_embeddings"], model)
        got = self._stored(enrich.embed(todo, provider, model, int(time.time()), size, retries), "vectors")
        new = got.where("error is null").select(schema.EMBEDDINGS.names)
        self._commit(symbol_embeddings=self._stored(store.upsert_embeddings(t["symbol_embeddings"], new), "embeddings"))
        return got

    def semantic_search(self, query: str | list[float], model: str, provider=None, top_k: int = 10, language: str | None = None, kind: str | None = None, min_similarity: float = 0.7) -> DataFrame:
        """query is a vector, or a text that the provider embeds with the same model."""
        if isinstance(query, str):
            if provider is None:
                raise ValueError("a text query needs a provider")
            (query,) = provider.embed([query], model)
            size = sum(x * x for x in query) ** 0.5
            query = [x / size for x in query] if size else query
        t = self.tables
        return search.semantic_search(t["symbol_embeddings"], t["symbols"], t["files"], query, model, top_k, language, kind, min_similarity)

    def tree_events(self):
        """A poller of the engine's tree, whose stream() is for watch()."""
        from .streaming.tree import TreeEvents

        return TreeEvents(self.spark, self.root, f"{self.path}/tree", self.include, self.exclude, self.languages)

    def watch(self, events: DataFrame, **how):
        """A started Watcher that keeps the index up to date with a stream of file events."""
        from .streaming.events import Watcher

        if getattr(self, "_watcher", None) is not None:
            raise RuntimeError("one watcher at a time")
        once = how.pop("once", False)
        self._watcher = Watcher(events, self.update_files, self.delete_paths, f"{self.path}/watch", **how)
        self._watcher.start(once)
        return self._watcher

    def stop_watching(self) -> None:
        if getattr(self, "_watcher", None) is not None:
            self._watcher.stop()
            self._watcher = None

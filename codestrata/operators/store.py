"""Snapshots of the five tables and their changes as whole-table expressions.

A snapshot is a folder of Parquet tables; a pointer file names the current one. A change writes a new snapshot and
then replaces the pointer in one rename, so a reader sees the old state or the new one and a failed writer nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema
from ..errors import NotFound, StoreError


def upsert_files(old: DataFrame, new: DataFrame, now: int, scratch: str) -> DataFrame:
    """Files by path: known paths keep their id and take the new values (the language too); new ones get ids above
    the largest, in order of path. new: path, language, content_hash, mtime, size (paths are unique)."""
    from .ids import numbered

    top = old.agg(F.coalesce(F.max("file_id"), F.lit(0)).alias("top")).first().top
    fresh = numbered(new.join(old.select("path"), "path", "left_anti"), "path", scratch, start=top + 1)
    fresh = fresh.select(F.col("__seq").alias("file_id"), "path", "language", "content_hash", "mtime", "size", F.lit(now).cast("bigint").alias("indexed_at"))
    kept = old.join(new.select("path"), "path", "left_anti").select(schema.FILES.names)
    updated = old.select("file_id", "path").join(new, "path").select("file_id", "path", "language", "content_hash", "mtime", "size", F.lit(now).cast("bigint").alias("indexed_at"))
    return kept.unionByName(updated).unionByName(fresh)


def keep_latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row a key: the first in `order`. A key's rows are ranked, of which each task sends on only the best."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rank", F.row_number().over(by)).where("__rank = 1").drop("__rank")


def upsert_embeddings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Embeddings by (symbol_id, model): the newest row, with the oldest created_at."""
    rows = old.unionByName(new)
    newest = keep_latest(rows, ["symbol_id", "model"], [F.desc("updated_at"), F.desc("created_at")]).drop("created_at")
    created = rows.groupBy("symbol_id", "model").agg(F.min("created_at").alias("created_at"))
    return newest.join(created, ["symbol_id", "model"]).select(schema.EMBEDDINGS.names)


def update_summaries(symbols: DataFrame, updates: DataFrame, now: int) -> DataFrame:
    """Sets the summary columns from (symbol_id, chunk_hash, summary, tokens); other symbols stay. 0 tokens stay 0."""
    u = updates.select("symbol_id", F.col("chunk_hash").alias("__h"), F.col("summary").alias("__s"), F.col("tokens").cast("int").alias("__t"))
    met = symbols.join(u, "symbol_id", "left")
    new = F.col("__s").isNotNull()
    pick = lambda a, b: F.when(new, F.col(a)).otherwise(F.col(b))
    return met.withColumns({"chunk_hash": pick("__h", "chunk_hash"), "chunk_summary": pick("__s", "chunk_summary"), "summary_tokens": pick("__t", "summary_tokens"), "summarized_at": F.when(new, F.lit(now).cast("bigint")).otherwise(F.col("summarized_at"))}).select(symbols.columns)


def delete_by_file(tables: dict[str, DataFrame], file_ids: DataFrame) -> dict[str, DataFrame]:
    """Deletes files and all that hangs on them: symbols, then calls, references and embeddings, by anti joins."""
    ids = file_ids.select("file_id").distinct()
    gone = tables["symbols"].join(ids, "file_id", "left_semi").select("symbol_id")
    named = lambda c: gone.withColumnRenamed("symbol_id", c)
    of = lambda c: ids.withColumnRenamed("file_id", c)
    out = dict(tables)
    out["files"] = tables["files"].join(ids, "file_id", "left_anti")
    out["symbols"] = tables["symbols"].join(ids, "file_id", "left_anti")
    calls = tables["calls"].join(of("site_file_id"), "site_file_id", "left_anti")
    out["calls"] = calls.join(named("caller_symbol_id"), "caller_symbol_id", "left_anti").join(named("callee_symbol_id"), "callee_symbol_id", "left_anti")
    out["symbol_references"] = tables["symbol_references"].join(of("from_file_id"), "from_file_id", "left_anti").join(named("to_symbol_id"), "to_symbol_id", "left_anti")
    out["symbol_embeddings"] = tables["symbol_embeddings"].join(gone, "symbol_id", "left_anti")
    return {k: v.select(schema.TABLES[k].names) for k, v in out.items()}


def below(path, directory: str):
    """The directory itself or a path in it."""
    d = directory.rstrip("/")
    return (path == d) | F.startswith(path, F.lit(d + "/"))


def delete_directory(tables: dict[str, DataFrame], directory: str) -> dict[str, DataFrame]:
    return delete_by_file(tables, tables["files"].where(below(F.col("path"), directory)))


def migrate(df: DataFrame, target) -> DataFrame:
    """Adds the columns of the schema that a table lacks, as nulls, in the schema's order."""
    return df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in target])


class Store:
    """A folder of snapshots."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self) -> bool:
        return self.fs.exists(self._path("CURRENT"))

    def current(self) -> str:
        if not self.exists():
            raise NotFound(f"no snapshot in {self.path}")
        try:
            stream = self.fs.open(self._path("CURRENT"))
            try:
                return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
            finally:
                stream.close()
        except Exception as e:
            raise StoreError(f"the pointer of {self.path} can't be read") from e

    def read(self) -> dict[str, DataFrame]:
        """All tables of the current snapshot; columns that an older one lacks are null."""
        at = f"{self.path}/{self.current()}"
        return {name: self.spark.read.schema(s).parquet(f"{at}/{name}").select(s.names) for name, s in schema.TABLES.items()}

    def empty(self) -> dict[str, DataFrame]:
        return {name: self.spark.createDataFrame([], s) for name, s in schema.TABLES.items()}

    def commit(self, tables: dict[str, DataFrame]) -> str:
        """Writes a snapshot, then the pointer."""
        name = f"snapshot-{uuid.uuid4().hex}"
        for key, kind in schema.TABLES.items():
            out = migrate(tables[key], kind)
            if key == "symbols":
                out = out.sortWithinPartitions("name")
            out.write.partitionBy(*schema.PARTITIONS.get(key, [])).parquet(f"{self.path}/{name}/{key}")
        fresh = self._path(f".CURRENT-{uuid.uuid4().hex}")
        stream = self.fs.create(fresh, True)
        stream.write(bytearray(name.encode()))
        stream.close()
        old = self._path("CURRENT")
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fresh, old, options)
        return name

    def clear(self) -> str:
        return self.commit(self.empty())

    def vacuum(self, target_rows: int = 5_000_000) -> str:
        """Rewrites the tables in files of about target_rows rows and removes all other snapshots."""
        tables = {}
        for key, df in self.read().items():
            tables[key] = df.repartition(max(1, -(-df.count() // target_rows)))
        name = self.commit(tables)
        for status in self.fs.listStatus(self._path("")):
            other = status.getPath().getName()
            if other.startswith("snapshot-") and other != name:
                self.fs.delete(status.getPath(), True)
        return name

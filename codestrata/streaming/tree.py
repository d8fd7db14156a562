"""File events out of a tree: two listings are compared; no file is read but those that have changed."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import files as source
from .events import EVENT


def compare(base: DataFrame, before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, event, mtime, size): what has happened to the files of `base` (those reported so far).

    All three: path, mtime, size. A file that is new or other than in base is reported once two listings in a row
    (before, now) agree on it, so a file that is still being written waits; one that is missing now is reported at once.
    """
    side = lambda df, name: df.select("path", F.struct("mtime", "size").alias(name))
    met = side(now, "n").join(side(before, "b"), "path", "left").join(side(base, "o"), "path", "full")
    stable = F.col("n").isNotNull() & F.col("n").eqNullSafe(F.col("b"))
    event = F.when(F.col("n").isNull(), F.when(F.col("o").isNotNull(), "unlink")).when(stable & F.col("o").isNull(), "add").when(stable & ~F.col("n").eqNullSafe(F.col("o")), "change")
    rows = met.withColumn("event", event).where("event is not null")
    return rows.select("path", "event", F.coalesce("n.mtime", "o.mtime").alias("mtime"), F.coalesce("n.size", "o.size").alias("size"))


class TreeEvents:
    """Polls a tree and writes its events as JSON files into `folder`, which a file stream follows. The first poll
    reports nothing. Listings are kept below `folder` too, so polling goes on where an earlier process has stopped."""

    def __init__(self, spark: SparkSession, root: str, folder: str, include=("**/*",), exclude=source.EXCLUDE, languages=None):
        self.spark, self.root, self.folder = spark, root, folder.rstrip("/")
        self.include, self.exclude, self.languages = list(include), list(exclude), languages
        self.events = f"{self.folder}/events"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path(self.events))
        done = sorted(int(s.getPath().getName()[5:]) for s in fs.listStatus(path(self.folder)) if s.getPath().getName().startswith("poll-") and fs.exists(path(f"{s.getPath()}/base/_SUCCESS")))
        self.polls = done[-1] + 1 if done else 0

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema("path string, mtime double, size bigint").parquet(f"{self.folder}/poll-{self.polls - 1}/{name}")

    def poll(self, now: float | None = None) -> int:
        """Lists the tree, writes the events since the last poll and returns their number."""
        at = f"{self.folder}/poll-{self.polls}"
        source.listed(self.spark, self.root, self.include, self.exclude, self.languages).write.mode("overwrite").parquet(f"{at}/now")
        listing = self.spark.read.schema("path string, mtime double, size bigint").parquet(f"{at}/now")
        if not self.polls:
            listing.write.mode("overwrite").parquet(f"{at}/base")
            self.polls = 1
            return 0
        base = self._read("base")
        found = compare(base, self._read("now"), listing).cache()
        try:
            paths = [r.path for r in found.where("event != 'unlink'").select("path").collect()]
            lines = source.read(self.spark, self.root, paths).select("path", T.line_count(F.col("content")).alias("lines"))
            stamp = F.timestamp_micros(F.lit(int((time.time() if now is None else now) * 1e6)))
            rows = found.join(lines, "path", "left").select("path", "event", stamp.alias("ts"), "mtime", "size", F.col("lines").cast("int").alias("lines"))
            count = rows.count()
            new = base.join(found.select("path"), "path", "left_anti").unionByName(found.where("event != 'unlink'").select("path", "mtime", "size"))
            new.write.mode("overwrite").parquet(f"{at}/base")
            if count:
                rows.coalesce(1).write.mode("append").json(self.events)
        finally:
            found.unpersist()
        self.polls += 1
        return count

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(EVENT).option("pathGlobFilter", "*.json").json(self.events)

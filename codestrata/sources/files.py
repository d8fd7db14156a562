"""Source files: globs, scan, language and change detection."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

EXCLUDE = ("**/node_modules/**", "**/dist/**", "**/.git/**")


def glob_regex(pattern: str) -> str:
    """A regex for a whole relative path. `**/` matches any directories or none, `*` and `?` stay inside a segment,
    {a,b} and [abc] work as in a shell; all else is literal."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "{" and (end := pattern.find("}", i)) > 0:
            out += "(?:" + "|".join(glob_regex(x)[1:-1] for x in pattern[i + 1 : end].split(",")) + ")"
            i = end + 1
        elif c == "[" and (end := pattern.find("]", i + 1)) > 0:
            inner = pattern[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner[:1] in "!^" else inner) + "]"
            i = end + 1
        else:
            out, i = out + re.escape(c), i + 1
    return f"^{out}$"


def matches(path: Column, include: list[str], exclude: list[str] = ()) -> Column:
    """Some include glob and no exclude glob matches."""
    any_of = lambda ps: path.rlike("|".join(f"(?:{glob_regex(p)})" for p in ps)) if ps else F.lit(False)
    return any_of(list(include)) & ~any_of(list(exclude))


def describe(files: DataFrame) -> DataFrame:
    """(path, content string) -> language, hash and size besides."""
    return files.withColumns({"language": T.language(F.col("path")), "content_hash": T.content_hash(F.col("content"))})


def _path(root: str) -> Column:
    return T.relative(F.col("path"), root if "://" not in root else "/" + root.split("://", 1)[1].lstrip("/"))


def _chosen(files: DataFrame, include: list[str], exclude: list[str], languages: list[str] | None) -> DataFrame:
    files = files.where(matches(F.col("path"), include, exclude)).withColumn("language", T.language(F.col("path"))).where("language is not null")
    return files if languages is None else files.where(F.col("language").isin(list(languages)))


def _raw(spark: SparkSession, root: str, languages: list[str] | None) -> DataFrame:
    """All files below root; the extensions prune the listing before any content is read."""
    wanted = [e for e, lang in T.EXTENSIONS.items() if languages is None or lang in languages]
    ends = ",".join(sorted({x for e in wanted for x in (e, e.upper())}))
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{ends}}}").load(root)


def _with_content(raw: DataFrame, root: str) -> DataFrame:
    return raw.select(_path(root).alias("path"), F.decode("content", "UTF-8").alias("content"), (F.unix_micros("modificationTime") / 1000.0).alias("mtime"), F.col("length").alias("size"))


def scan(spark: SparkSession, root: str, include: list[str] = ("**/*",), exclude: list[str] = EXCLUDE, languages: list[str] | None = None) -> DataFrame:
    """(path, language, content, content_hash, mtime, size) of the files below root whose language is known; globs and
    the language list filter by path."""
    files = describe(_chosen(_with_content(_raw(spark, root, languages), root), include, exclude, languages))
    return files.select("path", "language", "content", "content_hash", "mtime", "size")


def listed(spark: SparkSession, root: str, include: list[str] = ("**/*",), exclude: list[str] = EXCLUDE, languages: list[str] | None = None) -> DataFrame:
    """(path, mtime, size) of the same files; their contents aren't read."""
    raw = _raw(spark, root, languages).select(_path(root).alias("path"), (F.unix_micros("modificationTime") / 1000.0).alias("mtime"), F.col("length").alias("size"))
    return _chosen(raw, include, exclude, languages).select("path", "mtime", "size")


def read(spark: SparkSession, root: str, paths: list[str], include: list[str] = ("**/*",), exclude: list[str] = EXCLUDE, languages: list[str] | None = None) -> DataFrame:
    """scan() of these relative paths alone: no other file is listed or read. Paths that don't exist are left out."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    here = []
    for p in sorted(set(paths)):
        at = jvm.org.apache.hadoop.fs.Path(jvm.org.apache.hadoop.fs.Path(root), p)
        fs = at.getFileSystem(conf)
        if fs.exists(at) and fs.getFileStatus(at).isFile():
            here.append(re.sub(r"([\\{}\[\]*?])", r"\\\1", str(fs.makeQualified(at).toString())))  # a glob of itself
    if not here:
        return spark.createDataFrame([], "path string, language string, content string, content_hash string, mtime double, size bigint")
    raw = _with_content(spark.read.format("binaryFile").load(here), str(root))
    files = describe(_chosen(raw, include, exclude, languages))
    return files.select("path", "language", "content", "content_hash", "mtime", "size")


def changed(found: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose hash differs from the known one under the same path, and new ones."""
    old = known.select("path", F.col("content_hash").alias("__old"))
    return found.join(old, "path", "left").where(~F.col("content_hash").eqNullSafe(F.col("__old"))).drop("__old")


def vanished(found: DataFrame, known: DataFrame) -> DataFrame:
    """Known files that the scan no longer finds."""
    return known.join(found.select("path"), "path", "left_anti")


def extract(files: DataFrame, nested: int = 3) -> DataFrame:
    """Items (schema.ITEMS) of (path, language, content). A file that can't be parsed gives one error row."""
    from .. import schema

    def run(batches):
        import pandas as pd

        from ..extractors import items

        for pdf in batches:
            for start in range(0, len(pdf), 64):
                rows = [r for x in pdf.iloc[start : start + 64].itertuples() for r in items(x.path, x.content or "", x.language, nested)]
                yield pd.DataFrame(rows, columns=schema.ITEMS.names).astype(object).where(lambda d: d.notna(), None)

    return files.select("path", "language", "content").mapInPandas(run, schema.ITEMS)

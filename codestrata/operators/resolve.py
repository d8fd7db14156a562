"""From extracted items to the symbol, call and reference tables.

Files are numbered by path. A name resolves to the symbol with the smallest id among the files that come no later
than the site's file, which is what indexing file after file in that order gives; as a set formula it needs one
aggregation by name and one join. A full rebuild and an incremental run give the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Lines of a bin: most functions reach into one or two.
BIN = 64


def innermost(sites: DataFrame, ranges: DataFrame, key: str, site: str, line: str, order: str) -> DataFrame:
    """Each site's smallest range of the same key that holds its line; the first in `order` among equals.

    ranges: key, start_line, end_line, `order` and further columns, which come back as a struct `inner_range`. A range is
    dealt to each BIN of lines that it reaches into, and a site meets those of its own bin alone, by an equi-join on key
    and bin; the choice is a partial aggregation, so no site's candidates are sorted. Null lines hold nothing.
    """
    r = ranges.select(key, F.struct(*[c for c in ranges.columns if c != key]).alias("inner_range")).where("inner_range.start_line <= inner_range.end_line")
    bins = lambda c: F.floor(F.col(c) / BIN).cast("bigint")
    r = r.withColumn("__bin", F.explode(F.sequence(bins("inner_range.start_line"), bins("inner_range.end_line"))))
    met = sites.withColumn("__bin", bins(line)).join(r, [key, "__bin"]).where(F.col(line).between(F.col("inner_range.start_line"), F.col("inner_range.end_line")))
    rank = F.struct(F.col("inner_range.end_line") - F.col("inner_range.start_line"), F.col(f"inner_range.{order}"))
    return met.groupBy(key, site).agg(F.min_by("inner_range", rank).alias("inner_range"))


def first_by_name(symbols: DataFrame) -> DataFrame:
    """name -> its smallest symbol_id and the place in order of that symbol's file."""
    return symbols.groupBy("name").agg(F.min("symbol_id").alias("target_id"), F.min_by("file_seq", "symbol_id").alias("target_seq"))


def by_name(sites: DataFrame, symbols: DataFrame, name: str = "name") -> DataFrame:
    """Sites (with file_seq) whose name has a symbol in a file that comes no later; target_id is that symbol.

    The name side has one row a name; a very frequent name on the other side is split by adaptive execution.
    """
    names = first_by_name(symbols).withColumnRenamed("name", name)
    return sites.join(names, name).where(F.col("target_seq") <= F.col("file_seq")).drop("target_seq")


def last_by_qualified_name(symbols: DataFrame) -> DataFrame:
    """(file_id, qualified_name) -> the largest symbol_id."""
    return symbols.groupBy("file_id", "qualified_name").agg(F.max("symbol_id").alias("symbol_id"))


_SPAN = ["start_line", "start_col", "end_line", "end_col"]


def tables(items: DataFrame, files: DataFrame, path: str) -> dict[str, DataFrame]:
    """symbols, calls and references of all files. files: file_id, path. Ids follow path order and order in the file.

    Calls without a containing or a known symbol and references to unknown names are dropped.
    """
    from .. import schema
    from .ids import numbered

    counts = items.where("item = 'symbol'").groupBy("path").count()
    seq = numbered(files.select("file_id", "path").join(counts, "path", "left").na.fill(0, ["count"]), "path", f"{path}/file_order", "count")
    seq = seq.select("path", "file_id", F.col("__seq").alias("file_seq"), F.col("__base").alias("base"))
    placed = items.join(seq, "path")
    symbols = placed.where("item = 'symbol'").withColumn("symbol_id", F.col("base") + F.col("ordinal") + 1)
    calls = placed.where("item = 'call'").withColumn("site", F.concat_ws(":", "file_id", "ordinal"))
    inner = innermost(calls.select("file_id", "site", F.col("start_line").alias("line")), symbols.select("file_id", "start_line", "end_line", "ordinal", "qualified_name"), "file_id", "site", "line", "ordinal")
    callers = inner.select("file_id", "site", F.col("inner_range.qualified_name").alias("qualified_name")).join(last_by_qualified_name(symbols), ["file_id", "qualified_name"]).select("site", F.col("symbol_id").alias("caller_symbol_id"))
    resolved = by_name(calls.select("site", "file_id", "file_seq", "ordinal", "name", *_SPAN), symbols.select("name", "symbol_id", "file_seq")).join(callers, "site")
    refs = by_name(placed.where("item = 'reference'").select("file_id", "file_seq", "ordinal", "name", "kind", *_SPAN), symbols.select("name", "symbol_id", "file_seq"))
    null = lambda t: F.lit(None).cast(t)
    out_symbols = symbols.withColumns({"chunk_hash": null("string"), "chunk_summary": null("string"), "summary_tokens": null("int"), "summarized_at": null("bigint")}).select(schema.SYMBOLS.names)
    number = lambda df: (F.col("file_seq") * (1 << 24) + F.col("ordinal")).cast("bigint")  # noqa: E731  room for 16 million items a file
    out_calls = resolved.select(number(resolved).alias("call_id"), "caller_symbol_id", F.col("target_id").alias("callee_symbol_id"), F.col("file_id").alias("site_file_id"), *[F.col(c).alias(f"site_{c}") for c in _SPAN])
    out_refs = refs.select(number(refs).alias("ref_id"), F.col("file_id").alias("from_file_id"), *[F.col(c).alias(f"from_{c}") for c in _SPAN], F.col("target_id").alias("to_symbol_id"), F.col("kind").alias("ref_kind"))
    return {"symbols": out_symbols, "calls": out_calls, "symbol_references": out_refs}

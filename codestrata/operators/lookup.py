"""Point and prefix lookups over the symbol tables; every filter reaches the Parquet scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PLACE = ["path", "start_line", "start_col", "end_line", "end_col"]


def find_symbols(symbols: DataFrame, name: str, language: str | None = None, kind: str | None = None) -> DataFrame:
    """All symbols with this name, of the language and kind if given."""
    out = symbols.where(F.col("name") == name)
    if language is not None:
        out = out.where(F.col("language") == language)
    return out if kind is None else out.where(F.col("kind") == kind)


def find_symbol(symbols: DataFrame, files: DataFrame, name: str, language: str | None = None, in_file: str | None = None, kind: str | None = None) -> DataFrame:
    """The best match: in_file (a part of the path) and then kind narrow the matches, but neither when it would leave
    none; the smallest id of what is left. At most one row."""
    out = find_symbols(symbols, name, language).join(files.select("file_id", "path"), "file_id")
    here = F.contains("path", F.lit(in_file)) if in_file is not None else F.lit(False)
    like = F.col("kind") == kind if kind is not None else F.lit(False)
    return out.orderBy(here.desc(), like.desc(), "symbol_id").limit(1).drop("path")


def by_id(table: DataFrame, key: str, value: int) -> DataFrame:
    return table.where(F.col(key) == value)


def file_by_path(files: DataFrame, path: str) -> DataFrame:
    return files.where(F.col("path") == path)


def in_file(symbols: DataFrame, file_id: int) -> DataFrame:
    return symbols.where(F.col("file_id") == file_id)


def definition(symbols: DataFrame, files: DataFrame, symbol_id: int | None = None) -> DataFrame:
    """Where symbols are defined: the place as a struct."""
    chosen = symbols if symbol_id is None else symbols.where(F.col("symbol_id") == symbol_id)
    return chosen.join(files.select("file_id", "path"), "file_id").select("symbol_id", "name", "qualified_name", F.struct(*_PLACE).alias("location"))


def references(refs: DataFrame, files: DataFrame, symbol_id: int | None = None) -> DataFrame:
    """Places that refer to a symbol; those in files that are gone are left out."""
    chosen = refs if symbol_id is None else refs.where(F.col("to_symbol_id") == symbol_id)
    met = chosen.join(files.select(F.col("file_id").alias("from_file_id"), "path"), "from_file_id")
    return met.select("ref_id", "to_symbol_id", "ref_kind", F.struct("path", *[F.col(f"from_{c}").alias(c) for c in _PLACE[1:]]).alias("location"))


def calls_from(calls: DataFrame, symbol_id: int) -> DataFrame:
    return calls.where(F.col("caller_symbol_id") == symbol_id)


def calls_to(calls: DataFrame, symbol_id: int) -> DataFrame:
    return calls.where(F.col("callee_symbol_id") == symbol_id)


def has_embedding(embeddings: DataFrame, symbol_id: int, model: str) -> bool:
    return not embeddings.where((F.col("symbol_id") == symbol_id) & (F.col("model") == model)).limit(1).isEmpty()


def embedding(embeddings: DataFrame, symbol_id: int, model: str) -> DataFrame:
    return embeddings.where((F.col("symbol_id") == symbol_id) & (F.col("model") == model)).select("embedding")


def stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows) of every table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionAll(one)
    return out

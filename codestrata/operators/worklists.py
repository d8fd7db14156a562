"""What still needs work, and how it went."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def needs_summary(symbols: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """Symbols without a summary (an empty one is a summary) or, given (symbol_id, new_hash), with another chunk."""
    if hashes is None:
        return symbols.where(F.col("chunk_summary").isNull())
    met = symbols.join(hashes, "symbol_id", "left")
    return met.where(F.col("chunk_summary").isNull() | F.col("new_hash").isNotNull() & ~F.col("chunk_hash").eqNullSafe(F.col("new_hash"))).drop("new_hash")


def needs_embedding(symbols: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """Symbols without an embedding of the model for their present chunk: an anti join."""
    have = embeddings.where(F.col("model") == model).select("symbol_id", "chunk_hash")
    on = (symbols.symbol_id == have.symbol_id) & symbols.chunk_hash.eqNullSafe(have.chunk_hash)
    return symbols.join(have, on, "left_anti")


def report(results: DataFrame, tokens: str = "tokens", error: str = "error") -> DataFrame:
    """One row: succeeded, failed, tokens."""
    failed = F.col(error).isNotNull()
    return results.agg(F.count_if(~failed).alias("succeeded"), F.count_if(failed).alias("failed"), F.coalesce(F.sum(tokens), F.lit(0)).cast("bigint").alias("tokens"))

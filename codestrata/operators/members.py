"""Members of a class, struct or interface."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMBER_KINDS = ["method", "property", "field"]
OWNER_KINDS = ["class", "interface", "struct"]


def object_properties(symbols: DataFrame, files: DataFrame, name: str, language: str | None = None) -> DataFrame:
    """Methods, properties and fields of the first class, interface or struct with this name.

    Members are named `owner.member` or, in Rust, `owner::member`; Go methods are also found by their receiver in any
    of its written forms, as part of the qualified name. Each symbol comes once. No owner gives no row.
    """
    named = symbols.where((F.col("name") == name) & F.col("kind").isin(OWNER_KINDS))
    if language is not None:
        named = named.where(F.col("language") == language)
    owner = named.orderBy("symbol_id").limit(1).select(F.col("qualified_name").alias("owner"), F.col("language").alias("owner_language"))
    members = symbols.where(F.col("kind").isin(MEMBER_KINDS))
    if language is not None:
        members = members.where(F.col("language") == language)
    one = owner.first()  # at most one row; its names become filters that reach the scan
    if one is None:
        one_name, receiver = None, F.lit(False)
    else:
        one_name, receiver = one["owner"], F.lit(one["owner_language"] == "go") & (F.col("language") == "go") & (F.col("kind") == "method")
    below = F.lit(False) if one_name is None else F.startswith("qualified_name", F.lit(f"{one_name}.")) | F.startswith("qualified_name", F.lit(f"{one_name}::"))
    written = F.contains("qualified_name", F.lit(f"{name}.")) | F.contains("qualified_name", F.lit(f"(*{name}).")) | F.contains("qualified_name", F.lit(f".{name}."))
    found = members.where(below | receiver & written).join(files.select("file_id", "path"), "file_id")
    return found.select("symbol_id", "name", "kind", "qualified_name", F.struct("path", "start_line", "start_col", "end_line", "end_col").alias("location"))


def displayed(found: DataFrame) -> DataFrame:
    """Depth and tail of each member's name, in the order of a Unicode collation."""
    from ..functions import text as T

    q = F.col("qualified_name")
    return found.withColumns({"depth": T.depth(q), "tail": T.tail_path(q)}).orderBy(F.collate(q, "UNICODE"))

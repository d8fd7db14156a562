"""Explicit schemas of the five tables and of what extractors emit.

Lines count from 1 and columns from 0. Spark has no indexes: symbols are written partitioned by language and sorted by
name, embeddings partitioned by model, so that Parquet statistics and partition pruning do the work of B-trees.
"""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

_TYPES = {"bigint": LongType(), "int": IntegerType(), "string": StringType(), "double": DoubleType(), "boolean": BooleanType(), "array<float>": ArrayType(FloatType()), "array<bigint>": ArrayType(LongType())}


def struct(ddl: str) -> StructType:
    """A schema from `name type, ...` without a running session."""
    return StructType([StructField(part.split()[0], _TYPES[part.split()[1]]) for part in ddl.split(",")])


LANGUAGES = ("ts", "tsx", "js", "jsx", "python", "go", "java", "rust", "html")
SYMBOL_KINDS = ("function", "class", "interface", "type", "variable", "constant", "method", "property", "struct", "field", "module", "namespace")
REFERENCE_KINDS = ("read", "write", "call", "import", "export", "extend", "implement")

_SPAN = "{0}start_line int, {0}start_col int, {0}end_line int, {0}end_col int"

FILES = struct("file_id bigint, path string, language string, content_hash string, mtime double, size bigint, indexed_at bigint")
SYMBOLS = struct(
    f"symbol_id bigint, file_id bigint, language string, kind string, name string, qualified_name string, {_SPAN.format('')}, signature string, exported boolean, chunk_hash string, chunk_summary string, summary_tokens int, summarized_at bigint"
)
CALLS = struct(f"call_id bigint, caller_symbol_id bigint, callee_symbol_id bigint, site_file_id bigint, {_SPAN.format('site_')}")
REFERENCES = struct(f"ref_id bigint, from_file_id bigint, {_SPAN.format('from_')}, to_symbol_id bigint, ref_kind string")
EMBEDDINGS = struct("symbol_id bigint, model string, dim int, embedding array<float>, chunk_hash string, created_at bigint, updated_at bigint")
TABLES = {"files": FILES, "symbols": SYMBOLS, "calls": CALLS, "symbol_references": REFERENCES, "symbol_embeddings": EMBEDDINGS}
PARTITIONS = {"symbols": ["language"], "symbol_embeddings": ["model"]}

#: One row an item found in a file; ordinal counts the items of one type in order.
ITEMS = struct(f"path string, item string, ordinal int, language string, kind string, name string, qualified_name string, {_SPAN.format('')}, signature string, exported boolean, error string")
CALL_TREE = struct("root bigint, node_id bigint, parent_id bigint, depth int, preorder int, path array<bigint>")

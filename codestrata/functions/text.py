"""Scalar expressions over code and text; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTENSIONS = {"ts": "ts", "tsx": "tsx", "js": "js", "mjs": "js", "cjs": "js", "jsx": "jsx", "py": "python", "pyw": "python", "go": "go", "java": "java", "rs": "rust", "html": "html", "htm": "html"}
KIND_TEXT = {"function": "function", "class": "class", "interface": "interface", "type": "type definition", "variable": "variable", "constant": "constant", "method": "method", "property": "property", "struct": "struct", "field": "field", "module": "module", "namespace": "namespace"}
DIMENSIONS = {"text-embedding-3-small": 1536, "text-embedding-3-large": 3072, "text-embedding-ada-002": 1536, "bge-small-en-v1.5": 384, "bge-base-en-v1.5": 768, "bge-large-en-v1.5": 1024, "bge-m3": 1024}
DEFAULT_DIMENSION = 1536


def lookup(column: Column, table: dict, default: Column) -> Column:
    """A value of a small constant table, else the default."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), column), default)


def language(path: Column) -> Column:
    """Language by the lower-cased extension of the last path segment; null if it has none that is known."""
    name = F.element_at(F.split(path, "/"), -1)
    ext = F.when(F.contains(name, F.lit(".")), F.lower(F.element_at(F.split(name, r"\."), -1)))
    return lookup(F.coalesce(ext, F.lit("")), EXTENSIONS, F.lit(None).cast("string"))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def line_count(text: Column) -> Column:
    """Parts between line feeds: 1 for an empty text."""
    return F.size(F.split(text, "\n", -1))


def line_slice(text: Column, first: Column, last: Column) -> Column:
    """Lines first..last (from 1), both clipped to the text, joined by line feeds."""
    a = F.greatest(first, F.lit(1))
    lines = F.split(text, "\n", -1)
    n = F.greatest(F.least(last, F.size(lines)) - a + 1, F.lit(0))
    return F.array_join(F.slice(lines, a, n), "\n")


def signature(text: Column, first: Column, last: Column) -> Column:
    """At most three lines from `first`, trimmed of white space, and of them 200 characters."""
    return F.substring(F.regexp_replace(line_slice(text, first, F.least(last, first + 2)), r"^\s+|\s+$", ""), 1, 200)


def last_segment(name: Column, separator: str = r"\.") -> Column:
    return F.element_at(F.split(name, separator), -1)


def tail_path(name: Column) -> Column:
    """Everything after the first segment of a dotted name; the name itself if it has one segment."""
    parts = F.split(name, r"\.")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(2), F.size(parts) - 1), ".")).otherwise(name)


def depth(name: Column) -> Column:
    return F.regexp_count(name, F.lit("[.]"))


def percent(value: Column) -> Column:
    return F.format_string("%.1f", value * 100)


def truncate(text: Column, n: int) -> Column:
    """The text, or its first n characters and three dots."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def kind_text(kind: Column) -> Column:
    return lookup(kind, KIND_TEXT, kind)


def dimension(model: Column) -> Column:
    return lookup(model, DIMENSIONS, F.lit(DEFAULT_DIMENSION))


def embed_text(summary: Column, qualified_name: Column) -> Column:
    """What is embedded for a symbol: the summary unless null or empty, else its qualified name."""
    return F.coalesce(F.nullif(summary, F.lit("")), qualified_name)


def relative(path: Column, root: str) -> Column:
    """path below root with forward slashes and no leading ./; other paths are only normalised."""
    plain = F.regexp_replace(F.regexp_replace(path, r"^file:/+", "/"), r"\\", "/")
    base = root.rstrip("/") + "/"
    return F.regexp_replace(F.when(F.startswith(plain, F.lit(base)), F.substring(plain, F.lit(len(base) + 1), F.length(plain))).otherwise(plain), r"^(\./)+", "")


def class_names(value: Column) -> Column:
    """The class names in an attribute's value."""
    return F.filter(F.split(value, r"\s+"), lambda x: x != "")


def prompt(kind: Column, qualified_name: Column, code: Column) -> Column:
    return F.concat(F.lit("Describe in one or two sentences what this "), kind_text(kind), F.lit(" does.\nName: "), qualified_name, F.lit("\nCode:\n"), code)


def response_vector(body: Column) -> Column:
    """The vector in an embedding service's answer: {data: [{embedding}]}, {embedding} or {embeddings: [[...]]}."""
    parse = lambda ddl: F.from_json(body, ddl)
    return F.coalesce(
        F.get(parse("data array<struct<embedding: array<double>>>")["data"], F.lit(0))["embedding"],
        parse("embedding array<double>")["embedding"],
        F.get(parse("embeddings array<array<double>>")["embeddings"], F.lit(0)),
    )

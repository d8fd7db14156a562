"""Extractors: the text of one file -> its symbols, calls and references."""

from __future__ import annotations

from . import go, html, java, python, rust, typescript

REGISTRY = {"ts": typescript, "tsx": typescript, "js": typescript, "jsx": typescript, "python": python, "go": go, "java": java, "rust": rust, "html": html}


def items(path: str, text: str, language: str, nested: int = 3) -> list[tuple]:
    """Rows of schema.ITEMS for one file. A file that can't be parsed gives one row that holds the error."""
    try:
        found = REGISTRY[language].extract(text, language, nested=nested)
    except Exception as e:  # one file's fault must not end the job
        return [(path, "error", 0, language, None, None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:500])]
    span = lambda x: (x["start_line"], x["start_col"], x["end_line"], x["end_col"])
    out = [(path, "symbol", i, language, x["kind"], x["name"], x["qualified_name"], *span(x), x["signature"], x["exported"], None) for i, x in enumerate(found.symbols)]
    out += [(path, "call", i, language, "call", x["name"], None, *span(x), None, None, None) for i, x in enumerate(found.calls)]
    out += [(path, "reference", i, language, x["kind"], x["name"], None, *span(x), None, None, None) for i, x in enumerate(found.references)]
    return out

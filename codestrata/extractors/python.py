"""Python, by the standard library's own parser."""

from __future__ import annotations

import ast
import re

from .tokens import Source

_CAPS = re.compile(r"[A-Z0-9]+(_[A-Z0-9]+)+|[A-Z0-9]*_[A-Z0-9_]*")


def _shown(name: str) -> bool:
    return not name.startswith("_")


def _constant(name: str) -> bool:
    """All capitals and with an underscore."""
    return "_" in name and name == name.upper() and any(c.isalpha() for c in name)


class _Walk(ast.NodeVisitor):
    def __init__(self, src: Source):
        self.src, self.scope, self.classes = src, [], []
        self.bytes = [line.encode() for line in src.lines]

    def col(self, line: int, byte: int) -> int:
        return len(self.bytes[line - 1][:byte].decode(errors="replace")) if line <= len(self.bytes) else byte

    def span(self, node, first=None) -> dict:
        a, b = (first or node).lineno, (first or node).col_offset
        return {"start_line": a, "start_col": self.col(a, b), "end_line": node.end_lineno, "end_col": self.col(node.end_lineno, node.end_col_offset)}

    def symbol(self, kind: str, name: str, node, exported: bool) -> None:
        from .tokens import signature

        place = self.span(node)
        self.src.symbols.append({"kind": kind, "name": name, "qualified_name": ".".join([*self.scope, name]), **place, "signature": signature(self.src.lines, place), "exported": exported})

    def inside(self, name: str, nodes: list, is_class: bool) -> None:
        self.scope.append(name)
        self.classes.append(is_class)
        for n in nodes:
            self.visit(n)
        self.classes.pop()
        self.scope.pop()

    def visit_FunctionDef(self, node) -> None:
        for x in [*node.decorator_list, node.args, *([node.returns] if node.returns else [])]:
            self.visit(x)
        member = bool(self.classes and self.classes[-1])
        is_property = any(isinstance(d, ast.Name) and d.id == "property" for d in node.decorator_list)
        dunder = node.name.startswith("__") and node.name.endswith("__")
        kind = "property" if member and is_property else "method" if member else "function"
        self.symbol(kind, node.name, node, _shown(node.name) or member and dunder and not is_property)
        self.inside(node.name, node.body, False)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node) -> None:
        for x in [*node.decorator_list, *node.bases, *node.keywords]:
            self.visit(x)
        self.symbol("class", node.name, node, _shown(node.name))
        self.inside(node.name, node.body, True)

    def assigned(self, target, node) -> None:
        if isinstance(target, ast.Name) and not self.scope:
            self.symbol("constant" if _constant(target.id) else "variable", target.id, node, _shown(target.id))
        elif isinstance(target, ast.Name) and self.classes and self.classes[-1]:
            self.symbol("property", target.id, node, _shown(target.id))
        elif isinstance(target, (ast.Tuple, ast.List)):
            for t in target.elts:
                self.assigned(t, node)

    def visit_Assign(self, node) -> None:
        for t in node.targets:
            self.assigned(t, node)
        self.generic_visit(node)

    def visit_AnnAssign(self, node) -> None:
        self.assigned(node.target, node)
        self.generic_visit(node)

    def visit_Name(self, node) -> None:
        kind = "write" if isinstance(node.ctx, (ast.Store, ast.Del)) else "read"
        self.src.references.append({"name": node.id, "kind": kind, **self.span(node)})

    def visit_Call(self, node) -> None:
        name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else None
        if name:
            self.src.calls.append({"name": name, **self.span(node)})
            self.src.references.append({"name": name, "kind": "call", **self.span(node.func)})
        self.generic_visit(node)


#: Lines that may be wrong in a file of which the rest is read.
WRONG = 100


def parsed(text: str) -> ast.Module:
    """The tree of a file, without the lines that can't be parsed. A wrong line that begins a block leaves the block, any
    other one nothing; a line that is still wrong then goes altogether. With more than WRONG of them the first error is
    raised."""
    lines, first, tried = text.split("\n"), None, {}
    while True:
        try:
            return ast.parse("\n".join(lines))
        except SyntaxError as e:
            first = first or e
            at = min(max(1, e.lineno or 1), len(lines)) - 1
            if len(tried) >= WRONG or tried.get(at, 0) > 1 or not isinstance(e.lineno, int):
                raise first from None
            indent = len(lines[at]) - len(lines[at].lstrip())
            below = next((x for x in lines[at + 1 :] if x.strip()), "")
            block = len(below) - len(below.lstrip()) > indent
            lines[at] = "" if at in tried or isinstance(e, IndentationError) else " " * indent + ("if 1:" if block else "pass")
            tried[at] = tried.get(at, 0) + 1


def extract(text: str, language: str = "python", **_) -> Source:
    """Module-level names are constants (capitals with an underscore) or variables; class-level ones are properties.
    A definition's range begins at its def or class line. Lines that can't be parsed are passed over; a file in which
    nothing is left then raises the SyntaxError."""
    s = Source(text, language)
    try:
        tree = ast.parse(text)
    except SyntaxError as e:
        tree = parsed(text)
        _Walk(s).visit(tree)
        if not s.symbols and not s.references:
            raise e
        return s
    _Walk(s).visit(tree)
    return s

"""TypeScript and JavaScript: functions, classes, interfaces, type aliases, methods and properties."""

from __future__ import annotations

from .tokens import Source, add_uses, after_angles

KEYWORDS = set(
    "abstract as async await break case catch class const continue declare default delete do else enum export extends false finally for from function get if implements import in instanceof interface is keyof let namespace new null of private protected public readonly return set static super switch this throw true try type typeof undefined var void while with yield".split()
)
_MODIFIERS = {"public", "private", "protected", "static", "readonly", "abstract", "async", "override", "declare", "accessor", "*", "get", "set"}


def _statement_end(s: Source, i: int, stop: int) -> int:
    """Last token of a statement without a body: up to ; or the line end after a value is complete."""
    last = i
    while i < stop:
        if s.is_(i, ";"):
            return i
        if i > last and s.is_(i, "}"):
            return last
        line = s.at(s.tokens[i].start)[0]
        if i > last and line > s.at(s.tokens[last].end)[0] and not s.is_(i, "|", "&", ".", "?", ":", "=>", "=", ",", "(", "[", "{", "+", "?.") and not s.is_(last, "|", "&", "=", "=>", ",", "?", ":", "+", "extends"):
            return last
        last = s.pair.get(i, i)
        i = last + 1
    return min(last, stop - 1)


def _body(s: Source, i: int, stop: int) -> int:
    """The { of a function or class whose head is at token i, or stop if a ; or another statement comes first."""
    while i < stop:
        if s.is_(i, "{"):
            if s.is_(i - 1, ":", "|", "&", "=>") or s.is_(i - 1, "<", ","):
                i = s.pair.get(i, i) + 1  # a type in braces
                continue
            return i
        if s.is_(i, ";"):
            return stop
        i = s.pair.get(i, i) + 1
    return stop


def _members(s: Source, a: int, b: int, owner: str, shown: bool) -> None:
    i = a
    while i < b:
        first = i
        if s.is_(i, "@"):
            i += 2
            while s.is_(i, ".", "("):
                i = s.pair[i] + 1 if s.is_(i, "(") else i + 2
            continue
        while i < b and s.is_(i, *_MODIFIERS) and not s.is_(i + 1, "(", "=", ":", ";", "?", "!", "}"):
            i += 1
        if not (s.named(i) or s.is_(i, "#") or i < b and s.tokens[i].kind in ("string", "number")):
            i = s.pair.get(i, i) + 1
            continue
        name = i + 1 if s.is_(i, "#") else i
        after = after_angles(s, name + 1)
        if s.is_(after, "?", "!"):
            after = after_angles(s, after + 1)
        label = s.tokens[name].text.strip("\"'")
        if s.is_(after, "("):
            brace = _body(s, s.pair.get(after, after) + 1, b)
            if brace < b:
                end = s.pair.get(brace, b)
                s.symbol("method", name, f"{owner}.{label}", first, end, False)
                _scan(s, brace + 1, end, f"{owner}.{label}", shown)
            else:
                end = s.seek(after, b, ";")
                s.defined.add(name)
            i = end + 1
        else:
            end = _statement_end(s, name, b)
            s.symbol("property", name, f"{owner}.{label}", first, end, False)
            i = end + 1


def _value_is_function(s: Source, i: int, stop: int) -> bool:
    if s.is_(i, "async"):
        i += 1
    if s.is_(i, "function"):
        return True
    i = after_angles(s, i)
    if s.named(i):
        return s.is_(i + 1, "=>")
    if not s.is_(i, "("):
        return False
    i = s.pair.get(i, i) + 1
    if s.is_(i, ":"):
        i = s.seek(i, min(stop, i + 40), "=>", ";", "{")
    return s.is_(i, "=>")


def _scan(s: Source, a: int, b: int, scope: str, shown: bool) -> None:
    i, exported = a, False
    full = lambda n: f"{scope}.{s.tokens[n].text}" if scope else s.tokens[n].text
    while i < b:
        if s.is_(i, "export"):
            exported, i = True, i + 1
            continue
        if s.is_(i, "default", "declare", "abstract") and exported or s.is_(i, "abstract", "declare") and s.is_(i + 1, "class", "interface", "function", "type", "abstract"):
            i += 1
            continue
        out = shown or exported
        first = i
        if s.is_(i, "async") and s.is_(i + 1, "function"):
            i += 1
        if s.is_(i, "function") and not s.is_(i - 1, ".", "?."):
            name = i + 2 if s.is_(i + 1, "*") else i + 1
            params = s.seek(name, b, "(")
            brace = _body(s, s.pair.get(params, b) + 1, b)
            end = s.pair.get(brace, brace) if brace < b else s.seek(params, b, ";")
            if s.named(name) and name < params:
                s.symbol("function", name, full(name), first, end, out)
                _scan(s, brace + 1, end, full(name), out)
            else:
                _scan(s, brace + 1, end, scope, out)
            i = end + 1
        elif s.is_(i, "class") and s.named(i + 1) and not s.is_(i - 1, ".", "?."):
            brace = s.seek(i, b, "{")
            end = s.pair.get(brace, b)
            s.symbol("class", i + 1, full(i + 1), first, end, out)
            _members(s, brace + 1, end, full(i + 1), out)
            i = end + 1
        elif s.is_(i, "interface") and s.named(i + 1) and not s.is_(i - 1, ".", "?."):
            brace = s.seek(i, b, "{")
            end = s.pair.get(brace, b)
            s.symbol("interface", i + 1, full(i + 1), first, end, out)
            s.defined.update(k for k in range(brace, end) if s.named(k) and s.is_(k + 1, "(", "?", ":"))
            i = end + 1
        elif s.is_(i, "type") and s.named(i + 1) and s.is_(after_angles(s, i + 2), "="):
            end = _statement_end(s, i, b)
            s.symbol("type", i + 1, full(i + 1), first, end, out)
            i = end + 1
        elif s.is_(i, "const", "let", "var") and s.named(i + 1):
            equal = s.seek(i + 1, b, "=", ";", "of", "in")
            s.defined.add(i + 1)
            if s.is_(equal, "=") and _value_is_function(s, equal + 1, b):
                end = _statement_end(s, equal, b)
                s.symbol("function", i + 1, full(i + 1), i + 1, end, out)
                _scan(s, equal + 1, end + 1, full(i + 1), out)
                i = end + 1
            else:
                i = equal + 1
        else:
            if not s.is_(i, "{", "(", "[", "${"):
                i += 1
                exported = False
                continue
            end = s.pair.get(i, b)
            _scan(s, i + 1, min(end, b), scope, out)
            i = end + 1
        exported = False


def extract(text: str, language: str = "ts", **_) -> Source:
    """A const whose value is no function is no symbol, `new X()` is no call, and nested definitions come once."""
    s = Source(text, language).scan()
    _scan(s, 0, len(s.tokens), "", False)
    imports = [(i, s.seek(i, len(s.tokens), ";")) for i in range(len(s.tokens)) if s.is_(i, "import") and s.at(s.tokens[i].start)[1] == 0]
    add_uses(s, KEYWORDS, skip=imports)
    return s

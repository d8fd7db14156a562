"""Rust: functions, structs, enums, traits, implementations, constants, statics and modules."""

from __future__ import annotations

from .tokens import Source, add_uses, after_angles

KEYWORDS = set("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type union unsafe use where while".split())
_LEAD = {"async", "unsafe", "extern", "default"}


def _skip_lead(s: Source, i: int) -> tuple[int, bool]:
    """(token of the item's keyword, has pub)."""
    public = False
    while True:
        if s.is_(i, "#") and s.is_(i + 1, "["):
            i = s.pair.get(i + 1, i + 1) + 1
        elif s.is_(i, "pub"):
            public, i = True, i + 1
            if s.is_(i, "("):
                i = s.pair.get(i, i) + 1
        elif s.is_(i, *_LEAD) or s.is_(i, "const") and s.is_(i + 1, "fn", "unsafe", "async", "extern"):
            i += 1
            if s.tokens[i].kind == "string":
                i += 1
        else:
            return i, public


def _function(s: Source, i: int, stop: int, first: int, kind: str, prefix: str, public: bool, macros: list) -> int:
    name = i + 1
    params = after_angles(s, name + 1)
    k = s.seek(s.pair.get(params, params) + 1, stop, "{", ";")
    end = s.pair.get(k, k)
    s.symbol(kind, name, prefix + s.tokens[name].text, first, end, public)
    if s.is_(k, "{"):
        _items(s, k + 1, end, prefix + s.tokens[name].text, macros, inside=True)
    return end + 1


def _items(s: Source, a: int, b: int, scope: str, macros: list, inside: bool = False) -> None:
    i = a
    join = lambda n: f"{scope}::{n}" if scope else n
    while i < b:
        first = i
        i, public = _skip_lead(s, i)
        while first < i and s.is_(first, "#"):
            first = s.pair.get(first + 1, first + 1) + 1
        text = s.tokens[i].text if i < b and s.tokens[i].kind == "name" else ""
        if text == "fn" and s.named(i + 1):
            i = _function(s, i, b, first, "function", f"{scope}::" if scope else "", public, macros)
        elif text in ("struct", "union") and s.named(i + 1):
            name = s.tokens[i + 1].text
            k = s.seek(after_angles(s, i + 2), b, "{", ";")
            end = s.pair.get(k, k)
            s.symbol("struct", i + 1, join(name), first, end, public)
            j = k + 1
            while s.is_(k, "{") and j < end:
                lead, shown = _skip_lead(s, j)
                close = lead
                while close < end and not s.is_(close, ","):
                    close = after_angles(s, close) if s.is_(close, "<") else s.pair.get(close, close) + 1
                if s.named(lead) and s.is_(lead + 1, ":"):
                    s.symbol("field", lead, f"{join(name)}.{s.tokens[lead].text}", j, close - 1, shown)
                j = close + 1
            i = end + 1
        elif text == "enum" and s.named(i + 1):
            k = s.seek(i, b, "{")
            s.symbol("type", i + 1, join(s.tokens[i + 1].text), first, s.pair.get(k, k), public)
            i = s.pair.get(k, k) + 1
        elif text == "trait" and s.named(i + 1):
            name, k = s.tokens[i + 1].text, s.seek(i, b, "{")
            end = s.pair.get(k, k)
            s.symbol("interface", i + 1, join(name), first, end, public)
            j = k + 1
            while j < end:
                lead, shown = _skip_lead(s, j)
                if s.is_(lead, "fn"):
                    j = _function(s, lead, end, j, "method", f"{join(name)}.", shown, macros)
                else:
                    j = s.pair.get(lead, lead) + 1
            i = end + 1
        elif text == "impl":
            k = after_angles(s, i + 1)
            brace = s.seek(k, b, "{")
            target = next((x + 1 for x in range(k, brace) if s.is_(x, "for")), k)
            end = s.pair.get(brace, brace)
            names, x = [], target
            while x < brace and not s.is_(x, "<", "where"):
                if s.named(x) and not s.is_(x, "dyn", "mut"):
                    names.append(s.tokens[x].text)
                x += 1
            owner = join(names[-1]) if names else scope
            j = brace + 1
            while j < end:
                lead, shown = _skip_lead(s, j)
                if s.is_(lead, "fn"):
                    j = _function(s, lead, end, j, "method", f"{owner}::", shown, macros)
                elif s.is_(lead, "const") and s.named(lead + 1):
                    close = s.seek(lead, end, ";")
                    s.symbol("constant", lead + 1, f"{owner}::{s.tokens[lead + 1].text}", j, close, shown)
                    j = close + 1
                else:
                    j = s.pair.get(lead, lead) + 1
            i = end + 1
        elif text in ("const", "static") and (s.named(i + 1)) and not inside:
            name = i + 2 if s.is_(i + 1, "mut") else i + 1
            end = s.seek(i, b, ";")
            s.symbol("constant" if text == "const" else "variable", name, join(s.tokens[name].text), first, end, public)
            i = end + 1
        elif text == "mod" and s.named(i + 1):
            name = s.tokens[i + 1].text
            if s.is_(i + 2, "{"):
                end = s.pair.get(i + 2, i + 2)
                s.symbol("module", i + 1, join(name), first, end, public)
                _items(s, i + 3, end, join(name), macros)
            else:
                end = i + 2
                s.symbol("module", i + 1, name if scope == name else join(name), first, end, public)
            i = end + 1
        elif text == "let":
            s.defined.update(x for x in (i + 1, i + 2) if s.named(x) and not s.is_(x, "mut"))
            i += 2 + s.is_(i + 1, "mut")
        elif text and s.is_(i + 1, "!") and s.is_(i + 2, "(", "[", "{"):
            macros.append((i, s.pair.get(i + 2, i + 2)))
            s.defined.add(i)
            i = macros[-1][1] + 1
        elif i < b and s.is_(i, "{", "(", "["):
            end = s.pair.get(i, i)
            _items(s, i + 1, min(end, b), scope, macros, inside)
            i = end + 1
        else:
            i += 1


def extract(text: str, language: str = "rust", **_) -> Source:
    """The first `mod name;` of a file is the scope of its items. A macro's arguments hold references, no calls."""
    s = Source(text, language).scan()
    first = next((s.tokens[i + 1].text for i in range(len(s.tokens)) if s.is_(i, "mod") and s.named(i + 1) and s.is_(i + 2, ";")), "")
    macros: list[tuple[int, int]] = []
    _items(s, 0, len(s.tokens), first, macros)
    uses = [(i, s.seek(i, len(s.tokens), ";")) for i in range(len(s.tokens)) if s.is_(i, "use")]
    add_uses(s, KEYWORDS, skip=uses, quiet=macros)
    return s

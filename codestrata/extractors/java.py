"""Java: classes, interfaces, enums, methods, constructors, fields and interface constants."""

from __future__ import annotations

from .tokens import Source, add_uses, after_angles

KEYWORDS = set(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null var record".split()
)
_MODIFIERS = set("public protected private static final abstract native synchronized transient volatile strictfp default sealed".split())


def _lead(s: Source, i: int) -> tuple[int, set[str]]:
    """(token after annotations and modifiers, the modifiers)."""
    found: set[str] = set()
    while True:
        if s.is_(i, "@") and s.named(i + 1) and not s.is_(i + 1, "interface"):
            i += 2
            while s.is_(i, "."):
                i += 2
            if s.is_(i, "("):
                i = s.pair.get(i, i) + 1
        elif s.is_(i, *_MODIFIERS):
            found.add(s.tokens[i].text)
            i += 1
        else:
            return i, found


def _type_end(s: Source, i: int) -> int:
    """Token after a type: a dotted name, its type arguments and brackets."""
    i += 1
    while True:
        if s.is_(i, "<"):
            i = after_angles(s, i)
        elif s.is_(i, ".") and s.named(i + 1):
            i += 2
        elif s.is_(i, "["):
            i = s.pair.get(i, i) + 1
        elif s.is_(i, "..."):
            i += 1
        else:
            return i


def _members(s: Source, a: int, b: int, owner: str, simple: str, interface: bool) -> None:
    i = a
    while i < b:
        first = i
        i, mods = _lead(s, i)
        if i >= b:
            return
        if s.is_(i, "class", "interface", "enum", "record") and s.named(i + 1) or s.is_(i, "@") and s.is_(i + 1, "interface"):
            i = _declare(s, i + s.is_(i, "@"), b, first, owner, mods)
            continue
        if s.is_(i, "{"):
            i = s.pair.get(i, i) + 1
            continue
        i = after_angles(s, i)
        public = interface or "public" in mods
        if s.named(i) and s.is_(i + 1, "(") and s.tokens[i].text == simple:
            name = i
        elif s.named(i):
            name = _type_end(s, i)
        else:
            i = s.pair.get(i, i) + 1
            continue
        if not s.named(name):
            i = max(name, i + 1)
            continue
        label = s.tokens[name].text
        if s.is_(name + 1, "("):
            k = s.seek(s.pair.get(name + 1, name + 1) + 1, b, "{", ";")
            end = s.pair.get(k, k)
            s.symbol("method", name, f"{owner}.{label}", first, end, public)
            if s.is_(k, "{"):
                _nested(s, k + 1, end, f"{owner}.{label}")
            i = end + 1
        else:
            end = s.seek(name, b, ";")
            k = name
            while s.named(k):
                s.symbol("constant" if interface else "field", k, f"{owner}.{s.tokens[k].text}", first, end, public)
                k = s.seek(k, end, ",") + 1
                if k > end:
                    break
            i = end + 1


def _nested(s: Source, a: int, b: int, owner: str) -> None:
    """Classes declared in a body."""
    i = a
    while i < b:
        if s.is_(i, "class", "interface", "enum") and s.named(i + 1) and not s.is_(i - 1, "."):
            i = _declare(s, i, b, i, owner, set())
        else:
            i += 1


def _declare(s: Source, i: int, stop: int, first: int, scope: str, mods: set[str]) -> int:
    name = s.tokens[i + 1].text
    brace = s.seek(i, stop, "{")
    end = s.pair.get(brace, brace)
    full = f"{scope}.{name}" if scope else name
    word = s.tokens[i].text
    s.symbol({"interface": "interface", "enum": "type"}.get(word, "class"), i + 1, full, first, end, "public" in mods)
    begin = brace + 1
    if word == "enum":  # constants come before the first ;
        semicolon = s.seek(begin, end, ";")
        s.defined.update(k for k in range(begin, semicolon) if s.named(k) and s.is_(k - 1, "{", ","))
        begin = semicolon + 1
    _members(s, begin, end, full, name, word == "interface")
    return end + 1


def extract(text: str, language: str = "java", **_) -> Source:
    """`new T()` is a call of T; a dotted package is kept in its order."""
    s = Source(text, language).scan()
    n, i, pkg = len(s.tokens), 0, ""
    skip: list[tuple[int, int]] = []
    while i < n:
        if s.is_(i, "package", "import"):
            end = s.seek(i, n, ";")
            if s.is_(i, "package"):
                pkg = "".join(t.text for t in s.tokens[i + 1 : end])
            skip.append((i, end))
            i = end + 1
            continue
        first = i
        i, mods = _lead(s, i)
        if s.is_(i, "class", "interface", "enum", "record") and s.named(i + 1):
            i = _declare(s, i, n, first, pkg, mods)
        elif s.is_(i, "@") and s.is_(i + 1, "interface"):
            i = _declare(s, i + 1, n, first, pkg, mods)
        else:
            i += 1
    add_uses(s, KEYWORDS, fields_are_names=True, new_is_call=True, skip=skip)
    return s

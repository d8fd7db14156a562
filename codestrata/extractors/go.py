"""Go: functions, methods, structs with fields to a chosen depth, interfaces, types, constants and variables."""

from __future__ import annotations

from .tokens import Source, add_uses

KEYWORDS = set("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var nil true false iota".split())


def shown(name: str) -> bool:
    """Exported iff the first character equals its upper case, so an underscore counts."""
    return name[:1] == name[:1].upper()


def _line(s: Source, i: int) -> int:
    return s.at(s.tokens[i].start)[0]


def _entry(s: Source, i: int, stop: int) -> int:
    """Token after the entry (of a struct, interface or group) that begins at i: to the line's end or a semicolon."""
    line = _line(s, i)
    while i < stop:
        if s.is_(i, ";"):
            return i + 1
        if _line(s, i) > line:
            return i
        close = s.pair.get(i, i)
        line = max(line, s.at(s.tokens[close].end)[0])
        i = close + 1
    return stop


def _fields(s: Source, a: int, b: int, owner: str, left: int) -> None:
    i = a
    while i < b:
        end = _entry(s, i, b)
        last = end - 2 if s.is_(end - 1, ";") else end - 1
        names = [i] if s.named(i) else []
        k = i + 1
        while names and s.is_(k, ",") and s.named(k + 1):
            names.append(k + 1)
            k += 2
        alone = not names or k >= end or s.is_(k, ".", ";") or s.tokens[k].kind == "string"
        if alone:  # embedded: named by its type
            head = s.seek(i, end, "[")
            typed = [x for x in range(i, head) if s.named(x)]
            if typed:
                s.symbol("field", typed[-1], f"{owner}.{s.tokens[typed[-1]].text}", i, last, shown(s.tokens[typed[-1]].text))
        else:
            for n in names:
                label = s.tokens[n].text
                s.symbol("field", n, f"{owner}.{label}", i, last, shown(label))
                inner = k + 1 if s.is_(k, "*") else k
                if s.is_(inner, "struct") and left > 0:
                    brace = inner + 1
                    _fields(s, brace + 1, s.pair.get(brace, brace), f"{owner}.{label}", left - 1)
        i = max(end, i + 1)


def _type(s: Source, i: int, stop: int, first: int, pkg: str, depth: int) -> int:
    name = s.tokens[i].text
    k = i + 1
    if s.is_(k, "[") and not s.is_(k + 1, "]") and s.named(k + 1) and s.named(k + 2):
        k = s.pair.get(k, k) + 1
    if s.is_(k, "="):
        k += 1
    full = f"{pkg}.{name}"
    if s.is_(k, "struct", "interface"):
        brace = k + 1
        end = s.pair.get(brace, brace)
        s.symbol(s.tokens[k].text, i, full, first, end, shown(name))
        if s.is_(k, "struct"):
            _fields(s, brace + 1, end, full, depth)
        else:
            j = brace + 1
            while j < end:
                after = _entry(s, j, end)
                if s.named(j) and s.is_(j + 1, "("):
                    s.symbol("method", j, f"{full}.{s.tokens[j].text}", j, after - 1 - s.is_(after - 1, ";"), shown(s.tokens[j].text))
                j = max(after, j + 1)
        return end + 1
    end = _entry(s, i, stop)
    s.symbol("type", i, full, first, end - 1 - s.is_(end - 1, ";"), shown(name))
    return end


def _values(s: Source, i: int, stop: int, first: int, kind: str, pkg: str) -> int:
    end = _entry(s, i, stop)
    k = i
    while s.named(k):
        name = s.tokens[k].text
        if name != "_":
            s.symbol(kind, k, f"{pkg}.{name}", first, end - 1 - s.is_(end - 1, ";"), shown(name))
        if not s.is_(k + 1, ","):
            break
        k += 2
    return end


def extract(text: str, language: str = "go", nested: int = 3, **_) -> Source:
    """nested: the depth to which the fields of anonymous structs are followed."""
    s = Source(text, language).scan()
    n, i, pkg = len(s.tokens), 0, "main"
    skip: list[tuple[int, int]] = []
    while i < n:
        if s.is_(i, "package") and s.named(i + 1):
            pkg = s.tokens[i + 1].text
            skip.append((i, i + 1))
            i += 2
        elif s.is_(i, "import"):
            end = _entry(s, i, n)
            skip.append((i, end - 1))
            i = end
        elif s.is_(i, "func"):
            name, owner = i + 1, ""
            if s.is_(name, "("):
                close = s.pair.get(name, name)
                k = s.seek(name + 1, close, "[")
                typed = [x for x in range(name + 1, k) if s.named(x)]
                owner = s.tokens[typed[-1]].text + "." if typed else ""
                s.defined.update(typed[:-1])
                name = close + 1
            k = name + 1
            if s.is_(k, "["):
                k = s.pair.get(k, k) + 1
            k = s.pair.get(k, k) + 1  # after the parameters
            line = _line(s, k - 1)
            while k < n and not s.is_(k, "{") and _line(s, k) == line:
                close = s.pair.get(k, k)
                if s.is_(k, "interface", "struct") and s.is_(k + 1, "{"):
                    close = s.pair.get(k + 1, k + 1)
                line = s.at(s.tokens[close].end)[0]
                k = close + 1
            end = s.pair.get(k, k) if s.is_(k, "{") else k - 1
            if s.named(name):
                label = s.tokens[name].text
                s.symbol("method" if owner else "function", name, f"{pkg}.{owner}{label}", i, end, shown(label))
            i = end + 1
        elif s.is_(i, "type", "const", "var"):
            word = s.tokens[i].text
            kind = {"const": "constant", "var": "variable"}.get(word)
            if s.is_(i + 1, "("):
                end = s.pair.get(i + 1, i + 1)
                k = i + 2
                while k < end:
                    k = max(k + 1, _type(s, k, end, k, pkg, nested) if kind is None else _values(s, k, end, k, kind, pkg))
                i = end + 1
            elif s.named(i + 1):
                i = max(i + 1, _type(s, i + 1, n, i, pkg, nested) if kind is None else _values(s, i + 1, n, i, kind, pkg))
            else:
                i += 1
        else:
            i = s.pair.get(i, i) + 1
    add_uses(s, KEYWORDS, skip=skip)
    return s

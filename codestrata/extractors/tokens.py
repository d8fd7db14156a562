"""A token scanner for the brace languages and the walk that finds calls and references."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

_SPACE = re.compile(r"\s+")
_NUMBER = re.compile(r"\d[\w.]*")
_NAME = re.compile(r"[^\W\d][\w$]*|\$[\w$]*", re.ASCII)
_WIDE = re.compile(r"[^\W\d]\w*")
_OPS = re.compile(r"=>|===|!==|==|!=|<=|>=|:=|->|::|\.\.\.|&&=|\|\|=|\?\?=|\*\*=|<<=|>>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|&&|\|\||\?\.|\+\+|--|.", re.S)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_RAW = re.compile(r'b?r(#*)"')
_LIFETIME = re.compile(r"'[A-Za-z_]\w*(?!')")
ASSIGN = {"=", ":=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "&&=", "||=", "??=", "**=", "<<=", ">>="}
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}", "${": "}"}, {")", "]", "}"}


@dataclass(slots=True)
class Token:
    kind: str  # name, number, string, op
    text: str
    start: int
    end: int


def _quoted(src: str, at: int, quote: str) -> int:
    i = at + 1
    while i < len(src) and src[i] != quote:
        i += 2 if src[i] == "\\" else 1
    return min(len(src), i + 1)


def tokenize(src: str, language: str) -> list[Token]:
    """Comments and white space are left out. In a TypeScript template the parts between ${ and } are tokens."""
    out: list[Token] = []
    templates: list[int] = []  # depth of braces at which each open template goes on
    depth, i, n = 0, 0, len(src)
    script = language in ("ts", "tsx", "js", "jsx")

    def template(at: int) -> int:
        k = at
        while k < n and src[k] != "`":
            if src[k] == "\\":
                k += 2
            elif src.startswith("${", k):
                out.append(Token("string", src[at:k], at, k))
                out.append(Token("op", "${", k, k + 2))
                templates.append(depth)
                return k + 2
            else:
                k += 1
        out.append(Token("string", src[at:k], at, min(n, k + 1)))
        return min(n, k + 1)

    while i < n:
        c = src[i]
        if c.isspace():
            i = _SPACE.match(src, i).end()
        elif src.startswith("//", i):
            i = src.find("\n", i)
            i = n if i < 0 else i
        elif src.startswith("/*", i):
            level, i = 1, i + 2
            while i < n and level:
                if src.startswith("*/", i):
                    level, i = level - 1, i + 2
                elif language == "rust" and src.startswith("/*", i):
                    level, i = level + 1, i + 2
                else:
                    i += 1
        elif c == "`" and script:
            i = template(i + 1)
        elif c == "`":
            end = src.find("`", i + 1)
            end = n if end < 0 else end + 1
            out.append(Token("string", src[i:end], i, end))
            i = end
        elif language == "rust" and (m := _RAW.match(src, i)):
            end = src.find('"' + m[1], m.end())
            end = n if end < 0 else end + 1 + len(m[1])
            out.append(Token("string", src[i:end], i, end))
            i = end
        elif language == "rust" and c == "'" and (m := _LIFETIME.match(src, i)):
            out.append(Token("op", m[0], i, m.end()))
            i = m.end()
        elif language == "java" and src.startswith('"""', i):
            end = src.find('"""', i + 3)
            end = n if end < 0 else end + 3
            out.append(Token("string", src[i:end], i, end))
            i = end
        elif c in "\"'":
            end = _quoted(src, i, c)
            out.append(Token("string", src[i:end], i, end))
            i = end
        elif m := _NUMBER.match(src, i):
            out.append(Token("number", m[0], i, m.end()))
            i = m.end()
        elif m := _NAME.match(src, i) or _WIDE.match(src, i):
            out.append(Token("name", m[0], i, m.end()))
            i = m.end()
        elif script and c == "/" and (not out or out[-1].text in {"return", "typeof", "case"} or out[-1].kind == "op" and out[-1].text not in CLOSE) and (m := _REGEX.match(src, i)):
            out.append(Token("string", m[0], i, m.end()))
            i = m.end()
        else:
            m = _OPS.match(src, i)
            if m[0] == "{":
                depth += 1
            elif m[0] == "}":
                if templates and templates[-1] == depth:
                    templates.pop()
                    out.append(Token("op", "}", i, i + 1))
                    i = template(i + 1)
                    continue
                depth -= 1
            out.append(Token("op", m[0], i, m.end()))
            i = m.end()
    return out


@dataclass
class Source:
    """One file's tokens and what is found in them."""

    text: str
    language: str
    tokens: list[Token] = field(default_factory=list)
    pair: dict[int, int] = field(default_factory=dict)
    symbols: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    references: list[dict] = field(default_factory=list)
    defined: set[int] = field(default_factory=set)

    def __post_init__(self):
        self.lines = self.text.split("\n")
        self.starts = [0]
        for line in self.lines:
            self.starts.append(self.starts[-1] + len(line) + 1)

    def scan(self) -> Source:
        self.tokens = tokenize(self.text, self.language)
        stack: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.kind == "op" and t.text in OPEN:
                stack.append(i)
            elif t.kind == "op" and t.text in CLOSE:
                while stack:
                    j = stack.pop()
                    if OPEN[self.tokens[j].text] == t.text:
                        self.pair[j] = i
                        break
        for i in stack:
            self.pair.setdefault(i, len(self.tokens) - 1)
        return self

    def at(self, offset: int) -> tuple[int, int]:
        line = bisect_right(self.starts, offset) - 1
        return line + 1, offset - self.starts[line]

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind != "string" and self.tokens[i].text in texts

    def named(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "name"

    def seek(self, i: int, stop: int, *texts: str) -> int:
        """First token in i..stop, outside of brackets opened on the way, with one of the texts; or stop."""
        while i < stop:
            if self.is_(i, *texts):
                return i
            i = self.pair.get(i, i) + 1
        return stop

    def span(self, start: int, end: int) -> dict:
        (a, b), (c, d) = self.at(start), self.at(end)
        return {"start_line": a, "start_col": b, "end_line": c, "end_col": d}

    def symbol(self, kind: str, name: int | str, qualified: str, first: int, last: int, exported: bool) -> None:
        """A definition from token `first` to token `last`; name is a token's number or the name itself."""
        if isinstance(name, int):
            self.defined.add(name)
            name = self.tokens[name].text
        last = min(last, len(self.tokens) - 1)
        place = self.span(self.tokens[first].start, self.tokens[last].end)
        self.symbols.append({"kind": kind, "name": name, "qualified_name": qualified, **place, "signature": signature(self.lines, place), "exported": exported})


def signature(lines: list[str], place: dict) -> str:
    """The first three lines of a definition at most, trimmed, and of them 200 characters."""
    first = place["start_line"] - 1
    return "\n".join(lines[first : min(place["end_line"] - 1, first + 2) + 1]).strip()[:200]


def add_uses(src: Source, keywords: set[str], *, fields_are_names: bool = False, new_is_call: bool = False, skip: list[tuple[int, int]] = (), quiet: list[tuple[int, int]] = ()) -> None:
    """Calls and references of all tokens. skip: ranges without uses (imports); quiet: ranges without calls (macros)."""
    t = src.tokens
    silent = {i for a, b in quiet for i in range(a, b + 1)}
    hidden = {i for a, b in skip for i in range(a, b + 1)}

    def head(i: int) -> int:
        """Where the member chain that ends in token i begins."""
        while i >= 2 and src.is_(i - 1, ".", "?.", "::"):
            j = i - 2
            while src.is_(j, ")", "]"):
                opened = next((a for a, b in src.pair.items() if b == j), None)
                if opened is None:
                    return i
                j = opened - 1 if src.named(opened - 1) or src.is_(opened - 1, ")", "]") else opened
                if j == opened:
                    return j
            if not (src.named(j) or t[max(j, 0)].kind in ("string", "number")):
                return i
            i = j
        return i

    def tail(i: int) -> int:
        """The token after the member chain that begins with token i."""
        i += 1
        while True:
            if src.is_(i, ".", "?.", "::") and src.named(i + 1):
                i += 2
            elif src.is_(i, "["):
                i = src.pair.get(i, i) + 1
            else:
                return i

    for i, token in enumerate(t):
        if token.kind != "name" or i in hidden or i in src.defined or token.text in keywords:
            continue
        member = src.is_(i - 1, ".", "?.")
        opened = i + 1
        if src.is_(opened, "::") and src.is_(opened + 1, "<"):
            opened = src.seek(opened + 1, len(t), "(")
        elif src.is_(opened, "<") and (close := _angles(src, opened)) and src.is_(close + 1, "("):
            opened = close + 1
        made = src.is_(head(i) - 1, "new")
        if src.is_(opened, "(") and i not in silent and (new_is_call or not made):
            a = head(i)
            first = t[a - 1].start if made else t[a].start
            src.calls.append({"name": token.text, **src.span(first, t[src.pair.get(opened, opened)].end)})
            src.references.append({"name": token.text, "kind": "call", **src.span(t[a].start, token.end)})
            if not fields_are_names and not member:
                src.references.append({"name": token.text, "kind": "read", **src.span(token.start, token.end)})
            continue
        if member and not fields_are_names:
            continue
        if src.is_(i + 1, ":") and src.is_(i - 1, "{", ",") and not src.is_(i + 2, ":"):
            continue  # a key
        kind = "write" if src.is_(tail(i), *ASSIGN) else "read"
        src.references.append({"name": token.text, "kind": kind, **src.span(token.start, token.end)})


def _angles(src: Source, i: int) -> int | None:
    """The > that closes the < at token i, if only type-like tokens stand between."""
    depth = 0
    for j in range(i, min(len(src.tokens), i + 60)):
        x = src.tokens[j]
        if x.text == "<":
            depth += 1
        elif x.text in (">", ">>") or x.text == ">=":
            depth -= 1 if x.text != ">>" else 2
            if depth <= 0:
                return j
        elif not (x.kind == "name" or x.text in {",", ".", "::", "?", "&", "[", "]", "|", "*"} or x.text.startswith("'")):
            return None
    return None


def after_angles(src: Source, i: int) -> int:
    """The token after the type parameters that begin at token i, or i."""
    if not src.is_(i, "<"):
        return i
    depth = 0
    for j in range(i, len(src.tokens)):
        text = src.tokens[j].text if src.tokens[j].kind == "op" else ""
        depth += (text == "<") - text.count(">") * (text in (">", ">="))
        if depth <= 0:
            return j + 1
    return i

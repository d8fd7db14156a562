"""HTML: ids, classes, non-standard tags, scripts and styles."""

from __future__ import annotations

from html.parser import HTMLParser

from .tokens import Source, signature

# The tags that are no symbols of their own.
STANDARD = {
    "html", "head", "body", "title", "meta", "link", "style", "script",
    "div", "span", "p", "a", "img", "ul", "ol", "li", "table", "tr", "td", "th",
    "form", "input", "button", "textarea", "select", "option",
    "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "footer", "nav", "section", "article", "aside", "main",
    "br", "hr", "strong", "em", "b", "i", "u", "code", "pre",
    "canvas", "svg", "video", "audio", "iframe",
    "dl", "dt", "dd", "blockquote", "cite", "abbr", "address",
}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())


class _Reader(HTMLParser):
    def __init__(self, src: Source):
        super().__init__(convert_charrefs=False)
        self.src, self.open = src, []

    def here(self) -> tuple[int, int]:
        return self.getpos()

    def add(self, kind: str, name: str, place: dict) -> dict:
        s = {"kind": kind, "name": name, "qualified_name": name, **place, "signature": "", "exported": True}
        self.src.symbols.append(s)
        return s

    def handle_starttag(self, tag, attrs, closed: bool = False) -> None:
        line, col = self.here()
        raw = self.get_starttag_text() or ""
        rows = raw.split("\n")
        end = (line + len(rows) - 1, col + len(raw) if len(rows) == 1 else len(rows[-1]))
        place = {"start_line": line, "start_col": col, "end_line": end[0], "end_col": end[1]}
        own: list[dict] = []
        for key, value in attrs:
            value = value or ""
            if key == "id" and value:
                own.append(self.add("variable", f"#{value}", place))
            elif key == "class":
                for c in value.split():
                    own.append(self.add("variable", f".{c}", place))
                    self.src.references.append({"name": f".{c}", "kind": "read", **place})
            if value.startswith("#") and len(value) > 1 and key != "id":
                self.src.references.append({"name": value, "kind": "read", **place})
        if tag in ("script", "style"):
            own.append(self.add("module", f"<{tag}>", place))
        elif tag not in STANDARD:
            own.append(self.add("class", tag, place))
        if not closed and tag not in _VOID:
            self.open.append((tag, own))

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs, closed=True)

    def handle_endtag(self, tag) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                line, col = self.here()
                for s in self.open[k][1]:
                    s["end_line"], s["end_col"] = line, col + len(tag) + 3
                del self.open[k:]
                return


def extract(text: str, language: str = "html", **_) -> Source:
    """An element's symbols range from its start tag to its end tag. There are no calls."""
    s = Source(text, language)
    reader = _Reader(s)
    reader.feed(text)
    reader.close()
    for x in s.symbols:
        x["signature"] = signature(s.lines, x)
    return s

import pytest

from codestrata.extractors import REGISTRY, items

TS = """// greetings
export function greet(name: string): string {
  return `Hi ${upper(name)}`;
}
const helper = (x: number) => greet(String(x));
const LIMIT = 3;
export class Box<T> {
  private size: number = 0;
  grow(by: number): this {
    this.size += by;
    return this;
  }
}
interface Shape { area(): number; }
export type Id = number;
function make() { return new Box(); }
"""
GO = """package shop

import "fmt"

type Item struct {
	X, Y float64
	Base
	Info struct {
		Name string
	}
}

type Priced interface {
	Price() int
}

const (
	Max = 3
	min = 1
)

func (i *Item) Price() int { return total(i.X) }

func total(x float64) int {
	v := int(x)
	return v
}
"""
RUST = """mod shop;
const MAX: u32 = 3;
pub struct Item { pub id: u32, name: String }
impl Item {
    pub fn new(id: u32) -> Self { check(id); Item { id, name: String::new() } }
}
pub trait Priced { fn price(&self) -> u32; }
impl Priced for Item { fn price(&self) -> u32 { check(self.id) } }
fn check(id: u32) -> u32 { println!("{}", inner(id)); id }
enum Kind { A, B }
"""
JAVA = """package a.b;
import java.util.*;
public class Item {
    private int id, size;
    public Item(int id) { this.id = id; }
    public int price() { return new Calc().total(id); }
}
interface Priced { int MAX = 3; int price(); }
enum Kind { A("x"), B("y"); private final String s; Kind(String s) { this.s = s; } }
"""
PY = """MAX_SIZE = 3
debug = False
class Item:
    kind = "x"
    def __init__(self):
        self.id = make()
    @property
    def shown(self):
        return self.id
def _make():
    total = 1
    return total
"""
HTML = """<div id="top" class="a b">
<user-card></user-card>
<a href="#top">x</a>
<script>if (1 < 2) { "</p>" }</script>
</div>"""


def found(text, language, **how):
    s = REGISTRY[language].extract(text, language, **how)
    return {x["qualified_name"]: x for x in s.symbols}, [c["name"] for c in s.calls], s


def test_typescript():
    s, calls, src = found(TS, "ts")
    assert {k: v["kind"] for k, v in s.items()} == {"greet": "function", "helper": "function", "Box": "class", "Box.size": "property", "Box.grow": "method", "Shape": "interface", "Id": "type", "make": "function"}
    assert s["greet"]["exported"] and s["Box"]["exported"] and not s["helper"]["exported"] and not s["Box.grow"]["exported"]
    assert (s["greet"]["start_line"], s["greet"]["end_line"]) == (2, 4)
    assert sorted(calls) == ["String", "greet", "upper"]
    assert s["greet"]["signature"].startswith("export function greet")


def test_go_fields_to_a_depth():
    s, calls, _ = found(GO, "go")
    assert {"shop.Item.X", "shop.Item.Y", "shop.Item.Base", "shop.Item.Info.Name", "shop.Priced.Price", "shop.Item.Price"} <= set(s)
    assert s["shop.Max"]["kind"] == "constant" and not s["shop.min"]["exported"]
    assert s["shop.Item.Price"]["kind"] == "method" and s["shop.total"]["kind"] == "function"
    assert "total" in calls
    assert "shop.Item.Info.Name" not in found(GO, "go", nested=0)[0]


def test_rust():
    s, calls, _ = found(RUST, "rust")
    assert {k: v["kind"] for k, v in s.items()} == {"shop": "module", "shop::MAX": "constant", "shop::Item": "struct", "shop::Item.id": "field", "shop::Item.name": "field", "shop::Item::new": "method", "shop::Priced": "interface", "shop::Priced.price": "method", "shop::Item::price": "method", "shop::check": "function", "shop::Kind": "type"}
    assert calls.count("check") == 2 and "inner" not in calls


def test_java():
    s, calls, _ = found(JAVA, "java")
    assert {k: v["kind"] for k, v in s.items()} == {"a.b.Item": "class", "a.b.Item.id": "field", "a.b.Item.size": "field", "a.b.Item.Item": "method", "a.b.Item.price": "method", "a.b.Priced": "interface", "a.b.Priced.MAX": "constant", "a.b.Priced.price": "method", "a.b.Kind": "type", "a.b.Kind.s": "field", "a.b.Kind.Kind": "method"}
    assert sorted(calls) == ["Calc", "total"]
    assert s["a.b.Priced.price"]["exported"] and not s["a.b.Item.id"]["exported"]


def test_python():
    s, calls, _ = found(PY, "python")
    assert {k: v["kind"] for k, v in s.items()} == {"MAX_SIZE": "constant", "debug": "variable", "Item": "class", "Item.kind": "property", "Item.__init__": "method", "Item.shown": "property", "_make": "function"}
    assert s["Item.__init__"]["exported"] and not s["_make"]["exported"]
    assert calls == ["make"]


def test_html():
    s, calls, src = found(HTML, "html")
    assert {k: v["kind"] for k, v in s.items()} == {"#top": "variable", ".a": "variable", ".b": "variable", "user-card": "class", "<script>": "module"}
    assert calls == [] and {r["name"] for r in src.references} == {".a", ".b", "#top"}
    assert s["#top"]["end_line"] == 5


@pytest.mark.parametrize("language", sorted(REGISTRY))
@pytest.mark.parametrize("text", ["", "}}}", "((((", "class", "func (", "type X struct {", "`${", "'", "impl<", "fn f<T", "<a <b"])
def test_broken_files_end(language, text):
    rows = items("f", text, language)
    assert all(r[1] in ("symbol", "call", "reference", "error") for r in rows)


def test_standard_tags_are_no_symbols():
    s, _, _ = found("<b>x</b><dl><dt>t</dt></dl><svg><path d='m'/></svg><cite>c</cite><label>l</label>", "html")
    assert set(s) == {"path", "label"}


def test_python_passes_over_wrong_lines():
    text = "import os\n\ndef good():\n    return 1\n\ndef bad(:\n    x = 1\n    return x\n\nclass C:\n    y = = 2\n    def m(self):\n        return good()\n\nz = (1,\n\nend = 3\n"
    s, calls, _ = found(text, "python")
    assert {"good", "C", "C.m"} <= set(s) and s["C.m"]["start_line"] == 12
    assert "good" in str(calls)
    assert items("f.py", "def f(:\n", "python")[0][1] == "error"

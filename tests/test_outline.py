"""Elements of brace languages, by exact extents."""

import time

import pytest

from tessera.operators import chunking
from tessera.operators.outline import declarations

SOURCES = {
"js":"import React, { a } from 'x';\nimport b from \"y\";\n\nclass A extends B {\n  #p = 1;\n  constructor(x = f(1, {a: 2})) { super(x); }\n  async load(id) {\n    const r = await fetch(`/${id}`);\n    return r.items.map(x => x.id);\n  }\n  get size() { return 1 }\n}\nconst T = 5;\nvar old = 3, more = [1, 2];\nexport const go = async (p, q) => {\n  if (p) { return q; }\n};\nexport default A;\nfunction plain(a, b) {\n  function nested() {}\n  return nested();\n}\n",
"ts":"export class C<T extends D<E>> implements F {\n  private readonly m: Map<string, T> = new Map();\n  constructor(private x: number) {}\n  run<K>(a: K, cb: (e: Error) => void): Promise<void> {\n    return g(a);\n  }\n}\ninterface I { a: string; f(x: number): void }\nnamespace N { export function h(): void {} }\n",
"java":"package a.b;\nimport java.util.*;\nimport static c.D.e;\n/** Doc { */\n@Anno(x = {1, 2})\npublic class A<T> extends B<T> {\n  private final Map<String, List<T>> m = new HashMap<>();\n  int n;\n  public A(int x) { this.n = x; }\n  @Override public <U> List<? extends U> all(final int a,\n      String... b) throws X {\n    for (int i = 0; i < n; i++) { f(\"}\"); }\n    return null;\n  }\n  abstract void later();\n  enum E { P, Q; int v() { return 0; } }\n}\ninterface I { void x(); }\n",
"go":"package main\n\nimport (\n\t\"fmt\"\n)\n\ntype Point struct {\n\tX, Y int\n}\n\ntype Shape interface { Area() float64 }\n\nvar limit = 3\n\nfunc (p *Point) Add(o Point) (r Point, err error) {\n\tf := func() { g() }\n\treturn\n}\n\nfunc main() {\n\tvar x int\n\tfmt.Println(x)\n}\n",
"cpp":"#include <vector>\nnamespace n {\nclass A : public B {\n public:\n  A(int x) : x_(x) {}\n  virtual int f(const std::vector<int>& v) const override { return v[0]; }\n  int g();\n private:\n  int x_;\n};\nstruct P { int a; };\nint A::g() { return x_; }\ntemplate <typename T> T twice(T v) { return v + v; }\nstatic const int LIMIT = 5;\n}\nint main(int argc, char** argv) {\n  std::string s = \"}\";\n  n::A a(1);\n  return a.g();\n}\n",
"rust":"use std::fmt;\n#[derive(Debug)]\npub struct P<'a> { x: &'a str }\nenum E { A, B(i32) }\nimpl<'a> P<'a> {\n    pub fn new(x: &'a str) -> Self { P { x } }\n    fn len(&self) -> usize { let n = self.x.len(); n }\n}\nfn main() { let mut v = vec![1, 2]; println!(\"{}\", v[0]); }\n",
"csharp":"using System;\nnamespace N {\n  public class A : B {\n    private readonly int x = 1;\n    public string Name { get; set; } = \"q\";\n    public int Twice => x * 2;\n    public A(int y) { x = y; }\n    public override async Task<int> Run(int a) { return await F(a); }\n  }\n  interface I { void M(); }\n  struct S { public int Q; }\n}\n",
}

WANT = {
    "js": ["import ", "import ", "class A", "function constructor", "function load", "function x", "function size", "assignment old", "import ", "function p", "import ", "function plain", "function nested"],
    "java": ["import ", "import ", "import ", "class A", "assignment m", "assignment n", "function all", "function later", "function v", "class I", "function x"],
    "go": ["import ", "import ", "assignment Point", "assignment Shape", "assignment limit", "function Add", "function main", "assignment x"],
    "cpp": ["class A", "function f", "class P", "function g", "function twice", "assignment LIMIT", "function main", "assignment s"],
    "rust": ["import ", "class P", "class E", "function new", "function len", "assignment n", "function main", "assignment v"],
    "csharp": ["import ", "class A", "assignment x", "assignment Name", "assignment Twice", "function Run", "class I", "function M", "class S", "assignment Q"],
}


@pytest.mark.parametrize("language", sorted(WANT))
def test_declarations(language):
    text = SOURCES[language]
    got = declarations(text, language)
    assert [f"{kind} {'' if kind == 'import' else name}" for kind, name, _, _ in got] == WANT[language]
    for kind, _, a, b in got:
        piece = text[a:b]
        assert piece == piece.strip() and all(piece.count(x) == piece.count(y) for x, y in ("()", "[]")) and (language == "cpp" or piece.replace('"}"', "").count("{") == piece.replace('"}"', "").count("}"))
    elements = chunking.braced_elements(text, language)
    assert all("\n".join(text.split("\n")[e.first - 1 : e.last]).find(e.text) >= 0 for e in elements)


def test_typescript_members():
    names = [f"{k} {n}" for k, n, _, _ in declarations(SOURCES["ts"], "ts") if k != "import"]
    assert {"class C", "function constructor", "function run", "function h"} <= set(names) and not any(n.endswith(" I") for n in names)


def test_what_does_not_parse_is_flagged():
    for language in WANT:
        with pytest.raises(ValueError):
            declarations("class A { (", language)
        assert chunking.syntax_chunks("class A { (", language)[0].extra == {"parse_error": True}
        assert declarations("", language) == []
    assert chunking.syntax_chunks("x", "cobol")[0].extra == {"unsupported_language": True}


def test_long_files_take_linear_time():
    began = time.process_time()
    for language, one in {"js": "a.map(x=>x.y(z=>z));function f(){return(a)=>{b}}", "java": "class A{int x=1;void f(){g(1);}}", "cpp": "int f(int a){return g(a);}"}.items():
        assert len(declarations(one * 8_000, language)) >= 8_000
    assert time.process_time() - began < 60


def test_classes_are_cut_by_size():
    small = "class Main:\n" + "".join(f"    def m{i}(self):\n        return '{'x' * 100}'\n" for i in range(17))
    element = [e for e in chunking.python_elements(small) if e.kind == "class"][0]
    assert 2000 < chunking.nonws(element.text) <= 2500 >= len(element.text) and any(p.extra.get("is_decomposed_unit") for p in chunking.split_large(element, "python"))
    large = [e for e in chunking.python_elements(small + "".join(f"    def n{i}(self):\n        return '{'y' * 100}'\n" for i in range(16))) if e.kind == "class"][0]
    assert not any(p.extra.get("is_decomposed_unit") for p in chunking.split_large(large, "python"))

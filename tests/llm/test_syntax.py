import ast
import random
import time

import pytest

from tessera.llm import syntax
from tessera.llm.gll import END, Network


def test_ambiguous_and_left_recursive_grammar():
    names = ["a", "+"]
    net = Network("E: E '+' E | 'a' | E E\nN: 'a'* '+'?", lambda k, t: names[k] == t[1], lambda k, p: False)
    ok = lambda n, s: net.derives(n, tuple(names.index(c) for c in s))
    assert ok("E", "a") and ok("E", "a+a+aa" * 6) and not ok("E", "a+") and not ok("E", "")
    assert ok("N", "") and ok("N", "aaa+") and not ok("N", "+a")


def test_fronts_agree_with_descriptors():
    rng = random.Random(3)
    grammars = ["S: 'a' S? 'b' | T\nT: 'a'* ('b' T)? U\nU: @end | 'c' U", "S: X Y | Y Z?\nX: 'a' ('b' X)? | 'a'\nY: ('b' | Z)* 'c'?\nZ: 'a' 'b'? | 'c' X", "S: 'a' S 'a' | 'b' S 'b' | 'a' | 'b' | V\nV: 'c' V?"]
    for text in grammars:
        net = Network(text, lambda k, t: "abc"[k] == t[1], lambda k, p: k == END)
        assert not net.cyclic
        for _ in range(1500):
            kinds = tuple(rng.randrange(3) for _ in range(rng.randrange(9)))
            front = net.start(*sorted(net.names))
            for k in kinds:
                front = front[k]
            assert front.accepts == {n for n in net.names if net.descends(n, kinds)}, (text, kinds)


def test_long_lines_take_linear_time():
    for ext, one in {".js": "x=f({a:[1,2],b(){return y?1:2}});", ".java": "class A{void f(){int x=(int)g(1)+h[2];}}", ".py": "x=f(a[1],{'b':2});"}.items():
        start = time.process_time()
        assert syntax.parses("a" + ext, one * (800_000 // len(one)))
        assert time.process_time() - start < 4
    assert syntax.parses("a.jsx", "x = " + "<a>" * 3000 + "</a>" * 3000) and not syntax.parses("a.jsx", "x = " + "<a>{" * 3000)
    assert syntax.parses("a.js", "x=" + "(" * 5000 + "1" + ")" * 5000) and syntax.parses("a.js", "if(a)b();else " * 3000 + "c()")


GOOD = {
    ".py": ["", "x = 1", "def f(a, *, b=2, **k) -> int:\n\treturn a\n", "if a:\n  pass\nelif b: c\nelse:\n  d\n", "@d\nasync def f():\n    async with a as b, c:\n        await x\n", "match x:\n    case [1, *r] if r:\n        pass\n    case {'a': b, **k} | None:\n        pass\n", "x = [i for i in y if i]; z = {**a, 'b': 1}\n", "try:\n    a\nexcept* E as e:\n    b\n", "print(f'{x!r}' 'y', file=z)\n", "def f(a, /, b): \\\n    return lambda *x, y=1: (yield)\n", "# only a comment", "class A(B, m=C):\n    '''doc'''\n    x: int = 1\n\n# c\n    y = 2\n", "type X[T] = list[T]\nmatch = 1\n", "a = b = c[1:2, ::3]\nx: int\n(y) : int = 3\n"],
    ".js": ["", "export default class A extends B { #p = 1; static { x(); } get a() { return this.#p } async *g() {} }", "const {a, b: [c = 1, ...d], ...e} = f, g = /[/]re\\//gi.test(x)\nlet y = a / b / c", "for (const x of y) if (x) continue; else break", "(()=>{var e={1:(e,t)=>{!function(){}()}};var t={};})();", "a = b\n++c\nx = `t${`n${1}`}`", "import a, {b as c, default as d} from './x.js';\nexport * as n from 'y';\nexport {a as default}", "label: for (;;) { switch (x) { case 1: default: } }", "x = a ? b : c => ({d: e, f() {}, [g]: h, get i() { return 1 }})\nasync (a, b) => { await c?.d?.[e]?.(f) }", "new A(b)(c).d\nif (a)\n  b()\nelse\n  c()\ndo x(); while (y)\nz()", "'use strict'; var \\u0061".replace("\\u0061", "a"), "return_ = 1; a = b ** c ?? d; delete a.b; var async = 1, of = 2, get = 3"],
    ".jsx": ["const A = ({ a, ...r }) => (\n  <div className=\"x\" {...r} onClick={() => { go(a < 1 && b > 2) }}>\n    Don't {/* no */} stop {a ? <b>{`t${a}`}</b> : null}\n    <></>\n    <Menu.Item data-x='y' open />\n  </div>\n)\nexport default A", "function f() { return <p>it's {x.map(i => <li key={i}>{i}'s</li>)}</p> }", "let x = a < b, y = c > d; z = /<a>/.test(q)", "const e = <A b=<i/> />;"],
    ".tsx": ["const f = <T,>(x: T) => <B<string> x={x}>{x as any}</B>;".replace("<B<string> x", "<B x"), "export const C: FC<P> = ({ a }: P) => <>{a!.b}</>", "const g = <T extends U>(x: T): T => x"],
    ".ts": ["export interface A<T extends B = C> extends D<T> { a: string; b?(x: number): void; [k: string]: any; readonly c: A[]; new (x: E): F }", "class A<T> implements B { private readonly x: Map<string, Array<T>> = new Map<string, Array<T>>(); constructor(public a: number, b?: string) { super() } abstract m(): void; }", "type X = { [K in keyof Y]?: Y[K] } | ((a: number) => asserts a is B) | 'lit' | [a: string, b?: C]\nlet z = <any>y as unknown as X; let w = a < b && c > d", "enum E { A = 1, B }\ndeclare module 'm' { export const x: number }\nnamespace N.M { export type T = typeof import('x') }", "function f(this: A, ...r: B[]): r is C;\nfunction f(x) { return x! }\nexport type { T } from './t'\nabstract class Q { @dec() p = 1 }"],
    ".java": ["package a.b;\nimport static c.D.*;\n@Anno(x = {1, 2}) public final class A<T extends B & C> extends D<T> implements E, F {\n private static final int[][] N = {{1}, {2,}};\n @Override public <U> List<? extends U> m(final int a, String... b) throws X, Y { for (int i = 0, j = 1; i < n; i++, j--) { x[i] = (int) y; } return new ArrayList<>() { void q() {} }; }\n A() { this(1); } static { z(); } enum G { P(1) { int v() { return 1; } }, Q; int v() { return 0; } } record R(int a, B<C> b) { R { } } interface I { default void d() {} } }", "class A { void f() { var x = switch (y) { case 1, 2 -> 3; default -> { yield 4; } }; Function<A, B> g = (a) -> a.b(); h = A::new; if (o instanceof B b && b.c()) try (var r = q()) { } catch (E | F e) { } finally { } do { } while (true); String t = \"\"\"\n a \"q\" \"\"\"; int s = a >>> 2; i >>>= 1; l: while (x) continue l; } }"],
    ".go": ["package x\n", "package main\n\nimport (\n\t\"fmt\"\n\tm \"a/b\"\n)\n\ntype T[K comparable, V any] struct {\n\tA, B int `json:\"a\"`\n\t*C\n}\n\nfunc (t *T[K, V]) F(a, b int, c ...string) (n int, err error) {\n\tif x, ok := m[k]; ok && !y {\n\t} else if z {\n\t}\n\tfor i, v := range l {\n\t\tgo func() { ch <- v }()\n\t}\n\tswitch t := x.(type) {\n\tcase int, *T:\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-ch:\n\t}\n\ta[i:j], b = []int{1, 2,\n\t}, map[string]T{\"a\": {A: 1}}\n\treturn\n}\n\nvar (\n\tx = 1\n)\n\nconst c = `raw`\n"],
}
BAD = {
    ".py": ["print 'x'", "def f(:\n  pass", "if a:\nb", "x = (1", "  x = 1\n y = 2", "a +", "<<<<<<< a\nx\n=======\ny\n>>>>>>> b\n", "f() = 1", "else:\n  x\n", "'open", "def f():\n", "from import x", "class A\n  pass", "import a as\n", "x = 1 2"],
    ".js": ["x = <a/>", "{\"a\": 1, \"b\": [2]}", "function () {}", "a b", "if (", "class A { x( }", "import x from;", "let x: number = 1", "<html></html>", "try { }", "for (a; b) {}", "'open\n'", "x = {a: 1", "interface A { b: string }", "<<<<<<< a\nvar b\n=======\nvar c\n>>>>>>> d", "1 = 2", "def f():\n  return 1"],
    ".jsx": ["x = <a>", "x = <a></b>", "x = <a b=1 />", "x = <a>{b c}</a>", "x = <a>}</a>", "x = <a b={} />", "x = <a {b} />", "let x: number = 1", "x = <a>" * 3000],
    ".tsx": ["const x = <any>y;", "const x = <a>{1 2}</a>", "let x: = <a/>"],
    ".ts": ["const x = <a>b</a>", "interface A { b: }", "let x: = 1", "class A { m() }}", "type = 1 2", "def f(x):\n  return x"],
    ".java": ["class A { void f() { a + b; } }", "class A { int }", "class A { void f( { } }", "class A { void f() { int x = ; } }", "package a", "func main() {}", "class A { void f() { if x { } } }", "class A { String s = \"open; }"],
    ".go": ["", "func f() {}", "package x\n\nfunc f() {\n\tif x {\n", "package x\n\nfunc f() { else }\n", "package x\n\nx := 1\n", "package x\n\nfunc f() {}\n\nimport \"a\"\n", "package x\n\nfunc f()\n{\n}\n}", "package x\nvar a = 'ab'c\n"],
}


@pytest.mark.parametrize("ext, text", [(e, t) for e, ts in GOOD.items() for t in ts])
def test_good(ext, text):
    assert syntax.parses("a" + ext, text) is True


@pytest.mark.parametrize("ext, text", [(e, t) for e, ts in BAD.items() for t in ts])
def test_bad(ext, text):
    assert syntax.parses("a" + ext, text) is False


def test_python_agrees_with_its_own_parser(spark, sf):
    rows = spark.read.parquet(f"{sf}/source_files.parquet").where("file_path like '%.py' and content is not null").select("content").distinct().collect()
    language = syntax.language_of("a.py")
    for (text,) in rows:
        try:
            ast.parse(text.removeprefix("﻿"))
            want = True
        except (SyntaxError, ValueError):
            want = False
        assert syntax.Language.valid(language, text) == want, text[:200]  # the grammar alone


def test_table(spark):
    rows = [(1, "a.py", "x = ", "q"), (1, "a.py", "x = ", "q"), (2, "b.py", None, "q"), (3, "c.txt", "(", "q"), (4, None, "(", "q"), (None, "d.go", "package d\n", "q"), (6, "E.JS", "\r\n".join(["f(1);"] * 20_000), "q"), (7, "f.py", "", "q"), (8, "x\\y.py", "﻿#!/usr/bin/env python\nx = 1\r\n", "q")]
    df = spark.createDataFrame(rows, "file_id long, file_path string, content string, valid string")
    got = {r["file_id"]: (r["language"], r["valid"]) for r in syntax.unparsable(df).distinct().collect()}
    assert got == {1: ("python", False), None: ("go", True), 6: ("js", True), 7: ("python", True), 8: ("python", True)}
    assert syntax.unparsable(df.limit(0)).count() == 0

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators import chunking as c

PY = '''import os
import sys


class Shape:
    """Doc."""

    def __init__(self, n):
        self.n = n

    @property
    def area(self):
        return self.n ** 2


LIMIT = 10


def main(a, b=2):
    x = a + b
    return x


if __name__ == "__main__":
    main(1)
'''
JS = "import a from './a.js';\nexport class Box extends React.Component {\n  constructor(p) { super(p); }\n  render(x) { return x; }\n}\nconst f = (a) => { return a; };\nexport default f;\n"
JAVA = "package org.x;\nimport java.util.List;\npublic class A {\n  private int n = 1;\n  public A() { n = 2; }\n  public int get(List<String> l) { return n; }\n}\ninterface B { void run(); }\n"
GO = 'package main\n\nimport (\n\t"fmt"\n)\n\ntype T struct {\n\tN int\n}\n\nfunc (t *T) Run(a int) error {\n\tfmt.Println(a)\n\treturn nil\n}\n\nvar X = 1\n'


def test_python_elements():
    got = [(e.kind, e.name) for e in c.python_elements(PY)]
    assert ("class", "Shape") in got and ("function", "__init__") in got and ("decorated_definition", "area") in got and ("assignment", "LIMIT") in got and ("function", "main") in got
    assert ("assignment", "x") not in got and sum(k == "import" for k, _ in got) == 2


def test_other_languages():
    for language, text, names in (("js", JS, {"Box", "render"}), ("ts", JS, {"Box"}), ("java", JAVA, {"A", "get", "B"}), ("go", GO, {"T", "Run", "X"})):
        got = c.syntax_chunks(text, language)
        assert got and names <= {e.name for e in c.braced_elements(text, language)}, language
        assert all(1 <= e.first <= e.last <= text.count("\n") + 1 for e in got)


def test_fallbacks():
    assert c.syntax_chunks("def broken_function(\n    # x", "python")[0].extra == {"parse_error": True}
    assert c.syntax_chunks("print('hello')", "unknown")[0].extra == {"unsupported_language": True}
    assert c.syntax_chunks("x", "go")[0].extra == {"no_elements": True}


def test_fifty_classes():
    text = "import os\n" + "".join(f"\nclass C{i}:\n" + "".join(f"    def m{j}(self):\n        return {j}\n\n" for j in range(3)) for i in range(50))
    got = c.syntax_chunks(text, "python")
    assert sum(e.kind == "class" for e in got) >= 50


def test_large_class_is_split_with_overlap():
    text = "class Main:\n" + "".join(f"    def method_{i}(self, value):\n        result = value * {i} + self.offset_{i}\n        return result\n\n" for i in range(60))
    whole = [e for e in c.python_elements(text) if e.kind == "class"][0]
    parts = c.split_large(whole, "python")
    assert len(parts) > 2 and all(p.extra["is_chunk"] and p.extra["original_element_name"] == "Main" for p in parts)
    assert all(c.nonws(p.text) <= 1200 for p in parts)
    assert abs(c.nonws(whole.text) - sum(p.extra["chunk_non_ws_chars"] for p in parts)) <= len(parts) * 200
    for line in text.strip().split("\n"):
        assert any(line in p.text for p in parts)


def test_small_ones_merge():
    e = [c.Element(f"import m{i}", "import", f"m{i}", i, i) for i in range(5)] + [c.Element("X = 1", "assignment", "X", 9, 9)]
    got = c.merge_small(e)
    assert [g.kind for g in got] == ["import", "assignment"] and got[0].extra["merged_count"] == 5 and (got[0].first, got[0].last) == (0, 4)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab c\n\t.de", max_size=600), st.integers(5, 60), st.integers(0, 4), st.sampled_from([None, "python", "go", "markdown"]))
def test_recursive_split_properties(text, size, overlap, language):
    pieces = c.recursive_split(text, language, size, overlap)
    assert all(p and p == p.strip() and len(p) <= size for p in pieces)
    # nothing but white space gets lost
    at = 0
    for p in pieces:
        assert p in text
    assert re.sub(r"\s", "", text) == "" or set(re.sub(r"\s", "", "".join(pieces))) == set(re.sub(r"\s", "", text))


def test_chunk_files(spark):
    rows = [("a.py", PY, "python", "syntax"), ("b.md", "# T\n\n" + "word " * 500, "markdown", "text"), ("c", None, None, "text"), ("d", "  \n", None, "text"), ("e.py", "def (", "python", "syntax")]
    out = c.chunk_files(spark.createDataFrame(rows, "file_path string, content string, language string, route string"), route="route").collect()
    by = {}
    for r in out:
        by.setdefault(r["file_path"], []).append(r)
    assert set(by) == {"a.py", "b.md", "e.py"} and by["e.py"][0]["flag"] == "parse_error"
    assert [r["local_idx"] for r in by["b.md"]] == list(range(len(by["b.md"]))) and by["b.md"][1]["start_line"] == 21 and by["b.md"][0]["content"].startswith("文件路径: b.md")

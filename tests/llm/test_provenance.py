from datetime import datetime

import pytest

from tessera.llm import provenance as p

CODE = "import os\n\n\ndef main(value):\n    # the usual work\n    return os.path.join(value, 'x')\n\n\nclass A:\n    def run(self):\n        return main(1)\n" * 3
judge = p.Judge(frozenset({"dist", ".git"}))


@pytest.mark.parametrize(
    "path, text, want",
    [
        ("a.py", CODE, None),
        ("a.go", "// Code generated by tool v1. DO NOT EDIT.\n\npackage x\n", "generated"),
        ("a.java", "/*\n * This file was automatically produced by gen; changes will be lost.\n */\nclass A {}\n", "generated"),
        ("a.py", "# Diese Datei wurde automatisch von x erzeugt.\nX = 1\n", "generated"),
        ("a.py", CODE + "# @generated by x\n", "generated"),
        ("a.py", CODE + "banner = '@generated'\n" + CODE, None),
        ("a.py", CODE + "# writes the generated files; edit the template, not the output\n" + CODE, None),
        ("a.js", "// Imported from lib 2.3, upstream revision ab12; local changes: none.\nlet a = 1;\n", "third_party"),
        ("a.js", "// Copyright (c) 2013 The dormi contributors. Released under the Quill licence.\nlet a = 1;\n", "third_party"),
        ("a.js", "// Copyright 2023 the project team\nlet a = 1;\n", None),
        ("a.js", "// SPDX-License-Identifier: Quill-2.0\nlet a = 1;\n", None),
        ("x/node_modules/b/a.js", CODE, "third_party"),
        ("third_party/b/a.js", CODE, "third_party"),
        ("src/vendors/a.py", CODE, None),
        ("x\\dist\\a.py", CODE, "excluded_directory"),
        ("/dist/a.py", CODE, "excluded_directory"),
        ("Dist/a.py", CODE, None),
        ("x/dist.py", CODE, None),
        ("a.js", "var a=function(b){return b?b.c:void 0};" * 40, "minified"),
        ("a.js", "var _0x12ab=['x'];" + "_0x12ab[0](_0x34cd);" * 60, "obfuscated"),
        ("t.py", "T = [\n" + "    0.123, -0.456, 0.789,\n" * 40 + "]\n", "data"),
        ("t.go", 'package x\n\nvar d = "' + "QUJDRA09" * 200 + '"\n', "data"),
        ("a.py", CODE + "icon = 'data:image/png;base64," + "QUJD" * 60 + "'\n" + CODE, None),
        ("a.js", '"use strict";\nObject.defineProperty(exports, "__esModule", { value: true });\nvar a = 1;\n', "generated"),
        ("a.py", "def get_a_000(m): pass\ndef get_a_001(m): pass\ndef get_a_002(m): pass\ndef get_a_003(m): pass\n", "generated"),
        ("a.c", "".join(f"F{i:03d} = {i};\n" for i in range(1, 9)) + CODE, "generated"),
        ("a.py", "port_0080 = 1\nport_0443 = 2\nport_8080 = 3\nport_0022 = 4\n" + CODE, None),
        ("a.js", "const table = [\n" + "  [34, 17, 1],\n" * 12 + "];\n", "data"),
        ("a.py", "LIMIT = 12\n", None),
        (None, CODE, None),
        ("a.py", "", None),
        ("a.py", " \n", None),
    ],
)
def test_judge(path, text, want):
    assert judge(path, text) == want


def test_settings(spark):
    rows = [("EXCLUDED_DIRECTORIES", ".git, old", datetime(2024, 1, 1)), ("EXCLUDED_DIRECTORIES", '["dist", " x "]', datetime(2024, 1, 3)), ("EXCLUDED_DIRECTORIES", "no", None), ("OTHER", "y", datetime(2025, 1, 1))]
    df = spark.createDataFrame(rows, "setting_key string, setting_value string, updated_at timestamp")
    assert p.read_excluded(df) == {"dist", "x"} and p.read_excluded(df.limit(0)) == frozenset()
    assert p.read_excluded(df.where("setting_value like '%old'")) == {".git", "old"}


def test_table(spark):
    rows = [(1, "dist/a.py", CODE, 1), (1, "dist/a.py", CODE, 1), (2, "a.py", CODE, 1), (3, "dist/a.py", None, 1), (None, "dist/b.py", "x", 1), (5, None, None, None), (6, "b.py", CODE * 4000, 2)]
    df = spark.createDataFrame(rows, "file_id long, file_path string, content string, reason int")
    assert sorted(map(str, map(tuple, p.machine_made(df, frozenset({"dist"})).distinct().collect()))) == sorted(map(str, [(1, "excluded_directory"), (None, "excluded_directory")]))
    assert p.machine_made(df.limit(0), frozenset()).count() == 0


@pytest.mark.parametrize("text", ["".join(f"// licence line {i}\n" for i in range(60)) + "// Code generated by tool v1. DO NOT EDIT.\npackage x\n", '"""Tables of the parser.\n\nThis file was generated by gen; do not edit.\n"""\n\nX = 1\n', CODE + "# @generated by x\n" + "# a remark\n" * 40])
def test_whole_comment_block_and_docstring(text):
    assert judge.notice(text) == "generated"


def test_docstring_behind_code_is_no_notice():
    assert judge.notice('import os\n"""do not edit"""\n') is None and judge.notice('"""Doc."""\nbanner = "do not edit"\n') is None

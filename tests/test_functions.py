import fnmatch
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tessera.functions import paths, text, urls


def col(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", expression(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def brute_tokens(t):
    t = (t or "").lower()
    files = re.findall(r"[a-zA-Z0-9_-]+\.[a-zA-Z0-9]+", t)
    words = set(re.findall(r"[a-zA-Z0-9_-]+|[一-鿿]+", t)) | set(files) | {f.split(".")[0] for f in files}
    return {w for w in words if len(w) > 1}


TEXTS = ["", None, "foo.py", "a.py a.js", "a.b-c.d", "中文 mixed 汉字abc a", "x", "See src/foo_bar.py, FOO.PY!", "　tab\tnew\nline", "é è", "word " * 5000]


def test_tokens(spark):
    got = col(spark, TEXTS, text.tokens)
    assert [set(g) for g in got] == [brute_tokens(t) for t in TEXTS] and all(len(g) == len(set(g)) for g in got)


def test_clean(spark):
    def brute(t):
        t = re.sub(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "", t)
        t = unicodedata.normalize("NFKC", t).replace("\r\n", "\n").replace("\r", "\n")
        return re.sub(r"[ \t]+\n", "\n", re.sub(r"\n{3,}", "\n\n", t)).strip()

    values = ["a\n \n \nb", "ｆｕｌｌ ﬁ", "a\x00b\x1fc", "x\r\ny\rz", "a  \t\n\n\n\nb", "  　q\xa0 ", "", "ok"]
    assert col(spark, values, text.clean) == [brute(v) for v in values]
    assert col(spark, [None], text.clean) == [None]


def test_counts_and_boundaries(spark):
    assert col(spark, ["a b　c\n", "", None], text.nonws_len) == [3, 0, None]
    assert col(spark, ["a\nb\n", "", None], text.line_count) == [3, 1, -1] or col(spark, ["a\nb\n", ""], text.line_count) == [3, 1]
    assert col(spark, ["  def f():", "x = 1", "@dec", "public:", "classic"], text.major_boundary) == [True, False, True, True, False]


def test_decode(spark):
    values = ["é".encode(), "é".encode("latin-1"), "﻿x".encode(), b"a\r\nb", b"", None]
    assert col(spark, values, text.decode, "binary") == ["é", "é", "x", "a\nb", "", None]
    assert col(spark, [b"x" * (text.MAX_CHARS + 1)], text.decode, "binary") == [None]


@pytest.mark.parametrize("lines", [["*.log", "build/", "!keep.log", "docs/*"], ["test?/[ab]*", "# x", ""], ["src"]])
def test_ignored(spark, lines):
    values = ["a.log", "x/a.log", "build/x", "keep.log", "docs/a/b", "test1/a", "a/test1/b", "src", "src/a", "tests/a"]
    keep = [x.strip() for x in lines if x.strip() and not x.startswith("#")]
    want = [any(fnmatch.fnmatchcase(v, p) or fnmatch.fnmatchcase(v.split("/")[-1], p) for p in keep) for v in values]
    assert col(spark, values, lambda c: paths.ignored(c, lines)) == want


def test_path_rules(spark):
    values = ["a/b.py", "Dockerfile", "x/Makefile.in", ".gitignore", "a.tar.gz", "README", "readme.md", "noext", ".env", "A.PY", "x/.b/c.ts"]
    assert col(spark, values, paths.file_type) == ["code", "config", "config", "unknown", "unknown", "document", "document", "unknown", "unknown", "code", "code"]
    assert col(spark, values, paths.admitted) == [True, True, False, False, False, True, True, False, False, True, True]
    assert col(spark, ["node_modules/x", "a/.git/x", "x/distribution/y", "dist", ".a"], paths.pruned) == [True, True, False, False, False]
    assert col(spark, ["./a\\b", "/x/y", "z"], paths.unify) == ["a/b", "x/y", "z"]


def test_urls(spark):
    import hashlib

    values = ["https://github.com/Ow/Re.git", "github.com/a/b#frag", " HTTP://GITHUB.COM/A/B/ ", "https://example.org/only", "https://www.github.com/a/b/c?x=1", None]
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()[:8]
    assert col(spark, values, urls.repository_identifier) == [f"github_ow_re_{h('ow/re')}", f"github_a_b_{h('a/b')}", f"github_a_b_{h('a/b')}", None, f"github_a_b_{h('a/b')}", None]
    assert col(spark, values, urls.valid) == [True, False, False, False, True, False]
    assert col(spark, values, urls.owner)[0] == "Ow" and col(spark, values, urls.name)[:2] == ["Re", "b"]
    assert col(spark, values, urls.looks_like) == [True, True, False, False, False, False]

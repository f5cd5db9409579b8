import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import splitting as s

RUNS = re.compile("[" + "".join(map(re.escape, map(chr, s.WHITE))) + "]+")


def size_of(t):
    return len(RUNS.sub("", t))


def check(texts, sizes, overlaps):
    t, a, b, c, f = s.split_batch(texts, np.array(sizes), np.array(overlaps))
    for i, x in enumerate(texts):
        on = t == i
        start, end, count, forced = a[on].tolist(), b[on].tolist(), c[on].tolist(), f[on]
        assert start[0] == 0 and end[-1] == len(x)
        over = size_of(x) > sizes[i]
        assert (len(start) > 1) == over
        assert bool(forced.any()) == (over and any(len(r) > sizes[i] for r in RUNS.split(x)))
        assert all(size_of(x[p:q]) == n <= sizes[i] for p, q, n in zip(start, end, count))
        assert all(p <= q and size_of(x[p:q]) <= overlaps[i] for p, q in zip(start[1:], end))
        assert all(p < q for p, q in zip(end, end[1:])) and all(p < q for p, q in zip(start, start[1:]))


TEXT = st.text(alphabet="abcde \n\t\r　\x85é中.{}", min_size=1, max_size=400)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(TEXT, st.integers(1, 50), st.integers(0, 49)), min_size=1, max_size=6))
def test_properties(cases):
    check([t for t, _, _ in cases], [n for _, n, _ in cases], [min(o, n - 1) for _, n, o in cases])


def test_natural_boundaries_come_first():
    text = "def a():\n    x = 1\n    y = 2\n\ndef b():\n    z = 3\n    w = 4\n\ndef c():\n    pass\n"
    t, a, b, *_ = s.split_batch([text], np.array([20]), np.array([0]))
    assert [text[p:q].split("\n")[0] for p, q in zip(a, b)] == ["def a():", "def b():", "def c():"]


def test_column(spark):
    settings_ = {"py": (10, 4), None: (20, 0)}
    rows = [(1, "word " * 10, "py"), (2, "word " * 3, None), (3, None, "py"), (4, "", "py"), (5, "x" * 45, "zz"), (1, "word " * 10, "py"), (6, "ab" * 60_000, "py"), (7, " \n" * 50, "py")]
    df = spark.createDataFrame([(k, c, l, 0, "e") for k, c, l in rows], "file_id long, content string, language string, piece_no int, size string")
    out = s.split_column(df, settings_, "file_id", "content", "language").dropDuplicates(["file_id", "piece_no"]).collect()
    by = {}
    for r in sorted(out, key=lambda r: (r["file_id"], r["piece_no"])):
        by.setdefault(r["file_id"], []).append(r)
    assert set(by) == {1, 5, 6} and any(r["forced"] for r in by[5]) and not any(r["forced"] for r in by[1])
    assert all(r["piece"] == dict((k, c) for k, c, _ in rows)[k][r["start"] : r["end"]] for k, rs in by.items() for r in rs)
    assert [r["piece_no"] for r in by[1]] == list(range(len(by[1])))
    assert s.split_column(df.limit(0), settings_, "file_id", "content", "language").count() == 0
    whole = s.split_column(df, settings_, "file_id", "content", "language", with_text=False, whole=True).select("file_id").distinct().count()
    assert whole == 5


def test_settings(spark):
    df = spark.createDataFrame([("a", 5, 1), (None, 7, None), ("b", None, 1)], "language string, chunk_size long, chunk_overlap long")
    assert s.read_settings(df) == {"a": (5, 1), None: (7, 0)}
    assert s.read_settings(df.limit(0)) == {None: (1000, 200)}


def test_texts_of_pieces_and_redactions_are_not_shuffled(spark, tmp_path):
    """Repeated rows are taken out by key and place before the texts are cut."""
    from tessera.llm import queries

    rows = [(1, "x " * 900, "python"), (1, "x " * 900, "python"), (2, "password = 'Tuldor5218!tullo'\n" + "y " * 900, None), (3, None, "go")]
    spark.createDataFrame([("python", 500, 50), (None, 600, 0)], "language string, chunk_size long, chunk_overlap long").coalesce(1).write.parquet(str(tmp_path / "parser_settings.parquet"))
    spark.createDataFrame(rows, "file_id long, content string, language string").repartition(8).write.parquet(str(tmp_path / "source_files.parquet"))
    pieces = queries.p3_pieces(spark, str(tmp_path))
    assert pieces.where("file_id = 1").count() == pieces.where("file_id = 1").select("piece_no").distinct().count()
    red = queries.p7_redacted(spark, str(tmp_path))
    assert [r["file_id"] for r in red.collect()] == [2]
    for df in (pieces, red):
        assert "Exchange hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()

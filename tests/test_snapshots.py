from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import snapshots

FILES = "snapshot_no int, delivered_at timestamp, repository_identifier string, file_path string, file_type string, file_size long, line_count long, content_hash string, extra string, kh string, bucket string"
REPOS = "snapshot_no int, delivered_at timestamp, repository_identifier string, repository_url string, total_files long, total_chunks long, last_commit_hash string"
T = [datetime(2024, 1, d) for d in range(1, 20)]


def f(no, t, repo, path, kind="code", size=1, lines=1, digest="a"):
    return (no, t, repo, path, kind, size, lines, digest, str(t), "x", "y")


def run(spark, files, repos=()):
    out = snapshots.repository_and_file_changes(spark.createDataFrame(list(repos), REPOS), spark.createDataFrame(list(files), FILES))
    assert out.columns == ["snapshot_no", "repository_identifier", "file_path", "change_kind"]
    return sorted(map(tuple, out.collect()))


def test_hash_equals_the_engines(spark):
    rows = [(i * 7919 - 5, i * 104729 + 3) for i in range(50)] + [(-(2**63), 2**63 - 1)]
    want = [r[0] for r in spark.createDataFrame(rows, "a long, b long").select(F.xxhash64("a", "b")).collect()]
    assert snapshots.xxhash64(np.array([r[0] for r in rows]), np.array([r[1] for r in rows])).tolist() == want


def test_kinds_gaps_corrections_and_returns(spark):
    files = [
        f(1, T[0], "R", "a"), f(1, T[0], "R", "b"), f(1, T[0], "R", "c", digest="X"),
        f(2, T[1], " r ", "a"), f(2, T[1], "R", "a"), f(2, T[1], "R", "c", digest="x"), f(2, T[9], "R", "d", digest="late"), f(2, T[2], "R", "d"),
        f(4, T[5], "R", "a", size=None), f(4, T[5], "R", "b"), f(4, T[5], "R", "d", digest="LATE"),
        f(5, T[6], "R", "a", size=None), f(5, T[6], "R", "b"), f(5, T[6], "R", "d", digest="LATE"),
    ]
    repos = [(1, T[0], "R", "u", 1, 1, "AB"), (2, T[1], "r", "u", 1, 1, "ab"), (3, T[2], "r", "u", None, 1, "ab")]
    assert run(spark, files, repos) == [
        (2, "r", "b", "removed"), (2, "r", "d", "added"), (3, "r", "", "changed"), (4, "r", "a", "changed"), (4, "r", "b", "added"), (4, "r", "c", "removed"),
    ]


def test_empty_single_and_null(spark):
    assert run(spark, []) == []
    assert run(spark, [f(1, T[0], "r", "a")]) == []
    assert run(spark, [f(None, T[0], "r", "a"), f(1, None, None, None), f(2, T[1], None, None), f(2, None, "r", "a", None, None, None, None)]) == [(2, "r", "a", "added")]


def test_large_differences_enlarge_the_tables(spark):
    """Every record changes, far beyond what the first cells hold; brute force agrees."""
    old = {f"p{i}": i for i in range(3000)}
    new = {f"p{i}": i + (i % 3 == 0) for i in range(1000, 4500)}
    files = [f(1, T[0], "r", p, size=v) for p, v in old.items()] + [f(2, T[1], "r", p, size=v) for p, v in new.items()]
    want = [(2, "r", p, "added") for p in new.keys() - old.keys()] + [(2, "r", p, "removed") for p in old.keys() - new.keys()] + [(2, "r", p, "changed") for p in old.keys() & new.keys() if old[p] != new[p]]
    assert run(spark, files) == sorted(want)


@pytest.mark.parametrize("cells", [1, 2])
def test_hopeless_tables_still_end_right(spark, cells):
    records = snapshots.latest(spark.createDataFrame([f(1, T[0], "r", str(i)) for i in range(40)] + [f(2, T[1], "r", str(i)) for i in range(20, 60)], FILES), "snapshot_no", "delivered_at", [F.col("file_path")], [F.col("file_size")], ["file_path"])
    got = snapshots.changes(records, ["file_path"], cells=cells).groupBy("change_kind").count().collect()
    assert {r[0]: r[1] for r in got} == {"added": 20, "removed": 20}

from datetime import datetime

from pyspark.sql import functions as F

from tessera.operators import catalog
from tessera.plans.engine import Config, parse_list

import pytest

T = [datetime(2024, 1, d) for d in range(1, 9)]


def test_fold_takes_the_latest_known(spark):
    rows = [("s", T[0], "pending", 5), ("s", T[2], None, 7), ("s", T[1], "processing", None), ("t", None, "x", None), (None, T[1], "x", 1)]
    got = {r[0]: tuple(r) for r in catalog.fold_sessions(spark.createDataFrame(rows, "session_id string, updated_at timestamp, status string, n long")).select("session_id", "status", "n").collect()}
    assert got == {"s": ("s", "processing", 7), "t": ("t", "x", None)}


def test_chunk_ids_are_contiguous(spark):
    rows = [(r, p, i) for r in ("a", "b", None) for p in ("y", "x", None) for i in range(3)]
    df = spark.createDataFrame(rows, "repository_identifier string, file_path string, local_idx long")
    out = catalog.assign_chunk_ids(df, existing=spark.createDataFrame([("a",)] * 4, "repository_identifier string")).collect()
    seqs = {}
    for r in out:
        seqs.setdefault(r["repository_identifier"], []).append((r["chunk_seq"], r["file_path"] or "", r["local_idx"]))
    assert len(out) == len(rows)
    assert [s for s, *_ in sorted(seqs["a"])] == list(range(4, 13)) and [s for s, *_ in sorted(seqs["b"])] == list(range(9)) and len(seqs[None]) == 9
    assert [x[1:] for x in sorted(seqs["b"])] == sorted(x[1:] for x in seqs["b"])
    assert {r["chunk_id"] for r in out if r["repository_identifier"] == "b"} == {f"chunk_repo_b_{i}" for i in range(9)}
    assert catalog.assign_chunk_ids(df.limit(0)).count() == 0


def test_resolve(spark):
    ident = catalog.urls.repository_identifier
    sessions = spark.createDataFrame([("s1", "u", "success", T[0]), ("s2", "u", "success", T[1]), ("s3", "u", "partial_success", T[2]), ("s4", "v", "success", None)], "session_id string, u string, status string, completed_at timestamp")
    sessions = sessions.withColumn("repository_identifier", ident(F.concat(F.lit("github.com/o/"), "u")))
    asked = spark.createDataFrame([("s1",), ("s3",), ("https://github.com/o/u.git",), ("github.com/o/v",), ("nonsense",), (None,), ("s1",)], "request string")
    got = {r["request"]: r["session_id"] for r in catalog.resolve_sessions(asked, sessions).collect()}
    assert got == {"s1": "s1", "s3": None, "https://github.com/o/u.git": "s2", "github.com/o/v": "s4", "nonsense": None}


def test_outcomes_and_progress(spark):
    df = spark.createDataFrame([("x", None), (" \n", None), (None, None), ("y", "boom")], "content string, error_message string")
    assert [r["outcome"] for r in catalog.file_outcomes(df).collect()] == ["success", "skipped", "skipped", "failed"]
    p = spark.createDataFrame([(0, 0), (4, 1), (None, None)], "t long, i long").select(catalog.progress(F.col("t"), F.col("i"))).collect()
    assert [r[0] for r in p] == [0.0, 25.0, 0.0]
    assert [catalog.final_status(*x) for x in ((False, False), (True, False), (True, True))] == ["failed", "partial_success", "success"]


def test_ingest_dedupe(spark):
    asked = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "repository_identifier string")
    have = spark.createDataFrame([("b",), (None,)], "repository_identifier string")
    assert [r[0] for r in catalog.not_yet_ingested(asked, have).collect()] == ["a"]


def test_config():
    assert parse_list('["a", " b "]') == ("a", "b") == parse_list("a, b ,")
    assert Config().updated(chunk_size="500", excluded_directories="x,y").excluded_directories == ("x", "y")
    with pytest.raises(ValueError):
        Config(chunk_size=100, chunk_overlap=100)
    with pytest.raises(KeyError):
        Config().updated(nope=1)

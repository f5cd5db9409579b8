import json
import subprocess
import time

import pytest
from pyspark.sql import functions as F

from tessera.plans import ingest as pipeline
from tessera.plans import models
from tessera.plans.engine import Config, Engine
from tessera.sources import clones
from tessera.sources import files as source
from tessera.streaming import requests

from .test_chunking import GO, PY


def make(root):
    for name, body in {
        "src/shapes.py": PY, "src/run.go": GO, "src/__init__.py": "X = 1\n", "docs/guide.md": "# Guide\n\nShapes have an area.\n", "node_modules/x/y.js": "x", ".git/config": "x", "a.log": "x", "pic.png": "x", "Makefile": "all:\n\techo\n",
        "requirements.txt": "a==1\n# no\n\nb\n", "Dockerfile": "from x\n# c\nrun y\nexpose 1\n", "package.json": '{"name": "n", "dependencies": {"a": "1"}}', ".gitignore": "*.log\n# c\nsecret/*\n", "secret/k.py": "x", "latin.txt": None,
    }.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes("é\r\n".encode("latin-1") if body is None else body.encode())
    return str(root)


def test_scan(spark, tmp_path):
    rows = {r["file_path"]: r for r in source.scan(spark, make(tmp_path / "r")).collect()}
    assert set(rows) == {"src/shapes.py", "src/run.go", "src/__init__.py", "docs/guide.md", "Makefile", "requirements.txt", "Dockerfile", "package.json", "latin.txt"}
    assert rows["latin.txt"]["content"] == "é\n" and rows["src/shapes.py"]["language"] == "python" and rows["Makefile"]["file_type"] == "config"


def test_special(spark):
    rows = [("x/requirements.txt", "a==1\n# no\n\n b \n"), ("Dockerfile.dev", "from x\n# c\n run y\nexpose 1"), ("package.json", '{"name": "n", "scripts": {"t": "1"}}'), ("package.json", "[broken"), ("pyproject.toml", ""), ("o", "")]
    df = spark.createDataFrame(rows, "p string, c string")
    got = [tuple(r) for r in df.select(source.special_kind(F.col("p"), F.col("c")), source.special_lines(F.col("p"), F.col("c")), source.package_field(F.col("c"), "name"), source.package_field(F.col("c"), "scripts")).collect()]
    assert [g[0] for g in got] == ["requirements", "dockerfile", "package_json", "unknown", "pyproject_toml", "unknown"]
    assert got[0][1] == ["a==1", "b"] and got[1][1] == ["FROM X", "RUN Y"] and got[2][2] == "n" and json.loads(got[2][3]) == {"t": "1"} and got[3][2] is None


def test_ingest_search_and_delete(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "w"))
    root = make(tmp_path / "r")
    first = engine.ingest(root, "repo")
    assert first.status == "success" and first.files == 9 and first.chunks >= 9
    assert engine.ingest(root, "repo").chunks == 0 and engine.chunks("repo").count() == first.chunks
    assert sorted(r[0] for r in engine.chunks("repo").select("chunk_seq").collect()) == list(range(first.chunks))
    best = engine.search("repo", "where is shapes.py").collect()
    assert best[0]["file_path"] == "src/shapes.py" or any(r["file_path"] == "src/shapes.py" for r in best[:3])
    assert "where is shapes.py" in engine.prompt("repo", "where is shapes.py")
    assert [tuple(r) for r in engine.collections().collect()] == [("repo", first.chunks)]
    assert engine.session(first.session_id)["status"] == "success"
    engine.clear_cache()
    assert engine.ingest(str(tmp_path / "absent"), "gone").status == "failed"
    assert engine.chunks("gone").count() == 0


def test_stream_of_requests(spark, tmp_path):
    root = make(tmp_path / "r")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(x) for x in ({"root": root, "repository": "one"}, {"root": root, "repository": "one"}, {"root": None, "repository": "two"})))
    q = requests.drain(spark, str(tmp_path / "in"), str(tmp_path / "w"), str(tmp_path / "c"))
    q.awaitTermination(120)
    assert {r[0] for r in spark.read.parquet(str(tmp_path / "w" / "chunks")).select("repository_identifier").collect()} == {"one"}


class Echo:
    def generate(self, prompt):
        return f"answer of {len(prompt)} characters"


class Broken:
    def generate(self, prompt):
        raise RuntimeError("model is away")


def test_books_of_an_ingest(spark, tmp_path):
    seen = []
    engine = Engine(spark, str(tmp_path / "w"), config=Config(chunk_size=60, chunk_overlap=5, embedding_batch_size=3, excluded_directories=("docs", "node_modules")))
    root = make(tmp_path / "r")
    (tmp_path / "r" / "blank.md").write_text(" \n")
    (tmp_path / "r" / "long.md").write_text("# Long\n\n" + "A sentence of words. " * 40)
    out = engine.ingest(root, "repo", report=lambda stage, percent: seen.append((stage, percent)))
    assert seen == [(k, v) for k, v in pipeline.STAGES.items()] and out.status == "success"
    files = {r["file_path"]: r for r in engine.books.files(out.session_id).collect()}
    assert "docs/guide.md" not in files and files["blank.md"]["is_processed"] == "skipped" and files["long.md"]["chunk_count"] > 12
    assert json.loads(files["requirements.txt"]["dependencies"]) == ["a==1", "b"] and json.loads(files["package.json"]["dependencies"]) == {"a": "1"}
    state = engine.session(out.session_id)
    assert state["status"] == "success" and state["total_files"] == len(files) and state["processed_files"] == len(files) - 1 and state["total_chunks"] == out.chunks == state["indexed_chunks"]
    assert state["progress_percentage"] == 100.0 and state["processing_duration"] > 0 and json.loads(state["embedding_config"])["batch_size"] == 3
    # replacing keeps other collections, and numbers start anew
    engine.ingest(root, "other")
    (tmp_path / "r" / "long.md").unlink()
    again = engine.ingest(root, "repo", replace=True)
    assert again.chunks < out.chunks and {r[0]: r[1] for r in engine.collections().collect()} == {"repo": again.chunks, "other": out.chunks}
    assert sorted(r[0] for r in engine.chunks("repo").select("chunk_seq").collect()) == list(range(again.chunks))
    assert engine.health()["collections"] == ["other", "repo"] and engine.health()["status"] == "healthy"
    with pytest.raises(LookupError):
        engine.session("none")


def test_late_failures_leave_a_part(spark, tmp_path):
    class Dead:
        size = 4

        def embed(self, texts):
            raise RuntimeError("invalid api key")

    engine = Engine(spark, str(tmp_path / "w"), Dead())
    out = engine.ingest(make(tmp_path / "r"), "repo")
    assert out.status == "partial_success" and "api key" in out.error and engine.session(out.session_id)["indexed_chunks"] is None
    assert engine.ingest(str(tmp_path / "absent"), "gone").status == "failed" and engine.health()["collections"] == []
    assert engine.books.sessions().count() == 2


def test_questions_are_answered_and_logged(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "w"), generator=Echo())
    out = engine.ingest(make(tmp_path / "r"), "repo")
    found = engine.query(out.session_id, "where is shapes.py")
    assert found.status == "success" and found.answer.startswith("answer of") and found.passages[0]["rank"] == 1
    assert engine.query(out.session_id, "where is shapes.py", "plugin").status == "retrieved"
    assert engine.query("nobody", "q").status == "not_found"
    engine.generator = Broken()
    broken = engine.query(out.session_id, "q")
    assert broken.status == "failed" and broken.answer is None and broken.error == "model is away"
    log = {r["query_id"]: r for r in engine.books.query_log().collect()}
    assert len(log) == 4 and log[found.query_id]["retrieved_chunks_count"] == len(found.passages) and log[broken.query_id]["error_message"] == "model is away"
    assert engine.query_info(found.query_id)["answer"] == found.answer
    engine.provider.embed = lambda texts: 1 / 0  # the other leg goes on alone
    assert engine.search("repo", "where is shapes.py").count() > 0


def test_jobs(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "w"), generator=Echo(), workers=1)
    root = make(tmp_path / "r")
    first, second = engine.start(root, "repo"), engine.start(root, "later")
    assert engine.cancel(second) and engine.job(second)["state"] == "cancelled" and engine.session(second)["status"] == "cancelled"
    assert engine.result(first, 120).status == "success" and engine.job(first) == {"id": first, "state": "success", "error": None} and not engine.cancel(first)
    asked = engine.ask(first, "where is shapes.py")
    assert engine.result(asked, 120).status == "success" and engine.queue() == {"pending": 0, "running": 0, "success": 2, "failed": 0, "cancelled": 1}


def test_a_running_job_is_stopped(spark, tmp_path):
    class Slow:
        size = 2

        def embed(self, texts):
            import time

            time.sleep(60)

    engine = Engine(spark, str(tmp_path / "w"), Slow())
    session = engine.start(make(tmp_path / "r"), "repo")
    until = time.time() + 90
    while engine.session(session)["total_files"] is None and time.time() < until:
        time.sleep(0.5)
    while not engine.jobs[session].done() and time.time() < until:
        engine.cancel(session)
        time.sleep(0.5)
    assert engine.result(session, 30).status == "cancelled" and engine.session(session)["status"] == "cancelled"


def test_clones(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b.c", *a], cwd=tmp_path / "o.git", check=True, capture_output=True)
    (tmp_path / "o.git").mkdir()
    git("init", "-q")
    (tmp_path / "o.git" / "a.py").write_text("X = 1\n")
    git("add", "."), git("commit", "-qm", "one")
    path = clones.clone(f"file://{tmp_path}/o.git", str(tmp_path / "c"), "one")
    assert clones.is_clone(path) and clones.head(path)["subject"] == "one" and clones.clones(str(tmp_path / "c")) == ["one"]
    (tmp_path / "o.git" / "b.py").write_text("Y = 1\n")
    git("add", "."), git("commit", "-qm", "two")
    assert clones.head(clones.clone(f"file://{tmp_path}/o.git", str(tmp_path / "c"), "one"))["subject"] == "one"
    assert clones.pull(path) and not clones.pull(path) and clones.head(path)["subject"] == "two"
    with pytest.raises(clones.CloneError):
        clones.clone(f"file://{tmp_path}/none.git", str(tmp_path / "c"), "two")
    assert clones.clones(str(tmp_path / "c")) == ["one"] and clones.remove(str(tmp_path / "c"), "one") and not clones.remove(str(tmp_path / "c"), "../o.git")
    out = Engine(spark, str(tmp_path / "w")).ingest(f"file://{tmp_path}/o.git", "repo")
    assert out.status == "success" and out.files == 2


def test_model_settings():
    s = models.ModelSettings("HF", "m").checked(models.EMBEDDING_PROVIDERS)
    assert s.provider == "huggingface" and models.ModelSettings("qwen", "m", batch_size=64).checked(models.EMBEDDING_PROVIDERS).batch_size == 10
    assert models.ModelSettings("azure", "m", "k", "https://x").checked(models.GENERATION_PROVIDERS).api_version == "2024-02-01" and "k" not in str(models.ModelSettings("openai", "m", "k").public())
    for bad in (models.ModelSettings("nobody", "m"), models.ModelSettings("openai", ""), models.ModelSettings("azure", "m")):
        with pytest.raises(ValueError):
            bad.checked(models.EMBEDDING_PROVIDERS)
    assert len(models.embedders.create(models.ModelSettings("hashing", "words", extra={"size": 8})).embed(["a b"])[0]) == 8
    with pytest.raises(LookupError):
        models.generators.create(models.ModelSettings("openai", "m"))
    models.generators.register("local", lambda s: Echo())
    assert models.generators.create(models.ModelSettings("local", "m")).generate("abc") == "answer of 3 characters" and "local" in models.generators.available()

"""The Python API: ingest, search, sessions, collections and configuration."""

from __future__ import annotations

import json
import shutil
import time
import uuid
from collections import Counter
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, fields, replace

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import catalog, fusion, lexical, vector
from ..sources import clones
from . import ingest as pipeline
from . import models, tables


@dataclass(frozen=True)
class Config:
    chunk_size: int = 1000
    chunk_overlap: int = 200
    embedding_batch_size: int = 32
    vector_top_k: int = 10
    bm25_top_k: int = 10
    final_top_k: int = 10
    excluded_directories: tuple[str, ...] = (".git", "node_modules", "dist", "build", "venv", ".venv", "target")

    def __post_init__(self):
        for name in ("chunk_size", "embedding_batch_size", "vector_top_k", "bm25_top_k", "final_top_k"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_overlap must be below chunk_size")

    def updated(self, **values: str | int) -> "Config":
        """A checked copy; lists may be JSON or separated by commas, numbers may be text."""
        known = {f.name for f in fields(self)}
        if extra := set(values) - known:
            raise KeyError(f"unknown settings: {sorted(extra)}")
        return replace(self, **{k: parse_list(v) if k == "excluded_directories" else int(v) for k, v in values.items()})


def parse_list(value: str | list[str] | tuple[str, ...]) -> tuple[str, ...]:
    if not isinstance(value, str):
        return tuple(value)
    try:
        parsed = json.loads(value)
    except ValueError:
        parsed = value.split(",")
    return tuple(s for x in (parsed if isinstance(parsed, list) else [parsed]) if (s := str(x).strip()))


@dataclass
class Answer:
    """``status``: success, retrieved (no answer was asked for), failed (see ``error``) or not_found."""

    query_id: str
    question: str
    status: str
    answer: str | None = None
    error: str | None = None
    session_id: str | None = None
    passages: list[dict] | None = None
    retrieval_ms: int = 0
    generation_ms: int = 0
    total_ms: int = 0


class Engine:
    """Ingest and query jobs run on threads of their own, each in a job group by which it can be stopped."""

    def __init__(self, spark: SparkSession, warehouse: str, provider: vector.EmbeddingProvider | None = None, config: Config = Config(), generator: models.Generator | None = None, workers: int = 4):
        self.spark, self.warehouse, self.config = spark, warehouse.rstrip("/"), config
        self.provider, self.generator = provider or vector.HashingEmbedder(), generator
        self.books = tables.Books(spark, self.warehouse)
        self.pool = ThreadPoolExecutor(workers)
        self.jobs: dict[str, Future] = {}
        self._index: dict[str, lexical.Index] = {}

    # -- ingest -------------------------------------------------------------

    def ingest(self, root: str, repository: str | None = None, replace: bool = False, report: Callable[[str, int], None] = lambda stage, percent: None, session_id: str | None = None) -> pipeline.Outcome:
        """From a folder, or from the address of a repository, which is cloned first."""
        session, url, c = session_id or str(uuid.uuid4()), None, self.config
        if "://" in root and not root.startswith("file:") or root.endswith(".git"):
            url = root
            repository = repository or self.spark.range(1).select(urls.repository_identifier(F.lit(url))).first()[0]
            try:
                root = clones.clone(url, f"{self.warehouse.removeprefix('file://')}/clones", repository or "repository")
            except (clones.CloneError, ValueError) as e:
                self.books.session_event(session, status="failed", repository_url=url, repository_identifier=repository, error_message=str(e), created_at=tables.now(), completed_at=tables.now())
                return pipeline.Outcome(session, repository, "failed", error=str(e))
        if not repository:
            raise ValueError("a folder needs the name of its repository")
        self.spark.sparkContext.setJobGroup(f"job-{session}", f"ingest of {repository}", interruptOnCancel=True)
        try:
            return pipeline.ingest(self.spark, root, repository, self.warehouse, self.provider, report, session, url, replace, c.chunk_size, c.chunk_overlap, c.embedding_batch_size, c.excluded_directories)
        finally:
            self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
            self.clear_cache(repository)

    def start(self, root: str, repository: str | None = None, replace: bool = False) -> str:
        """Queue an ingest; its session's id."""
        session = str(uuid.uuid4())
        self.books.session_event(session, status="pending", repository_identifier=repository, created_at=tables.now())
        self.jobs[session] = self.pool.submit(inheritable_thread_target(self.spark)(self.ingest), root, repository, replace, session_id=session)
        return session

    def session(self, session_id: str) -> dict:
        """The present state of a session; an unknown one is a LookupError."""
        row = self.books.sessions().where(F.col("session_id") == session_id).first()
        if row is None:
            raise LookupError(session_id)
        return row.asDict()

    def cancel(self, job_id: str) -> bool:
        """Stop a queued or running job; false if it has ended or is unknown."""
        job = self.jobs.get(job_id)
        if job is None or job.done():
            return False
        if job.cancel():
            if self.books.sessions().where(F.col("session_id") == job_id).count():
                self.books.session_event(job_id, status="cancelled", completed_at=tables.now())
        else:
            self.spark.sparkContext.cancelJobGroup(f"job-{job_id}")
        return True

    def job(self, job_id: str) -> dict:
        """State of a queued job: pending, running, success, failed or cancelled; with its error, if any."""
        job = self.jobs[job_id]
        if not job.done():
            return {"id": job_id, "state": "running" if job.running() else "pending", "error": None}
        if job.cancelled():
            return {"id": job_id, "state": "cancelled", "error": None}
        error = job.exception()
        return {"id": job_id, "state": "failed" if error else "success", "error": str(error) if error else None}

    def result(self, job_id: str, timeout: float | None = None):
        """What a job returned, waiting for it."""
        return self.jobs[job_id].result(timeout)

    def queue(self) -> dict[str, int]:
        """Numbers of jobs by state."""
        states = Counter(self.job(j)["state"] for j in self.jobs)
        return {s: states.get(s, 0) for s in ("pending", "running", "success", "failed", "cancelled")}

    # -- collections ----------------------------------------------------------

    def chunks(self, repository: str | None = None) -> DataFrame:
        df = pipeline.existing(self.spark, f"{self.warehouse}/chunks")
        if df is None:
            raise LookupError("nothing is ingested yet")
        return df if repository is None else df.where(F.col("repository_identifier") == repository)

    def collections(self) -> DataFrame:
        return catalog.collection_stats(self.chunks())

    def health(self, names: int = 5) -> dict:
        """Whether the warehouse answers, and the first names of its collections."""
        try:
            df = pipeline.existing(self.spark, f"{self.warehouse}/chunks")
            found = [] if df is None else [r[0] for r in df.select("repository_identifier").distinct().orderBy("repository_identifier").limit(names).collect()]
            return {"status": "healthy", "version": self.spark.version, "collections": found}
        except Exception as e:
            return {"status": "unhealthy", "error": str(e)}

    def delete(self, repository: str) -> None:
        """Drop a collection's partition."""
        self.clear_cache(repository)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.warehouse}/chunks/repository_identifier={tables.escaped(repository)}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def clear_cache(self, repository: str | None = None) -> None:
        for key in [repository] if repository else list(self._index):
            if key in self._index:
                self._index.pop(key).clear()

    # -- questions --------------------------------------------------------------

    def search(self, repository: str, question: str) -> DataFrame:
        """(rank, chunk_seq, file_path, start_line, content, score) of the best passages; where the embedder fails, of the lexical list alone."""
        chunks = self.chunks(repository)
        if repository not in self._index:
            self._index[repository] = lexical.build(chunks)
        try:
            vectors = vector.with_retry(self.provider.embed, [question], retries=1, delay=0.1)[0]
        except vector.EmbeddingError:
            vectors = None
        asked = self.spark.createDataFrame([(0, question, vectors)], "query_id long, question string, query_vector array<float>")
        c = self.config
        best = fusion.hybrid(chunks, asked, self._index[repository], c.vector_top_k, c.bm25_top_k, c.final_top_k)
        return best.join(chunks, best.chunk == chunks.chunk_seq).select("rank", "chunk_seq", "file_path", "start_line", "content", F.col("rrf").alias("score")).orderBy("rank")

    def prompt(self, repository: str, question: str) -> str:
        return self._prompt(self.search(repository, question), question)

    def _prompt(self, found: DataFrame, question: str) -> str:
        row = found.agg(fusion.context(F.col("rank"), F.col("file_path"), F.col("content"), F.col("start_line")).alias("c")).select(fusion.prompt(F.lit(question), F.coalesce("c", F.lit("")))).first()
        return row[0]

    def resolve(self, request: str) -> tuple[str, str] | None:
        """(session id, repository) that a session's id or a repository's address means, of successful sessions."""
        row = catalog.resolve_sessions(self.spark.createDataFrame([(request,)], "request string"), self.books.sessions()).first()
        return (row["session_id"], row["repository_identifier"]) if row and row["session_id"] else None

    def query(self, request: str, question: str, mode: str = "service", query_id: str | None = None) -> Answer:
        """Passages for a question and, in mode ``service``, the generator's answer; every query is logged.

        A failing generator gives status ``failed`` and its error, never an error
        in place of an answer; any other mode only retrieves.
        """
        out = Answer(query_id or str(uuid.uuid4()), question, "not_found")
        self.spark.sparkContext.setJobGroup(f"job-{out.query_id}", "query", interruptOnCancel=True)
        begun = time.monotonic()
        meant = self.resolve(request)
        if meant is None:
            out.error = "no successful session"
        else:
            out.session_id = meant[0]
            try:
                found = self.spark.createDataFrame(self.search(meant[1], question).collect(), "rank int, chunk_seq long, file_path string, start_line long, content string, score double")  # at most final_top_k rows
                out.passages = [r.asDict() for r in found.orderBy("rank").collect()]
                out.status, out.retrieval_ms = "retrieved", round((time.monotonic() - begun) * 1000)
                if mode == "service":
                    if self.generator is None:
                        raise LookupError("no generator is set")
                    asked = time.monotonic()
                    out.answer = self.generator.generate(self._prompt(found, question))
                    out.status, out.generation_ms = "success", round((time.monotonic() - asked) * 1000)
            except Exception as e:
                out.status, out.error = "failed", str(e)
        self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        out.total_ms = round((time.monotonic() - begun) * 1000)
        self.books.log_query(
            query_id=out.query_id, session_id=out.session_id, question=question, answer=out.answer, status=out.status, error_message=out.error, retrieved_chunks_count=len(out.passages or []),
            generation_mode=mode, retrieval_time=out.retrieval_ms, generation_time=out.generation_ms, total_time=out.total_ms,
        )
        return out

    def ask(self, request: str, question: str, mode: str = "service") -> str:
        """Queue a query; its id, for ``job``, ``result`` and ``query_info``."""
        query_id = str(uuid.uuid4())
        self.jobs[query_id] = self.pool.submit(inheritable_thread_target(self.spark)(self.query), request, question, mode, query_id)
        return query_id

    def query_info(self, query_id: str) -> dict:
        """The logged row of a query; an unknown one is a LookupError."""
        row = self.books.query_log().where(F.col("query_id") == query_id).first()
        if row is None:
            raise LookupError(query_id)
        return row.asDict()


def remove_warehouse(path: str) -> None:
    shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)

"""The ingest pipeline: scan, clean, chunk, number, embed, append, and keep the books."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import catalog, chunking, vector
from ..session import cut
from ..sources import files as source
from . import tables

#: Progress reported after each stage, in per cent.
STAGES = {"configured": 5, "checked": 10, "located": 15, "scanned": 20, "chunked": 35, "embedded": 70, "stored": 95, "done": 100}


@dataclass
class Outcome:
    session_id: str
    repository_identifier: str
    status: str
    files: int = 0
    chunks: int = 0
    error: str | None = None


def cleaned(files: DataFrame) -> DataFrame:
    """Files with cleaned text and the route their type and size ask for."""
    return files.withColumn("content", text.clean(F.col("content"))).withColumn("_route", paths.syntax_route(F.col("file_path"), F.col("file_size")))


def chunked(files: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Cleaned and chunked files; each by its route, text by these sizes."""
    return chunking.chunk_files(cleaned(files), route="_route", size=size, overlap=overlap)


def outcomes(files: DataFrame, chunks: DataFrame, session_id: str, repository: str) -> DataFrame:
    """A row for every admitted file: success with its number of chunks, skipped without text, failed if text gave no chunk."""
    counts = chunks.groupBy("file_path").agg(F.count("*").alias("chunk_count"))
    content = F.col("content")
    empty = content.isNull() | (F.regexp_replace(content, r"(?U)\s", "") == "")
    kind = source.special_kind(F.col("file_path"), content)
    depends = F.when(kind == "package_json", source.package_field(content, "dependencies")).when(kind == "requirements", F.to_json(source.special_lines(F.col("file_path"), content)))
    n = F.coalesce("chunk_count", F.lit(0).cast("long"))
    rows = files.join(counts, "file_path", "left")
    return rows.select(
        F.lit(session_id).alias("session_id"),
        F.lit(repository).alias("repository_identifier"),
        *["file_path", "file_type", "file_extension", "language", "file_size"],
        F.when(~empty, text.line_count(content)).cast("long").alias("line_count"),
        depends.alias("dependencies"),
        F.when(empty, "skipped").when(n == 0, "failed").otherwise("success").alias("is_processed"),
        n.alias("chunk_count"),
        F.when(content.isNull(), "no text, or too large").when(~empty & (n == 0), "no chunk").alias("error_message"),
        F.lit(tables.now()).alias("created_at"),
    )


def ingest(
    spark: SparkSession,
    root: str,
    repository: str,
    warehouse: str,
    provider: vector.EmbeddingProvider,
    report: Callable[[str, int], None] = lambda stage, percent: None,
    session_id: str | None = None,
    url: str | None = None,
    replace: bool = False,
    chunk_size: int = 1000,
    chunk_overlap: int = 200,
    batch_size: int = 32,
    excluded: tuple[str, ...] | list[str] = tuple(paths.EXCLUDED),
) -> Outcome:
    """Add a repository's chunks to ``warehouse``/chunks; nothing is done if it has some already, unless they are to be replaced.

    Chunks are written aside and moved into place as one partition, so that a
    failed run leaves no empty collection behind and none half replaced.  What fails before the chunks are numbered
    fails the run; what fails while they are embedded or stored leaves it done in
    part.  Every step is an event of the session, every file has its outcome.
    """
    session = session_id or str(uuid.uuid4())
    books = tables.Books(spark, warehouse)
    table = f"{warehouse}/chunks"
    config = json.dumps({"provider": type(provider).__name__, "batch_size": batch_size})
    books.session_event(session, status="processing", repository_url=url, repository_identifier=repository, embedding_config=config, created_at=tables.now(), started_at=tables.now())
    report("configured", STAGES["configured"])

    def ended(status: str, files: int = 0, chunks: int = 0, error: str | None = None, **stats) -> Outcome:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)  # how it ended is written even if the run is stopped
        books.session_event(session, status=status, error_message=error, completed_at=tables.now(), **stats)
        return Outcome(session, repository, status, files, chunks, error)

    try:
        stored = existing(spark, table)
        report("checked", STAGES["checked"])
        if not replace and stored is not None and not stored.where(F.col("repository_identifier") == repository).isEmpty():
            return ended("success")
        report("located", STAGES["located"])
        files = cut(cleaned(source.scan(spark, root, excluded=list(excluded))))  # read, decoded and cleaned once
        report("scanned", STAGES["scanned"])
        chunks = cut(chunking.chunk_files(files, route="_route", size=chunk_size, overlap=chunk_overlap).withColumn("repository_identifier", F.lit(repository)))
        numbered = catalog.assign_chunk_ids(chunks)
        rows = cut(outcomes(files, chunks, session, repository))
        stats = catalog.session_stats(rows).first()
        total = dict(total_files=stats["total_files"], processed_files=stats["processed_files"], total_chunks=stats["total_chunks"]) if stats else dict(total_files=0, processed_files=0, total_chunks=0)
        books.add_files(rows)
        books.session_event(session, **total)
        report("chunked", STAGES["chunked"])
    except Exception as e:
        return ended("cancelled" if cancelled(e) else "failed", error=str(e))
    try:
        embedded = vector.embed(numbered, provider, batch=batch_size).drop("repository_identifier")
        tables.put(embedded, f"{table}/repository_identifier={tables.escaped(repository)}", f"{warehouse}/_staging/{session}")
        report("embedded", STAGES["embedded"])
        report("stored", STAGES["stored"])
    except Exception as e:
        return ended("cancelled" if cancelled(e) else catalog.final_status(True, False), total["processed_files"], 0, str(e))
    out = ended(catalog.final_status(True, True), total["processed_files"], total["total_chunks"], indexed_chunks=total["total_chunks"])
    report("done", STAGES["done"])
    return out


def cancelled(e: Exception) -> bool:
    return "OPERATION_CANCELED" in str(e) or "cancelled" in str(e).lower()


def existing(spark: SparkSession, table: str) -> DataFrame | None:
    try:
        return spark.read.parquet(table).withColumn("repository_identifier", F.col("repository_identifier").cast("string"))
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise

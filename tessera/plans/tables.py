"""Append-only tables of a warehouse: session events, file outcomes and the query log.

Rows are only ever added.  A session's present state is the fold of its events
(latest known value of each column), so that writers never wait for each other
and a lost writer leaves no half-changed row.  Every write has a folder of its
own below the table's, as two jobs cannot write into one folder at a time.
"""

from __future__ import annotations

import re
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog

SESSIONS = (
    "session_id string, task_id string, repository_url string, repository_name string, repository_owner string, repository_identifier string, status string, error_message string, total_files long, processed_files long, "
    "total_chunks long, indexed_chunks long, embedding_config string, created_at timestamp, started_at timestamp, completed_at timestamp, updated_at timestamp"
)
FILES = "session_id string, repository_identifier string, file_path string, file_type string, file_extension string, language string, file_size long, line_count long, dependencies string, is_processed string, chunk_count long, error_message string, created_at timestamp"
QUERY_LOG = "query_id string, session_id string, question string, answer string, status string, error_message string, retrieved_chunks_count long, generation_mode string, llm_config string, retrieval_time long, generation_time long, total_time long, created_at timestamp"


def now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, without rows while nothing was written."""
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def append(spark: SparkSession, path: str, schema: str, **values) -> None:
    """One row; columns not named are null, unknown ones an error."""
    names = [c.split()[0] for c in schema.split(", ")]
    if extra := set(values) - set(names):
        raise KeyError(f"no such columns: {sorted(extra)}")
    spark.createDataFrame([tuple(values.get(n) for n in names)], schema).coalesce(1).write.parquet(f"{path}/{uuid.uuid4()}")


def escaped(name: str) -> str:
    """A value as it stands in the name of a partition's folder."""
    return re.sub(r"[\x00-\x1f\x7f\"#%'*/:=?\\{}\[\]^]", lambda m: f"%{ord(m[0]):02X}", name)


def put(df: DataFrame, path: str, staging: str) -> None:
    """Store the rows as a folder that appears, or takes the place of what is there, only when it is whole."""
    df.write.mode("overwrite").parquet(staging)
    jvm = df.sparkSession._jvm.org.apache.hadoop.fs
    source, target = jvm.Path(staging), jvm.Path(path)
    fs = source.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    fs.delete(target, True)
    if not fs.rename(source, target):
        raise OSError(f"{path} was not stored")


class Books:
    """The bookkeeping of one warehouse."""

    def __init__(self, spark: SparkSession, warehouse: str):
        self.spark, self.warehouse = spark, warehouse.rstrip("/")

    def session_event(self, session_id: str, **values) -> None:
        append(self.spark, f"{self.warehouse}/session_events", SESSIONS, session_id=session_id, updated_at=now(), **values)

    def sessions(self) -> DataFrame:
        """One row per session with its progress in per cent and duration in seconds."""
        folded = catalog.fold_sessions(read(self.spark, f"{self.warehouse}/session_events", SESSIONS))
        return folded.withColumn("progress_percentage", catalog.progress(F.col("total_chunks"), F.col("indexed_chunks"))).withColumn("processing_duration", catalog.duration(F.col("started_at"), F.col("completed_at")))

    def add_files(self, outcomes: DataFrame) -> None:
        """All outcomes of a run in one atomic write."""
        columns = [c.split()[0] for c in FILES.split(", ")]
        outcomes.select(*columns).write.parquet(f"{self.warehouse}/files/{uuid.uuid4()}")

    def files(self, session_id: str | None = None) -> DataFrame:
        df = read(self.spark, f"{self.warehouse}/files", FILES)
        return df if session_id is None else df.where(F.col("session_id") == session_id)

    def log_query(self, **values) -> None:
        append(self.spark, f"{self.warehouse}/query_log", QUERY_LOG, created_at=now(), **values)

    def query_log(self) -> DataFrame:
        return read(self.spark, f"{self.warehouse}/query_log", QUERY_LOG)

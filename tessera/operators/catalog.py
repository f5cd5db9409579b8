"""Sessions, files and collections: bookkeeping as folds and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..session import cut

STATUSES = ["pending", "processing", "success", "failed", "cancelled", "partial_success"]
FINAL = ["success", "failed", "cancelled", "partial_success"]


def fold_sessions(events: DataFrame, key: str = "session_id", time: str = "updated_at") -> DataFrame:
    """One row per session: each column's latest non-null value, in order of ``time``."""
    rest = [c for c in events.columns if c not in (key, time)]
    # the greatest (time, value) pair among non-null values: partial on the map side, no window
    picks = [F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(time), F.col(c))))[c].alias(c) for c in rest]
    return events.where(F.col(key).isNotNull()).groupBy(key).agg(*picks, F.max(time).alias(time))


def progress(total: Column, indexed: Column) -> Column:
    return F.when(F.coalesce(total, F.lit(0)) == 0, 0.0).otherwise(F.coalesce(indexed, F.lit(0)) / total * 100.0)


def duration(started: Column, completed: Column) -> Column:
    """Seconds, null while either end is missing."""
    return F.unix_micros(completed) / 1e6 - F.unix_micros(started) / 1e6


def session_stats(files: DataFrame, key: str = "session_id") -> DataFrame:
    """Roll-up of a session's files by outcome."""
    done = F.col("is_processed") == "success"
    return files.groupBy(key).agg(
        F.count("*").alias("total_files"),
        F.count(F.when(done, 1)).alias("processed_files"),
        F.count(F.when(F.col("is_processed") == "failed", 1)).alias("failed_files"),
        F.count(F.when(F.col("is_processed") == "skipped", 1)).alias("skipped_files"),
        F.coalesce(F.sum(F.when(done, F.col("chunk_count"))), F.lit(0)).alias("total_chunks"),
    )


def file_outcomes(files: DataFrame, content: str = "content", chunks: str = "chunk_count") -> DataFrame:
    """Adds ``outcome``: an error counts as failed, no text as skipped, else success."""
    empty = F.col(content).isNull() | (F.regexp_replace(content, r"(?U)\s", "") == "")
    return files.withColumn("outcome", F.when(F.col("error_message").isNotNull(), "failed").when(empty, "skipped").otherwise("success"))


def final_status(collected: bool, stored: bool) -> str:
    """What a run ends with: early failures fail it, later ones leave it in part."""
    return "failed" if not collected else "success" if stored else "partial_success"


def resolve_sessions(requests: DataFrame, sessions: DataFrame, request: str = "request") -> DataFrame:
    """The session each request means: a successful session by id, else the latest of that repository's address.

    Adds session_id and repository_identifier, null where nothing matches; ties
    by completion time, then by the greater id.
    """
    ok = sessions.where(F.col("status") == "success")
    wanted = requests.select(request).where(F.col(request).isNotNull()).distinct()
    by_id = wanted.join(ok.select("session_id", "repository_identifier"), F.col(request) == F.col("session_id")).groupBy(request).agg(F.max("session_id").alias("session_id"), F.max("repository_identifier").alias("repository_identifier"))
    latest = ok.where(F.col("repository_identifier").isNotNull()).groupBy("repository_identifier").agg(F.max(F.struct("completed_at", "session_id"))["session_id"].alias("session_id"))
    like = wanted.join(by_id, request, "left_anti").where(urls.looks_like(F.col(request))).withColumn("repository_identifier", urls.repository_identifier(F.col(request)))
    by_url = like.join(latest, "repository_identifier").select(request, "session_id", "repository_identifier")
    return wanted.join(by_id.unionByName(by_url), request, "left")


def not_yet_ingested(requests: DataFrame, chunks: DataFrame, key: str = "repository_identifier") -> DataFrame:
    """Requests whose repository has no chunk yet, each once."""
    return requests.where(F.col(key).isNotNull()).dropDuplicates([key]).join(chunks.select(key).distinct(), key, "left_anti")


def collection_stats(chunks: DataFrame, key: str = "repository_identifier") -> DataFrame:
    return chunks.groupBy(key).agg(F.count("*").alias("chunks"))


def assign_chunk_ids(chunks: DataFrame, existing: DataFrame | None = None, collection: str = "repository_identifier", order: tuple[str, ...] = ("file_path", "local_idx")) -> DataFrame:
    """Adds chunk_seq, contiguous from the collection's present size, and chunk_id.

    Neither the chunks nor the files of a hot collection are sorted in one task:
    rows are counted per file, the files are cut into ranges of (collection,
    file), sums run on within each range, and the ranges' sums - one row for
    each range and collection in it - run on over the ranges.
    """
    first, rest = order[0], list(order[1:])
    files = chunks.groupBy(collection, first).agg(F.count("*").alias("_n")).repartitionByRange(collection, first)
    files = cut(files.withColumn("_range", F.spark_partition_id()))  # sampled ranges may differ when they are made again
    ahead = Window.rowsBetween(Window.unboundedPreceding, -1)
    sums = files.groupBy(collection, "_range").agg(F.sum("_n").alias("_sum"))
    sums = sums.select(F.col(collection).alias("_c"), F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(ahead.partitionBy(collection).orderBy("_range")), F.lit(0)).alias("_start"))
    inside = F.coalesce(F.sum("_n").over(ahead.partitionBy(collection, "_range").orderBy(first)), F.lit(0))
    files = files.withColumn("_inside", inside).join(F.broadcast(sums), F.col(collection).eqNullSafe(F.col("_c")) & (F.col("_range") == F.col("_r")))
    files = files.select(collection, first, (F.col("_inside") + F.col("_start")).alias("_before"))
    numbered = chunks.withColumn("_row", F.row_number().over(Window.partitionBy(collection, first).orderBy(*rest)) - 1)
    out = numbered.join(files, numbered[collection].eqNullSafe(files[collection]) & numbered[first].eqNullSafe(files[first])).drop(files[collection]).drop(files[first])
    base = F.lit(0)
    if existing is not None:
        counts = existing.groupBy(collection).agg(F.count("*").alias("_base"))
        out = out.join(counts, collection, "left")
        base = F.coalesce("_base", F.lit(0))
    out = out.withColumn("chunk_seq", (F.col("_row") + F.col("_before") + base).cast("long")).drop("_row", "_before", "_base")
    return out.withColumn("chunk_id", F.concat(F.lit("chunk_repo_"), F.col(collection), F.lit("_"), F.col("chunk_seq").cast("string")))

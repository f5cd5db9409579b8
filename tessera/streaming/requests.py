"""Ingest requests from a folder, as a stream that ends when it is read (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import vector
from ..plans import ingest as pipeline

SCHEMA = "root string, repository string"
#: Request files in a batch, whose requests the driver works off one by one.
FILES = 100


def drain(spark: SparkSession, requests: str, warehouse: str, checkpoint: str, provider: vector.EmbeddingProvider | None = None) -> StreamingQuery:
    """Work off all JSON requests that have arrived; each repository is ingested once."""
    embedder = provider or vector.HashingEmbedder()

    def work(batch: DataFrame, epoch: int) -> None:
        # requests are few; each starts a distributed job
        for r in batch.where("root is not null and repository is not null").dropDuplicates(["repository"]).collect():
            pipeline.ingest(spark, r["root"], r["repository"], warehouse, embedder)

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", FILES).json(requests)
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Landed pages as a stream: the batch verbs run on each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pagemill.plans.engine import Engine

RESPONSES = "url string, status int, content_type string, body string"


def landed(spark: SparkSession, path: str, schema: str = RESPONSES, files: int = 1000) -> DataFrame:
    """Parquet files of responses as they land."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def each_batch(stream: DataFrame, take: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Everything there is, batch by batch, then stop; a restart goes on behind the last batch."""
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest(engine: Engine, stream: DataFrame, checkpoint: str) -> StreamingQuery:
    """The model is fixed within a batch; a batch that a failure repeats is taken once."""

    def take(batch: DataFrame, epoch: int) -> None:
        engine.ingest(batch, epoch)

    return each_batch(stream, take, checkpoint)

"""Structured Streaming: the stateless report on a stream of documents, and tracing against a registry in each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import canary, forensic


def documents(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    """Documents of Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def verdicts(stream: DataFrame, column: str = "text") -> DataFrame:
    """doc_id, score and verdict of each document: projections only, so no state is kept."""
    return forensic.reported(stream, column).select("doc_id", "score", "verdict")


def verdict_counts(stream: DataFrame, time_col: str, column: str = "text", width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Verdicts per window of event time. State is bounded by the watermark: rows later than `late` are dropped."""
    rows = forensic.reported(stream.withWatermark(time_col, late), column)
    return rows.groupBy(F.window(time_col, width).alias("window"), "verdict").agg(F.count("*").alias("n_docs"))


def trace(stream: DataFrame, registry: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, column: str = "text") -> StreamingQuery:
    """Traces every micro-batch against a registry and hands (rows, batch id) to the sink; the batch id makes retries idempotent."""

    def each(batch: DataFrame, batch_id: int) -> None:
        sink(canary.traced(batch.withColumnRenamed(column, "marked"), registry), batch_id)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

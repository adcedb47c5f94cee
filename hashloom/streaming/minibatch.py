"""Mini-batches from a stream: a bounded number of files per trigger, one function call per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def stream_batches(spark: SparkSession, path: str, schema: StructType, run: Callable[[DataFrame, int], None], checkpoint: str, files_per_trigger: int = 1) -> StreamingQuery:
    """Starts a query over the Parquet files below ``path`` that calls ``run(batch, number)`` until all files there have been read.

    The checkpoint folder keeps which files were read: started again, the query goes on with new files only.
    """
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, late: str, length: str, by: str) -> DataFrame:
    """Counts per tumbling window and key of a streaming or batch table; a stream drops rows later than ``late``."""
    from pyspark.sql import functions as F

    x = events.withWatermark(time, late) if events.isStreaming else events
    return x.groupBy(F.window(time, length).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")

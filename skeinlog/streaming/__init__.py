"""Following append-only logs with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def follow(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """Lines of JSON files as they arrive, ``per_trigger`` files at a time, with their file's path."""
    return spark.readStream.format("json").schema(schema).option("maxFilesPerTrigger", per_trigger).load(path).withColumn("path", F.col("_metadata.file_path"))


def once_each(rows: DataFrame, keys: list[str], at: str | None = None, delay: str = "1 hour") -> DataFrame:
    """The first row of each key: within ``delay`` of the event time ``at`` (state is dropped behind it), else over all time."""
    if at is None:
        return rows.dropDuplicates(keys)
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def drain(rows: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Writes all that is there as Parquet and stops; with the same checkpoint a later call goes on behind it."""
    query = rows.writeStream.format("parquet").outputMode("append").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query

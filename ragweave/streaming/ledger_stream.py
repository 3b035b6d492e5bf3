"""Ledgers as streams: new JSON rows are appended once per key, with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def append_once(rows: DataFrame, keys: list[str], time: str, delay: str, target: str, checkpoint: str):
    """A query that writes each key once within `delay` of the watermark; a restart goes on from checkpoint."""
    once = rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
    return once.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Scans of streams. A scan keeps no state, so any batch plan runs as it is, in append mode and without watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from redactlake.plans.scanner import Scanner


def read_stream(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", **options) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def write_findings(scanner: Scanner, stream: DataFrame, path: str, checkpoint: str, *keys: str, text: str = "text", fmt: str = "parquet", once: bool = True) -> StreamingQuery:
    """Appends a row per finding; once: what is there now, else as it comes."""
    writer = scanner.findings(stream, *keys, text=text).writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(path)

"""Reading texts and writing results in any format Spark knows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    return spark.read.format(fmt).options(**options).load(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder of Parquet files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None, **options) -> None:
    writer = df.write.format(fmt).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


#: Bytes of a usual split.
SPLIT = 128 << 20


def dealt(df: DataFrame) -> DataFrame:
    """A table of less than a usual split for each core, dealt over the cores: its files may hold fewer row groups than
    there are cores, and a scan would run on as many. Larger ones stay as they are, unshuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPLIT else df

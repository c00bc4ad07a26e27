"""Shared plumbing: scratch tables in the shared folder, Arrow batches of bounded size."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

#: Bytes of text that a worker handles at a time.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a new one of this machine where that is unset and the
    session runs on this machine alone (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="redactlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Fewer rows and bytes in an Arrow batch than Spark's defaults (10,000 and 64 MB), as texts can be long. Smaller
    settings stay. They are the session's and are read when a plan runs, so they are not taken back."""
    for key, usual, most in (("maxRecordsPerBatch", "10000", rows), ("maxBytesPerBatch", "64MB", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}", usual)
        if not 0 < (int(now) if now.lstrip("-").isdigit() else most + 1) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


@contextlib.contextmanager
def _shuffles_given_up(spark: SparkSession) -> Iterator[None]:
    """What runs here removes its shuffle files when it is done, not when the driver happens to collect them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


#: All that was made here and not dropped.
_made: list[Scratch] = []


@atexit.register
def _drop_made(first: int = 0) -> None:
    for s in _made[first:]:
        s.drop()
    del _made[first:]


@contextlib.contextmanager
def tables_given_up() -> Iterator[None]:
    """Tables that operators have written in here are dropped at its end, so their results must be written as well."""
    first = len(_made)
    try:
        yield
    finally:
        _drop_made(first)


class Scratch:
    """Tables written in the shared folder, to cut lineage: a lost executor costs no recomputation past them. Results
    are read from them, so they stay until they are dropped or the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _made.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        with _shuffles_given_up(self.spark):
            df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        with contextlib.suppress(Exception):
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def utf8(column: str | Column) -> Column:
    """The text's bytes in UTF-8, null as empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string").cast("binary"), F.lit(b""))


def pieces(batches: Iterator[pa.RecordBatch], size_column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices whose size_column holds at most about limit bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(size_column))
        start, held = 0, 0
        for i, n in enumerate(pc.binary_length(column).to_pylist()):
            if held and held + (n or 0) > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n or 0
        yield batch.slice(start)


def crc32_mod(column: str, n: int) -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(0)) % n


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, ... so that none has a name that an operator uses itself."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def place(df: DataFrame, column: str) -> str:
    """The name that `numbered` gives to a column."""
    return f"c{[c.lower() for c in df.columns].index(column.lower())}"


def carried(df: DataFrame, text: str, *replaced: str | None) -> tuple[DataFrame, StructType]:
    """df's columns but for the replaced ones, named as by `numbered`, then `data`, the text in UTF-8 (or the bytes of a
    binary column), null as empty; and the schema of the former with their own names."""
    gone = {c.lower() for c in replaced if c}
    keep = [i for i, c in enumerate(df.columns) if c.lower() not in gone]
    own = F.col(place(df, text))
    data = F.coalesce(own, F.lit(b"")) if df.schema[int(place(df, text)[1:])].dataType == BinaryType() else utf8(own)
    source = numbered(df).select(*(f"c{i}" for i in keep), data.alias("data"))
    return source, StructType([df.schema.fields[i] for i in keep])


def fresh(df: DataFrame, name: str) -> str:
    """The name, or a longer one if df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name

"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes (as Parquet) that a broadcast side may have; larger sides are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only a local session, which has one machine, may go without."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="meshquill-"))
    return spark.sparkContext.getCheckpointDir()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._meshquill_path = path
    return out


def _folder(df: DataFrame):
    """The file system and the path of what materialize() wrote."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._meshquill_path)
    return path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()), path


def release(*frames: DataFrame | None) -> None:
    """Delete what materialize() wrote, once nothing reads it any more."""
    for df in frames:
        if hasattr(df, "_meshquill_path"):
            files, path = _folder(df)
            files.delete(path, True)


class Scratch:
    """materialize() that remembers what it wrote; release() deletes all of it but what is named."""

    def __init__(self) -> None:
        self.frames: list[DataFrame] = []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.frames.append(materialize(df, name))
        return self.frames[-1]

    def release(self, *keep: DataFrame) -> None:
        release(*(x for x in self.frames if not any(x is k for k in keep)))
        self.frames = list(keep)


def tidy(spark: SparkSession) -> None:
    """Let the driver drop what it no longer refers to; Spark then deletes the shuffle files behind it on the executors."""
    gc.collect()
    spark._jvm.System.gc()


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a materialized side for broadcast if it has at most so many rows and bytes; else Spark shuffles both sides.

    A side that materialize() did not write itself must have rows of a fixed width.
    """
    if hasattr(df, "_meshquill_path"):
        files, path = _folder(df)
        if files.getContentSummary(path).getLength() > size:
            return df
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def sendable(df: DataFrame, text: str, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a table has few rows and its text or binary column few bytes, so that the driver may send it to every task."""
    told = df.select(F.octet_length(text).alias("b")).limit(rows + 1).agg(F.count("*").alias("n"), F.sum("b").alias("b")).first()
    return told["n"] <= rows and (told["b"] or 0) <= size


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once, also where a lambda function uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def slices(batches, rows: int = 512):
    """Smaller batches: bounds what a worker holds as Python objects at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: str = "8m"):
    """What runs inside sends at most so much text to a Python worker at a time; Spark's own bound suits rows that are all short."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def hex_number(digest: Column, digits: int) -> Column:
    """The first hex digits of a digest as a long."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")

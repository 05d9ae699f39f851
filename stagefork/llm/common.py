"""Helpers that the operators of this subpackage share.

Tables that cut lineage are written under the folder named by
``spark.checkpoint.dir``, which driver and executors share.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: White space of the query contracts, as a regular-expression class and as a string.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of text that a task turns into Python objects at a time; a longer text is worked on alone.
SLICE = 1 << 21
#: Whether Spark deletes a plan's shuffle files when the plan ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths that `scratch_path` has given within each open `passing`.
_PASSING: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where none is set and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="stagefork-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, where = _file_system(spark, path)
    fs.deleteOnExit(where)
    if _PASSING:
        _PASSING[-1].append(path)
    return path


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """Delete at the end what `scratch_path` gave within, but for paths that were taken off the list."""
    made: list[str] = []
    _PASSING.append(made)
    try:
        yield made
    finally:
        _PASSING.pop()
        for path in made:
            fs, where = _file_system(spark, path)
            fs.delete(where, True)


def saved(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """`df` written to the shared folder and read again, so that its lineage ends there; what the plan shuffled goes at once."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stagefork_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files behind a table made by `saved`, once nothing reads it any more."""
    path = getattr(df, "_stagefork_path", None)
    if path:
        fs, where = _file_system(df.sparkSession, path)
        fs.delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that have ended.

    It does so once the JVM's collector has found a plan unreachable, which an idle driver's
    heap may put off until long after; `spark.cleaner.periodicGC.interval` is 30 minutes. The
    plan that ended last is still held then, so this is for plans whose rows go to the driver;
    `saved` doesn't need it.
    """
    spark.sparkContext._jvm.System.gc()


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in parts whose texts or bytes in `column` have `most` bytes together, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, UPPER.lower())


def id_remainder(col: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo `modulus`; a null id counts as empty text."""
    return (F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores behind it until `df` has no such column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

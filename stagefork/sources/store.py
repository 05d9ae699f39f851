"""Stage tables by what they hang on: a name, the input files, settings and the code.

With `spark.stagefork.store` set to a folder that driver and executors share, tables stay
there and a later session with the same inputs, settings and code reads them; anything
else gives another name. Without it they live under `spark.checkpoint.dir` for a session.
A table is written beside its place and moved there when whole, so that a broken write
is never read.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable
from functools import cache
from importlib import resources

import pyspark
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

STORE = "spark.stagefork.store"
#: How tables are compressed on disk.
PACKED = "zstd"
_MADE: dict[tuple[str, str], DataFrame] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where none is set and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="stagefork-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = file_system(spark, path)
    return fs.exists(where)


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table's write ended: its success marker is there."""
    return exists(spark, f"{path}/_SUCCESS")


def move(spark: SparkSession, start: str, end: str) -> None:
    """Give a whole table its name; if another session was first, theirs stays."""
    fs, where = file_system(spark, start)
    _, to = file_system(spark, end)
    if fs.exists(to) and not complete(spark, end):
        fs.delete(to, True)
    if fs.exists(to) or not fs.rename(where, to):
        fs.delete(where, True)
    if not complete(spark, end):
        raise OSError(f"{end} isn't whole")


def data_fingerprint(spark: SparkSession, paths: list[str], more: tuple[str, ...] = ()) -> str:
    """Hangs on name, length and time of every file below the paths, and on `more`; a path that isn't there counts as empty."""
    found: list[str] = [f"= {x}" for x in more]

    def walk(fs, where) -> None:
        for status in fs.listStatus(where):
            if status.isDirectory():
                walk(fs, status.getPath())
            else:
                found.append(f"{status.getPath()} {status.getLen()} {status.getModificationTime()}")

    for path in paths:
        fs, where = file_system(spark, path)
        found.append(path)
        if fs.exists(where):
            walk(fs, where)
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


@cache
def code_fingerprint() -> str:
    """The start of a SHA-256 over the sources of the retrieval experiment, names included."""
    root, whole = resources.files(__package__.split(".")[0]), hashlib.sha256()
    for part in ("functions", "operators", "plans", "sources"):
        for file in sorted((f for f in (root / part).iterdir() if f.name.endswith(".py")), key=lambda f: f.name):
            whole.update(f"{part}/{file.name}\n".encode() + file.read_bytes())
    return whole.hexdigest()[:16]


def artefact_name(name: str, data: str, settings: object = None) -> str:
    """`name` and a digest of all that the artefact hangs on."""
    key = json.dumps([name, data, settings, code_fingerprint(), pyspark.__version__], sort_keys=True, default=str)
    return f"{name}-{hashlib.sha256(key.encode()).hexdigest()[:16]}"


def place(spark: SparkSession, name: str) -> str:
    """Path of an artefact: in the store, or else in the shared folder until the session's JVM ends."""
    root = spark.conf.get(STORE, None)
    if root:
        return f"{root.rstrip('/')}/{name}"
    path = f"{shared_dir(spark)}/stage-{spark.sparkContext.applicationId}-{name}"
    fs, where = file_system(spark, path)
    fs.deleteOnExit(where)
    return path


def stage_table(spark: SparkSession, name: str, data: str, build: Callable[[], DataFrame], settings: object = None, buckets: tuple[str, int] | None = None) -> DataFrame:
    """The table `name` over the inputs with fingerprint `data`: read if it is there whole, else built and written.

    `buckets` (a column and a number) hashes rows by that column, so that later joins and
    aggregates by it need no shuffle of the table; `build` had best deal them out so.
    """
    path = place(spark, artefact_name(name, data, [settings, buckets]))
    key = (spark.sparkContext.applicationId, path)
    if key not in _MADE:
        if not complete(spark, path):
            df, half = build(), f"{path}.{uuid.uuid4().hex}"
            if buckets:
                _write_buckets(df, half, *buckets)
            else:
                df.write.option("compression", PACKED).parquet(half)
            move(spark, half, path)
        _MADE[key] = _bucketed(spark, path, *buckets) if buckets else spark.read.parquet(path)
    return _MADE[key]


def made(spark: SparkSession, name: str, data: str, settings: object = None, buckets: tuple[str, int] | None = None) -> bool:
    """Whether `stage_table` of the same would read a table, not build it."""
    return complete(spark, place(spark, artefact_name(name, data, [settings, buckets])))


def _table_name(path: str) -> str:
    return "stagefork_" + hashlib.sha256(path.encode()).hexdigest()[:24]


def _write_buckets(df: DataFrame, path: str, column: str, n: int) -> None:
    name = _table_name(path)
    df.write.format("parquet").option("compression", PACKED).bucketBy(n, column).sortBy(column).option("path", path).saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # the files stay: the path is the caller's


def _bucketed(spark: SparkSession, path: str, column: str, n: int) -> DataFrame:
    """Bucketed files as a table of this session's catalog."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    name = _table_name(path)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (`{column}`) SORTED BY (`{column}`) INTO {n} BUCKETS LOCATION '{path}'")
    return spark.table(name)


class Increments:
    """A table that grows by whole parts; a part whose write broke off isn't seen."""

    def __init__(self, spark: SparkSession, name: str, data: str, settings: object = None):
        self.spark, self.path = spark, place(spark, artefact_name(name, data, settings))

    def parts(self) -> list[str]:
        fs, where = file_system(self.spark, self.path)
        found = [status.getPath().toString() for status in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(p for p in found if complete(self.spark, p))

    def read(self) -> DataFrame | None:
        """All parts; None as long as there is none."""
        found = self.parts()
        return self.spark.read.parquet(*found) if found else None

    def add(self, rows: DataFrame) -> None:
        rows.write.option("compression", PACKED).parquet(f"{self.path}/{uuid.uuid4().hex}")


def scratch(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again, until the session's JVM ends."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    fs, where = file_system(df.sparkSession, path)
    fs.deleteOnExit(where)
    df.write.option("compression", PACKED).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: str, to: str = "number") -> DataFrame:
    """`df` with the place of each row in `order`, from 0, without a window over all rows.

    Rows are dealt to ranges and sorted there; a row's number is its place in its range
    behind the sizes of the ranges before. Only those sizes, one a range, meet in a task.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(to, F.monotonically_increasing_id())
    rows = scratch(ranged, "numbered")
    part, within = F.shiftright(to, 33), F.col(to).bitwiseAND((1 << 33) - 1)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    return rows.withColumn("_part", part).join(F.broadcast(before), "_part").select(*df.columns, (within + F.col("_before")).alias(to))

"""What long jobs need from a session: a shared folder to cut lineage in, and partition counts."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or else the context's own checkpoint
    folder. Only where neither is set (tests on one machine) is a temporary folder made and set."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = sc._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found:
        found = tempfile.mkdtemp(prefix="reedbed-")
        sc.setCheckpointDir(found)
    return found


@contextlib.contextmanager
def shuffle_files_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, a query's shuffle files go as soon as the query ends. Only for queries whose result is a
    written table: nothing reads their shuffles again."""
    before = spark.conf.get(_CLEANUP, None)
    try:
        spark.conf.set(_CLEANUP, "true")
    except Exception:  # a Spark without the setting keeps them until garbage collection
        yield
        return
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def materialise(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and returns a reader of it: lineage ends there, so a
    lost executor costs no more than the stage that runs. The files go when the driver's process ends, or
    with :func:`release`. With ``by`` there is a folder for each of that column's values."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/reedbed/{name}-{uuid.uuid4().hex}"
    with shuffle_files_dropped(spark):
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._reedbed_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables of :func:`materialise` that no later query reads."""
    for table in tables:
        for entry in [e for e in _written if e[1] == getattr(table, "_reedbed_path", None)]:
            _delete(*entry)
            _written.remove(entry)


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _release_all() -> None:
    for entry in _written:
        _delete(*entry)
    _written.clear()


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

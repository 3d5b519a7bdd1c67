"""Session construction and the shared scratch folder.

Executors may be lost at any time, so lineage is only ever cut by writing Parquet into the
folder all executors share (``spark.checkpoint.dir``), never by ``localCheckpoint``.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "loomspark", cores: int | str = "*", shuffle_partitions: int = 16) -> SparkSession:
    """Local session with the settings the package is tested under."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a single-machine session without that setting gets a temporary folder of its own;
    a cluster session without it is an error, since executors could not see local files.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), f"loomspark-{spark.sparkContext.applicationId}")


_tables: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_scopes: list[list[str]] = []


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet under the scratch folder and return the table read back.

    Cuts lineage like a reliable checkpoint, but stays columnar, so later readers prune columns. ``keep``: the table outlives the
    innermost ``temporary_tables`` block.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/loomspark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _tables[out] = path
    scopes = _scopes[:-1] if keep else _scopes
    if scopes:
        scopes[-1].append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialize`` returned, once nothing lazy depends on it."""
    path = _tables.pop(df, None)
    if path is not None:
        _delete(df.sparkSession, path)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what ``materialize`` wrote inside, but for what was written with ``keep``."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _delete(spark, path)


def shuffle_width(spark: SparkSession) -> int:
    """The cluster's own shuffle parallelism."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame) -> DataFrame:
    """The same rows over all tasks of a shuffle: for short rows that cost much each, as the files of a small table are few."""
    return df.repartition(max(shuffle_width(df.sparkSession), df.sparkSession.sparkContext.defaultParallelism))


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows of an Arrow batch while the block runs its jobs: rows that hold whole texts need small batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _session() -> SparkSession:
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("files are read and written through a session, as it knows their file system")
    return spark


def put_text(path: str, content: str) -> None:
    """Write a small file on any file system that the session knows, in place of an earlier one."""
    spark = _session()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()


def get_text(path: str) -> str:
    """The whole of a small file."""
    spark = _session()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()

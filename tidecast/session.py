"""Session helpers: a local builder for tests and bench, and lineage cuts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths that ``shared_path`` has given out and nothing has removed yet, oldest first.
_given: list[str] = []


def local_session(cpus: int | str = "*", app: str = "tidecast") -> SparkSession:
    """Session for tests and bench only; on a cluster pass the session you already have."""
    parallelism = "8" if cpus == "*" else str(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", parallelism)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may do without: it falls back to a folder of the warehouse. On a cluster a machine-local folder
    would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if configured is None and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        configured = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured or sc.getCheckpointDir()


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder for one written intermediate."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _given.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written intermediate, wherever the session's file systems keep it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _given:
        _given.remove(path)


def materialize(df: DataFrame, label: str = "cut") -> DataFrame:
    """Cut the lineage of ``df``: write it to the shared folder as Parquet and read it back.

    The copy is columnar and prunable, survives the loss of any executor, and
    starts a plan of constant size. (A checkpoint would hand the constraints of
    its plan on to the next one, which piles up in iterative jobs.)
    """
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove on leaving, with or without an error, all intermediates that were written inside.

    Frames are lazy, so use them up (write, collect) before leaving.
    """
    before = set(_given)
    try:
        yield
    finally:
        for path in [p for p in _given if p not in before]:
            remove(spark, path)


def spread(df: DataFrame, label: str = "spread", partitions: int | None = None) -> DataFrame:
    """Give a written frame at least ``partitions`` partitions (default: the session's parallelism).

    Iterative learners scan their data hundreds of times, so a frame of fewer files is written once more; a frame that
    has as many is returned as it is.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism if partitions is None else partitions
    return df if df.rdd.getNumPartitions() >= wanted else materialize(df.repartition(wanted), label)

"""Session helpers: the folder that driver and executors share, and checkpoints in it."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..session import ship


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a local master, whose driver and
    executors are one process (as in tests), gets a temporary folder where it is
    unset; elsewhere that is an error, as a folder of one machine isn't shared."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        folder = context.getCheckpointDir()
        if not folder:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='declarium-')}")
            folder = context.getCheckpointDir()
    elif not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_dropped(spark: SparkSession):
    """Inside, a finished job's shuffle files go: its result is kept elsewhere."""
    before = spark.conf.get(_CLEANUP, None)
    if before is not None:
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is not None:
            spark.conf.set(_CLEANUP, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and cut its lineage."""
    shared_dir(df.sparkSession)
    with _shuffles_dropped(df.sparkSession):
        return df.checkpoint(eager=True)


def written(df: DataFrame, kind: str) -> DataFrame:
    """As ``checkpointed``, for wide or many rows: a Parquet table in the shared
    folder, which stays there until the session's end."""
    spark, folder = df.sparkSession, new_folder(df.sparkSession, kind)
    with _shuffles_dropped(spark):
        df.write.parquet(folder)
    _written.append((spark.sparkContext.applicationId, folder))
    out = spark.read.schema(df.schema).parquet(folder)
    out._declarium_folder = folder
    return out


_written: list[tuple[str, str]] = []


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete a table of ``written`` that nothing will read again."""
    _delete(df.sparkSession, df._declarium_folder)


def clean(spark: SparkSession) -> None:
    """Delete the tables of ``written``; results that still read them are lost."""
    for app, folder in _written:
        if app == spark.sparkContext.applicationId:
            _delete(spark, folder)
    _written.clear()


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names`` behind a mark that no column of ``df`` begins with."""
    mark = "_x_"
    while any(c.lower().startswith(mark) for c in df.columns):
        mark += "_"
    return [mark + n for n in names]


def tasks(df: DataFrame) -> int:
    """As many tasks as reading ``df`` takes, or shuffles have: for work whose cost
    lies in what its few bytes stand for, which Spark would put in few tasks."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


_BATCH, _DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` with the package on the workers. Rows hold whole texts, so
    a session that has Spark's default batch of 10,000 rows gets one of 2,000."""
    if df.sparkSession.conf.get(_BATCH, _DEFAULT) == _DEFAULT:
        df.sparkSession.conf.set(_BATCH, "2000")
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)

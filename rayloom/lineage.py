"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Only a local session that has none (tests, a laptop) gets a temporary one;
    on a cluster executors would not see it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is not None:
        return path
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    _MADE.append(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: a lost executor costs a re-read, not a re-run."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt_out(df: DataFrame, *by: str) -> DataFrame:
    """``df`` over all cores, by columns or evenly: for steps that make much of few bytes.

    Adaptive execution sizes tasks by the bytes that they read, and a small
    file is one task; a number that is asked for stays.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), *by)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path through the file system that holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[list[str]]:
    """Scratch paths made inside are deleted at the end, but for those that the block puts into the list it is given.

    For blocks whose results are written when they end: a result that is still
    lazy would miss its inputs.
    """
    mark, kept = len(_MADE), []
    yield kept
    made = _MADE[mark:]
    del _MADE[mark:]
    for path in made:
        if path in kept:
            _MADE.append(path)
        else:
            remove(spark, path)


def last_made() -> str:
    """The newest scratch path."""
    return _MADE[-1]

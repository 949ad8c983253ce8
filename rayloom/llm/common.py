"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rayloom.lineage import stored

__all__ = ["WORD", "key_of", "maybe_broadcast", "modest_batches", "small_enough", "stored", "table"]

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def modest_batches(spark: SparkSession, rows: int = 1000, size: int = 64 << 20) -> None:
    """At most so many rows, and about so many bytes, in an Arrow batch of this session: texts are long, and a worker holds some copies of a batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) <= size:
        spark.conf.set(name, str(size))


def key_of(column: Column) -> Column:
    """A string that is never null, sorts as ``column`` does, nulls last."""
    return F.when(column.isNull(), F.lit("2")).otherwise(F.concat(F.lit("1"), column.cast("string")))


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, most: int, weight: Column | None = None) -> DataFrame:
    """``df`` with a broadcast hint when it has at most ``most`` rows; without, Spark shuffles.

    Rows of no fixed size have a ``weight``, whose sum must not be more.
    """
    if weight is not None:
        total = df.agg(F.sum(1 + weight).alias("n")).first().n or 0
        return F.broadcast(df) if total <= most else df
    return F.broadcast(df) if small_enough(df, most) else df

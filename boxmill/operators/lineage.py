"""Cutting a long lineage with a table in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local session without it gets a temporary one, a cluster the warehouse."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    local = spark.sparkContext.master.startswith("local[")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_cut")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def broadcast_below(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df with a broadcast hint if it has at most that many rows, which are counted first; beyond, the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Tables that cut() wrote and nobody deleted yet.
_made: list[str] = []
#: The folder of a table that cut() gave.
_path: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a folder through the cluster's file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving what cut() wrote inside. What was made of it must be written by then."""
    first = len(_made)
    try:
        yield
    finally:
        for path in _made[first:]:
            deleted(spark, path)
        del _made[first:]


#: Shuffle files go at the end of the write that made them, not when the driver's memory is cleared.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _own_shuffles(spark: SparkSession) -> Iterator[None]:
    """Writes inside leave no shuffle files. A write has a plan of its own, so no other result needs them."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def cut(df: DataFrame, tag: str) -> DataFrame:
    """df, written to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _made.append(path)
    with _own_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _path[out] = path
    return out


def cut_alone(make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """What make gives, cut; the tables that were cut on the way are deleted."""
    first = len(_made)
    df = cut(make(), tag)
    for path in _made[first:-1]:
        deleted(df.sparkSession, path)
    del _made[first:-1]
    return df


def dropped(table: DataFrame, *columns: str) -> DataFrame:
    """A table that cut() gave, written again without the columns; the first one is deleted, so nothing may read it later."""
    out, path = cut(table.drop(*columns), "slim"), _path[table]
    deleted(table.sparkSession, path)
    _made.remove(path)
    return out

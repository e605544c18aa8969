"""Shared working folders for written state, staged files and stream checkpoints."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_OURS: set[str] = set()


def _hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of a Hadoop path."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def remove(spark: SparkSession, path: str) -> None:
    system, target = _hadoop_path(spark, path)
    system.delete(target, True)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder; none if there is no such folder."""
    system, target = _hadoop_path(spark, path)
    if not system.exists(target):
        return []
    return [status.getPath().getName() for status in system.listStatus(target)]


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Hadoop reads it with."""
    system, target = _hadoop_path(spark, path)
    return target.makeQualified(system.getUri(), system.getWorkingDirectory()).toString()


def shared_root(spark: SparkSession) -> str:
    """A folder of this application below the one the cluster names.

    That is ``spark.checkpoint.dir``; where it is unset, the warehouse, which all
    executors share as well. The folder is removed when the driver ends.
    """
    root = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    root = root or f"{spark.conf.get('spark.sql.warehouse.dir')}/work"
    own = f"{root.rstrip('/')}/keybalance-{spark.sparkContext.applicationId}"
    if own not in _OURS:
        _OURS.add(own)
        system, target = _hadoop_path(spark, own)

        def clean() -> None:
            with contextlib.suppress(Exception):  # the JVM may be gone before us
                system.delete(target, True)

        atexit.register(clean)
    return own


def fresh_dir(spark: SparkSession, purpose: str) -> str:
    """A new, not yet existing path below the shared root."""
    return f"{shared_root(spark)}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and safe from lost executors."""
    path = fresh_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

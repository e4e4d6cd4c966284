"""Where queries of the engine keep files: the folder that all executors share.

A table that a plan reads several times is written once; its readers then share one computation and know its size.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_LEFT: list[tuple[SparkSession, str]] = []


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear() -> None:
    """Delete the folders of past queries. Call it once their results have been read; it also runs at exit."""
    while _LEFT:
        spark, folder = _LEFT.pop()
        try:
            delete(spark, folder)
        except Exception:  # the session has ended; the cluster's own cleaning of the folder takes over
            pass


atexit.register(clear)


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder under ``spark.checkpoint.dir``. Only where all of Spark is one process may that be unset: a temporary one then."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[[^]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = named.rstrip("/") if named else "file://" + tempfile.gettempdir()
    folder = f"{root}/lexmill-{label}-{uuid.uuid4().hex}"
    _LEFT.append((spark, folder))
    return folder


def written(df: DataFrame, label: str) -> DataFrame:
    """The same rows, computed once."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

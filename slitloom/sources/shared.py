"""Tables written to the folder that all executors share, and read again."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where the session
    names none and all runs on this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if not re.match(r"local($|\[)", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        where = tempfile.mkdtemp(prefix="slitloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
    except Exception:  # the session has ended: the folder's owner clears it
        pass


_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def stored(df: DataFrame, name: str, **options: object) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts the
    lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table made by stored() that nothing will read any more."""
    path = _PATHS.pop(df, None)
    if path:
        _remove(df.sparkSession, path)

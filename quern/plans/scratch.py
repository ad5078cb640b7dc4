"""Cutting lineage through tables in the cluster's shared folder.

A cut writes the frame as Parquet under ``spark.checkpoint.dir`` and reads it back: what follows starts
from files that every executor can reach, so a lost executor costs a re-read and not the whole lineage.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a temporary folder, but only with a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="quern-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; it goes when the driver ends."""
    path = f"{shared_folder(spark)}/quern-{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def cut(df: DataFrame, label: str) -> DataFrame:
    """`df`, computed once and read back from the shared folder."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path through Hadoop's file system layer, so any store will do."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written() -> list[tuple[SparkSession, str]]:
    """What this driver has written by `cut` and `new_path` and not deleted yet, in order."""
    return list(_written)


def drop(paths: list[tuple[SparkSession, str]]) -> None:
    """Deletes some of what `written` names."""
    for spark, path in paths:
        if (spark, path) in _written:
            _written.remove((spark, path))
            remove(spark, path)


def clear() -> None:
    """Deletes all that this driver wrote by `cut` and `new_path`."""
    while _written:
        spark, path = _written.pop()
        try:
            remove(spark, path)
        except Exception:  # the session may be gone when the driver ends; other paths may still be within reach
            continue


atexit.register(clear)


def _width(column: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes in memory."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, T.StructType):
        return sum((_width(column.getField(f.name), f.dataType) for f in kind.fields), F.lit(8))
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.coalesce(F.octet_length(column.cast("string")), F.lit(0)) + 16
    return F.lit(8)


def fits(df: DataFrame, rows: int, size: int = 64 << 20) -> bool:
    """Whether `df` has at most `rows` rows of `size` bytes together: the check before a broadcast. At most rows + 1 are read."""
    width = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16))
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(width.cast("long")).alias("size")).first()
    return found.n <= rows and (found.size or 0) <= size


def small(df: DataFrame, rows: int, size: int = 64 << 20) -> DataFrame:
    """`df`, marked for a broadcast if it fits."""
    return F.broadcast(df) if fits(df, rows, size) else df

"""Tables that cut lineage, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Writes a DataFrame as a table of the given name and reads it back.
Keep = Callable[..., DataFrame]


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset and all runs in one process, a new local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-tonewright-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tonewright/{uuid.uuid4().hex}/{name}"


def _written(df: DataFrame, path: str, codec: str) -> DataFrame:
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df once as Parquet and read it back.

    What follows neither runs df's plan again nor needs an executor that ran it, so the result survives lost
    executors, and columns that nothing reads are not read.
    """
    return _written(df, new_path(df.sparkSession, name), codec)


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _file_system(spark, path)
    return files.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    files, where = _file_system(spark, path)
    files.delete(where, True)


def finished(spark: SparkSession, path: str) -> list[str]:
    """Folders in a folder whose writing has ended: Spark writes their _SUCCESS last."""
    files, where = _file_system(spark, path)
    if not files.exists(where):
        return []
    return sorted(str(f.getPath()) for f in files.listStatus(where) if f.isDirectory() and exists(spark, f"{f.getPath()}/_SUCCESS"))


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[Keep]:
    """As materialise, for tables that only the block needs: they go at its end. What outlives it is materialised in it."""
    folder, number = new_path(spark, name), iter(range(1 << 30))

    def keep(df: DataFrame, table: str, codec: str = "zstd") -> DataFrame:
        return _written(df, f"{folder}/{next(number)}-{table}", codec)

    try:
        yield keep
    finally:
        remove(spark, folder)

"""Written tables between the steps of a job."""

from __future__ import annotations

import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Where the frames that `written` gave are written.
_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one named in spark.checkpoint.dir. Where none
    is named, a folder beside the warehouse; on a cluster that must not be a machine's own."""
    if named := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if warehouse.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share: the warehouse is a local folder")
    return f"{warehouse}/_scratch/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame, *done: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: what several later steps use is computed
    once, and the optimizer knows its size. Afterwards the folders of `done` are deleted: frames from
    this function that nothing depends on any more."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _folders[out] = path
    discard(*done)
    return out


def discard(*done: DataFrame) -> None:
    """Delete what `written` wrote for these frames; others are left alone."""
    for df in done:
        if path := _folders.pop(df, None):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)

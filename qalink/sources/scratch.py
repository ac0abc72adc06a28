"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders made by this process, for :func:`remove_folders`.
_made: list[str] = []


def shared_base(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    A session on ``local[…]`` without it, where driver and tasks are one machine, uses a folder below
    the working directory. A cluster without it is an error: its machines share no local folder.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.abspath("spark-warehouse/scratch")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    _made.append(f"{shared_base(spark)}/qalink-{uuid.uuid4().hex}")
    return _made[-1]


def remove_folders(spark: SparkSession) -> None:
    """Removes what this process has stored, once the results are written."""
    jvm = spark.sparkContext._jvm
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder and read back.

    For a derived table that several jobs need: none of them computes it again, and a lost
    executor costs a re-read.
    """
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)

"""Readers and writers of the tables, and of the small word lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qalink import schemas


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    header: bool = True,
    quoted: bool = False,
    multi_line: bool = False,
) -> DataFrame:
    """CSV with a stated schema. ``quoted`` reads doubled quotes inside quoted fields.

    ``multi_line`` accepts line breaks inside quoted fields; such files cannot be split, so write
    them in many parts.
    """
    reader = spark.read.schema(schema).option("header", header).option("multiLine", multi_line)
    if quoted:
        reader = reader.option("quote", '"').option("escape", '"')
    return reader.csv(path)


def write_csv(df: DataFrame, path: str, header: bool = True, quoted: bool = False) -> None:
    """CSV written by the tasks, one file each; nothing passes through the driver."""
    writer = df.write.mode("overwrite").option("header", header)
    if quoted:
        writer = writer.option("quote", '"').option("escape", '"').option("quoteAll", True)
    writer.csv(path)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Parquet, the format to keep tables in; partition posts tables by category to prune scans."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def read_table(spark: SparkSession, path: str, deal_out: bool = False) -> DataFrame:
    """Parquet. ``deal_out`` is for work that is heavy per row, such as text and HTML.

    When the files give fewer tasks than there are cores, the rows are then dealt out over the
    cores first. A large table has more tasks than cores, and nothing is moved.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if deal_out and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def read_bigrams(spark: SparkSession, path: str) -> DataFrame:
    """Tag pairs with or without label columns; a missing label reads as null."""
    return read_csv(spark, path, schemas.BIGRAMS, header=False)


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    """``word``: a list of one word per line, of any length, each word once, for joins."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''").distinct()

"""Word vectors in the plain text format: a line ``count dimension``, then ``word f1 … fd``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``word, vector``. The header is the line of exactly two fields; the last line of a word wins.

    Lines are told apart by their place in the file, so the read stays split over tasks.
    """
    lines = spark.read.text(path).select(
        F.split(F.trim("value"), " ").alias("f"),
        F.struct(
            F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
        ).alias("place"),
    )
    words = lines.where(F.size("f") > 2).select(
        F.get("f", F.lit(0)).alias("word"),
        F.slice("f", F.lit(2), F.size("f")).cast("array<float>").alias("vector"),
        "place",
    )
    return words.groupBy("word").agg(F.max_by("vector", "place").alias("vector"))


def write_word_vectors(vectors: DataFrame, path: str) -> None:
    """The word lines, one file per task, without a header line."""
    fields = F.transform("vector", lambda x: x.cast("string"))
    vectors.select(F.concat_ws(" ", "word", fields)).write.mode("overwrite").text(path)

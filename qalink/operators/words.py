"""Words as rows: frequencies and stop words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qalink.operators.joins import lookup_join


def most_frequent_words(words: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The ``n`` most frequent words per key: ``keys…, word, count, rank``; ties by word."""
    counts = words.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("count"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("count"), "word"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)


def drop_stop_words(tokens: DataFrame, stop_words: DataFrame, column: str = "token") -> DataFrame:
    """Anti-join form for lists of any length: ``stop_words(word)``."""
    listed = stop_words.select(F.col("word").alias(column)).distinct()
    return lookup_join(tokens, listed, [column], "left_anti").select(*tokens.columns)

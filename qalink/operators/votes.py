"""Choosing the category of a question from the scores of its answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def category_votes(similarities: DataFrame) -> DataFrame:
    """Votes and mean similarity per question and category.

    The pair (category, similarity) is dropped as a whole when half of it is missing, and the
    pairs are counted rather than listed, so a busy question costs one row per category.
    """
    pairs = similarities.where(F.col("category").isNotNull() & F.col("similarity").isNotNull())
    return pairs.groupBy("question_id", "category").agg(
        F.count(F.lit(1)).alias("votes"), F.avg("similarity").alias("mean_similarity")
    )


def majority_category(
    similarities: DataFrame, min_rows: int = 2, min_similarity: float = 0.4
) -> DataFrame:
    """Questions whose answers mostly agree, with the mean similarity of the winning votes."""
    leader = F.struct("votes", "category", "mean_similarity")
    per_question = (
        category_votes(similarities)
        .groupBy("question_id")
        .agg(F.sum("votes").alias("n"), F.max(leader).alias("lead"))
    )
    return per_question.where(
        (F.col("n") >= min_rows)
        & (2 * F.col("lead.votes") > F.col("n"))
        & (F.round("lead.mean_similarity", 9) >= min_similarity)
    ).select("question_id", "lead.category", "lead.mean_similarity")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).count()

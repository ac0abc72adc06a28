"""Which libraries a post uses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qalink.functions import text as X
from qalink.operators.joins import lookup_join
from qalink.sources.scratch import stored


def post_tokens(posts: DataFrame, keys: list[str], identifiers: str = "identifiers") -> DataFrame:
    """One row per post and distinct identifier."""
    return posts.select(*keys, F.explode(F.array_distinct(F.col(identifiers))).alias("token"))


def token_overlap(
    tokens: DataFrame, other: DataFrame, keys: list[str], other_keys: list[str], within: Sequence[str] = ()
) -> DataFrame:
    """Number of shared distinct tokens for every pair sharing one; found through the tokens.

    ``within`` names columns of both sides that must agree, so that pairs stay within a category.
    """
    listed = stored(other.select(*other_keys, *within, "token").distinct())
    shared = lookup_join(tokens, listed, [*within, "token"], spread_by=keys, store_left=True)
    return shared.groupBy(*keys, *other_keys).agg(F.count(F.lit(1)).cast("int").alias("matches"))


def library_usages(posts: DataFrame, library_tokens: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """``answer_id, title, library, matches``: identifiers a post shares with a library.

    ``posts`` has one row per answer and title, ``identifiers`` among its columns. With ``within``, a
    post only meets the libraries of its own category, and the output grows with the posts.
    """
    keys = ["answer_id", "title"]
    libraries = library_tokens.select(
        X.coordinates(F.col("group_id"), F.col("artifact_id")).alias("library"), *within, "token"
    )
    return token_overlap(post_tokens(posts, [*keys, *within]), libraries, keys, ["library"], within)


def encode_usages(posts: DataFrame, usages: DataFrame) -> DataFrame:
    """One text field per post, ``library->n|library->n``; empty for a post without a match.

    The posts enter as marker rows of the same grouping, so no second join is needed. A field
    holds at most one entry per library of the category.
    """
    entry = X.encode_usage(F.col("library"), F.col("matches"))
    rows = usages.select("answer_id", "title", entry.alias("entry")).unionByName(
        posts.select("answer_id", "title").distinct().withColumn("entry", F.lit(None).cast("string"))
    )
    fields = F.array_join(F.sort_array(F.collect_list("entry")), "|")
    return rows.groupBy("answer_id", "title").agg(fields.alias("libraries"))


def decode_usages(usages: DataFrame) -> DataFrame:
    """Text fields back to one row per library."""
    columns = [c for c in usages.columns if c != "libraries"]
    return usages.select(*columns, F.inline(X.decode_usages(F.col("libraries"))))


def best_libraries(usages: DataFrame, post: str = "answer_id", above: int = 1) -> DataFrame:
    """Libraries tied at the highest match count of a post, if it exceeds ``above``.

    ``rank() = 1`` lets Spark cut each group down inside the map tasks, before the shuffle.
    """
    counted = usages.where(F.col("matches") > above)
    rank = F.rank().over(Window.partitionBy(post).orderBy(F.desc("matches")))
    return counted.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def titles_per_library(encoded: DataFrame, above: int = 1) -> DataFrame:
    """``library, title`` for the best libraries of each post with complete fields; no shuffle."""
    best = X.best_usages(X.decode_usages(F.col("libraries")), above)
    rows = encoded.na.drop("any").select("title", F.explode(best).alias("u"))
    return rows.select("u.library", "title")


def title_counts(titles: DataFrame) -> DataFrame:
    return titles.groupBy("library").agg(F.count(F.lit(1)).alias("titles"))

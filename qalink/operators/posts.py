"""Posts: records, joins with categories, classes of use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qalink.functions import html as H
from qalink.functions import text as X
from qalink.operators.joins import BROADCAST_BYTES, lookup_join, measured_bytes, spread_join
from qalink.operators.lists import chunked_lists

# Labels of the split report, in report order.
POST_CLASSES = ("withImport", "withLinks", "not(ImportLinks)")


def complete_rows(df: DataFrame) -> DataFrame:
    """Rows without any null."""
    return df.na.drop("any")


def of_category(df: DataFrame, category: str, column: str = "category") -> DataFrame:
    return df.where(F.col(column) == category)


def answer_records(posts: DataFrame, identifiers: Column) -> DataFrame:
    """Ids, cleaned title and identifiers; the text form joins identifiers by ``|``."""
    return posts.select(
        "question_id",
        "answer_id",
        X.title_commas_to_blanks(F.col("title")).alias("title"),
        identifiers.alias("identifiers"),
    )


def bodies_per_question(posts: DataFrame, chunk_rows: int = 1000) -> DataFrame:
    """Answer bodies of each question in answer order, as lists of bounded length."""
    return chunked_lists(posts, ["question_id"], ["body"], ["answer_id"], "bodies", chunk_rows)


def questions_of_category(
    selected: DataFrame, posts: DataFrame, columns: Sequence[str] = ("title", "tags")
) -> DataFrame:
    """Selected questions with the wanted post columns, each distinct combination once.

    Only the named columns are carried, and the copies a question has (one per answer) collapse
    before any shuffle, so a question with very many answers joins as a single row.
    """
    wanted, selected = posts.select("question_id", *columns), selected.distinct()
    if measured_bytes(selected) <= BROADCAST_BYTES:
        return wanted.join(F.broadcast(selected), "question_id").distinct()
    return spread_join(wanted.distinct(), selected, ["question_id"], spread_by=columns, keys_from=posts)


def posts_of_category(selected: DataFrame, posts: DataFrame) -> DataFrame:
    """Selected questions with all post columns, whole-row distinct."""
    return lookup_join(posts, selected.distinct(), ["question_id"], spread_by=["answer_id"]).distinct()


def answers_of_category(
    similarities: DataFrame, posts: DataFrame, category: str, columns: Sequence[str] = ("tags", "body")
) -> DataFrame:
    """Answers scored for a category with their post; the title is that of the score row."""
    scored = of_category(similarities, category)
    wanted = posts.select("answer_id", *columns)
    return lookup_join(wanted, scored, ["answer_id"], spread_by=columns).distinct()


def post_class(
    body: Column, needle: str = "import", needle_tag: str = "code", link: Column | None = None
) -> Column:
    """``withImport``, else ``withLinks``, else ``not(ImportLinks)``."""
    with_import, with_links, rest = POST_CLASSES
    return (
        F.when(H.mentions_in_elements(body, needle, needle_tag), with_import)
        .when(H.has_element(body) if link is None else link, with_links)
        .otherwise(rest)
    )


def class_counts(classified: DataFrame, named: str | None = None) -> DataFrame:
    """Posts per class plus a ``total`` row; rows are counted per class first.

    ``named`` is a boolean column of posts that name a library in the text; their number is then the
    row ``named``. It is counted beside the classes: a naming post is of some class as well.
    """
    hits = F.count_if(F.col(named)) if named else F.lit(0).cast("long")
    counts = classified.groupBy("class").agg(F.count(F.lit(1)).alias("n"), hits.alias("named"))
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum("named"), F.lit(0)).alias("named"))
    rows = counts.select("class", "n").union(sums.select(F.lit("total"), "total"))
    return rows.union(sums.select(F.lit("named"), "named")) if named else rows


def class_split_report(classified: DataFrame) -> DataFrame:
    """Class sizes per category with the running total inside the category."""
    rank = F.array_position(F.array(*[F.lit(c) for c in POST_CLASSES]), F.col("class"))
    counts = classified.groupBy("class", "category").agg(F.count(F.lit(1)).alias("len"))
    running = (
        Window.partitionBy("category").orderBy(rank).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return counts.withColumn("total", F.sum("len").over(running))


def naming_posts(posts: DataFrame, names: Sequence[str]) -> DataFrame:
    """Posts naming a library in the title or in the prose."""
    return posts.where(H.names_in_prose(F.col("title"), F.col("body"), names))

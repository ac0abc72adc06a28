"""From scored answers to selected questions, frequent tag pairs, and posts by tag.

Tags and titles are all that is read of the posts; posts that lack anything are dropped beforehand,
once, by the ``clean-posts`` job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qalink.functions import text as X
from qalink.operators import posts as P
from qalink.operators import tags as G
from qalink.operators import votes as O


def select_questions(similarities: DataFrame) -> DataFrame:
    return O.majority_category(similarities)


def frequent_tag_pairs(
    selected: DataFrame, posts: DataFrame, category: str, excluded=X.GENERAL_TAGS, above: int = 5
) -> DataFrame:
    """``tag_a, tag_b, count`` of a category, most frequent first."""
    questions = P.of_category(selected, category).select("question_id")
    posts = posts.select("question_id", "tags").na.drop()
    tagged = P.questions_of_category(questions, posts, ["tags"])
    return G.by_frequency(G.tag_bigrams(tagged, excluded, above))


def posts_with_selected_tags(
    selected: DataFrame, posts: DataFrame, labelled: DataFrame, category: str
) -> DataFrame:
    """``question_id, title, tags`` of the category's questions having a tag labelled valid."""
    questions = P.of_category(selected, category).select("question_id")
    posts = posts.select("question_id", "title", "tags").na.drop()
    common = P.questions_of_category(questions, posts, ["title", "tags"])
    chosen = G.posts_with_tags(common.select("question_id", "title", "tags"), G.selected_tags(labelled))
    return chosen.withColumn("title", X.title_without_commas(F.col("title")))

"""Scoring answers and questions against library categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qalink.functions import text as X
from qalink.functions import vectors as V
from qalink.functions.binding import let
from qalink.operators.joins import lookup_join
from qalink.operators.vectors import sentence_vectors
from qalink.sources.scratch import stored

#: Categories whose vectors one row holds while answers are scored.
CATEGORY_BLOCK = 256


def closest_category(
    words: DataFrame,
    category_words: DataFrame,
    vectors: DataFrame,
    keys: Sequence[str],
    weight: str | None = None,
    category_block: int = CATEGORY_BLOCK,
) -> DataFrame:
    """``keys…, category, similarity``: the category most similar to the words of each key.

    The similarity is the dot product of the two sentence vectors. Repeats of a word within a key
    are counted first, so vectors meet each word of a key once; the vector of a key is then scored
    against blocks of category vectors, whatever their number, and only the best of each block goes
    on. Keys without a known word have no result; a null key is a key. Equal scores go to the
    smaller category name. ``weight`` names a column of repeat counts in ``category_words``.
    """
    categories = sentence_vectors(category_words, vectors, ["category"], weight)
    blocks = max(1, -(-categories.count() // category_block))
    entry = F.struct("category", F.col("vector").alias("v"))
    table = categories.groupBy(F.pmod(F.xxhash64("category"), F.lit(blocks)).cast("int").alias("_b")).agg(
        F.collect_list(entry).alias("_block")
    )
    counted = words.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("_times"))
    sentences = sentence_vectors(counted, vectors, keys, "_times")
    each = sentences.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = lookup_join(each, table, ["_b"], spread_by=keys)

    def scored(e):
        return let(
            V.dot(e["v"], F.col("vector")),
            # Rounded for the choice only, so that equal scores stay equal whatever the order of summing.
            lambda s: F.struct((-F.round(s, 9)).alias("_order"), e["category"].alias("category"), s.alias("similarity")),
        )

    if blocks == 1:  # one row per key already: no second grouping
        best = met.select(*keys, F.array_min(F.transform("_block", scored)).alias("_best"))
    else:
        best = met.groupBy(*keys).agg(F.min(F.array_min(F.transform("_block", scored))).alias("_best"))
    return best.select(*keys, "_best.category", "_best.similarity")


def question_scores(
    answers: DataFrame, classes: DataFrame, methods: DataFrame, skip_empty: bool = False
) -> DataFrame:
    """Class and method similarity of each question with each category it shares a token with.

    ``answers(question_id, answer_id, identifiers)``; answers of fewer than three identifiers do
    not count. ``classes`` and ``methods`` are ``(category, token)``.

    * ``class_similarity``: share of the answers naming a class of the category;
    * ``method_similarity``: mean over the answers of the share of lower-case identifiers that
      are methods of the category, distinct hits over all occurrences. One answer without a
      lower-case identifier leaves the question without it, unless ``skip_empty``.

    Tokens meet the vocabulary by equality and collapse to one row per answer and category, then
    to one per question and category; both steps start in the map tasks.
    """
    # Stored, because it is read twice and the identifiers are dear to compute; filtered
    # afterwards, because a filter on them would be pushed down and compute them once more.
    kept = stored(
        answers.select(
            "question_id",
            "answer_id",
            F.size("identifiers").alias("n"),
            F.size(F.filter("identifiers", X.starts_lower)).alias("lower"),
            F.array_distinct("identifiers").alias("distinct"),
        )
    ).where(F.col("n") > 2)
    totals = kept.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("answers"), F.count_if(F.col("lower") == 0).alias("empty")
    )
    vocabulary = (
        classes.where(X.starts_upper(F.col("token")))
        .select("category", "token", F.lit(True).alias("is_class"))
        .union(methods.where(X.starts_lower(F.col("token"))).select("category", "token", F.lit(False)))
        .distinct()
    )
    tokens = kept.select("question_id", "answer_id", "lower", F.explode("distinct").alias("token"))
    hits = lookup_join(tokens, stored(vocabulary), ["token"], spread_by=["question_id", "answer_id"])
    per_answer = hits.groupBy("question_id", "answer_id", "category").agg(
        F.max(F.col("is_class").cast("int")).alias("class_hit"),
        F.count_if(~F.col("is_class")).alias("method_hits"),
        F.max("lower").alias("lower"),
    )
    per_question = per_answer.groupBy("question_id", "category").agg(
        F.sum("class_hit").alias("class_answers"),
        F.sum(F.try_divide(F.col("method_hits"), F.col("lower"))).alias("method_sum"),
    )
    counted = F.col("answers") - F.col("empty") if skip_empty else F.when(F.col("empty") == 0, F.col("answers"))
    return per_question.join(totals, "question_id").select(
        "question_id",
        "category",
        "answers",
        "class_answers",
        (F.col("class_answers") / F.col("answers")).alias("class_similarity"),
        F.try_divide(F.coalesce("method_sum", F.lit(0.0)), counted).alias("method_similarity"),
    )


def closest_category_classical(
    answers: DataFrame,
    classes: DataFrame,
    methods: DataFrame,
    min_class: float = 0.5,
    min_method: float = 0.5,
    skip_empty: bool = False,
) -> DataFrame:
    """``question_id, category, similarity`` by class overlap, then by method overlap.

    The categories tied at the highest class similarity (at least ``min_class``) are candidates;
    the candidate of the highest method similarity wins if that exceeds ``min_method``.
    """
    scores = question_scores(answers, classes, methods, skip_empty)
    question = Window.partitionBy("question_id")
    candidates = (
        scores.withColumn("_r", F.rank().over(question.orderBy(F.desc("class_answers"))))
        .where(F.col("_r") == 1)
        .where(F.round("class_similarity", 9) >= min_class)
    )
    method = F.round("method_similarity", 9)
    best = candidates.withColumn(
        "_r", F.row_number().over(question.orderBy(method.desc_nulls_last(), "category"))
    )
    return best.where((F.col("_r") == 1) & (method > min_method)).select(
        "question_id", "category", F.col("method_similarity").alias("similarity")
    )

"""Score answers, or whole questions, against the library categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qalink.functions import html as H
from qalink.functions import text as X
from qalink.operators import libraries as L
from qalink.operators import posts as P
from qalink.operators import scoring as S
from qalink.sources.scratch import stored


def _pre_identifiers():
    return X.chunk_words(H.joined_text(F.col("body"), "pre"))


def _libraries(selected: DataFrame, details: DataFrame) -> DataFrame:
    return stored(L.library_version_lookup(L.selected_libraries(selected), details))


def score_answers(
    posts: DataFrame, selected: DataFrame, details: DataFrame, symbols: DataFrame, vectors: DataFrame
) -> DataFrame:
    """Word-vector approach: ``question_id, answer_id, title, identifiers, category, similarity``."""
    # Stored: the identifiers are read out of the markup once, then used twice.
    records = stored(P.answer_records(P.complete_rows(posts), _pre_identifiers()))
    keys = ["question_id", "answer_id"]
    words = records.select(*keys, F.explode("identifiers").alias("word"))
    vocabulary = L.category_vocabulary(_libraries(selected, details), symbols)
    category_words = vocabulary.withColumnRenamed("token", "word")
    closest = S.closest_category(words, category_words, vectors, keys, weight="n")
    return records.join(closest, keys).select(*records.columns, "category", "similarity")


def score_questions(
    posts: DataFrame, selected: DataFrame, details: DataFrame, symbols: DataFrame, skip_empty: bool = False
) -> DataFrame:
    """Overlap approach: ``question_id, category, similarity``."""
    answers = P.complete_rows(posts).select(
        "question_id", "answer_id", _pre_identifiers().alias("identifiers")
    )
    libraries = _libraries(selected, details)
    classes = L.category_vocabulary(libraries, symbols, "classes")
    methods = L.category_vocabulary(libraries, symbols, "methods")
    return S.closest_category_classical(answers, classes, methods, skip_empty=skip_empty)


def similarity_lines(scored: DataFrame) -> DataFrame:
    """The text form of :func:`score_answers`: identifiers joined by ``|``."""
    return scored.withColumn("identifiers", F.array_join("identifiers", "|"))

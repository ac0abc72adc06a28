"""Which libraries the answers of a category use, and the titles per library."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qalink.functions import html as H
from qalink.functions import text as X
from qalink.operators import libraries as L
from qalink.operators import posts as P
from qalink.operators import titles as T
from qalink.operators import usages as U
from qalink.sources.scratch import stored

# Names looked for in titles and prose.
LIBRARY_NAMES = ("Jackson", "Gson", "JSON in Java", "Fastjson", "JSON Simple", "JSON Path")


def classify_posts(
    similarities: DataFrame, posts: DataFrame, category: str, names: Sequence[str] = LIBRARY_NAMES
) -> DataFrame:
    """Answers of a category with their class, and whether the prose names a library."""
    answers = P.answers_of_category(similarities, P.complete_rows(posts), category)
    body = F.col("body")
    return answers.withColumn("class", P.post_class(body)).withColumn(
        "named", (F.col("class") == P.POST_CLASSES[2]) & H.names_in_prose(F.col("title"), body, names)
    )


def library_table(versions: DataFrame, info: DataFrame) -> DataFrame:
    """``group_id, artifact_id, name`` of the libraries of a category."""
    return L.library_names(versions.select("group_id", "artifact_id"), info)


def extract_usages(
    similarities: DataFrame,
    posts: DataFrame,
    versions: DataFrame,
    symbols: DataFrame,
    lexicon: DataFrame,
    category: str,
) -> DataFrame:
    """``answer_id, title, libraries``: title keywords and encoded usages of each answer.

    Answers without a match are kept with an empty field.
    """
    answers = P.answers_of_category(similarities, P.complete_rows(posts), category)
    identifiers = X.word_identifiers(H.joined_text(F.col("body"), "code")).alias("identifiers")
    # Stored: the markup is read once for the tokens, the empty answers and the titles.
    coded = stored(answers.select("answer_id", "title", identifiers))
    listed = L.library_versions(versions).select("group_id", "artifact_id", "version").distinct()
    tokens = L.library_symbols(L.with_coordinates(symbols, stored(listed), version=True))
    usages = U.library_usages(coded, tokens)
    encoded = U.encode_usages(coded, usages)
    titles = coded.select("answer_id", "title").distinct()
    keywords = T.title_keywords(titles, lexicon, ["answer_id", "title"])
    return (
        encoded.join(keywords, ["answer_id", "title"])
        .select("answer_id", F.col("keywords").alias("title"), "libraries")
    )


def analyze_usages(usages: DataFrame) -> DataFrame:
    """``library, title`` for the best libraries of each post."""
    filled = usages.withColumn("libraries", F.nullif("libraries", F.lit("")))
    return U.titles_per_library(filled)

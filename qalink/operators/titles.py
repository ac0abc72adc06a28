"""Keywords of titles through a tag lexicon."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qalink.functions import text as X
from qalink.operators.joins import lookup_join
from qalink.sources.scratch import stored

# Tag families of nouns, verbs and adjectives.
KEYWORD_TAGS = ("NN", "VB", "JJ")


def build_lexicon(tagged: DataFrame) -> DataFrame:
    """``token, tag``: the most frequent tag of each lower-case token; ties by tag."""
    counts = tagged.groupBy(F.lower("token").alias("token"), "tag").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("token").agg(F.min_by("tag", F.struct(-F.col("n"), F.col("tag"))).alias("tag"))


def title_keywords(
    titles: DataFrame,
    lexicon: DataFrame,
    keys: Sequence[str],
    unknown_tag: str | None = "NN",
    families: Sequence[str] = KEYWORD_TAGS,
) -> DataFrame:
    """``keys…, keywords``: the lower-case nouns, verbs and adjectives of a title, in order.

    A token outside the lexicon counts as ``unknown_tag``; with None it is left out. ``keys``
    identify a title; copies of a title collapse first. Every title has a row, so one without keywords has the empty text.
    """
    keys = list(keys)
    words = F.filter(F.split(F.lower(X.title_without_commas(F.col("title"))), r"\s+"), lambda t: t != "")
    # The marker at the end keeps titles of which no token is left.
    once = titles.select(*keys, "title").distinct()
    listed = once.select(*keys, F.posexplode(F.concat(words, F.array(F.lit("")))).alias("pos", "token"))
    tagged = lookup_join(listed, stored(lexicon.select("token", "tag")), ["token"], "left", spread_by=[*keys, "pos"])
    tag = F.coalesce("tag", F.lit(unknown_tag).cast("string"))
    wanted = (F.col("token") != "") & tag.rlike("|".join(families))
    entry = F.when(wanted, F.struct("pos", "token"))
    ordered = F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["token"])
    return tagged.groupBy(*keys).agg(F.array_join(ordered, " ").alias("keywords"))

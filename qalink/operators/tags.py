"""Tag pairs, their labels, and posts chosen by tag."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qalink.functions import text as X
from qalink.operators.joins import lookup_join, measured_bytes
from qalink.sources.scratch import stored

UNSEEN, NOT_VALID, VALID = 0, 1, 2


def tag_bigrams(
    posts: DataFrame, excluded: Sequence[str] = X.GENERAL_TAGS, above: int = 5
) -> DataFrame:
    """Tag pairs found in more than ``above`` distinct tag strings, with that number."""
    lists = posts.select("tags").distinct()
    pairs = lists.select(F.explode(X.tag_pairs(X.parse_tags(F.col("tags"), excluded))).alias("p"))
    counts = pairs.groupBy("p.tag_a", "p.tag_b").agg(F.count(F.lit(1)).alias("count"))
    return counts.where(F.col("count") > above)


def by_frequency(bigrams: DataFrame) -> DataFrame:
    return bigrams.orderBy(F.desc("count"), "tag_a", "tag_b")


def distinct_tag_count(bigrams: DataFrame) -> DataFrame:
    tags = bigrams.select(F.explode(F.array("tag_a", "tag_b")).alias("tag"))
    return tags.agg(F.countDistinct("tag").alias("tags"))


def selected_tags(labelled: DataFrame) -> DataFrame:
    """Tags labelled valid on either side of a pair."""
    sides = F.array(
        F.when(F.col("label_a") == VALID, F.col("tag_a")), F.when(F.col("label_b") == VALID, F.col("tag_b"))
    )
    return labelled.select(F.explode(F.filter(sides, lambda t: t.isNotNull())).alias("tag")).distinct()


#: Chosen tags up to this measured size are tested inside each row, as a set in the plan.
TAGS_IN_PLAN_BYTES = 1024 * 1024


def posts_with_tags(posts: DataFrame, tags: DataFrame) -> DataFrame:
    """Distinct posts having at least one of ``tags``.

    A set of chosen tags of a bounded, measured size is tested inside each row (Spark turns the
    literal list into a hash set): no explode, no join, one distinct. A larger set is joined.
    """
    columns = posts.columns
    chosen = stored(tags.select("tag").where(F.col("tag").isNotNull()).distinct())
    if measured_bytes(chosen) <= TAGS_IN_PLAN_BYTES:
        wanted = [r["tag"] for r in chosen.collect()]
        if not wanted:
            return posts.limit(0)
        found = F.exists(X.parse_tags(F.col("tags")), lambda t: t.isin(*wanted))
        return posts.where(F.coalesce(found, F.lit(False))).distinct()
    exploded = posts.distinct().withColumn("tag", F.explode(F.array_distinct(X.parse_tags(F.col("tags")))))
    return lookup_join(exploded, chosen, ["tag"], "left_semi").select(*columns).distinct()


def spread_labels(bigrams: DataFrame, labels: DataFrame) -> DataFrame:
    """Give every occurrence of a tag its label; a tag without one stays unseen, of several the highest counts."""
    out, labels = bigrams.select("tag_a", "tag_b"), stored(labels.groupBy("tag").agg(F.max("label").alias("label")))
    for side in ("a", "b"):
        named = labels.select(F.col("tag").alias(f"tag_{side}"), F.col("label").alias(f"label_{side}"))
        out = lookup_join(out, named, [f"tag_{side}"], "left")
    return out.select(
        "tag_a",
        "tag_b",
        F.coalesce("label_a", F.lit(UNSEEN)).alias("label_a"),
        F.coalesce("label_b", F.lit(UNSEEN)).alias("label_b"),
    )


def _label(side: str) -> Column:
    return F.coalesce(F.col(f"label_{side}"), F.lit(UNSEEN))


def label_queue(labelled: DataFrame) -> DataFrame:
    """Pairs that still need a decision: none of the tags is rejected and one is unseen."""
    a, b = _label("a"), _label("b")
    return labelled.where((a != NOT_VALID) & (b != NOT_VALID) & ((a == UNSEEN) | (b == UNSEEN)))


def label_coverage(labelled: DataFrame) -> DataFrame:
    seen = (_label("a") != UNSEEN) | (_label("b") != UNSEEN)
    return labelled.agg(F.count_if(seen).alias("covered"), F.count(F.lit(1)).alias("total"))

"""Tag pairs, labels, posts chosen by tag."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.standins import CATEGORY, EXCLUDED, SELECTED, TAGGED_POSTS, selected, sql_list, sql_split, tagged_posts
from qalink.functions import text as X
from qalink.operators import tags as G
from qalink.plans import tag_mining
from qalink.sources import tables
from qalink.sources.scratch import shared_folder


def tag_bigrams(spark, d):
    return tag_mining.frequent_tag_pairs(selected(spark, d), tagged_posts(spark, d), CATEGORY, EXCLUDED)


def frequent_tag_count(spark, d):
    return G.distinct_tag_count(tag_bigrams(spark, d))


def _pairs(sql_tags, excluded):
    kept = f"list_filter({sql_split(sql_tags)}, lambda t: NOT list_contains({sql_list(excluded)}, t))"
    if not excluded:
        kept = sql_split(sql_tags)
    return f"""
      SELECT tag_a, tag_b, count(*) AS count
      FROM (SELECT DISTINCT tags, least(l[i], l[j]) AS tag_a, greatest(l[i], l[j]) AS tag_b
            FROM (SELECT tags, {kept} AS l FROM posts),
                 unnest(range(1, len(l) + 1)) a(i), unnest(range(1, len(l) + 1)) b(j) WHERE i < j)
      GROUP BY 1, 2 HAVING count(*) > 5"""


_OPENED = "replace(replace(tags, '<', ''), '>', ' ')"
SQL_BIGRAMS = f"""
WITH posts AS (SELECT DISTINCT tags FROM ({SELECTED}) JOIN ({TAGGED_POSTS}) USING (question_id)
               WHERE category = '{CATEGORY}')
{_pairs(_OPENED, EXCLUDED)}
"""

# A label per tag: its length modulo three, unseen ones left out.


def _labels(spark, d):
    tags = tagged_posts(spark, d).select("tags").distinct()
    tag = tags.select(F.explode(X.parse_tags(F.col("tags"))).alias("tag")).distinct()
    return tag.withColumn("label", F.length("tag") % 3).where("label > 0")


def spread_labels(spark, d):
    return G.spread_labels(G.tag_bigrams(tagged_posts(spark, d), ()), _labels(spark, d))


SQL_LABELLED = f"""
WITH posts AS (SELECT DISTINCT tags FROM ({TAGGED_POSTS}))
SELECT tag_a, tag_b, CAST(length(tag_a) % 3 AS INTEGER) AS label_a, CAST(length(tag_b) % 3 AS INTEGER) AS label_b
FROM ({_pairs(_OPENED, ())})
"""


def bigram_labels_load(spark, d):
    folder = shared_folder(spark)
    tables.write_csv(spread_labels(spark, d), folder, header=False)
    return tables.read_bigrams(spark, folder)


def selected_tags(spark, d):
    return G.selected_tags(spread_labels(spark, d))


SQL_SELECTED_TAGS = f"""
SELECT tag_a AS tag FROM ({SQL_LABELLED}) WHERE label_a = 2 UNION SELECT tag_b FROM ({SQL_LABELLED}) WHERE label_b = 2
"""


def posts_with_selected_tags(spark, d):
    return tag_mining.posts_with_selected_tags(
        selected(spark, d), tagged_posts(spark, d), spread_labels(spark, d), CATEGORY
    )


QUERIES = {
    "tag_bigrams": (tag_bigrams, SQL_BIGRAMS),
    "frequent_tag_count": (
        frequent_tag_count,
        f"SELECT count(*) AS tags FROM (SELECT tag_a FROM ({SQL_BIGRAMS}) UNION SELECT tag_b FROM ({SQL_BIGRAMS}))",
    ),
    "spread_labels": (spread_labels, SQL_LABELLED),
    "bigram_labels_load": (bigram_labels_load, SQL_LABELLED),
    "selected_tags": (selected_tags, SQL_SELECTED_TAGS),
    "label_queue": (
        lambda s, d: G.label_queue(spread_labels(s, d)),
        f"SELECT * FROM ({SQL_LABELLED}) WHERE label_a <> 1 AND label_b <> 1 AND (label_a = 0 OR label_b = 0)",
    ),
    "label_coverage": (
        lambda s, d: G.label_coverage(spread_labels(s, d)),
        f"SELECT count(*) FILTER (WHERE label_a <> 0 OR label_b <> 0) AS covered, count(*) AS total FROM ({SQL_LABELLED})",
    ),
    "posts_with_selected_tags": (
        posts_with_selected_tags,
        f"""SELECT DISTINCT question_id, replace(title, ',', '') AS title, tags
            FROM ({SELECTED}) JOIN (SELECT *, {sql_split(_OPENED)} AS l FROM ({TAGGED_POSTS})) USING (question_id)
            WHERE category = '{CATEGORY}' AND list_has_any(l, (SELECT list(tag) FROM ({SQL_SELECTED_TAGS})))""",
    ),
}

"""Posts, joins with categories, votes, usages."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.standins import CATEGORY, SELECTED, TAGGED_POSTS, USAGES, selected, sql_words, table, tagged_posts, usages
from catalog.standins import scored_lines
from qalink.functions import text as X
from qalink.operators import posts as P
from qalink.operators import usages as U
from qalink.operators import votes as O


def drop_null_posts(spark, d):
    events = table(spark, d, "events")
    return P.complete_rows(
        events.select("event_id", "user_id", F.nullif("event_type", F.lit("error")).alias("event_type"))
    )


def category_filter(spark, d):
    return P.of_category(selected(spark, d), "2-HIGH")


def posts_of_category(spark, d):
    return P.posts_of_category(P.of_category(selected(spark, d), CATEGORY), tagged_posts(spark, d))


def answers_of_category(spark, d):
    scores = table(spark, d, "labels").select(
        F.col("doc_id").alias("answer_id"),
        F.concat(F.lit("doc "), "doc_id").alias("title"),
        F.concat(F.lit("quality"), "quality").alias("category"),
        F.col("toxic").cast("double").alias("similarity"),
    )
    posts = table(spark, d, "documents").select(
        F.col("doc_id").alias("answer_id"), F.col("lang").alias("tags"), F.col("text").alias("body")
    )
    return P.answers_of_category(scores, posts, "quality1")


def bodies_per_question(spark, d):
    posts = table(spark, d, "conversations").select(
        F.col("conv_id").alias("question_id"), F.col("turn").alias("answer_id"), F.col("text").alias("body")
    )
    lists = P.bodies_per_question(posts)
    return lists.select(
        "question_id", "chunk", F.size("bodies").alias("n"), F.array_join("bodies", "\n--\n").alias("bodies")
    )


def category_votes(spark, d):
    votes = O.category_votes(scored_lines(spark, d))
    return votes.withColumn("mean_similarity", F.round("mean_similarity", 6))


def majority_category(spark, d):
    chosen = O.majority_category(scored_lines(spark, d), min_similarity=0.05)
    return chosen.withColumn("mean_similarity", F.round("mean_similarity", 6))


def _library_input(spark, d):
    posts = table(spark, d, "documents").select(
        F.col("doc_id").alias("answer_id"),
        F.col("source").alias("title"),
        F.col("source").alias("category"),
        X.word_identifiers(F.col("text")).alias("identifiers"),
    )
    items = table(spark, d, "benchmark").select(
        F.concat(F.lit("src"), F.col("item_id") % 20).alias("category"),
        F.lit("item").alias("group_id"),
        F.col("item_id").cast("string").alias("artifact_id"),
        F.explode(X.word_identifiers(F.col("text"))).alias("token"),
    )
    return posts, items


def library_usages(spark, d):
    return U.library_usages(*_library_input(spark, d), within=["category"])


def library_usages_encoded(spark, d):
    posts, items = _library_input(spark, d)
    return U.encode_usages(posts, U.library_usages(posts, items, within=["category"]))


SQL_USAGES = f"""
SELECT answer_id, title, library, CAST(count(*) AS INTEGER) AS matches
FROM (SELECT DISTINCT doc_id AS answer_id, source AS title, source AS category, unnest({sql_words('text')}) AS token FROM documents)
JOIN (SELECT DISTINCT 'item ' || item_id AS library, 'src' || (item_id % 20) AS category, unnest({sql_words('text')}) AS token
      FROM benchmark) USING (category, token)
GROUP BY 1, 2, 3
"""


def usages_decode(spark, d):
    return U.decode_usages(usages(spark, d))


def best_libraries(spark, d):
    counts = table(spark, d, "events").groupBy(
        F.col("user_id").alias("answer_id"), F.col("event_type").alias("library")
    ).agg(F.count(F.lit(1)).alias("matches"))
    return U.best_libraries(counts)


def titles_per_library(spark, d):
    return U.titles_per_library(usages(spark, d))


def library_title_counts(spark, d):
    return U.title_counts(U.titles_per_library(usages(spark, d)))


SQL_DECODED = f"""
SELECT title, split_part(u, '->', 1) AS library, CAST(split_part(u, '->', 2) AS INTEGER) AS matches
FROM (SELECT title, unnest(string_split(libraries, '|')) AS u FROM ({USAGES}))
"""
SQL_TITLES = f"""
SELECT split_part(u, '->', 1) AS library, title
FROM (SELECT title, l, list_max(list_transform(l, lambda x: CAST(split_part(x, '->', 2) AS INTEGER))) AS best, unnest(l) AS u
      FROM (SELECT title, string_split(libraries, '|') AS l FROM ({USAGES})))
WHERE CAST(split_part(u, '->', 2) AS INTEGER) = best AND best > 1
"""
SQL_VOTES = """
SELECT l_orderkey AS question_id, l_returnflag AS category, count(*) AS votes, avg(l_discount) AS mean_similarity
FROM lineitem GROUP BY 1, 2
"""

QUERIES = {
    "drop_null_posts": (
        drop_null_posts, "SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'error'"
    ),
    "category_filter": (category_filter, f"SELECT * FROM ({SELECTED}) WHERE category = '2-HIGH'"),
    "posts_of_category": (
        posts_of_category,
        f"SELECT DISTINCT question_id, category, answer_id, title, tags FROM ({SELECTED}) JOIN ({TAGGED_POSTS}) "
        f"USING (question_id) WHERE category = '{CATEGORY}'",
    ),
    "answers_of_category": (
        answers_of_category,
        "SELECT DISTINCT l.doc_id AS answer_id, 'doc ' || l.doc_id AS title, 'quality' || quality AS category, "
        "CAST(toxic AS DOUBLE) AS similarity, lang AS tags, text AS body "
        "FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE quality = 1",
    ),
    "bodies_per_question": (
        bodies_per_question,
        "SELECT conv_id AS question_id, 0 AS chunk, CAST(count(*) AS INTEGER) AS n, "
        "string_agg(text, chr(10) || '--' || chr(10) ORDER BY turn) AS bodies FROM conversations GROUP BY 1",
    ),
    "category_votes": (
        category_votes,
        f"SELECT question_id, category, votes, round(mean_similarity, 6) AS mean_similarity FROM ({SQL_VOTES})",
    ),
    "majority_category": (
        majority_category,
        f"""SELECT question_id, category, round(mean_similarity, 6) AS mean_similarity
            FROM (SELECT *, sum(votes) OVER (PARTITION BY question_id) AS n FROM ({SQL_VOTES}))
            WHERE n >= 2 AND votes > n // 2 AND round(mean_similarity, 9) >= 0.05""",
    ),
    "value_counts": (
        lambda s, d: O.value_counts(table(s, d, "events"), "event_type"),
        "SELECT event_type, count(*) AS count FROM events GROUP BY 1",
    ),
    "library_usages": (library_usages, SQL_USAGES),
    "library_usages_encoded": (
        library_usages_encoded,
        f"""SELECT d.doc_id AS answer_id, d.source AS title, coalesce(libraries, '') AS libraries FROM documents d
            LEFT JOIN (SELECT answer_id, string_agg(library || '->' || matches, '|' ORDER BY library || '->' || matches) AS libraries
                       FROM ({SQL_USAGES}) GROUP BY 1) u ON d.doc_id = u.answer_id""",
    ),
    "usages_decode": (usages_decode, SQL_DECODED),
    "best_libraries": (
        best_libraries,
        """SELECT answer_id, library, matches
           FROM (SELECT *, max(matches) OVER (PARTITION BY answer_id) AS best
                 FROM (SELECT user_id AS answer_id, event_type AS library, count(*) AS matches FROM events GROUP BY 1, 2))
           WHERE matches = best AND best > 1""",
    ),
    "titles_per_library": (titles_per_library, SQL_TITLES),
    "library_title_counts": (
        library_title_counts, f"SELECT library, count(*) AS titles FROM ({SQL_TITLES}) GROUP BY 1"
    ),
}

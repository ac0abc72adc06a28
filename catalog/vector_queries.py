"""Word vectors: arithmetic, sentences, neighbours, vector scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.standins import ELEMENTS, VECTORS, label_words, line_words, table, vectors
from qalink.functions import vectors as V
from qalink.operators import scoring as S
from qalink.operators import vectors as W


def _exploded(df, *keys):
    return df.select(*keys, F.posexplode("vector").alias("pos", "x")).withColumn("x", F.round(F.col("x").cast("double"), 6))


def _known_pairs(spark, d):
    pairs = table(spark, d, "lineitem").select(
        F.col("l_partkey").cast("string").alias("word_a"), F.col("l_suppkey").cast("string").alias("word_b")
    ).distinct()
    return W.pair_vectors(pairs, vectors(spark, d))


SQL_PAIRS = f"""
SELECT word_a, word_b, a.embedding AS va, b.embedding AS vb
FROM (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS word_a, CAST(l_suppkey AS VARCHAR) AS word_b FROM lineitem)
JOIN ({VECTORS}) a ON word_a = a.word JOIN ({VECTORS}) b ON word_b = b.word
"""


def vector_lookup(spark, d):
    words = line_words(spark, d).distinct()
    found = W.lookup_vectors(words, vectors(spark, d))
    return found.select("word", "known", F.size("vector").alias("n"))


def vector_pairs(measure):
    def run(spark, d):
        value = F.round(measure(F.col("vector_a"), F.col("vector_b")), 6)
        return _known_pairs(spark, d).select("word_a", "word_b", value.alias("value"))

    return run


def vector_normalize(spark, d):
    v = F.col("vector")
    return _exploded(vectors(spark, d).select("word", F.round(V.magnitude(v), 6).alias("magnitude"), V.normalize(v).alias("vector")), "word", "magnitude")


def vector_sum(spark, d):
    return _exploded(W.vector_sums(line_words(spark, d, "l_orderkey"), vectors(spark, d), ["l_orderkey"]), "l_orderkey")


def sentence_vectors(spark, d):
    return _exploded(W.sentence_vectors(line_words(spark, d, "l_suppkey"), vectors(spark, d), ["l_suppkey"]), "l_suppkey")


def n_similarity(spark, d):
    side = F.when(F.col("l_linestatus") == "F", "a").otherwise("b").alias("side")
    words = line_words(spark, d, "l_orderkey", side)
    return W.n_similarity(words, vectors(spark, d), ["l_orderkey"]).withColumn("similarity", F.round("similarity", 6))


def _label_queries(spark, d):
    return label_words(spark, d).withColumnRenamed("category", "query_id")


def _found(df, *columns):
    return df.select(*columns, "word", F.round("score", 6).alias("score"))


def nearest_neighbors(spark, d):
    queries = W.vector_sums(_label_queries(spark, d), vectors(spark, d), ["query_id"])
    return _found(W.nearest_neighbors(vectors(spark, d), queries, 10), "query_id", "rank")


def nearest_to_words(spark, d):
    return _found(W.nearest_to_words(_label_queries(spark, d), vectors(spark, d), 10), "query_id", "rank")


def _triples(spark, d):
    first = F.get("embedding", F.lit(0))
    return table(spark, d, "embeddings").groupBy(F.col("label").alias("query_id")).agg(
        F.min("vec_id").cast("string").alias("word1"),
        F.max("vec_id").cast("string").alias("word2"),
        F.max_by("vec_id", first).cast("string").alias("word3"),
    )


def analogy(spark, d):
    return _found(W.analogy(_triples(spark, d), vectors(spark, d), 10), "query_id", "rank")


def rank_words(spark, d):
    embeddings = table(spark, d, "embeddings")
    centers = embeddings.groupBy("label").agg(F.min("vec_id").cast("string").alias("center"))
    sets = embeddings.join(centers, "label").select("center", F.col("vec_id").cast("string").alias("word"))
    return _found(W.rank_words(sets, vectors(spark, d)), "center")


def closest_category_ml(spark, d):
    words = line_words(spark, d, "l_orderkey")
    closest = S.closest_category(words, label_words(spark, d), vectors(spark, d), ["l_orderkey"])
    return closest.withColumn("similarity", F.round("similarity", 6))


SQL_LINES = f"""
lines AS (SELECT l_orderkey, l_suppkey, l_linestatus, CAST(l_partkey AS VARCHAR) AS word FROM lineitem),
e AS ({ELEMENTS}), v AS ({VECTORS})
"""


def _sql_unit(name, source, keys):
    return f"""
    {name}_s AS (SELECT {keys}, i, sum(x) AS s FROM {source} GROUP BY {keys}, i),
    {name} AS (SELECT {keys}, i, s / nullif(sqrt(sum(s * s) OVER (PARTITION BY {keys})), 0) AS u FROM {name}_s)
    """


def _sql_top(scores, n, exclude="true"):
    return f"""
    SELECT query_id, CAST(rank AS INTEGER) AS rank, word, round(round(score, 9), 6) AS score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, word) AS rank
          FROM ({scores}) WHERE {exclude}) WHERE rank <= {n}
    """


SQL_QUERIES = f"""
{SQL_LINES}, {_sql_unit('q', '(SELECT label AS query_id, i, x FROM e)', 'query_id')},
{_sql_unit('w', 'e', 'word, label')}
"""
SQL_LABEL_SCORES = """
SELECT 'c' || query_id AS query_id, word, label, sum(q.u * w.u) AS score FROM q JOIN w USING (i) GROUP BY query_id, word, label
"""

QUERIES = {
    "vector_stats": (
        lambda s, d: W.vector_stats(vectors(s, d)),
        f"SELECT count(*) AS words, CAST(max(len(embedding)) AS INTEGER) AS dimension FROM ({VECTORS})",
    ),
    "vector_lookup": (
        vector_lookup,
        f"""SELECT l.word, v.word IS NOT NULL AS known, CAST(coalesce(len(embedding), 0) AS INTEGER) AS n
            FROM (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS word FROM lineitem) l LEFT JOIN ({VECTORS}) v ON l.word = v.word""",
    ),
    "vector_euclidean": (
        vector_pairs(V.euclidean),
        f"SELECT word_a, word_b, round(list_distance(CAST(va AS DOUBLE[]), CAST(vb AS DOUBLE[])), 6) AS value FROM ({SQL_PAIRS})",
    ),
    "vector_cosine": (
        vector_pairs(V.cosine),
        f"SELECT word_a, word_b, round(list_cosine_similarity(CAST(va AS DOUBLE[]), CAST(vb AS DOUBLE[])), 6) AS value FROM ({SQL_PAIRS})",
    ),
    "vector_normalize": (
        vector_normalize,
        f"""SELECT word, round(m, 6) AS magnitude, CAST(i - 1 AS INTEGER) AS pos, round(x / m, 6) AS x
            FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY word)) AS m FROM ({ELEMENTS}))""",
    ),
    "vector_sum": (
        vector_sum,
        f"""WITH {SQL_LINES},
            whole AS (SELECT l_orderkey FROM lines LEFT JOIN v USING (word) GROUP BY 1 HAVING count(*) = count(embedding))
            SELECT l_orderkey, CAST(i - 1 AS INTEGER) AS pos, round(sum(x), 6) AS x
            FROM lines JOIN e USING (word) WHERE l_orderkey IN (SELECT l_orderkey FROM whole) GROUP BY l_orderkey, i""",
    ),
    "sentence_vectors": (
        sentence_vectors,
        f"""WITH {SQL_LINES}, {_sql_unit('s', 'lines JOIN e USING (word)', 'l_suppkey')}
            SELECT l_suppkey, CAST(i - 1 AS INTEGER) AS pos, round(u, 6) AS x FROM s""",
    ),
    "n_similarity": (
        n_similarity,
        f"""WITH {SQL_LINES}, {_sql_unit('s', 'lines JOIN e USING (word)', 'l_orderkey, l_linestatus')}
            SELECT a.l_orderkey, round(sum(a.u * b.u), 6) AS similarity FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey
              AND a.i = b.i AND a.l_linestatus = 'F' AND b.l_linestatus <> 'F' GROUP BY 1""",
    ),
    "nearest_neighbors": (nearest_neighbors, f"WITH {SQL_QUERIES} {_sql_top(SQL_LABEL_SCORES, 10)}"),
    "nearest_to_words": (
        nearest_to_words, f"WITH {SQL_QUERIES} {_sql_top(SQL_LABEL_SCORES, 10, 'query_id <> ' + chr(39) + 'c' + chr(39) + ' || label')}"
    ),
    "analogy": (
        analogy,
        f"""WITH {SQL_LINES}, {_sql_unit('w', 'e', 'word')},
            t AS (SELECT label AS query_id, CAST(min(vec_id) AS VARCHAR) AS w1, CAST(max(vec_id) AS VARCHAR) AS w2,
                         CAST(arg_max(vec_id, embedding[1]) AS VARCHAR) AS w3 FROM embeddings GROUP BY 1),
            {_sql_unit('q', '(SELECT query_id, b.i, b.x - a.x + c.x AS x FROM t JOIN e a ON a.word = w1 JOIN e b ON b.word = w2 AND b.i = a.i JOIN e c ON c.word = w3 AND c.i = a.i)', 'query_id')}
            {_sql_top("SELECT q.query_id, word, w1, w2, w3, sum(q.u * w.u) AS score FROM q JOIN w USING (i) JOIN t ON t.query_id = q.query_id GROUP BY 1, 2, 3, 4, 5", 10, "word NOT IN (w1, w2, w3)")}""",
    ),
    "rank_words": (
        rank_words,
        f"""WITH {SQL_LINES}, {_sql_unit('w', 'e', 'word, label')},
            centers AS (SELECT label, CAST(min(vec_id) AS VARCHAR) AS center FROM embeddings GROUP BY 1)
            SELECT center, b.word, round(round(sum(a.u * b.u), 9), 6) AS score
            FROM centers JOIN w a ON a.word = center JOIN w b ON b.label = centers.label AND a.i = b.i GROUP BY 1, 2""",
    ),
    "closest_category_ml": (
        closest_category_ml,
        f"""WITH {SQL_LINES}, {_sql_unit('c', '(SELECT label, i, x FROM e)', 'label')},
            {_sql_unit('s', 'lines JOIN e USING (word)', 'l_orderkey')}
            SELECT l_orderkey, category, round(score, 6) AS similarity
            FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(score, 9) DESC, category) AS r
                  FROM (SELECT l_orderkey, 'c' || label AS category, sum(s.u * c.u) AS score FROM s JOIN c USING (i) GROUP BY 1, 2))
            WHERE r = 1""",
    ),
}

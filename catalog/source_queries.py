"""Tables written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.standins import VECTORS, table, vectors
from qalink import schemas
from qalink.sources import tables, word_vectors
from qalink.sources.scratch import shared_folder


def csv_roundtrip(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("question_id"),
        F.col("l_linenumber").cast("long").alias("answer_id"),
        F.concat(F.lit("part "), "l_partkey").alias("title"),
        F.col("l_returnflag").alias("category"),
        F.col("l_discount").alias("similarity"),
    )
    folder = shared_folder(spark)
    tables.write_csv(rows, folder)
    return tables.read_csv(spark, folder, schemas.SIMILARITIES)


def csv_quoted_roundtrip(spark, d):
    rows = table(spark, d, "documents").select(
        F.col("doc_id").alias("question_id"),
        F.col("doc_id").alias("answer_id"),
        F.concat(F.lit('a "quoted", '), "source").alias("title"),
        F.concat(F.lit('<p class="b">'), "text", F.lit("</p>")).alias("body"),
        F.concat(F.lit("<"), "lang", F.lit(">")).alias("tags"),
    )
    folder = shared_folder(spark)
    tables.write_csv(rows, folder, quoted=True)
    return tables.read_csv(spark, folder, schemas.POSTS, quoted=True, multi_line=True)


def word_vectors_load(spark, d):

    words = vectors(spark, d)
    folder = shared_folder(spark)
    word_vectors.write_word_vectors(words, folder)
    loaded = word_vectors.read_word_vectors(spark, folder)
    return loaded.select("word", F.posexplode("vector").alias("pos", "x"))


QUERIES = {
    "csv_roundtrip": (
        csv_roundtrip,
        "SELECT l_orderkey AS question_id, CAST(l_linenumber AS BIGINT) AS answer_id, 'part ' || l_partkey AS title, "
        "l_returnflag AS category, l_discount AS similarity FROM lineitem",
    ),
    "csv_quoted_roundtrip": (
        csv_quoted_roundtrip,
        """SELECT doc_id AS question_id, doc_id AS answer_id, 'a "quoted", ' || source AS title,
                  '<p class="b">' || text || '</p>' AS body, '<' || lang || '>' AS tags FROM documents""",
    ),
    "word_vectors_load": (
        word_vectors_load,
        f"SELECT word, CAST(i - 1 AS INTEGER) AS pos, embedding[i] AS x FROM ({VECTORS}), range(1, 65) t(i)",
    ),
}

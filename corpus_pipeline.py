"""From raw documents to token ids: quality, exact copies, near copies, source mix, encoding.

``STAGES`` are (name, function) pairs; a function takes ``(spark, docs, sf_dir)`` and returns a table
that is written as Parquet and read again as the next one's ``docs``. Every stage works on all rows
its predecessor kept and passes on the columns of ``documents``; the last gives the encoded rows.
Null text counts as empty in every stage; an empty table passes through as one; rows that repeat
id and text are copies, of which one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qalink.llm import cuckoo, kneser_ney, merge_automaton, mixing, near_copies
from qalink.llm.queries import tokenizer_path
from qalink.sources.scratch import shared_folder

#: A language model over scored text is no SQL query; tests run the stages against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose perplexity is above their language's threshold."""
    return kneser_ney.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts."""
    return cuckoo.without_duplicates(docs)


def near_copy_classes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near copies."""
    return near_copies.one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that the sources come near their targets."""
    return mixing.emitted(mixing.mix(docs))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256`` of every row, repeated ones too."""
    encoded = merge_automaton.encode(docs.select("doc_id", "text"), tokenizer_path())
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("quality", quality),
    ("exact copies", exact_copies),
    ("near copies", near_copy_classes),
    ("source mix", source_mix),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        folder = shared_folder(spark)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs

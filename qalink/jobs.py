"""The jobs as one command, from folder to folder.

``qalink JOB --input FOLDER --output FOLDER [--category NAME] [--format parquet|csv] [--work-dir FOLDER]``

The input folder holds one table per name of ``TABLES``, as a file or a folder. A job reads what
it needs and writes its result as Parquet, or as CSV with a header. Each job is one lazy plan
that the tasks write out; the next job reads it as it is. Intermediate tables go to the work
folder, which all executors must share (by default ``spark.checkpoint.dir``), and are removed at
the end. Bodies with line breaks make a CSV file one task; Parquet splits.
"""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Callable

if __package__ in (None, ""):  # started as a script: its folder stands first instead of the package's
    sys.path[0] = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession

from qalink import schemas
from qalink.functions import text as X
from qalink.operators.posts import complete_rows
from qalink.plans import categories, library_use, tag_mining
from qalink.sources import archives, tables
from qalink.sources.scratch import remove_folders, stored
from qalink.sources.word_vectors import read_word_vectors

TABLES = {
    "posts": schemas.POSTS,
    "similarities": schemas.SIMILARITIES,
    "selected_posts": schemas.SELECTED_POSTS,
    "libraries_selected": schemas.LIBRARIES_SELECTED,
    "libraries_details": schemas.LIBRARIES_DETAILS,
    "library_versions": schemas.LIBRARY_VERSIONS,
    "library_info": schemas.LIBRARY_INFO,
    "symbols": schemas.SYMBOLS,
    "lexicon": schemas.LEXICON,
    "usages": schemas.USAGES,
    "bigrams": schemas.BIGRAMS,
}


class Inputs:
    """Tables of the input folder by name."""

    def __init__(self, spark: SparkSession, folder: str, kind: str = "csv", category: str = "") -> None:
        self.spark, self.folder, self.kind, self.category = spark, folder.rstrip("/"), kind, category

    def __getitem__(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        if name == "vectors":
            return stored(read_word_vectors(self.spark, path))  # read several times
        if self.kind == "parquet":
            return tables.read_table(self.spark, path, deal_out=name == "posts")
        if name == "bigrams":
            return tables.read_bigrams(self.spark, path)
        # Post bodies may hold line breaks inside their quotes.
        return tables.read_csv(self.spark, path, TABLES[name], quoted=True, multi_line=name == "posts")


def _score_answers(t: Inputs) -> DataFrame:
    scored = categories.score_answers(
        t["posts"], t["libraries_selected"], t["libraries_details"], t["symbols"], t["vectors"]
    )
    return scored.select(*TABLES["similarities"].names)


def _score_questions(t: Inputs) -> DataFrame:
    return categories.score_questions(t["posts"], t["libraries_selected"], t["libraries_details"], t["symbols"])


def _select_questions(t: Inputs) -> DataFrame:
    return tag_mining.select_questions(t["similarities"])


def _mine_tags(t: Inputs) -> DataFrame:
    return tag_mining.frequent_tag_pairs(t["selected_posts"], t["posts"], t.category, X.GENERAL_TAGS)


def _select_posts(t: Inputs) -> DataFrame:
    return tag_mining.posts_with_selected_tags(t["selected_posts"], t["posts"], t["bigrams"], t.category)


def _extract_usages(t: Inputs) -> DataFrame:
    return library_use.extract_usages(
        t["similarities"], t["posts"], t["library_versions"], t["symbols"], t["lexicon"], t.category
    )


def _classify_posts(t: Inputs) -> DataFrame:
    return library_use.classify_posts(t["similarities"], t["posts"], t.category).drop("body")


def _analyze_usages(t: Inputs) -> DataFrame:
    return library_use.analyze_usages(t["usages"])


def _list_symbols(t: Inputs) -> DataFrame:
    return archives.class_symbols(archives.archive_entries(t.spark, f"{t.folder}/archives"))


def _clean_posts(t: Inputs) -> DataFrame:
    return complete_rows(t["posts"])


JOBS: dict[str, Callable[[Inputs], DataFrame]] = {
    "score-answers": _score_answers,
    "score-questions": _score_questions,
    "select-questions": _select_questions,
    "mine-tags": _mine_tags,
    "select-posts": _select_posts,
    "extract-usages": _extract_usages,
    "classify-posts": _classify_posts,
    "analyze-usages": _analyze_usages,
    "list-symbols": _list_symbols,
    "clean-posts": _clean_posts,
}


def run(spark: SparkSession, job: str, source: str, target: str, category: str = "", kind: str = "csv") -> None:
    result = JOBS[job](Inputs(spark, source, kind, category))
    if kind == "parquet":
        tables.write_table(result, target)
    else:
        tables.write_csv(result, target, quoted=True)


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("job", choices=sorted(JOBS))
    parser.add_argument("--input", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--category", default="")
    parser.add_argument("--format", choices=("csv", "parquet"), default="parquet")
    parser.add_argument("--work-dir")
    given = parser.parse_args()
    builder = SparkSession.builder.appName(f"qalink {given.job}")
    if given.work_dir:
        builder = builder.config("spark.checkpoint.dir", given.work_dir)
    spark = builder.getOrCreate()
    try:
        run(spark, given.job, given.input, given.output, given.category, given.format)
    finally:
        remove_folders(spark)


if __name__ == "__main__":
    main()

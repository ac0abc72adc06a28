"""Listing of library archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qalink import schemas


# Rows gathered before they are handed on.
_ROWS_AT_ONCE = 100_000


def _frame(rows: list[tuple[str, str]]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=["path", "entry"])
    return df.assign(is_dir=df["entry"].str.endswith("/").astype(bool))


def _list(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows: list[tuple[str, str]] = []
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    rows += [(path, entry) for entry in archive.namelist()]
            except zipfile.BadZipFile:
                continue
            if len(rows) >= _ROWS_AT_ONCE:
                yield _frame(rows)
                rows = []
    if rows:
        yield _frame(rows)


def list_entries(files: DataFrame) -> DataFrame:
    """``path, entry, is_dir`` of archives given as ``path, content``; unreadable ones have no rows,
    see :func:`unreadable`."""
    return files.select("path", "content").mapInPandas(_list, schemas.ARCHIVE_ENTRIES)


def archive_entries(spark: SparkSession, path: str, pattern: str = "*.jar") -> DataFrame:
    """:func:`list_entries` for every archive below ``path``."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(path)
    )
    return list_entries(files)


def unreadable(files: DataFrame) -> DataFrame:
    """``path`` of the archives given as ``path, content`` that :func:`list_entries` has no rows for."""
    readable = list_entries(files).select("path").distinct()
    return files.select("path").join(readable, "path", "left_anti")


def class_symbols(entries: DataFrame) -> DataFrame:
    """Class rows of ``symbols`` from ``entries(path, entry)``: the inverse of ``jar_path``.

    ``…/org/json/json/1.2/json-1.2.jar`` is group ``org.json``, artifact ``json``, version ``1.2``; an
    entry ``a/b/C$D.class`` is the class ``a.b.C$D``. A path names a group in as many folders as follow
    the last one called ``archives``, or ``repository``, or else all of them. Other paths and entries
    have no rows. ``ord`` is a hash of the class name; members are not listed.
    """
    parts = F.split(F.regexp_replace("path", r"^.*/(?:archives|repository)/", ""), "/")
    size = F.size(parts)
    artifact, version = F.get(parts, size - 3), F.get(parts, size - 2)
    named = F.get(parts, size - 1) == F.concat(artifact, F.lit("-"), version, F.lit(".jar"))
    classes = entries.where(F.col("entry").rlike(r"\.class$") & ~F.col("entry").rlike(r"(?:^|/)module-info\.class$"))
    rows = classes.where((size > 3) & named).select(
        F.array_join(F.slice(parts, F.lit(1), size - 3), ".").alias("group_id"),
        artifact.alias("artifact_id"),
        version.alias("version"),
        F.translate(F.regexp_replace("entry", r"\.class$", ""), "/", ".").alias("class_name"),
        F.lit(None).cast("string").alias("member_name"),
    )
    return rows.distinct().withColumn("ord", F.xxhash64("class_name"))

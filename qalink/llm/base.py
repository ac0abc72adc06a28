"""What several operators share."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterable, Iterator
from types import ModuleType

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space, as all contracts here define it: [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def text_of(column: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A digest of id and whole text: equal only for rows that repeat both."""
    said = F.coalesce(F.concat(F.lit("="), F.col(doc_id).cast("string")), F.lit("-"))
    return F.md5(F.concat_ws("\n", said, F.coalesce(F.concat(F.lit("="), F.col(text)), F.lit("-"))))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def shards_for(df: DataFrame, rows: int, rows_per_shard: int) -> int:
    """Enough shards that none holds much more than ``rows_per_shard``, and all cores have work."""
    return max(-(-rows // rows_per_shard), partitions(df), 1)


def per_process(name: str, make: Callable[[], object]) -> object:
    """One object per Python worker and name, made when first asked for.

    Functions of this package come to a worker anew with every task, so they cannot hold it.
    """
    held = sys.modules.setdefault("_qalink_held", ModuleType("_qalink_held")).__dict__
    if name not in held:
        held[name] = make()
    return held[name]


def tidied(task: Callable[[Iterator], Iterable]) -> Callable[[Iterator], Iterator]:
    """The function of a partition, after which its worker gives freed memory back to the system.

    Workers wait for more tasks, and for a while they stay in memory beside those of the next stages.
    """

    def run(items: Iterator) -> Iterator:
        yield from task(items)
        gc.collect()  # tables that know their owner are not freed before
        for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
            pool.release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps what lies between objects in use
            trim(0)

    return run

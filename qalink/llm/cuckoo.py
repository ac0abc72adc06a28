"""Exact deduplication through a sharded cuckoo-filter index of live digests.

A shard owns the digests of one hash range. It holds a cuckoo filter (16-bit marks, four to a
bucket) and, slot by slot beside the marks, the stored keys: the full SHA-256 digests. A mark that
matches is only a hint; the digest stored in that slot decides. When an insertion finds no room,
the filter is rebuilt with twice the buckets from the stored keys. Keys can be deleted again, since
each mark belongs to one key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qalink.llm.base import WHITE, row_key, shards_for, text_of
from qalink.sources.scratch import stored

SLOTS = 4
MAX_KICKS = 200
ROWS_PER_SHARD = 65_536
#: One digest reaches its shard in at most so many rows, however many documents have it.
PIECES = 16


class CuckooShard:
    """Live 32-byte digests with a number each."""

    def __init__(self, buckets: int = 64):
        self.values: dict[bytes, int] = {}
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.buckets = buckets
        self.marks = np.zeros(buckets * SLOTS, np.uint16)
        self.keys: list[bytes | None] = [None] * (buckets * SLOTS)

    def __len__(self) -> int:
        return len(self.values)

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[8:10], "little") or 1
        first = int.from_bytes(digest[:8], "little") & (self.buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & (self.buckets - 1)

    def _slot(self, digest: bytes) -> int:
        """The slot whose mark matches and whose stored key is this digest, or -1."""
        mark, first, second = self._places(digest)
        for bucket in (first, second):
            at = bucket * SLOTS
            for slot in range(at, at + SLOTS):
                if self.marks[slot] == mark and self.keys[slot] == digest:
                    return slot
        return -1

    def __contains__(self, digest: bytes) -> bool:
        return self._slot(digest) >= 0

    def _put(self, digest: bytes) -> bool:
        mark, bucket, second = self._places(digest)
        for b in (bucket, second):
            for slot in range(b * SLOTS, b * SLOTS + SLOTS):
                if self.keys[slot] is None:
                    self.marks[slot], self.keys[slot] = mark, digest
                    return True
        for kick in range(MAX_KICKS):
            slot = bucket * SLOTS + kick % SLOTS
            out_mark, out_key = int(self.marks[slot]), self.keys[slot]
            self.marks[slot], self.keys[slot] = mark, digest
            mark, digest = out_mark, out_key
            bucket = self._other(bucket, mark)
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.keys[slot] is None:
                    self.marks[slot], self.keys[slot] = mark, digest
                    return True
        return False

    def insert(self, digest: bytes, value: int = 0) -> bool:
        """Whether the digest is new; a live one keeps its value."""
        if self._slot(digest) >= 0:
            return False
        self.values[digest] = value
        if len(self.values) > 0.95 * self.buckets * SLOTS or not self._put(digest):
            self._resize()
        return True

    def _resize(self) -> None:
        """Twice the buckets, filled from the stored keys; again, should that overflow."""
        buckets = self.buckets
        while True:
            buckets *= 2
            self._clear(buckets)
            if all(self._put(key) for key in self.values):
                return

    def delete(self, digest: bytes) -> bool:
        slot = self._slot(digest)
        if slot < 0:
            return False
        self.marks[slot], self.keys[slot] = 0, None
        del self.values[digest]
        return True


# The index as a table: one row per shard.

INDEX = "shard int, buckets int, keys binary"


def _load(rows: pd.DataFrame) -> CuckooShard:
    shard = CuckooShard(int(rows["buckets"].iloc[0]) if len(rows) else 64)
    for keys in rows["keys"]:
        for at in range(0, len(keys), 32):
            shard.insert(bytes(keys[at : at + 32]))
    return shard


def _saved(number: int, shard: CuckooShard) -> pd.DataFrame:
    return pd.DataFrame({"shard": [number], "buckets": [shard.buckets], "keys": [b"".join(sorted(shard.values))]})


def shard_of(digest: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(shards)).cast("int").alias("shard")


def build_index(digests: DataFrame, shards: int) -> DataFrame:
    """``shard, buckets, keys``: an index of the non-null digests of ``digests(digest binary)``."""
    live = digests.where("digest is not null").select("digest").distinct()

    def build(key, rows: pd.DataFrame) -> pd.DataFrame:
        shard = CuckooShard()
        for digest in rows["digest"]:
            shard.insert(bytes(digest))
        return _saved(int(key[0]), shard)

    return live.select("digest", shard_of(F.col("digest"), shards)).groupBy("shard").applyInPandas(build, INDEX)


def update_index(index: DataFrame, changes: DataFrame, shards: int) -> DataFrame:
    """The index after ``changes(digest, live)``: true inserts, false deletes.

    Of several changes of one digest a true one wins; a null in either column changes nothing.
    ``shards`` is the number the index was built with; a shard grows by resizing, and
    ``build_index`` deals keys out anew when there should be more shards.
    """
    once = changes.where("digest is not null and live is not null").groupBy("digest").agg(F.max("live").alias("live"))
    dealt = once.select("digest", "live", shard_of(F.col("digest"), shards))

    def change(key, old: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        shard = _load(old)
        for digest, live in zip(rows["digest"], rows["live"]):
            if live:
                shard.insert(bytes(digest))
            else:
                shard.delete(bytes(digest))
        return _saved(int(key[0]), shard)

    return index.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInPandas(change, INDEX)


def probe_index(index: DataFrame, digests: DataFrame, shards: int) -> DataFrame:
    """``digest, live`` for each different digest; ``shards`` as built."""
    dealt = digests.where("digest is not null").select("digest").distinct()
    dealt = dealt.select("digest", shard_of(F.col("digest"), shards))

    def probe(old: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        shard = _load(old)
        return pd.DataFrame({"digest": rows["digest"], "live": [bytes(d) in shard for d in rows["digest"]]})

    return index.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInPandas(probe, "digest binary, live boolean")


# Deduplication of documents.


def _fold(key, rows: pd.DataFrame) -> pd.DataFrame:
    """Pieces of digests into one row per live digest: its number of rows and its best row."""
    shard = CuckooShard()
    kept: list[list] = []
    for digest, count, chars, order, tag in zip(
        rows["digest"], rows["count"], rows["chars"], rows["rank"], rows["tag"]
    ):
        digest, best = bytes(digest), (chars, order, tag)
        if shard.insert(digest, len(kept)):
            kept.append([digest, count, best])
        else:
            entry = kept[shard.values[digest]]
            entry[1] += count
            entry[2] = max(entry[2], best)
    return pd.DataFrame(
        [(d, n, tag) for d, n, (_, _, tag) in kept], columns=["digest", "group_size", "keep_tag"]
    ).astype({"group_size": "int64", "keep_tag": "int64"})


def duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256, row_key`` for every row of ``docs(doc_id, text)``.

    Texts are equal when they are the same without ASCII white space. The row with the most code
    points stays, then the one with the smallest ``doc_id``, a null id last; of rows that repeat
    both, one stays. Null text is the empty text, and all empty texts are equal. Further columns of
    ``docs`` are ignored, whatever their names. An empty table gives no rows.

    Texts are read once: everything after that works on ids and digests, which are stored. Each
    digest is first gathered into at most ``PIECES`` rows, so a digest that a third of all
    documents share is no burden to its shard. The join back is by digest, and adaptive execution
    splits hot ones.
    """
    text = text_of()
    rows = stored(
        docs.select(
            "doc_id",
            F.length(text).cast("long").alias("chars"),
            F.unhex(F.sha2(F.translate(text, WHITE, ""), 256)).alias("digest"),
            row_key().alias("row_key"),
            F.monotonically_increasing_id().alias("tag"),
        )
    )
    # ~doc_id falls as doc_id grows, over all long values; the smallest number is left for null.
    rank = F.coalesce(F.bitwise_not(F.col("doc_id").cast("long")), F.lit(-(2**63)))
    pieces = rows.groupBy("digest", F.pmod("tag", F.lit(PIECES)).alias("piece")).agg(
        F.count(F.lit(1)).alias("count"), F.max(F.struct("chars", rank.alias("rank"), "tag")).alias("best")
    )
    shards = shards_for(docs, rows.count(), ROWS_PER_SHARD)
    live = (
        pieces.select("digest", "count", "best.*", shard_of(F.col("digest"), shards))
        .groupBy("shard")
        .applyInPandas(_fold, "digest binary, group_size long, keep_tag long")
    )
    live = stored(live)
    ids = rows.select(F.col("tag").alias("keep_tag"), F.col("doc_id").alias("keep_id"))
    live = live.join(ids, "keep_tag")
    return rows.join(live, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("tag") == F.col("keep_tag")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "row_key",
    )


def without_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay by ``duplicates``, with all their columns."""
    keep = duplicates(docs).where("kept").select(F.col("row_key").alias("k"))
    packed = docs.select(F.struct("*").alias("row"), row_key().alias("k"))
    # Rows that repeat id and text have one key, of which one row stays.
    return packed.join(keep, "k", "left_semi").dropDuplicates(["k"]).select("row.*")

"""Near copies: documents whose sets of word n-grams have a Jaccard similarity of 0.8 or more.

Documents of equal sets are one node. Nodes get a MinHash signature, cut into bands; as many rows
to a band as a bound on the hashes allows, and as many bands as the wanted recall at the threshold
then needs. Nodes are shuffled on band hashes. Within a band each node is tied to the smallest one
only, so bands cost a row per node, however full they are. What hangs together by such ties is a
cluster: every candidate pair lies within one.

Clusters are verified on the full n-gram sets. Their nodes are cut into blocks of a bounded size,
and a task compares two blocks: shared n-grams are counted for all pairs at once, by products of
membership matrices. It passes on how many links each node has and a tree over linked nodes, never
the pairs.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qalink.llm.base import row_key, text_of, tidied
from qalink.llm.components import components
from qalink.operators.joins import lookup_join
from qalink.sources.scratch import stored

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.9999
MAX_HASHES = 192
BLOCK_NODES = 1024
CHUNK_SIGNS = 1_000_000
CHUNK_ROWS = 1_000
MEMO_WORDS = 50_000
_COLUMNS = 2048

_WORD = re.compile(r"[^ \t-\r]+").findall
_P = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows whose bands, at this recall, fit the number of hashes."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1)
    for rows in range(2, 33):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    return best


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """64-bit hash of each word."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        raw = hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest()
        found = self[word] = int.from_bytes(raw, "little")
        return found


def ngram_sets(texts: list[str], words: dict[str, int], n: int) -> list[np.ndarray]:
    """The different word n-grams of each text as sorted 64-bit hashes.

    Words are lower-case runs of signs other than ASCII white space. A text of fewer words than
    ``n`` has one n-gram, all of its words; a text without words has none.
    """
    cut = [_WORD(text.lower()) for text in texts]
    lengths = np.fromiter(map(len, cut), np.int64, len(cut))
    flat = np.fromiter((words[w] for some in cut for w in some), np.uint64, int(lengths.sum()))
    ends = np.cumsum(lengths)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(flat) - n + 1), np.uint64)
        for i in range(n):
            rolled = rolled * _P + flat[i : len(flat) - n + 1 + i]
        rolled = _mixed(rolled)
        out = []
        for end, length in zip(ends.tolist(), lengths.tolist()):
            if length >= n:
                out.append(np.unique(rolled[end - length : end - n + 1]))
            else:
                short = np.uint64(length)
                for w in flat[end - length : end]:
                    short = short * _P + w
                out.append(_mixed(np.array([short], np.uint64)) if length else np.zeros(0, np.uint64))
    return out


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """One hash per set (none empty) and band."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    low = (flat >> np.uint64(32)).astype(np.uint32)
    rng = np.random.default_rng(20_240_601)
    factors = rng.integers(0, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    masks = rng.integers(0, 2**32, bands * rows, dtype=np.uint32)
    out = np.zeros((len(sets), bands), np.uint64)
    with np.errstate(over="ignore"):
        for band in range(bands):
            h = np.full(len(sets), band + 1, np.uint64)
            for row in range(band * rows, band * rows + rows):
                x = (low ^ masks[row]) * factors[row]
                x ^= x >> np.uint32(15)
                h = _mixed(h * _P + np.minimum.reduceat(x, starts))
            out[:, band] = h
    return out.view(np.int64)


def _slices(batch: pa.RecordBatch, texts: int) -> Iterator[pa.RecordBatch]:
    """A batch in pieces, as only one is taken out of Arrow at a time; ``texts`` is the column whose size counts."""
    start = size = 0
    for i, more in enumerate(pc.binary_length(batch.column(texts)).to_pylist()):
        size += more
        if size >= CHUNK_SIGNS or i + 1 - start >= CHUNK_ROWS or i + 1 == batch.num_rows:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, key, set_id, size, bands`` per row; without words ``set_id`` and ``bands`` are null."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for some in (some for batch in batches for some in _slices(batch, 2)):
            sets = ngram_sets(some.column(2).to_pylist(), words, n)
            full = [s for s in sets if len(s)]
            signed = iter(band_hashes(full, bands, rows).tolist() if full else [])
            ids = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            hashes = [next(signed) if len(s) else None for s in sets]
            sizes = [len(s) for s in sets]
            arrays = [pa.array(ids, pa.binary()), pa.array(sizes, pa.int32()), pa.array(hashes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [*some.columns[:2], *arrays], names=["doc_id", "key", "set_id", "size", "bands"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", F.unhex(row_key()).alias("key"), text_of().alias("text"))
    return read.mapInArrow(tidied(sign), f"doc_id {kind}, key binary, set_id binary, size int, bands array<long>")


# Verification.


def linked(a: list[np.ndarray], b: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Which sets of ``a`` are similar to which of ``b``; within ``a`` if there is no ``b``."""
    sets = a if b is None else a + b
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    codes, found = pd.factorize(np.concatenate(sets))
    shared = np.bincount(codes, minlength=len(found)) > 1
    keep = shared[codes]
    owner, codes = owner[keep], (np.cumsum(shared) - 1)[codes[keep]]
    order = np.argsort(codes, kind="stable")
    owner, codes = owner[order], codes[order]
    split = len(a)
    common = np.zeros((split, len(sets) if b is None else len(sets) - split), np.float32)
    total = int(shared.sum())
    for first in range(0, total, _COLUMNS):
        lo, hi = np.searchsorted(codes, [first, first + _COLUMNS])
        member = np.zeros((len(sets), min(_COLUMNS, total - first)), np.float32)
        member[owner[lo:hi], codes[lo:hi] - first] = 1
        common += member[:split] @ (member if b is None else member[split:]).T
    rest = sizes if b is None else sizes[split:]
    union = sizes[:split, None] + rest[None, :] - common
    similar = common >= threshold * union - 1e-6
    if b is None:
        np.fill_diagonal(similar, False)
    return similar


def _tree(similar: np.ndarray) -> np.ndarray:
    """For each row the smallest row it hangs together with, by a symmetric table of links."""
    root = np.arange(len(similar))
    for start in range(len(similar)):
        if root[start] != start:
            continue
        reached = np.zeros(len(similar), bool)
        reached[start] = True
        edge = reached
        while edge.any():
            edge = similar[edge].any(axis=0) & ~reached
            reached |= edge
        root[reached] = start
    return root


def verified(members: DataFrame, threshold: float) -> DataFrame:
    """``node, links, root`` from ``members(cluster, lo, hi, block, node, copies, grams binary)``.

    Rows of one ``cluster, lo, hi`` are two blocks, or one if both are the same.
    """

    def compare(rows: list[dict], lo: int, hi: int) -> list[tuple[int, int, int]]:
        left = [r for r in rows if r["block"] == lo]
        right = None if lo == hi else [r for r in rows if r["block"] == hi]
        if not left or right == []:
            return []
        sets = [np.frombuffer(r["grams"], np.uint64) for r in left]
        similar = linked(sets, None if right is None else [np.frombuffer(r["grams"], np.uint64) for r in right], threshold)
        copies = np.array([r["copies"] for r in (left if right is None else right)], np.int64)
        links = similar @ copies
        if right is not None:
            links = np.concatenate([links, similar.T @ np.array([r["copies"] for r in left], np.int64)])
            n, both = len(left), np.zeros((len(rows), len(rows)), bool)
            both[:n, n:], both[n:, :n] = similar, similar.T
            similar, left = both, left + right
        root = _tree(similar)
        return [(r["node"], int(k), left[t]["node"]) for r, k, t in zip(left, links, root) if k]

    grams = members.columns.index("grams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for some in _slices(batch, grams) for row in some.to_pylist())
        out: list[tuple[int, int, int]] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["node", "links", "root"])

        for (_, lo, hi), group in groupby(rows, lambda r: (r["cluster"], r["lo"], r["hi"])):
            # Rows that repeat id and text share a key; one of them stands for the node.
            out += compare([next(same) for _, same in groupby(group, lambda r: r["node"])], lo, hi)
            if len(out) > 100_000:
                yield batch()
                out = []
        yield batch()

    dealt = members.repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi", "node")
    return dealt.mapInArrow(tidied(run), "node long, links long, root long")


def near_copies(
    docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, block_nodes: int = BLOCK_NODES
) -> DataFrame:
    """``doc_id, class_id, links, class_size, key`` for every row of ``docs(doc_id, text)``.

    Two documents are linked if the Jaccard similarity of their n-gram sets is at least
    ``threshold``; equal sets are. ``links`` counts a document's links, copies included, and a class
    is what hangs together by links; ``class_id`` is its smallest ``doc_id``, null if none has one.
    Candidate pairs at the threshold are found with probability ``recall``, more similar ones more
    surely; those found are judged exactly. Null text and texts without a word link to nothing: such
    a row is a class of its own. Rows that repeat id and text are copies of each other. Further
    columns are ignored; an empty table gives no rows.
    """
    bands, rows = bands_for(threshold, recall)
    signed = stored(
        signatures(docs, n, bands, rows).withColumn("tag", F.monotonically_increasing_id())
    )
    sets = stored(
        signed.where("set_id is not null").groupBy("set_id").agg(
            F.min("tag").alias("node"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least_id")
        )
    )
    nodes = signed.select(F.col("tag").alias("node"), "key", "bands").join(sets.select("node", "copies"), "node")
    nodes = stored(nodes)
    dealt = nodes.select("node", F.posexplode("bands").alias("band", "h"))
    hubs = dealt.groupBy("band", "h").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    ties = dealt.join(hubs.select("band", "h", "hub"), ["band", "h"]).where("node <> hub")
    clusters = stored(components(ties.select(F.col("node").alias("u"), F.col("hub").alias("v"))))

    sizes = clusters.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block_nodes).cast("int").alias("blocks"))
    placed = clusters.join(sizes, "component").join(nodes.select("node", "key", "copies"), "node").select(
        "key",
        "node",
        "copies",
        F.col("component").alias("cluster"),
        "blocks",
        F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"),
    )
    texts = docs.select(F.unhex(row_key()).alias("key"), text_of().alias("text"))
    found = lookup_join(texts, stored(placed), ["key"], spread_by=["key"])

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for some in (some for batch in batches for some in _slices(batch, 0)):
            grams = [s.tobytes() for s in ngram_sets(some.column(0).to_pylist(), words, n)]
            yield pa.RecordBatch.from_arrays(
                [*some.columns[1:], pa.array(grams, pa.large_binary())],
                names=["cluster", "blocks", "block", "node", "copies", "grams"],
            )

    ready = found.select("text", "cluster", "blocks", "block", "node", "copies").mapInArrow(
        tidied(to_sets), "cluster long, blocks int, block int, node long, copies long, grams binary"
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    members = ready.select("cluster", "block", "node", "copies", "grams", other).select(
        "cluster", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "copies", "grams"
    )
    parts = stored(verified(members, threshold))
    links = parts.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(parts.select(F.col("node").alias("u"), F.col("root").alias("v")))
    known = (
        sets.join(links, "node", "left")
        .join(classes, "node", "left")
        .select("set_id", "copies", "least_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
                F.coalesce("component", "node").alias("class"))
    )
    known = stored(known)
    named = known.groupBy("class").agg(F.min("least_id").alias("class_id"), F.sum("copies").alias("class_size"))
    known = known.join(named, "class").select("set_id", "links", "class_id", "class_size", "class")
    alone = signed.where("set_id is null").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("links"),
        F.lit(1).cast("long").alias("class_size"), "key", F.col("tag").alias("class")
    )
    joined = signed.select("doc_id", "key", "set_id").join(known, "set_id")
    return joined.select("doc_id", "class_id", "links", "class_size", "key", "class").unionByName(alone)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies: of each class the row of the smallest ``doc_id`` stays.

    A null id comes last; of equal ids the one of the smallest digest of id and text stays, and of
    rows that repeat both, one.
    """
    judged = near_copies(docs)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    keep = judged.groupBy("class").agg(F.min(order).alias("first")).select(F.col("first.key").alias("_near"))
    packed = docs.select(F.struct("*").alias("row"), F.unhex(row_key()).alias("_near"))
    return packed.join(stored(keep), "_near", "left_semi").dropDuplicates(["_near"]).select("row.*")

"""Importance resampling towards a target distribution of hashed word features.

Features of a text are its runs of ``n`` consecutive words; each lands in a bucket, the unsigned
CRC-32 of its UTF-8 bytes modulo ``buckets``. The CRC-32 of every feature is computed with position
tables: the register is linear in the message, so a byte ``b`` at distance ``d`` from the end of its
span adds the fixed word ``table[d, b]``. Contributions are XOR-ed per span with
``numpy.bitwise_xor.reduceat``, and a constant for the span's length stands for the register's
start and end inversion. A span longer than the table folds blockwise: its blocks of
``TABLE_BYTES`` from the end are reduced alike, and the register moves over one block by four
further tables.

Documents and the target texts give bucket counts; a bucket's gain is the log ratio of their
smoothed frequencies, a document's weight the floored mean gain of its features, and its score
adds Gumbel noise seeded by a hash of its id. The draw takes the highest scores among the long
enough documents, ranked over sorted ranges with offsets, so that no task sees all documents.

Cases: a null text has no features (weight 0); so has an empty one. A null ``doc_id`` hashes to
null, has a null score and is never drawn. Repeated rows are scored alike and ranked one after
the other. An empty table gives no rows. Extra columns of the input are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qalink.llm.base import partitions
from qalink.sources.scratch import stored

#: Bytes that the position table covers; longer spans fold block by block.
TABLE_BYTES = 32
#: Bytes of text handled at once inside a task.
CHUNK_BYTES = 1 << 23
_POLY = 0xEDB88320
_ONES = 0xFFFFFFFF


def _zero_steps(state: np.ndarray, steps: int) -> np.ndarray:
    """The reflected register after ``steps`` zero bits."""
    state = state.astype(np.uint32)
    for _ in range(steps):
        state = (state >> 1) ^ np.where(state & 1, np.uint32(_POLY), np.uint32(0)).astype(np.uint32)
    return state


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``by_distance[d, b]``, ``ones[n]`` (the register of ``n`` zero bytes from all ones) and ``shift[k, v]``."""
    first = _zero_steps(np.arange(256, dtype=np.uint32), 8)  # one byte from the empty register
    by_distance = np.empty((TABLE_BYTES, 256), np.uint32)
    by_distance[0] = first
    for d in range(1, TABLE_BYTES):
        by_distance[d] = _zero_steps(by_distance[d - 1], 8)
    ones = np.empty(TABLE_BYTES + 1, np.uint32)
    ones[0] = _ONES
    for n in range(1, TABLE_BYTES + 1):
        ones[n] = _zero_steps(ones[n - 1 : n], 8)[0]
    shift = np.stack([_zero_steps(np.arange(256, dtype=np.uint32) << np.uint32(8 * k), 8 * TABLE_BYTES) for k in range(4)])
    return by_distance, ones, shift


BY_DISTANCE, ONES, SHIFT = _tables()


def span_crc32(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of ``data[start:start + length]`` for each span (lengths of at least 1).

    Equal to ``zlib.crc32`` of each span's bytes.
    """
    if len(starts) == 0:
        return np.zeros(0, np.uint32)
    starts = starts.astype(np.int64)
    lengths = lengths.astype(np.int64)
    span = np.repeat(np.arange(len(starts)), lengths)
    ends = starts + lengths
    position = np.arange(len(span)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)
    distance = np.repeat(ends, lengths) - 1 - position
    block = distance // TABLE_BYTES  # blocks counted from the end of the span
    part = BY_DISTANCE[distance % TABLE_BYTES, data[position]]
    blocks = (lengths - 1) // TABLE_BYTES + 1
    # one XOR-sum per span and block, spans in order, blocks from the first (highest) to the last
    bounds = np.flatnonzero(np.r_[True, (span[1:] != span[:-1]) | (block[1:] != block[:-1])])
    sums = np.bitwise_xor.reduceat(part, bounds)
    first = np.cumsum(blocks) - blocks
    head = lengths - (blocks - 1) * TABLE_BYTES
    state = ONES[head] ^ sums[first]
    left = blocks - 1
    step = 1
    while (left > 0).any():
        more = np.flatnonzero(left > 0)
        s = state[more]
        s = SHIFT[0, s & 255] ^ SHIFT[1, (s >> 8) & 255] ^ SHIFT[2, (s >> 16) & 255] ^ SHIFT[3, s >> 24]
        state[more] = s ^ sums[first[more] + step]
        left[more] -= 1
        step += 1
    return state ^ np.uint32(_ONES)


#: Bytes that belong to words once A-Z are lower-cased: 0-9, a-z and all bytes of non-ASCII signs.
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[ord("0") : ord("9") + 1] = True
_WORD_BYTE[ord("a") : ord("z") + 1] = True
_WORD_BYTE[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def features(texts: list, n: int, buckets: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Per text: number of features, and its buckets with their counts (ascending buckets).

    Words are maximal runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z, which
    in UTF-8 are the runs of bytes 0-9, a-z and 0x80-0xFF. A feature is a run of ``n`` words
    joined by one space; its bytes are hashed as they would be written.
    """
    counts = np.zeros(len(texts), np.int64)
    found_b: list[np.ndarray] = []
    found_c: list[np.ndarray] = []
    for i, text in enumerate(texts):
        data = _LOWER[np.frombuffer((text or "").encode("utf-8"), np.uint8)]
        word = _WORD_BYTE[data]
        edges = np.diff(np.r_[False, word, False].astype(np.int8))
        starts = np.flatnonzero(edges == 1)
        ends = np.flatnonzero(edges == -1)
        m = len(starts) - n + 1
        if m <= 0:
            found_b.append(np.zeros(0, np.int32))
            found_c.append(np.zeros(0, np.int64))
            continue
        if n == 1:
            joined, f_starts, f_lengths = data, starts, ends - starts
        else:  # write each feature out: words joined by one space
            pieces = [b" ".join(data[starts[j + k] : ends[j + k]].tobytes() for k in range(n)) for j in range(m)]
            joined = np.frombuffer(b"".join(pieces), np.uint8)
            f_lengths = np.array([len(p) for p in pieces], np.int64)
            f_starts = np.cumsum(f_lengths) - f_lengths
        crc = span_crc32(joined, f_starts, f_lengths)
        bucket, count = np.unique((crc % np.uint32(buckets)).astype(np.int32), return_counts=True)
        counts[i] = m
        found_b.append(bucket)
        found_c.append(count.astype(np.int64))
    return counts, found_b, found_c


_FEATURES = "doc_id long, n_features long, buckets array<int>, counts array<long>"


def bucket_counts(texts: DataFrame, id_column: str, n: int = 1, buckets: int = 10000) -> DataFrame:
    """``doc_id, n_features, buckets, counts`` per row of ``texts(id_column, text)``, in place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, values = batch["doc_id"], batch["text"].tolist()
            start = 0
            while start < len(values):  # a bounded amount of text at a time
                end, size = start, 0
                while end < len(values) and (end == start or size < CHUNK_BYTES):
                    size += len(values[end] or "")
                    end += 1
                counts, found_b, found_c = features(values[start:end], n, buckets)
                yield pd.DataFrame({"doc_id": ids.iloc[start:end].to_numpy(), "n_features": counts,
                                    "buckets": found_b, "counts": found_c})
                start = end

    given = texts.select(F.col(id_column).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.mapInPandas(run, _FEATURES)


def _totals(counted: DataFrame) -> DataFrame:
    """``bucket, hits`` summed over all rows: partial sums per task, at most ``buckets`` rows each."""
    pairs = counted.select(F.explode(F.arrays_zip("buckets", "counts")).alias("p"))
    return pairs.groupBy(F.col("p.buckets").alias("bucket")).agg(F.sum("p.counts").alias("hits"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Gain of each bucket: ``floor(1000 * ln((t + 1) * (S + B) / ((s + 1) * (T + B))))``, in doubles.

    One value per bucket reaches the driver: ``buckets`` numbers whatever the input.
    """
    spark = corpus.sparkSession
    whole_s = corpus.agg(F.coalesce(F.sum("n_features"), F.lit(0)).cast("double")).first()[0]
    whole_t = target.agg(F.coalesce(F.sum("n_features"), F.lit(0)).cast("double")).first()[0]
    s = _totals(corpus).withColumnRenamed("hits", "s")
    t = _totals(target).withColumnRenamed("hits", "t")
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    b = float(buckets)
    gain = F.floor(F.lit(1000.0) * F.log(
        (F.coalesce("t", F.lit(0)).cast("double") + 1.0) * F.lit(whole_s + b)
        / ((F.coalesce("s", F.lit(0)).cast("double") + 1.0) * F.lit(whole_t + b))
    ))
    rows = every.join(F.broadcast(s), "bucket", "left").join(F.broadcast(t), "bucket", "left").select("bucket", gain.alias("g"))
    table = np.zeros(buckets, np.int64)
    for bucket, g in rows.collect():
        table[bucket] = g
    return table


def _weights(counted: DataFrame, table: np.ndarray) -> DataFrame:
    """``doc_id, n_features, weight``: the floored mean gain of the features, 0 without any."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total = np.array([int(np.dot(table[np.asarray(b, np.int64)], np.asarray(c, np.int64)))
                              for b, c in zip(batch["buckets"], batch["counts"])], np.int64)
            n = batch["n_features"].to_numpy(np.int64)
            weight = np.where(n > 0, np.floor_divide(total, np.maximum(n, 1)), 0)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_features": n, "weight": weight})

    return counted.mapInPandas(run, "doc_id long, n_features long, weight long")


def gumbel(doc_id: str, seed: int) -> F.Column:
    """``floor(-1000 * ln(-ln((h + 0.5) / 2^32)))``, ``h`` the first 8 hex digits of ``sha256('<seed>:<id>')``."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(doc_id).cast("string")), 256), 1, 8), 16, 10)
    u = (h.cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u)))


def ranked_draw(scored: DataFrame, eligible: F.Column, share_pct: int) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, ... by score (descending), then doc_id, over the eligible rows,
    for the first ``floor(share_pct * N / 100)`` of the ``N`` eligible; null for all others.

    Rows are range-partitioned and sorted once; each partition counts its eligible rows, and a rank
    is the count before its partition plus its place within it. Only one count per partition reaches
    the driver.
    """
    spark = scored.sparkSession
    order = [F.col("_e").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    keyed = scored.withColumn("_e", F.coalesce(eligible & F.col("score").isNotNull(), F.lit(False)))
    placed = stored(
        keyed.repartitionByRange(partitions(scored), *order).sortWithinPartitions(*order)
        .withColumn("_p", F.spark_partition_id())
        .withColumn("_i", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    )
    per_part = placed.where("_e").groupBy("_p").count().collect()
    counts = {p: c for p, c in per_part}
    draw = share_pct * sum(counts.values()) // 100
    offsets, before = {}, 0
    for p in sorted(counts):
        offsets[p] = before
        before += counts[p]
    # one number per partition
    table = F.array(*[F.lit(offsets.get(p, 0)).cast("long") for p in range(max(offsets, default=0) + 1)])
    rank = F.element_at(table, F.col("_p") + 1) + F.col("_i") + 1
    return placed.withColumn("rank", F.when(F.col("_e") & (rank <= draw), rank)).drop("_e", "_p", "_i")


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10000, share_pct: int = 10,
             min_words: int = 20, seed: int = 2024) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` (all long) for every row of ``docs(doc_id, text)``.

    ``target(text)`` gives the distribution to move towards. Of the documents with at least
    ``min_words`` words, ``floor(share_pct * N / 100)`` with the highest scores are drawn (ties to the
    smaller doc_id) and ranked from 1; all others have a null rank.
    """
    counted = stored(bucket_counts(docs, "doc_id", n, buckets))
    target_counted = bucket_counts(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), "doc_id", n, buckets)
    table = gains(counted, target_counted, buckets)
    weighted = _weights(counted, table)
    scored = weighted.withColumn("score", (F.col("weight") + gumbel("doc_id", seed)).cast("long"))
    words = F.col("n_features") + (n - 1)  # n - 1 more words than features, when there are any
    drawn = ranked_draw(scored, (F.col("n_features") > 0) & (words >= min_words), share_pct)
    return drawn.select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long"))

"""Product codes of integer vectors, with exact distances by limb-split matrix products.

Components become integers ``floor(scale * x)``; vectors are cut into equal consecutive parts,
and each part position has a codebook refined by rounds of k-means. The nearest entry of a part
needs the products of all parts with all entries: one matrix product. Integer products in
float64 are exact only below 2**53, so each integer is split into limbs of ``b`` bits,
``v = sum(limb_i * 2**(b*i))``, with ``b`` chosen so that a sum of ``dims`` limb products stays
below that bound. Each pair of limb matrices is multiplied by BLAS, rounded back to int64 and
recombined by shifts; distances ``|p|^2 - 2 p.c + |c|^2`` are then exact in int64, and the first
argmin gives the lower index on ties.

On Spark each round is one pass: tasks assign their rows and send partial sums per part, entry
and position (a bounded number of rows per task); the sums meet in one small aggregation, and the
new codebook (parts x entries x positions numbers) travels back in the next task's closure.

Cases: a vector that is null, holds a null or non-finite component, or one of magnitude
``2**17`` or more (so that a squared error fits in a long), takes no part and has no row; so has
a vector whose length differs from that of the first seed or is not a multiple of the number of
parts. Fewer kept vectors than entries give a codebook of that many entries. Repeated rows count
each time. A null label groups with the other null labels. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qalink.operators.joins import lookup_join
from qalink.sources.scratch import stored

#: Components of at least this magnitude take no part: squared errors must fit in a long.
LARGEST = 2.0**17
_EXACT_BITS = 52


def limb_bits(dims: int) -> int:
    """Bits per limb such that ``dims`` products of two limbs sum below 2**52."""
    return (_EXACT_BITS - max(int(np.ceil(np.log2(max(dims, 1)))), 0)) // 2


def limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """``values`` (int64) as float64 limbs, lowest first: all limbs but the last in ``[0, 2**bits)``."""
    mask = np.int64((1 << bits) - 1)
    largest = int(np.abs(values).max()) if values.size else 0
    count = max(1, -(-(largest.bit_length() + 1) // bits))
    out, rest = [], values.astype(np.int64)
    for i in range(count):
        if i == count - 1:
            out.append(rest.astype(np.float64))
        else:
            out.append((rest & mask).astype(np.float64))
            rest = rest >> np.int64(bits)
    return out


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of int64 matrices, exact in int64, by float64 products of limbs."""
    bits = limb_bits(a.shape[1])
    total = np.zeros((a.shape[0], b.shape[0]), np.int64)
    for i, la in enumerate(limbs(a, bits)):
        for j, lb in enumerate(limbs(b, bits)):
            part = np.rint(la @ lb.T).astype(np.int64)
            total += part << np.int64(bits * (i + j))
    return total


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (first on ties) and its squared distance, per row of ``parts``."""
    products = exact_products(parts, book)
    distance = (parts * parts).sum(axis=1)[:, None] - 2 * products + (book * book).sum(axis=1)[None, :]
    index = np.argmin(distance, axis=1)
    return index, distance[np.arange(len(parts)), index]


def _matrix(column: pd.Series, dims: int) -> np.ndarray:
    return np.array([np.asarray(v, np.int64) for v in column], np.int64).reshape(len(column), dims)


def integer_vectors(vectors: DataFrame, scale: float) -> DataFrame:
    """``vec_id, label, v array<long>`` of the vectors that take part."""
    def good(x):
        x = x.cast("double")
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(LARGEST))

    v = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return vectors.where(F.col("embedding").isNotNull() & F.forall("embedding", good)).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), v.alias("v")
    )


def _round(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """Partial sums per part, entry and position of the rows assigned to each entry."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((parts, entries, width), np.int64)
        counts = np.zeros((parts, entries), np.int64)
        for batch in batches:
            if len(batch) == 0:
                continue
            values = _matrix(batch["v"], parts * width)
            for p in range(parts):
                piece = values[:, p * width : (p + 1) * width]
                index, _ = nearest(piece, books[p])
                np.add.at(sums[p], index, piece)
                counts[p] += np.bincount(index, minlength=entries)
        used = np.argwhere(counts > 0)
        if len(used):
            p, e = used[:, 0], used[:, 1]
            yield pd.DataFrame({"part": np.repeat(p, width).astype(np.int32), "entry": np.repeat(e, width).astype(np.int32),
                                "pos": np.tile(np.arange(width), len(used)).astype(np.int32),
                                "total": sums[p, e].reshape(-1), "n": np.repeat(counts[p, e], width)})

    return kept.select("v").mapInPandas(run, "part int, entry int, pos int, total long, n long")


def fit(kept: DataFrame, seeds: np.ndarray, parts: int, rounds: int) -> np.ndarray:
    """The codebooks ``(parts, entries, width)`` after ``rounds`` rounds from the seed vectors."""
    width = seeds.shape[1] // parts
    books = np.stack([seeds[:, p * width : (p + 1) * width] for p in range(parts)]).astype(np.int64)
    for _ in range(rounds):
        sums = _round(kept, books).groupBy("part", "entry", "pos").agg(F.sum("total").alias("total"),
                                                                       F.sum("n").alias("n"))
        new = books.copy()
        for part, entry, pos, total, n in sums.collect():  # at most parts x entries x width rows
            new[part, entry, pos] = total // n
        books = new
    return books


def books_digest(books: np.ndarray) -> str:
    """sha256 of all components by part, entry and position, in decimal, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for x in books.reshape(-1)).encode()).hexdigest()


def encode(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024.0) -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256`` per kept row of ``vectors(vec_id, embedding, label)``.

    ``code``: the 0-based entry of each part, two hex digits each. ``error``: squared distances
    summed over the parts. ``label_error``: the errors of all rows with that label.
    """
    spark = vectors.sparkSession
    given = integer_vectors(vectors, scale)
    first = given.orderBy(F.col("vec_id").asc_nulls_last(), F.col("v").asc()).select(F.size("v")).first()
    if first is None:
        return spark.createDataFrame([], "vec_id long, label int, code string, error long, label_error long, codebooks_sha256 string")
    dims = first[0]
    kept = stored(given.where((F.size("v") == dims) & F.lit(dims % parts == 0 and dims > 0)))
    if dims % parts or not dims:
        return kept.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(0).cast("long").alias("error"),
                           F.lit(0).cast("long").alias("label_error"), F.lit(None).cast("string").alias("codebooks_sha256")).limit(0)
    # the seeds: the first rows by id among the vectors that take part
    seeds = np.array([r["v"] for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), F.col("v").asc()).limit(entries).collect()],
                     np.int64)
    books = fit(kept, seeds, parts, rounds)
    width = dims // parts

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch) == 0:
                continue
            values = _matrix(batch["v"], dims)
            error = np.zeros(len(batch), np.int64)
            codes = []
            for p in range(parts):
                index, distance = nearest(values[:, p * width : (p + 1) * width], books[p])
                error += distance
                codes.append(index)
            code = ["".join(f"{c:02x}" for c in row) for row in np.stack(codes, axis=1)]
            yield pd.DataFrame({"vec_id": batch["vec_id"], "label": batch["label"], "code": code, "error": error})

    coded = stored(kept.mapInPandas(assign, "vec_id long, label int, code string, error long"))
    key = F.coalesce(F.col("label").cast("string"), F.lit("null")).alias("_lk")
    per_label = coded.groupBy(key).agg(F.sum("error").alias("label_error"))
    out = lookup_join(coded.withColumn("_lk", key), per_label, ["_lk"], "left")
    return out.select("vec_id", "label", "code", "error", "label_error",
                      F.lit(books_digest(books)).alias("codebooks_sha256"))

"""Exact inner-product search over buckets of vectors of similar length.

Vectors are grouped by length into buckets. A query whose best products so far reach ``theta`` can
gain from a bucket of longest vector ``l`` only if some cosine there is at least
``theta / (|q| * l)``, the local threshold. Above 1 the bucket is skipped. A high threshold prunes
by coordinates: a unit vector that close to the query lies within an interval on each of the
query's largest coordinates. A low one prunes by length: the vectors stand longest first, and those
shorter than ``theta / |q|`` are left out. What remains is verified by whole-number products.

Queries and candidates both come in blocks of a bounded size, and a task compares one group of
each. The first thresholds come from the longest vectors, a set of a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qalink.sources.scratch import stored

BUCKET_ROWS = 4096
BUCKETS_PER_CELL = 8
QUERY_ROWS = 1024
QUERIES_PER_CELL = 4
MAX_LENGTH_CLASSES = 64
PROBE_ROWS = 2048
#: Local thresholds from here on prune by coordinates.
COORDINATES_FROM = 0.4
FOCUS = 3
_SLACK = 1e-7

_BLOCK = "dims int, longest double, tags binary, ids binary, named binary, values binary"


def whole_numbers(vector: Column, scale: float) -> Column:
    """``floor(scale * x)`` of each component, or null where the vector takes no part."""
    def finite(x: Column) -> Column:
        x = x.cast("double")
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return F.when(vector.isNotNull() & F.forall(vector, finite), whole)


def _lengths(values: np.ndarray) -> np.ndarray:
    return np.sqrt((values.astype(np.float64) ** 2).sum(axis=1))


def _pack(key, rows: pd.DataFrame) -> pd.DataFrame:
    """A block, its longest vector first."""
    dims = int(key[0])
    values = np.array([np.asarray(v, np.int64) for v in rows["v"]], np.int64).reshape(len(rows), dims)
    lengths = _lengths(values)
    order = np.argsort(-lengths, kind="stable")
    ids = rows["vec_id"].astype("Int64")
    return pd.DataFrame(
        {
            "dims": [dims],
            "longest": [float(lengths.max())],
            "tags": [rows["tag"].to_numpy(np.int64)[order].tobytes()],
            "ids": [ids.fillna(0).to_numpy(np.int64)[order].tobytes()],
            "named": [ids.notna().to_numpy(np.uint8)[order].tobytes()],
            "values": [values[order].tobytes()],
        }
    )


class Block:
    def __init__(self, row):
        self.longest = row.longest
        self.tags = np.frombuffer(row.tags, np.int64)
        self.ids = np.frombuffer(row.ids, np.int64)
        self.named = np.frombuffer(row.named, np.uint8).astype(bool)
        self.values = np.frombuffer(row.values, np.int64).reshape(len(self.ids), row.dims)
        self.lengths = _lengths(self.values)


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whole-number products; by floating point where that is exact."""
    bound = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * max(left.shape[1], 1)
    if bound < 2**53:
        return (left.astype(np.float64) @ right.T.astype(np.float64)).astype(np.int64)
    return left @ right.T


class Best:
    """The k best of each query of a block so far, ties to the smaller id, a null id last."""

    def __init__(self, queries: Block, k: int, theta: np.ndarray):
        self.queries, self.k, self.theta = queries, k, theta.copy()
        self.found: list[list[tuple[int, bool, int]]] = [[] for _ in theta]

    def offer(self, q: int, scores: np.ndarray, block: Block, rows: np.ndarray) -> None:
        own = block.named[rows] & (block.ids[rows] == self.queries.ids[q])
        good = ~own & (scores >= self.theta[q])
        scores, rows = scores[good], rows[good]
        if len(rows) > self.k:  # all that reach the k-th score take part in the order
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, rows = scores[scores >= least], rows[scores >= least]
        if not len(rows):
            return
        unnamed, ids = ~block.named[rows], block.ids[rows]
        order = np.lexsort((ids, unnamed, -scores))[: self.k]
        new = [(-int(scores[i]), bool(unnamed[i]), int(ids[i])) for i in order]
        self.found[q] = sorted(self.found[q] + new)[: self.k]
        if len(self.found[q]) == self.k:
            self.theta[q] = max(self.theta[q], -self.found[q][-1][0])


def search(best: Best, block: Block) -> None:
    """What the queries gain from a bucket."""
    queries = best.queries
    reach = queries.lengths * block.longest
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(reach > 0, best.theta / reach, np.where(best.theta > 0, np.inf, -np.inf))
        least = np.where(queries.lengths > 0, best.theta / queries.lengths, -np.inf)
    alive = local <= 1 + _SLACK
    by_coordinates = alive & (local >= COORDINATES_FROM)
    everyone = np.arange(len(block.ids))
    if by_coordinates.any():
        lengths = np.maximum(block.lengths, 1e-300)
        for q in np.nonzero(by_coordinates)[0]:
            unit = queries.values[q] / queries.lengths[q]
            focus = np.argsort(-np.abs(unit))[:FOCUS]
            t = min(local[q], 1.0)
            keep = block.lengths >= least[q] * (1 - _SLACK)
            for f in focus:
                spread = np.sqrt(max(0.0, (1 - unit[f] ** 2) * (1 - t**2))) + _SLACK
                low, high = unit[f] * t - spread, unit[f] * t + spread
                # Closer than t is allowed too: up to the query itself.
                low = -1.0 if -unit[f] >= t else low
                high = 1.0 if unit[f] >= t else high
                place = block.values[:, f] / lengths
                keep &= (place >= low) & (place <= high)
            rows = everyone[keep]
            if len(rows):
                best.offer(q, products(queries.values[q : q + 1], block.values[rows])[0], block, rows)
    by_length = np.nonzero(alive & ~by_coordinates)[0]
    for at in range(0, len(by_length), 256):
        some = by_length[at : at + 256]
        # Longest first: every query of the group needs at most this prefix.
        prefix = int(np.count_nonzero(block.lengths >= least[some].min() * (1 - _SLACK)))
        if prefix:
            scores = products(queries.values[some], block.values[:prefix])
            for q, row in zip(some, scores):
                best.offer(q, row, block, everyone[:prefix])


def top_products(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0) -> DataFrame:
    """``query_id, rank, vec_id, score`` for ``vectors(vec_id long, embedding array)``.

    Components become ``floor(scale * x)``. Queries are the rows where ``is_query`` holds, candidates
    all rows of other ids and of the same number of components; each query gets its ``k`` highest
    products, all if there are fewer, ties to the smaller ``vec_id``, a null one last. Rows of the
    query's id count as the query's own. A vector that is null, or holds null, NaN or an infinite
    number, takes no part. Repeated rows count as often as they stand there. Empty vectors have
    product 0. Products must fit a 64-bit integer. Further columns are ignored.
    """
    spark = vectors.sparkSession
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(F.col("embedding"), scale).alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = stored(
        given.where("v is not null").select(
            "vec_id", "v", F.size("v").alias("dims"), length.alias("length"), F.monotonically_increasing_id().alias("tag")
        )
    )
    total = rows.count()
    classes = int(min(MAX_LENGTH_CLASSES, max(1, total // BUCKET_ROWS)))
    cuts = sorted(set(rows.approxQuantile("length", [i / classes for i in range(1, classes)], 0.001))) if classes > 1 else []
    number = F.lit(0)
    for cut in cuts:
        number = number + (F.col("length") > cut).cast("int")
    sliced = rows.withColumn("class", number)
    sizes = sliced.groupBy("dims", "class").agg(F.ceil(F.count(F.lit(1)) / BUCKET_ROWS).cast("int").alias("slices"))
    mixed = F.xxhash64("tag")
    buckets = (
        sliced.join(F.broadcast(sizes), ["dims", "class"])  # a row per number of components and class
        .groupBy("dims", "class", F.pmod(mixed, F.col("slices")).alias("slice"))
        .applyInPandas(_pack, _BLOCK)
    )
    buckets = stored(buckets)
    asking = rows.where(is_query)
    count = asking.count()
    queries = stored(
        asking.groupBy("dims", F.pmod(mixed, F.lit(max(1, -(-count // QUERY_ROWS)))).alias("slice")).applyInPandas(_pack, _BLOCK)
    )

    longest = rows.orderBy(F.desc("length"), "tag").limit(PROBE_ROWS).groupBy("dims").applyInPandas(_pack, _BLOCK)
    # plain records: a worker needs no copy of this package to read them
    probe = spark.sparkContext.broadcast(longest.toPandas().to_dict("records"))

    def start(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        probes = [Block(SimpleNamespace(**record)) for record in probe.value]
        for frame in frames:
            thetas = []
            for row in frame.itertuples():
                block = Block(row)
                best = Best(block, k, np.full(len(block.ids), -np.inf))
                for other in probes:
                    if other.values.shape[1] == row.dims:
                        search(best, other)
                thetas.append(best.theta.tobytes())
            yield frame.assign(theta=thetas)

    def cell(key, groups: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        blocks = [Block(r) for r in groups.sort_values("longest", ascending=False).itertuples()]
        out = []
        for row in asked.itertuples():
            block = Block(row)
            best = Best(block, k, np.frombuffer(row.theta, np.float64))
            for other in blocks:
                search(best, other)
            for tag, query, found in zip(block.tags, block.ids, best.found):
                out += [(tag, query, None if unnamed else i, -s) for s, unnamed, i in found]
        frame = pd.DataFrame(out, columns=["tag", "query_id", "vec_id", "score"])
        return frame.astype({"tag": "int64", "query_id": "int64", "vec_id": "Int64", "score": "int64"})

    across = max(1, -(-buckets.count() // BUCKETS_PER_CELL))
    down = max(1, -(-queries.count() // QUERIES_PER_CELL))
    started = stored(queries.mapInPandas(start, _BLOCK + ", theta binary"))
    dealt = buckets.select(
        "*",
        F.pmod(F.xxhash64("tags"), F.lit(across)).cast("int").alias("g"),
        F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("h"),
    )
    asked = started.select(
        "*",
        F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("g"),
        F.pmod(F.xxhash64("tags"), F.lit(down)).cast("int").alias("h"),
    )
    found = (
        dealt.groupBy("dims", "g", "h")
        .cogroup(asked.groupBy("dims", "g", "h"))
        .applyInPandas(cell, "tag long, query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("tag").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

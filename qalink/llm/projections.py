"""Near-duplicate vectors by collisions in one-dimensional projections, with every link.

Vectors are normalised; exact copies (same label, same direction) collapse into one
representative with a multiplicity first. Each representative is projected on ``PROJECTIONS``
orthonormal directions. Unit vectors at cosine ``t`` lie ``sqrt(2 - 2 t)`` apart, and no projection
makes a distance longer: linked vectors collide in every projection, and the squares of their
differences there sum to ``2 - 2 t`` at most. What does not collide so cannot be linked, and all
that does is verified by its cosine, so no link is lost and none is added.

One range shuffle sorts the representatives of a label by the signs of ``PLANES`` projections and
the value of one more, and cuts them into blocks of ``ROW_BLOCK`` rows at most. A block knows its
range in every projection. Two blocks of a label meet in a task of their own if their ranges
collide; there, rows that collide with no row's range of the other block leave first. A pair of
blocks gives the number of links per row and a spanning forest of the links, never the links
themselves: a large cluster of near copies costs a row per member and pair of blocks.

Vectors without structure collide in all blocks of their label; the work is then the square of the
label's size in products of matrices, in tasks of bounded memory.

Cases: a vector that is null, zero, holds a null or non-finite component, or has a null label or
a null id links with nothing (``n_links`` 0, itself its component). Vectors of other lengths are
never compared. Repeated rows are copies of each other and link. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qalink.llm.components import components
from qalink.operators.joins import lookup_join
from qalink.sources.scratch import stored

PROJECTIONS = 16
PLANES = 6
ROW_BLOCK = 4096
#: Rows whose cosines with a block are held at a time.
ROWS_AT_ONCE = 512
SEED = 13
#: What rounding may add to a squared distance.
_SLACK = 1e-6


def _directions(dims: int) -> np.ndarray:
    """``(dims, k)`` orthonormal directions, the same in every task."""
    rng = np.random.default_rng([SEED, dims])
    return np.linalg.qr(rng.standard_normal((dims, min(PROJECTIONS, dims))))[0]


def unit_rows(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, x`` with ``x`` the unit vector, null where the row links with nothing."""
    def finite(v: Column) -> Column:
        v = v.cast("double")
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))

    e = F.col("embedding")
    norm = F.sqrt(F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))
    ok = e.isNotNull() & F.forall(e, finite) & (norm > 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    x = F.transform(e, lambda v: v.cast("double") / norm)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"),
                          F.when(F.coalesce(ok, F.lit(False)), x).alias("x"))


def _project(reps: DataFrame) -> DataFrame:
    """``reps`` with the number of components, the signs of the first projections and the value of the next."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dims, rows in batch.groupby(batch["x"].map(len)):
                values = np.stack(rows["x"].to_numpy()) @ _directions(int(dims))
                signs = values[:, :PLANES] >= 0
                cells = (signs << np.arange(signs.shape[1])).sum(axis=1)
                yield rows.assign(dims=int(dims), cell=cells, value=values[:, min(PLANES, values.shape[1] - 1)])

    return reps.mapInPandas(run, "label int, x array<double>, rep long, mult long, dims int, cell int, value double")


def _placed(reps: DataFrame) -> DataFrame:
    """``label, dims, block, place, x, rep, mult``: blocks of one label and length, in the order of the projections."""
    order = ["label", "dims", "cell", "value", "rep"]
    ranges = reps.count() // ROW_BLOCK + 1
    ranged = _project(reps).repartitionByRange(ranges, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, place, group = -1, 0, None
        for batch in batches:
            blocks, places = np.empty(len(batch), np.int64), np.empty(len(batch), np.int64)
            for i, (part, *of) in enumerate(zip(batch["_p"], batch["label"], batch["dims"])):
                if of != group or place == ROW_BLOCK:
                    number, place, group = number + 1, 0, of
                blocks[i], places[i] = part << 32 | number, place
                place += 1
            yield batch[["label", "dims", "x", "rep", "mult"]].assign(block=blocks, place=places)

    return ranged.withColumn("_p", F.spark_partition_id().cast("long")).mapInPandas(
        run, "label int, dims int, x array<double>, rep long, mult long, block long, place long")


def _packed(placed: DataFrame) -> DataFrame:
    """One row per block: its rows' ``x``, ``rep`` and ``mult`` by place, and its range in every projection."""
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        x = np.stack(rows["x"].to_numpy()).astype(np.float64)
        values = x @ _directions(x.shape[1])
        first = rows.iloc[0]
        return pd.DataFrame({
            "block": [first["block"]], "label": [first["label"]], "dims": [first["dims"]],
            "low": [values.min(axis=0)], "high": [values.max(axis=0)], "xs": [x.tobytes()],
            "reps": [rows["rep"].to_numpy(np.int64).tobytes()], "mults": [rows["mult"].to_numpy(np.int64).tobytes()],
        })

    return placed.groupBy("block").applyInPandas(
        pack, "block long, label int, dims int, low array<double>, high array<double>, xs binary, reps binary, mults binary")


def _meeting(packed: DataFrame, reach: float) -> DataFrame:
    """``i, j``: the blocks ``i <= j`` of a label whose ranges collide; a block always meets itself."""
    ranges = packed.select("label", "dims", "block", "low", "high")
    other = ranges.select("label", "dims", F.col("block").alias("j"), F.col("low").alias("low_j"), F.col("high").alias("high_j"))
    below = F.zip_with("low", "high_j", lambda a, b: a - b)
    above = F.zip_with("low_j", "high", lambda a, b: a - b)
    gaps = F.zip_with(below, above, lambda a, b: F.greatest(a, b, F.lit(0.0)))
    squares = F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + g * g)
    both = ranges.withColumnRenamed("block", "i").join(other, ["label", "dims"])
    return both.where((F.col("i") <= F.col("j")) & (squares <= reach)).select("i", "j")


def _colliding(x: np.ndarray, other: np.ndarray, reach: float) -> np.ndarray:
    """Which rows of ``x`` collide with the range that ``other`` takes in every projection."""
    if not len(other):
        return np.zeros(len(x), bool)
    directions = _directions(x.shape[1])
    mine, theirs = x @ directions, other @ directions
    gaps = np.maximum(np.maximum(theirs.min(axis=0) - mine, mine - theirs.max(axis=0)), 0.0)
    return (gaps * gaps).sum(axis=1) <= reach


def _linked(xa: np.ndarray, xb: np.ndarray, same: bool, threshold: float, reach: float):
    """Links of two blocks (or of one with itself) as chunks: rows of ``xa``, rows of ``xb`` and which are linked."""
    a, b = np.arange(len(xa)), np.arange(len(xb))
    if not same:
        a = np.flatnonzero(_colliding(xa, xb, reach))
        b = np.flatnonzero(_colliding(xb, xa[a], reach))
    for at in range(0, len(a) if len(b) else 0, ROWS_AT_ONCE):
        some = a[at : at + ROWS_AT_ONCE]
        linked = xa[some] @ xb[b].T >= threshold
        if same:  # each pair once
            linked &= b[None, :] > some[:, None]
        if linked.any():
            yield some, b, linked


def _compared(rows: pd.DataFrame, threshold: float, reach: float) -> pd.DataFrame:
    """Links of a pair of blocks: ``block, place, partners`` per linked row, ``u, v`` per edge of a spanning forest."""
    rows = rows.sort_values("block")
    blocks = [int(b) for b in rows["block"]]
    dims = int(rows["dims"].iloc[0])
    xs = [np.frombuffer(raw, np.float64).reshape(-1, dims) for raw in rows["xs"]]
    reps, mults = ([np.frombuffer(raw, np.int64) for raw in rows[c]] for c in ("reps", "mults"))
    same, shift = len(blocks) == 1, 0 if len(blocks) == 1 else len(xs[0])
    nodes, weights = np.concatenate(reps), np.concatenate(mults)
    partners, tree, edges = np.zeros(len(nodes), np.int64), np.arange(len(nodes)), []
    for a, b, linked in _linked(xs[0], xs[-1], same, threshold, reach):
        partners[a] += linked @ weights[b + shift]
        partners[b + shift] += weights[a] @ linked
        for row in np.flatnonzero(linked.any(axis=1)):
            others = b[linked[row]] + shift
            trees, one = np.unique(tree[others], return_index=True)
            new = trees != tree[a[row]]
            edges += [(nodes[a[row]], nodes[other]) for other in others[one[new]]]
            if new.any():
                tree[np.isin(tree, trees[new])] = tree[a[row]]
    at = np.flatnonzero(partners)
    found = pd.DataFrame({"block": np.repeat(blocks, [len(x) for x in xs])[at], "place": np.where(at < len(xs[0]), at, at - shift),
                          "partners": partners[at]})
    forest = pd.DataFrame(edges, columns=["u", "v"], dtype=np.int64)
    return pd.concat([found, forest], ignore_index=True).astype("Int64")[["block", "place", "partners", "u", "v"]]


def near_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding, label)``.

    ``n_links``: other rows linked directly (cosine at least ``threshold``, equal labels);
    ``component_id``: the smallest vec_id reachable by links; ``kept``: the row is its component's.
    """
    reach = 2 - 2 * threshold + _SLACK
    rows = stored(unit_rows(vectors))
    good = rows.where(F.col("x").isNotNull())
    reps = stored(good.groupBy("label", "x").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult")))
    placed = stored(_placed(reps))
    packed = stored(_packed(placed))
    met = _meeting(packed, reach)
    sides = met.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    compared = stored(
        sides.join(packed.select("block", "dims", "xs", "reps", "mults"), "block").groupBy("i", "j")
        .applyInPandas(lambda r: _compared(r, threshold, reach), "block long, place long, partners long, u long, v long"))
    partners = compared.where("partners IS NOT NULL").groupBy("block", "place").agg(F.sum("partners").alias("partners"))
    tree = components(compared.where("u IS NOT NULL").select("u", "v")).withColumnRenamed("node", "rep")
    per_rep = (placed.join(partners, ["block", "place"], "left").join(tree, "rep", "left")
               .select("label", "x", (F.col("mult") - 1 + F.coalesce("partners", F.lit(0))).alias("n_links"),
                       F.coalesce("component", "rep").alias("component_id")))
    joined = lookup_join(good, per_rep, ["label", "x"], "left")
    lone = rows.where(F.col("x").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                                  F.col("vec_id").alias("component_id"))
    out = joined.select("vec_id", F.col("n_links").cast("long"), "component_id").unionByName(lone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

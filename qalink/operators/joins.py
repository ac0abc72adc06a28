"""Joins against a side that may or may not be small, and keys that may or may not be hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qalink.sources.scratch import stored

BROADCAST_BYTES = 32 * 1024 * 1024
# A key is hot when it holds more than one row in HOT_SHARE, so at most HOT_SHARE keys are hot.
HOT_SHARE = 1024
HOT_ROWS = 100_000
_SALT = "_salt"


def _bytes(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.octet_length(value) + 16
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
        return F.size(value) * 8 + 16
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.octet_length(F.to_json(value)) * 2 + 16
    return F.lit(8)


def measured_bytes(df: DataFrame) -> int:
    """Bytes the rows take in memory, roughly; one aggregation, one number to the driver."""
    row = F.lit(16)
    for field in df.schema.fields:
        row = row + F.coalesce(_bytes(F.col(f"`{field.name}`"), field.dataType), F.lit(8))
    return df.agg(F.sum(row.cast("long")).alias("b")).first()["b"] or 0


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    spread_by: Sequence[str] = (),
    broadcast_bytes: int = BROADCAST_BYTES,
    store_left: bool = False,
) -> DataFrame:
    """Join a large table with a side that is usually small.

    The right side is measured. Up to ``broadcast_bytes`` it is broadcast and the left side is
    not shuffled at all; beyond that the join shuffles, with hot keys spread over many tasks.
    ``store_left`` writes a dearly computed left side first in that case, since its keys are
    sampled before it is joined.
    """
    if measured_bytes(right) <= broadcast_bytes:
        return left.join(F.broadcast(right), list(on), how)
    return spread_join(stored(left) if store_left else left, right, on, how, spread_by)


def hot_keys(
    df: DataFrame,
    on: Sequence[str],
    share: int = HOT_SHARE,
    sample: float = 1.0,
    min_rows: int = HOT_ROWS,
) -> DataFrame:
    """``on`` columns and ``_salts`` for the keys holding more than ``1 / share`` of the rows.

    At most ``share`` keys can qualify, and their ``_salts`` sum to at most twice that, whatever
    the size of the table. Keys of fewer than ``min_rows`` rows are no burden and stay whole.
    A sample only affects which keys get spread, never a join's result.
    """
    keys = df.select(*on).na.drop("any")
    counts = (keys.sample(sample, seed=7) if sample < 1.0 else keys).groupBy(*on).count()
    total = counts.agg(F.sum("count").alias("n")).scalar()
    heavy = (F.col("count") * share > total) & (F.col("count") >= min_rows * sample)
    hot = counts.where(heavy).select(
        *on, F.ceil(F.col("count") * share / total).cast("int").alias("_salts")
    )
    # Bounded by construction. Fixed here, so both sides of a join agree on it after a retry.
    return df.sparkSession.createDataFrame(hot.collect(), hot.schema)


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    spread_by: Sequence[str] = (),
    share: int = HOT_SHARE,
    sample: float = 0.02,
    min_rows: int = HOT_ROWS,
    keys_from: DataFrame | None = None,
) -> DataFrame:
    """Shuffle join in which the rows of a hot left key are dealt out to many tasks.

    A left row of a hot key goes to one salt, by the hash of ``spread_by`` (all columns by
    default); the matching right rows are copied to each salt of that key. Left rows without a
    key match nothing and are dealt out too. ``how``: inner, left, left_semi or left_anti.
    ``keys_from`` is a table to count the keys in, when that is cheaper than in ``left``.
    """
    on = list(on)
    hot = hot_keys(left if keys_from is None else keys_from, on, share, sample, min_rows)
    if how in ("inner", "left_semi") and hot.isEmpty():
        return left.join(right, on, how)
    hot = F.broadcast(hot)
    row_hash = F.xxhash64(*(spread_by or left.columns))
    no_key = F.lit(False)
    for key in on:
        no_key = no_key | F.col(key).isNull()
    salts = F.when(no_key, F.lit(share)).otherwise(F.coalesce(F.col("_salts"), F.lit(1)))
    dealt = left.join(hot, on, "left").withColumn(_SALT, F.pmod(row_hash, salts).cast("int"))
    copied = right.join(hot, on, "left").withColumn(
        _SALT, F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    )
    joined = dealt.drop("_salts").join(copied.drop("_salts"), [*on, _SALT], how)
    return joined.drop(_SALT)

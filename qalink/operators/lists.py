"""Lists per key whose length has an upper bound."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qalink.sources.scratch import stored


def chunked_lists(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    order: Sequence[str],
    output: str,
    chunk_rows: int = 1000,
) -> DataFrame:
    """``keys, chunk, output``: the values of a key as lists, sorted by ``order``.

    Rows of a key are numbered in that order, and each run of ``chunk_rows`` numbers is one list;
    null keys are a key like any other. Rows are dealt out by ranges of key, order and row, so a
    hot key, or very many rows of one order value, fill many partitions; a row's number is its
    place in its partition plus what earlier partitions hold of its key.
    """
    keys, order, values = list(keys), list(order), list(values)
    rows = df.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)],
        *[F.col(v).alias(f"_v{i}") for i, v in enumerate(values)],
        F.monotonically_increasing_id().alias("_row"),
    )
    named, sorting = [f"_k{i}" for i in range(len(keys))], [f"_o{i}" for i in range(len(order))]
    dealt = stored(rows.repartitionByRange(*named, *sorting, "_row").withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_part", *named).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*named).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(
        F.col("_part").alias("_p"),
        *[F.col(k).alias(f"_b{k}") for k in named],
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
    )
    same = F.col("_part") == F.col("_p")
    for k in named:
        same = same & F.col(k).eqNullSafe(F.col(f"_b{k}"))
    place = F.row_number().over(Window.partitionBy("_part", *named).orderBy(*sorting, "_row"))
    numbered = dealt.withColumn("_place", place).join(before, same)
    number = F.col("_before") + F.col("_place") - 1
    entry = F.struct(number.alias("_number"), *[F.col(f"_v{i}") for i in range(len(values))])
    lists = numbered.groupBy(*named, F.floor(number / chunk_rows).cast("int").alias("chunk")).agg(
        F.sort_array(F.collect_list(entry)).alias("_entries")
    )

    def value(e):
        if len(values) == 1:
            return e["_v0"]
        return F.struct(*[e[f"_v{i}"].alias(v) for i, v in enumerate(values)])

    return lists.select(
        *[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "chunk", F.transform("_entries", value).alias(output)
    )

"""Mixing sources to target weights by repeating documents.

Sizes are summed per source; each source gets a target; its rate is target over size. A document is
emitted ``floor(rate)`` times, and once more with a probability of the remaining fraction, drawn
from a hash of the seed and the document, so that every run agrees.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from qalink.llm.base import WORD_PATTERN, text_of
from qalink.operators.joins import lookup_join
from qalink.sources.scratch import stored

SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long")


def source_key(source: str = "source") -> Column:
    """Joins and sorts like the source, with null after all others."""
    return F.coalesce(F.concat(F.lit("0"), F.col(source).cast("string")), F.lit("1"))


def source_targets(sizes: DataFrame, weights: Sequence[float], total: float, cap: float) -> DataFrame:
    """``key, source_size, target`` for ``sizes(key, source_size)``, one row per source.

    Sources in the order of ``key`` take the weights in turn, over and over. Together they get
    ``total`` times all sizes in proportion to their weights, but none more than ``cap`` times its
    own size; what is over goes to the others by weight until none is above. Written as one level
    that all uncapped sources share, the result is ``min(cap * size, level * weight)``.

    Ranks come from range partitions and their counts, so no task sees all sources; the level is
    found by sums over the table, of which the driver sees two numbers a round.
    """
    spark = sizes.sparkSession
    dealt = stored(sizes.repartitionByRange("key").withColumn("part", F.spark_partition_id()))
    before, n = [], 0
    for row in dealt.groupBy("part").count().orderBy("part").collect():  # one number per task
        before.append((row["part"], n))
        n += row["count"]
    # An Arrow table needs no Python worker, unlike a list.
    parts, sums = zip(*before) if before else ((), ())
    offsets = spark.createDataFrame(pa.table({"part": pa.array(parts, pa.int32()), "before": pa.array(sums, pa.int64())}))
    within = F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1
    ranked = dealt.withColumn("within", within).join(F.broadcast(offsets), "part")
    turn = ((F.col("within") + F.col("before")) % len(weights) + 1).cast("int")
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn))
    ranked = stored(ranked.select("key", "source_size", "weight").withColumn("most", cap * F.col("source_size")))
    sums = ranked.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    everything = total * (sums["size"] or 0)
    level = everything / sums["weight"] if sums["weight"] else 0.0
    while True:
        full = F.col("most") <= F.lit(level) * F.col("weight")
        found = ranked.agg(
            F.sum(F.when(full, F.col("most"))).alias("most"), F.sum(F.when(~full, F.col("weight"))).alias("weight")
        ).first()
        if not found["weight"]:
            break
        higher = (everything - (found["most"] or 0.0)) / found["weight"]
        if higher <= level:
            break
        level = higher
    target = F.least(F.col("most"), F.lit(level) * F.col("weight"))
    return ranked.select("key", "source_size", target.alias("target"))


def draw(*parts: Column) -> Column:
    """A number in [0, 1) from the hash of some columns: 52 bits of SHA-256."""
    digest = F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(2**52))


def mix(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), total: float = 1.5, cap: float = 2.0, seed: str = SEED
) -> DataFrame:
    """``given, size, source_size, target, copies`` for every row of ``docs(doc_id, text, source)``.

    ``given`` holds the row as it came, whatever its columns are called. Size is the number of runs
    of signs other than ASCII white space; a null text has none. A null source is a source of its
    own, after all others. Rows that repeat id, source and size draw alike. A source without any
    word has target 0 and rate 0. An empty table gives no rows.

    The text is read twice (for the sums and for the result) and shuffled never: the targets are
    broadcast while there are few sources, and a hot source is dealt out beyond that.
    """
    measured = docs.select(
        F.struct("*").alias("given"), "doc_id", source_key().alias("key"), word_count(text_of()).alias("size")
    )
    sizes = measured.groupBy("key").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, total, cap)
    both = lookup_join(measured, targets, ["key"], spread_by=["doc_id", "size"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    fraction = F.col("rate") - F.floor("rate")
    more = (draw(F.lit(seed), F.col("doc_id"), F.col("key"), F.col("size")) < fraction).cast("long")
    return both.withColumn("rate", rate).select(
        "given", "size", "source_size", "target", (F.floor("rate").cast("long") + more).alias("copies")
    )


def emitted(mixed: DataFrame) -> DataFrame:
    """The documents of a mix, each as often as it is taken."""
    copies = mixed.where("copies > 0").select("given", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return copies.select("given.*")

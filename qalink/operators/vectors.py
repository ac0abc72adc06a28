"""Word vectors as tables: ``vectors(word, vector)`` with one row per word.

Words of a sentence or query are rows ``(keys…, word)``; repeats count.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from qalink.functions import vectors as V
from qalink.operators.joins import hot_keys, lookup_join, measured_bytes
from qalink.sources.scratch import stored

# A vocabulary does not grow with the posts; it is broadcast up to this measured size.
VOCABULARY_BYTES = 512 * 1024 * 1024
# Words whose vectors one task sums, and the share of rows in which keys of very many words are looked for.
ROWS_PER_TASK = 200_000
HOT_SAMPLE = 0.02
# Query vectors compared in one go, and the size of a block when there are more.
BLOCK_BYTES = 32 * 1024 * 1024
# Scores a task holds at a time while comparing a block with a batch of words.
SCORES_AT_ONCE = 8_000_000


def vector_stats(vectors: DataFrame) -> DataFrame:
    return vectors.agg(
        F.count(F.lit(1)).alias("words"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("dimension")
    )


def dimension(vectors: DataFrame) -> int:
    row = vectors.select(F.size("vector").alias("d")).first()
    return row["d"] if row else 0


def with_vectors(
    words: DataFrame, vectors: DataFrame, how: str = "inner", word: str = "word", vector: str = "vector"
) -> DataFrame:
    """Attach the vector of ``word``: unknown words are dropped (inner) or get null (left)."""
    named = vectors.select(F.col("word").alias(word), F.col("vector").alias(vector))
    return lookup_join(words, named, [word], how, broadcast_bytes=VOCABULARY_BYTES)


def lookup_vectors(words: DataFrame, vectors: DataFrame) -> DataFrame:
    """``word, known, vector``; an unknown word has the empty vector."""
    return with_vectors(words, vectors, "left").select(
        "word",
        F.col("vector").isNotNull().alias("known"),
        F.coalesce("vector", F.array().cast("array<float>")).alias("vector"),
    )


def pair_vectors(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors of ``word_a`` and ``word_b`` for the pairs of known words."""
    first = with_vectors(pairs, vectors, word="word_a", vector="vector_a")
    return with_vectors(first, vectors, word="word_b", vector="vector_b")


def vector_sum(column: str = "vector", weight: str | None = None) -> Column:
    """Aggregate: the element-wise sum of ``column`` (times ``weight``), as an array of doubles.

    One typed aggregate for the whole vector: partial sums form in the map tasks (a key costs one
    row per task in the shuffle, whatever its number of words), and the plan stays one expression
    whatever the dimension. Null vectors add nothing.
    """
    vector = array_to_vector(F.col(column).cast("array<double>"))
    summary = Summarizer.metrics("sum")
    whole = summary.summary(vector, F.col(weight).cast("double")) if weight else summary.summary(vector)
    return vector_to_array(whole.getField("sum"))


def summed(rows: DataFrame, keys: Sequence[str], column: str = "vector", weight: str | None = None) -> DataFrame:
    """Element-wise sums of ``column`` per key, as ``keys…, vector``."""
    return rows.where(F.col(column).isNotNull()).groupBy(*keys).agg(vector_sum(column, weight).alias("vector"))


def vector_sums(
    words: DataFrame,
    vectors: DataFrame,
    keys: Sequence[str],
    known_only: bool = False,
    weight: str | None = None,
) -> DataFrame:
    """Sum of the word vectors per key; a key with an unknown word has none.

    ``known_only`` skips unknown words instead. ``weight`` names a column of repeat counts.

    Rows of usual keys are dealt out by key without their vectors; keys with an unknown word leave,
    and the others get their vectors and sums where they are. Hot keys form partial sums first.
    """
    if known_only:
        return summed(with_vectors(words, vectors), keys, weight=weight)
    words = words.select(*dict.fromkeys([*keys, "word", *([weight] if weight else [])]))
    hot = hot_keys(words, keys, sample=HOT_SAMPLE)
    if hot.isEmpty():
        return _dealt_sums(words, vectors, keys, weight)
    hot = F.broadcast(hot.select(*keys))
    many, few = (words.join(hot, list(keys), how) for how in ("left_semi", "left_anti"))
    return _dealt_sums(few, vectors, keys, weight).unionByName(_partial_sums(many, vectors, keys, weight))


def _dealt_sums(words: DataFrame, vectors: DataFrame, keys: Sequence[str], weight: str | None) -> DataFrame:
    """Sums of keys that fit a task, so that no vector is shuffled while the vocabulary can be broadcast."""
    known = vectors.groupBy("word").agg(F.every(F.col("vector").isNotNull()).alias("_known"))
    tasks = max(words.count() // ROWS_PER_TASK, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = lookup_join(words.repartition(tasks, *keys), known, ["word"], "left", broadcast_bytes=VOCABULARY_BYTES)
    whole = F.every(F.coalesce("_known", F.lit(False))).over(Window.partitionBy(*keys))
    rows = dealt.withColumn("_known", whole).where("_known").drop("_known")
    return summed(with_vectors(rows, vectors), keys, weight=weight)


def _partial_sums(words: DataFrame, vectors: DataFrame, keys: Sequence[str], weight: str | None) -> DataFrame:
    """Sums that form in the map tasks, whatever the number of words of a key."""
    size = dimension(vectors)
    unknown = F.count_if(F.col("vector").isNull()).alias("_unknown")
    known = F.coalesce(F.col("vector").cast("array<double>"), F.array_repeat(F.lit(0.0), size)).alias("_known")
    per_key = with_vectors(words, vectors, "left").select("*", known).groupBy(*keys).agg(
        unknown, vector_sum("_known", weight).alias("vector"))
    return per_key.where(F.col("_unknown") == 0).select(*keys, "vector")


def sentence_vectors(
    words: DataFrame, vectors: DataFrame, keys: Sequence[str], weight: str | None = None
) -> DataFrame:
    """Unit vector of the known words per key; none when nothing is known or the sum is zero."""
    sums = summed(with_vectors(words, vectors), keys, weight=weight)
    return sums.select(*keys, V.normalize(F.col("vector")).alias("vector")).where("vector is not null")


def n_similarity(words: DataFrame, vectors: DataFrame, keys: Sequence[str], side: str = "side") -> DataFrame:
    """Dot product of the sentence vectors of the two sides (``a`` and ``b``) of each key."""
    size = dimension(vectors)
    both = with_vectors(words, vectors)
    zero = F.array_repeat(F.lit(0.0), size)
    sides = [F.when(F.col(side) == name, F.col("vector").cast("array<double>")).otherwise(zero).alias(f"_{name}")
             for name in ("a", "b")]
    sums = both.select(*keys, *sides).groupBy(*keys).agg(vector_sum("_a").alias("a"), vector_sum("_b").alias("b"))
    units = sums.select(*keys, V.normalize(F.col("a")).alias("a"), V.normalize(F.col("b")).alias("b"))
    return units.where("a is not null and b is not null").select(*keys, V.dot(F.col("a"), F.col("b")).alias("similarity"))


class _Best:
    """Running best ``n`` words per query: highest score first, then the smaller word.

    ``barred``: for each query the words that are no answer to it, or None.
    """

    def __init__(self, ids, matrix: np.ndarray, n: int, barred: Sequence | None = None) -> None:
        norms = np.linalg.norm(matrix, axis=1)
        usable = norms > 0
        self.ids = [i for i, ok in zip(ids, usable) if ok]
        self.units = matrix[usable] / norms[usable, None]
        self.n = n
        given = [None] * len(usable) if barred is None else list(barred)
        self.barred = [None if b is None else np.asarray(list(b), dtype=object) for b, ok in zip(given, usable) if ok]
        self.best = [(np.empty(0, dtype=object), np.empty(0)) for _ in self.ids]

    def add(self, words: np.ndarray, matrix: np.ndarray) -> None:
        if not len(words) or not self.ids:
            return
        norms = np.linalg.norm(matrix, axis=1)
        usable = norms > 0
        words, units = words[usable], matrix[usable] / norms[usable, None]
        if not len(words):
            return
        step = max(1, SCORES_AT_ONCE // len(words))
        for start in range(0, len(self.ids), step):
            block = np.round(self.units[start : start + step] @ units.T, 9)
            for row, scores in enumerate(block, start):
                if self.barred[row] is not None and len(self.barred[row]):
                    left = ~np.isin(words, self.barred[row])
                    self._keep(row, words[left], scores[left])
                else:
                    self._keep(row, words, scores)

    def _keep(self, row: int, words: np.ndarray, scores: np.ndarray) -> None:
        if len(scores) > self.n:
            least = np.partition(scores, len(scores) - self.n)[len(scores) - self.n]
            keep = scores >= least
            words, scores = words[keep], scores[keep]
        scores = np.concatenate([self.best[row][1], scores])
        words = np.concatenate([self.best[row][0], words])
        order = np.lexsort((words.astype(str), -scores))[: self.n]
        self.best[row] = words[order], scores[order]

    def rows(self) -> pd.DataFrame:
        rows = [(i, word, score) for i, (words, scores) in zip(self.ids, self.best) for word, score in zip(words, scores)]
        return pd.DataFrame(rows, columns=["query_id", "word", "score"]) if rows else pd.DataFrame()


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.empty((0, 0))


def _plain(value):
    """A query id as a key of a dictionary; not-a-number stands for a null one."""
    return None if value is None or value != value else value


def _candidates(vectors: DataFrame, queries: DataFrame, n: int, block_bytes: int) -> DataFrame:
    """The ``n`` best words per query and task, as ``query_id, word, score``.

    ``queries(query_id, vector, excluded)``; ``excluded`` lists the words that are no answer to the
    query: its own input, so no row grows with the number of queries that exclude a word.
    """
    spark = vectors.sparkSession
    query_type = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {query_type}, word string, score double"
    size = measured_bytes(queries)

    def compare(best: _Best, batch: pd.DataFrame) -> None:
        best.add(batch["word"].to_numpy(dtype=object), _matrix(batch["vector"]))

    def found(best: _Best) -> Iterator[pd.DataFrame]:
        rows = best.rows()
        if len(rows):
            yield rows

    if size <= block_bytes:
        held = queries.collect()
        if not held:
            return spark.createDataFrame([], schema)
        shared = spark.sparkContext.broadcast(
            ([r["query_id"] for r in held], np.array([r["vector"] for r in held], np.float64), n,
             [r["excluded"] for r in held])
        )

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = _Best(*shared.value)
            for batch in batches:
                compare(best, batch)
            yield from found(best)

        return vectors.select("word", "vector").mapInPandas(search, schema)

    # More queries than one task should hold: blocks of queries meet blocks of words, where cones allow.
    return _in_cones(vectors, queries, n, block_bytes, schema, compare)


#: Cells shipped by the last search in blocks, and all cells there were: for tests and reports.
SHIPPED = {"cells": 0, "all": 0}
_SLACK = 1e-6


def _with_pivot(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``df`` with ``pivot``, the nearest of the unit ``pivots`` by cosine, and ``near``, that cosine (1 for zero vectors)."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch["vector"])
            norms = np.linalg.norm(x, axis=1)
            cos = (x @ pivots.T) / np.where(norms > 0, norms, 1.0)[:, None]
            pivot = np.argmax(cos, axis=1)
            near = np.where(norms > 0, cos[np.arange(len(x)), pivot], 1.0)
            yield batch.assign(pivot=pivot.astype(np.int32), near=np.clip(near, -1.0, 1.0))

    return df.mapInPandas(run, f"{fields}, pivot int, near double")


def _in_cones(vectors: DataFrame, queries: DataFrame, n: int, block_bytes: int, schema: str, compare) -> DataFrame:
    """The ``n`` best words per query and cell, cells pruned by angle bounds.

    Words and queries join their nearest pivot (pivots: a fixed set of words, one per word block),
    and are split further where a pivot holds more than a block. A cone per block bounds the angle of
    its members from the pivot. First each query block meets the word blocks of its own pivot, which
    gives every query an ``n``-th score; a block of another pivot is shipped to a query block only
    if the smallest angle between their cones allows a cosine at least that high. Ties survive: the
    bound is compared with a slack above rounding.
    """
    spark = vectors.sparkSession
    word_bytes, query_bytes = measured_bytes(vectors), measured_bytes(queries)
    pivot_rows = (vectors.where(F.aggregate("vector", F.lit(0.0), lambda a, v: a + F.abs(v.cast("double"))) > 0)
                  .orderBy(F.xxhash64("word"), "word").limit(max(1, -(-word_bytes // block_bytes))).collect())
    if not pivot_rows:
        return spark.createDataFrame([], schema)
    pivots = np.array([r["vector"] for r in pivot_rows], np.float64)
    pivots /= np.linalg.norm(pivots, axis=1)[:, None]
    words = stored(_with_pivot(vectors.select("word", "vector"), pivots))
    asked = stored(_with_pivot(queries.select("query_id", "vector", "excluded"), pivots))

    def splits(df: DataFrame, size: int) -> dict[int, tuple[int, float]]:
        """Per pivot: how many blocks its rows need, and the least cosine of a member."""
        rows = df.groupBy("pivot").agg(F.count(F.lit(1)).alias("c"), F.min("near").alias("m")).collect()
        total = sum(r["c"] for r in rows) or 1
        return {r["pivot"]: (max(1, -(-r["c"] * size // (total * block_bytes))), r["m"]) for r in rows}

    word_split, query_split = splits(words, word_bytes), splits(asked, query_bytes)

    def sub(key: str, split: dict) -> Column:
        counts = F.array(*[F.lit(split.get(p, (1, 1.0))[0]) for p in range(len(pivots))])
        return F.pmod(F.xxhash64(key), F.element_at(counts, F.col("pivot") + 1)).cast("int")

    words = words.withColumn("sub", sub("word", word_split))
    asked = asked.withColumn("sub", sub("query_id", query_split))
    cones = {(r["pivot"], r["sub"]): r["m"] for r in asked.groupBy("pivot", "sub").agg(F.min("near").alias("m")).collect()}

    def meet(some: pd.DataFrame, them: pd.DataFrame) -> pd.DataFrame:
        best = _Best([*map(_plain, some["query_id"])], _matrix(some["vector"]), n, some["excluded"])
        compare(best, them)
        rows = best.rows()
        return rows if len(rows) else pd.DataFrame({"query_id": some["query_id"][:0], "word": them["word"][:0], "score": np.zeros(0)})

    def search(cells: list[tuple[int, int, int, int]]) -> DataFrame:
        def table() -> DataFrame:  # one each side, so that the two joins do not share columns
            return F.broadcast(spark.createDataFrame(cells, "qp int, qs int, wp int, ws int"))

        left = asked.join(table(), (F.col("pivot") == F.col("qp")) & (F.col("sub") == F.col("qs"))).select(
            "qp", "qs", "wp", "ws", "query_id", "vector", "excluded")
        right = words.join(table(), (F.col("pivot") == F.col("wp")) & (F.col("sub") == F.col("ws"))).select(
            "qp", "qs", "wp", "ws", "word", "vector")
        key = ["qp", "qs", "wp", "ws"]
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(meet, schema)

    blocks = sorted(cones)
    home_cells = [(p, s, p, w) for p, s in blocks for w in range(word_split.get(p, (0, 1.0))[0]) if p in word_split]
    home = stored(search(home_cells)) if home_cells else spark.createDataFrame([], schema)
    # the n-th score of each query at home, and the least of them per query block
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "word")
    nth = home.withColumn("r", F.row_number().over(order)).where(F.col("r") == n).select("query_id", F.col("score").alias("t"))
    floor = asked.join(nth, asked["query_id"].eqNullSafe(nth["query_id"]), "left").groupBy("pivot", "sub").agg(
        F.min(F.coalesce("t", F.lit(-2.0))).alias("t"))
    least = {(r["pivot"], r["sub"]): r["t"] for r in floor.collect()}
    angle = np.arccos(np.clip(pivots @ pivots.T, -1.0, 1.0))
    far_cells = []
    for p, s in blocks:
        for wp, (count, near) in word_split.items():
            if wp == p:
                continue
            gap = angle[p, wp] - np.arccos(near) - np.arccos(cones[(p, s)])
            if np.cos(max(gap, 0.0)) + _SLACK >= least.get((p, s), -2.0):
                far_cells += [(p, s, wp, w) for w in range(count)]
    SHIPPED.update(cells=len(home_cells) + len(far_cells), all=len(blocks) * sum(c for c, _ in word_split.values()))
    return home.unionByName(search(far_cells)) if far_cells else home


def nearest_neighbors(
    vectors: DataFrame,
    queries: DataFrame,
    n: int = 40,
    in_set: DataFrame | None = None,
    out_set: DataFrame | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The ``n`` words closest to each query by cosine: ``query_id, word, score, rank``.

    ``queries(query_id, vector)``; ``in_set(word)`` limits the words; ``out_set(query_id, word)``
    excludes words per query, of a null ``query_id`` too. Each query brings the words it excludes to
    its task, so that a task keeps and passes on ``n`` rows per query, and a word excluded by very
    many queries is still one row of its own.
    A query with a zero or null vector has no result.
    """
    words = vectors.select("word", "vector")
    if in_set is not None:
        words = lookup_join(words, in_set.select("word").distinct(), ["word"], "left_semi")
    asked = queries.where("vector is not null").select("query_id", "vector")
    if out_set is None:
        asked = asked.withColumn("excluded", F.lit(None).cast("array<string>"))
    else:
        # each query's own exclusions: as long as its input, however many queries exclude a word
        own = out_set.where(F.col("word").isNotNull()).groupBy(F.col("query_id").alias("_q")).agg(
            F.collect_set("word").alias("excluded"))
        asked = asked.join(own, asked["query_id"].eqNullSafe(own["_q"]), "left").drop("_q")
    found = _candidates(words, asked, n, block_bytes)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "word")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def nearest_to_words(groups: DataFrame, vectors: DataFrame, n: int = 40) -> DataFrame:
    """Words closest to the sum of each group ``(query_id, word)``, its own words excluded.

    A group with an unknown word has no result.
    """
    return nearest_neighbors(vectors, vector_sums(groups, vectors, ["query_id"]), n, out_set=groups)


def analogy(triples: DataFrame, vectors: DataFrame, n: int = 40) -> DataFrame:
    """``word1`` is to ``word2`` as ``word3`` is to …: closest to ``word2 - word1 + word3``.

    ``triples(query_id, word1, word2, word3)``; a triple with an unknown word has no result.
    """
    known = triples
    for i in (1, 2, 3):
        known = with_vectors(known, vectors, word=f"word{i}", vector=f"v{i}")
    target = V.add(V.subtract(F.col("v2"), F.col("v1")), F.col("v3"))
    own = triples.select("query_id", F.explode(F.array("word1", "word2", "word3")).alias("word"))
    return nearest_neighbors(vectors, known.select("query_id", target.alias("vector")), n, out_set=own)


def rank_words(sets: DataFrame, vectors: DataFrame) -> DataFrame:
    """Members of each set ``(center, word)`` by cosine to the centre: ``center, word, score``.

    The centre is ranked too if it is a member. A set with an unknown word has no result.
    """
    sets = sets.select("center", "word").distinct()
    unknown = lookup_join(sets, vectors.select("word"), ["word"], "left_anti", ["center"])
    incomplete = stored(unknown.select("center").distinct())
    whole = lookup_join(sets, incomplete, ["center"], "left_anti", spread_by=["word"])
    members = with_vectors(whole, vectors)
    both = with_vectors(members, vectors, word="center", vector="center_vector")
    score = V.cosine(F.col("center_vector"), F.col("vector"))
    return both.select("center", "word", F.round(score, 9).alias("score")).orderBy(
        "center", F.desc("score"), "word"
    )

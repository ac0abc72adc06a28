"""Document perplexity under an interpolated modified Kneser-Ney n-gram model of trusted text.

``judge`` scores with the word model of ``word_model``. ``Model`` and ``perplexities`` here are a
model of signs, which no query uses. Its units are signs: code points below 2,046 stand for themselves, all others share 2,048 classes
by a fixed hash, and two more mark the start and the end of a document. Five units of 12 bits fit
one long, so an n-gram is a number, its context is the number without the last 12 bits and its
suffix the number without the first. Four start marks stand before a document.

Training counts 5-grams; the adjusted count of a shorter n-gram is the number of different units
seen before it. Counts, contexts and probabilities are tables keyed by n-gram and sharded over
them. Each different 5-gram of the corpus is asked for once; joins with the counts of every order,
from one unit up, give its probability, and documents add up the logarithms.

Tasks gather their different 5-grams first, so what is shuffled grows with tasks times vocabulary,
far below the number of signs. The table of probabilities is broadcast while it is small; beyond
that, documents are packed into blocks, and each block is joined with the 5-grams it holds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qalink.llm.base import row_key, text_of
from qalink.llm.word_model import WordModel
from qalink.operators.joins import lookup_join
from qalink.sources.scratch import stored

ORDER = 5
BITS = 12
UNITS = 1 << BITS
START, END = 0, 1
#: Rows of the table of probabilities up to which it is broadcast, at 12 bytes each.
BROADCAST_GRAMS = 4_000_000
#: Signs that a task works on at once, and of a block beyond the broadcast limit.
CHUNK_SIGNS = 1_000_000
#: Different 5-grams that a task gathers before it passes them on.
GATHERED = 1_000_000
#: Units of average text that a document is judged together with, so that a few signs decide little.
PRIOR_UNITS = 20
#: One trusted document in so many is not learned from but gives the quantiles.
HELD_OUT = 5


# Signs to n-grams.


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 5-gram that ends at each sign and at the end of each text, and their number per text."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    units = np.where(codes < UNITS // 2 - 2, codes + 2, UNITS // 2 + (codes * 2654435761 >> 7) % (UNITS // 2))
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    row = np.full(int(lengths.sum()) + ORDER * len(texts), START, np.int64)
    before = np.repeat(np.arange(len(texts)) * ORDER + ORDER - 1, lengths)
    row[np.arange(len(units)) + before] = units
    ends = np.cumsum(lengths + ORDER) - 1
    row[ends] = END
    keys = row[ORDER - 1 :].copy()
    for back in range(1, ORDER):
        keys |= row[ORDER - 1 - back : len(row) - back] << (BITS * back)
    # The windows that would end at a start mark are left out.
    real = np.ones(len(keys), bool)
    for mark in range(ORDER - 1):
        real[ends[:-1] + 1 + mark - (ORDER - 1)] = False
    return keys[real], lengths + 1


def slices(texts: list[str], signs: int = CHUNK_SIGNS) -> Iterator[slice]:
    """Slices of about so many signs each; a longer text is a slice of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > signs:
            yield slice(start, i)
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield slice(start, len(texts))


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, found = pd.factorize(keys)
    return found, np.bincount(codes, minlength=len(found))


class _Gathered:
    """Counts of 5-grams, merged now and then."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.size += len(keys)
        if self.size > GATHERED:
            self.parts = [self.merged()]
            self.size = len(self.parts[0][0])

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys = np.concatenate([k for k, _ in self.parts])
        codes, found = pd.factorize(keys)
        counts = np.bincount(codes, np.concatenate([c for _, c in self.parts]), len(found)).astype(np.int64)
        return found, counts


def gram_counts(texts: DataFrame) -> DataFrame:
    """``g, a``: the 5-grams of ``texts(text)`` with their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = _Gathered()

        def rows() -> pa.RecordBatch:
            keys, counts = gathered.merged()
            gathered.parts, gathered.size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["g", "a"])

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for some in slices(texts):
                gathered.add(*_distinct(grams(texts[some])[0]))
                if len(gathered.parts) == 1 and gathered.size > GATHERED // 2:  # merged, and still many
                    yield rows()
        yield rows()

    counted = texts.select(text_of().alias("text")).mapInArrow(count, "g long, a long")
    return counted.groupBy("g").agg(F.sum("a").alias("a"))


# The model.


def suffix(gram: Column, units: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << BITS * units) - 1))


def context(gram: Column) -> Column:
    return F.shiftright(gram, BITS)


def discounts(seen: dict[int, int]) -> list[float]:
    """Discounts for counts of 1, 2 and 3 or more, from how many n-grams have each count up to 4."""
    n1, n2, n3, n4 = (seen.get(i, 0) for i in (1, 2, 3, 4))
    if not (n1 and n2 and n3 and n4):
        return [0.5, 0.75, 1.0]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)]


class Model:
    """Adjusted counts of every order as one table ``k, g, a``, with the discounts."""

    def __init__(self, trusted: DataFrame):
        """Learns from the texts of ``trusted(text)``."""
        levels = [stored(gram_counts(trusted))]
        for k in range(ORDER - 1, 0, -1):
            levels.insert(0, stored(levels[0].groupBy(suffix(F.col("g"), k).alias("g")).agg(F.count(F.lit(1)).alias("a"))))
        self.levels = levels
        self.discounts = []
        for level in levels:
            seen = level.groupBy(F.least("a", F.lit(5)).alias("a")).count().collect()
            self.discounts.append(discounts({r["a"]: r["count"] for r in seen}))

    def contexts(self, k: int) -> DataFrame:
        """``c, total, free``: what a context of ``k - 1`` units saw, and the mass it leaves to shorter ones."""
        d1, d2, d3 = self.discounts[k - 1]
        kept_back = F.when(F.col("a") == 1, d1).when(F.col("a") == 2, d2).otherwise(d3)
        return self.levels[k - 1].groupBy(context(F.col("g")).alias("c")).agg(
            F.sum("a").alias("total"), F.sum(kept_back).alias("free")
        )

    def probabilities(self, wanted: DataFrame) -> DataFrame:
        """``g, p`` for the different 5-grams ``wanted(g)``: of the last unit after the others."""
        asked = {ORDER: wanted}
        for k in range(ORDER - 1, 0, -1):
            asked[k] = asked[k + 1].select(suffix(F.col("g"), k).alias("g")).distinct()
        shorter = None
        for k in range(1, ORDER + 1):
            d1, d2, d3 = self.discounts[k - 1]
            a = F.coalesce("a", F.lit(0))
            taken = F.when(a == 0, 0.0).when(a == 1, d1).when(a == 2, d2).otherwise(d3)
            rows = asked[k].join(self.levels[k - 1], "g", "left").withColumn("c", context(F.col("g")))
            rows = rows.join(self.contexts(k), "c", "left")
            if shorter is None:
                rows = rows.withColumn("q", F.lit(1.0 / UNITS))
            else:
                rows = rows.withColumn("s", suffix(F.col("g"), k - 1)).join(
                    shorter.select(F.col("g").alias("s"), F.col("p").alias("q")), "s"
                )
            p = F.when(F.col("total").isNull(), F.col("q")).otherwise(
                (a - taken) / F.col("total") + F.col("free") / F.col("total") * F.col("q")
            )
            shorter = rows.select("g", p.alias("p"))
        return shorter


# Documents.


def _sums(texts: list[str], keys: np.ndarray, logs: np.ndarray) -> tuple[list[float], list[int]]:
    """Log probability and number of units of each text, by a sorted table."""
    found, counts = grams(texts)
    codes, different = pd.factorize(found)
    at = np.searchsorted(keys, different)
    if len(different) and (at.max(initial=0) >= len(keys) or (keys[at] != different).any()):
        raise ValueError("a 5-gram without a probability: the documents changed meanwhile")
    starts = np.cumsum(counts) - counts
    return np.add.reduceat(logs[at][codes], starts).tolist() if len(counts) else [], counts.tolist()


_SCORED = "logp double, units long"


def _by_broadcast(docs: DataFrame, table: DataFrame) -> DataFrame:
    frame = table.select("g", F.log("p").alias("l")).toArrow()
    keys, logs = frame.column("g").to_numpy(), frame.column("l").to_numpy()
    order = np.argsort(keys)
    sent = docs.sparkSession.sparkContext.broadcast((keys[order], logs[order]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, logs = sent.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sums, units = [], []
            for some in slices(texts):
                a, b = _sums(texts[some], keys, logs)
                sums += a
                units += b
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sums, pa.float64()), pa.array(units, pa.int64())], names=["key", "logp", "units"]
            )

    return docs.mapInArrow(score, "key string, " + _SCORED)


def blocks(docs: DataFrame, signs: int = CHUNK_SIGNS) -> DataFrame:
    """``block, keys, lengths, packed, grams``: documents in bounded blocks, with their 5-grams."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for some in slices(texts, signs):
                raw = "".join(texts[some]).encode("utf-8", "surrogatepass")
                row = [
                    [number],
                    [keys[some]],
                    [[len(t) for t in texts[some]]],
                    [zlib.compress(raw, 1)],
                    [pd.unique(grams(texts[some])[0]).tolist()],
                ]
                kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64())]
                arrays = [pa.array(v, t) for v, t in zip(row, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names=["block", "keys", "lengths", "packed", "grams"])
                number += 1

    return docs.mapInArrow(
        pack, "block long, keys array<string>, lengths array<long>, packed binary, grams array<long>"
    )


def _by_blocks(packed: DataFrame, table: DataFrame) -> DataFrame:
    asked = packed.select(F.col("block").alias("owner"), F.explode("grams").alias("g"))
    known = asked.join(table.select("g", F.log("p").alias("l")), "g").select("owner", "g", "l")

    def score(texts: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        order = known["g"].to_numpy().argsort()
        keys, logs = known["g"].to_numpy()[order], known["l"].to_numpy()[order]
        out = []
        for row in texts.itertuples():
            whole = zlib.decompress(row.packed).decode("utf-8", "surrogatepass")
            ends = np.cumsum(row.lengths)
            cut = [whole[b - n : b] for b, n in zip(ends, row.lengths)]
            out += zip(row.keys, *_sums(cut, keys, logs))
        return pd.DataFrame(out, columns=["key", "logp", "units"]).astype({"logp": "float64", "units": "int64"})

    return packed.drop("grams").groupBy("block").cogroup(known.groupBy("owner")).applyInPandas(score, "key string, " + _SCORED)


def perplexities(docs: DataFrame, model: Model, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """``key, logp, units, perplexity`` for ``docs(key string, text string)``, texts not null.

    Both ways give the same numbers; ``broadcast_grams`` only decides how they get there.
    """
    asked = stored(gram_counts(docs).select("g"))
    table = stored(model.probabilities(asked))
    if table.count() <= broadcast_grams:
        scored = _by_broadcast(docs, table)
    else:
        scored = _by_blocks(stored(blocks(docs)), table)
    return scored.withColumn("perplexity", F.exp(-F.col("logp") / F.col("units")))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """``doc_id, held_out`` of the documents that all their labels call good."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id")
    good = known.agg(F.min("quality").alias("quality")).where("quality = 1")
    turn = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(HELD_OUT))
    return good.select("doc_id", (turn == 0).alias("held_out"))


def judge(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, slack: float = 1.05) -> DataFrame:
    """``doc_id, lang, key, units, perplexity, smoothed, threshold, kept`` per row of ``docs(doc_id, text, lang)``.

    Trusted text is what ``labels(doc_id, quality)`` calls good; documents with conflicting labels
    are not trusted. Four fifths of it train the model. The rest gives each language its threshold:
    the ``quantile`` of their smoothed perplexities times ``slack``; smoothed is the perplexity of the
    document together with ``PRIOR_UNITS`` units as likely as those of the held-out text on average.
    A document is kept up to the threshold. A language
    without such a document has the threshold of all languages together, and without any trusted
    document everything is kept. A null language is one of its own; null text is empty, and an
    empty text still has its end mark to be judged by. Rows that repeat id and text share ``key``
    and result. Further columns are ignored. An empty table gives no rows.
    """
    rows = docs.select("doc_id", "lang", row_key().alias("key"), text_of().alias("text"))
    trusted = trusted_ids(labels)
    learn = lookup_join(rows.select("doc_id", "text"), trusted.where("not held_out").select("doc_id"), ["doc_id"], "left_semi")
    model = WordModel(learn)
    named = rows.select(F.to_json(F.struct("key", "doc_id", "lang")).alias("key"), "text")
    scored = stored(model.scores(named).withColumn("perplexity", F.exp(-F.col("logp") / F.col("units"))))
    kind = f"key string, doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string"
    scored = scored.select(F.from_json("key", kind).alias("r"), "logp", "units", "perplexity").select("r.*", "logp", "units", "perplexity")
    held = lookup_join(scored, trusted.where("held_out").select("doc_id"), ["doc_id"], "left_semi")
    usual = held.agg((F.sum(-F.col("logp")) / F.sum("units")).alias("m")).first()["m"] or 0.0
    smoothed = F.exp((F.lit(PRIOR_UNITS * usual) - F.col("logp")) / (F.col("units") + PRIOR_UNITS))
    language = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-"))
    scored, held = (x.withColumn("smoothed", smoothed).withColumn("language", language) for x in (scored, held))
    at = F.percentile_approx("smoothed", F.lit(quantile), F.lit(10_000)) * slack
    own = held.groupBy("language").agg(at.alias("own"))
    common = held.agg(at.alias("t")).first()["t"]
    judged = lookup_join(scored, own, ["language"], "left", spread_by=["key"])
    threshold = F.coalesce("own", F.lit(common).cast("double"), F.lit(float("inf")))
    return judged.withColumn("threshold", threshold).select(
        "doc_id", "lang", "key", "units", "perplexity", "smoothed", "threshold",
        (F.col("smoothed") <= F.col("threshold")).alias("kept"),
    )


def kept_documents(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, slack: float = 1.05) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns."""
    gone = judge(docs, labels, quantile, slack).where("not kept").select(F.col("key").alias("_judged")).distinct()
    packed = docs.select(F.struct("*").alias("row"), row_key().alias("_judged"))
    return lookup_join(packed, gone, ["_judged"], "left_anti", spread_by=["_judged"]).select("row.*")

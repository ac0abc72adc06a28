"""Document probabilities under an interpolated modified Kneser-Ney trigram model of words.

A word is a run of letters, digits and underscores, in its own case; every other sign that is not
white space is a word of its own. The most frequent words of the trusted text, ``VOCABULARY`` at
most, stand for themselves; all others share ``CLASSES`` hashed classes of case, length and last
two signs. A word that repeats the word before it, signs between them aside, is in one of as many
classes of repeated words, by its hash: a run of one word is no likelier for that word's frequency.
Three units of 17 bits fit one long: middle word, first word, last word.

All that the probability of a trigram takes is found by its middle word: the trigram, its context
and its shorter form. So trigrams are dealt to shards by the middle word, and by the first one too
where the middle is frequent; the shorter forms of such a middle are summed and copied to all its shards.

Trigrams travel as messages, many to a row: sorted, as differences, byte by byte, compressed. Those
of the trusted text are shuffled once; the discounts and the scores are both computed from that
shuffle. Texts are read once for scoring. Blocks of documents send each shard their different
trigrams; the shard builds its counts first, then looks up block after block and gives back a sum
per document, the sums of a block in one row. How many shards there are follows the trusted text,
as a shard holds its counts in memory, and not the texts that are scored. Nothing that grows with
the corpus goes to the driver; what is broadcast is bounded by the number of units.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qalink.llm.base import tidied

WORD_BITS = 17
VOCABULARY = 1 << 16
CLASSES = 1 << 12
REPEATED = VOCABULARY + CLASSES
FIRST, LAST = REPEATED + CLASSES, REPEATED + CLASSES + 1
UNITS = LAST + 1
#: A word that occurs less often in the text learned from is scored as its class.
LEAST_COUNT = 5
#: Signs of a block of documents, and of the trusted text whose trigrams one shard holds.
BLOCK_SIGNS = 4_000_000
SHARD_SIGNS = 64_000_000
#: Parts of one that sums of logarithms are rounded to, so that their order does not matter.
FINE = 1 << 30
#: Different words and trigrams that a task gathers before it passes them on.
GATHERED = 1_000_000
_MASK = (1 << WORD_BITS) - 1
_WORD = re.compile(r"\w+|[^\w\s]")


# Texts to trigrams.


def word_class(word: str) -> int:
    """The unit of a word outside the vocabulary."""
    case = "a" if word.islower() else "A" if word.isupper() and len(word) > 1 else "Aa" if word[0].isupper() else "?"
    form = f"{case if word[0].isalnum() else word} {min(len(word), 40) // 3} {word[-2:].lower()}"
    return VOCABULARY + zlib.crc32(form.encode("utf-8", "surrogatepass")) % CLASSES


class _Units(dict):
    """Words to units; what is outside the vocabulary is remembered up to a bound."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__(vocabulary)
        self.most = len(vocabulary) + GATHERED

    def __missing__(self, word: str) -> int:
        unit = word_class(word)
        if len(self) < self.most and len(word) <= 40:
            self[word] = unit
        return unit


def trigrams(texts: list[str], units: _Units) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams that end at each word and at the end of each text, and their number per text."""
    row: list[int] = []
    counts = []
    for text in texts:
        found = _WORD.findall(text)
        row += (FIRST, FIRST)
        start = len(row)
        row.extend(map(units.__getitem__, found))
        places = [i for i, word in enumerate(found) if word[0].isalnum()]
        for i, j in zip(places, places[1:]):
            if found[i] == found[j]:
                row[start + j] = REPEATED + zlib.crc32(found[j].encode("utf-8", "surrogatepass")) % CLASSES
        row.append(LAST)
        counts.append(len(found) + 1)
    ids = np.array(row, np.int64)
    lengths = np.array(counts, np.int64)
    keys = ids[1:-1] << 2 * WORD_BITS | ids[:-2] << WORD_BITS | ids[2:]
    real = np.ones(len(keys), bool)
    ends = np.cumsum(lengths + 2)[:-1]
    real[ends - 2] = real[ends - 1] = False
    return keys[real], lengths


def _batches(items: Iterable, signs: Callable) -> Iterator[list]:
    """Lists of items of ``BLOCK_SIGNS`` together; a longer item is a list of its own."""
    held, size = [], 0
    for item in items:
        if held and size + signs(item) > BLOCK_SIGNS:
            yield held
            held, size = [], 0
        held.append(item)
        size += signs(item) + 1
    if held:
        yield held


def usual_words(texts: DataFrame, parts: int) -> DataFrame:
    """``word, n`` of ``texts(text)`` from ``LEAST_COUNT`` on; words of over 40 signs have no place in the vocabulary."""

    def count(texts: Iterator) -> Iterator[tuple]:
        found: Counter = Counter()

        def messages() -> Iterator[tuple]:
            dealt: dict[int, list[str]] = {}
            for word in sorted(w for w in found if len(w) <= 40 and w.isprintable()):
                dealt.setdefault(zlib.crc32(word.encode()) % parts, []).append(word)
            for part, words in dealt.items():
                yield part, (_pressed("\n".join(words).encode()), _packed(np.array([found[w] for w in words]), 5))
            found.clear()

        for (text,) in texts:
            found.update(_WORD.findall(text))
            if len(found) > GATHERED:
                yield from messages()
        yield from messages()

    def total(messages: Iterator) -> Iterator[tuple]:
        found: Counter = Counter()
        for _, (words, counts) in messages:
            for word, n in zip(_plain(words).decode().split("\n"), _unpacked(counts).tolist()):
                found[word] += n
        return ((word, n) for word, n in found.items() if n >= LEAST_COUNT)

    # As everywhere here but at the end: no second kind of Python worker stays in memory beside the first.
    counted = texts.rdd.mapPartitions(tidied(count)).partitionBy(parts, _place).mapPartitions(tidied(total))
    return texts.sparkSession.createDataFrame(counted, "word string, n long", verifySchema=False)


# Messages.


def _pressed(raw: bytes) -> bytes:
    return len(raw).to_bytes(4, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def _plain(raw: bytes) -> bytes:
    return pa.Codec("zstd").decompress(raw[4:], int.from_bytes(raw[:4], "little"), asbytes=True)


def _packed(values: np.ndarray, width: int) -> list[bytes]:
    """Values below 256 ** ``width``, not negative; bytes of equal weight stand together, as they are alike."""
    planes = np.ascontiguousarray(values, "<i8").view(np.uint8).reshape(-1, 8)
    return [_pressed(planes[:, i].tobytes()) for i in range(width)]


def _unpacked(planes: list[bytes]) -> np.ndarray:
    raw = [np.frombuffer(_plain(p), np.uint8) for p in planes]
    out = np.zeros((len(raw[0]), 8), np.uint8)
    for i, plane in enumerate(raw):
        out[:, i] = plane
    return out.view("<i8").ravel()


def _units(keys: np.ndarray) -> list[np.ndarray]:
    return [keys >> shift & _MASK for shift in (2 * WORD_BITS, WORD_BITS, 0)]


def _steps(columns: list[np.ndarray]) -> list[bytes]:
    """Sorted rows: what each column adds to the row before, or all of it where a column left of it is new."""
    out, new = [], np.arange(len(columns[0])) == 0
    for column in columns:
        step = np.where(new, column, np.diff(column, prepend=0))
        out += _packed(step, 3)
        new |= step != 0
    return out


def _from_steps(parts: list[bytes]) -> list[np.ndarray]:
    columns, new = [], None
    for i in range(0, len(parts), 3):
        step = _unpacked(parts[i : i + 3])
        new = np.arange(len(step)) == 0 if new is None else new
        run = np.cumsum(step)
        starts = np.flatnonzero(new)
        columns.append(run - np.repeat(run[starts] - step[starts], np.diff(np.r_[starts, len(step)])))
        new |= step != 0
    return columns


def _joined(middle: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return middle << 2 * WORD_BITS | first << WORD_BITS | last


def _runs(sorted_values: np.ndarray) -> Iterator[tuple[int, slice]]:
    ends = np.flatnonzero(np.r_[sorted_values[1:] != sorted_values[:-1], True]) + 1 if len(sorted_values) else []
    start = 0
    for end in ends:
        yield int(sorted_values[start]), slice(start, int(end))
        start = int(end)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, sorted, with the sums of their counts."""
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    together, numbers = np.concatenate(keys), np.concatenate(counts)
    keys.clear()
    counts.clear()
    order = np.argsort(together, kind="stable")
    together, numbers = together[order], numbers[order]
    first = np.flatnonzero(np.diff(together, prepend=-1))
    return together[first], np.add.reduceat(numbers, first, dtype=np.int64) if len(first) else numbers


def _pair_counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Middle and last word of different trigrams, with the number of words seen before them."""
    return np.unique(keys >> 2 * WORD_BITS << WORD_BITS | keys & _MASK, return_counts=True)


def _place(shard: int) -> int:
    return shard


#: Kinds of messages ``shard, (kind, block, parts)``: counts of trigrams and of pairs, a block's trigrams, its names.
KNOWN, PAIRS, ASKED, NAMES = range(4)


def _trigrams_of(messages: Iterator) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = [], []
    for _, (_, _, parts) in messages:
        keys.append(_joined(*_from_steps(parts[:9])))
        counts.append(_unpacked(parts[9:]).astype(np.uint32))
    return _summed(keys, counts)


def _pairs_of(messages: Iterator) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = [], []
    for _, (_, _, parts) in messages:
        keys.append(np.cumsum(_unpacked(parts[:5])))
        counts.append(_unpacked(parts[5:]))
    return _summed(keys, counts)


# Lookup.


def _cut(a: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(a, 3)]


def _find(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``asked`` in the sorted ``keys``, and which of them are there."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


class _Level:
    """Counts of one order with the totals of their contexts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, d: list[float]):
        if np.any(keys[1:] < keys[:-1]):
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            del order
        self.keys = keys
        cut = _cut(counts, d)
        self.own = counts - cut
        self.contexts, first = np.unique(self.keys >> WORD_BITS, return_index=True)
        none = not len(first)
        self.total = np.zeros(0) if none else np.add.reduceat(counts, first).astype(float)
        self.free = np.zeros(0) if none else np.add.reduceat(cut, first)

    def interpolated(self, asked: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        at, known = _find(self.contexts, asked >> WORD_BITS)
        p = shorter.copy()
        if known.any():
            place, there = _find(self.keys, asked[known])
            total, free = self.total[at[known]], self.free[at[known]]
            p[known] = np.where(there, self.own[place], 0.0) / total + free / total * shorter[known]
        return p


def _dealt(keys: np.ndarray, salts: np.ndarray, shards: int) -> np.ndarray:
    """The shard of trigrams: by the middle word, and the first one where the middle is frequent."""
    middle, first = keys >> 2 * WORD_BITS, keys >> WORD_BITS & _MASK
    return _shard(middle, (first * 40503 >> 4) % salts[middle], shards)


def _shard(middle: np.ndarray, salt: np.ndarray, shards: int) -> np.ndarray:
    mixed = (middle * 2654435761 + salt * 2246822519) & 0xFFFFFFFF
    return ((mixed ^ mixed >> 15) * 2654435761 >> 9 & 0xFFFFFF) % shards


def _seen(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts, 5), minlength=6)


class WordModel:
    """Learns from the texts of ``trusted(text)``, texts not null."""

    def __init__(self, trusted: DataFrame):
        from qalink.llm.kneser_ney import discounts

        context = trusted.sparkSession.sparkContext
        trusted = trusted.select("text")
        signs = trusted.agg(F.sum(F.length("text"))).first()[0] or 0
        self.shards = shards = max(2 * context.defaultParallelism, -(-signs // SHARD_SIGNS))
        usual = usual_words(trusted, shards).orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()
        self.vocabulary = vocabulary = context.broadcast({r["word"]: i for i, r in enumerate(usual)})
        share = np.zeros(UNITS)
        share[: len(usual)] = [r["n"] for r in usual]
        self.salts = salts = context.broadcast(1 + (share / max(share.sum(), 1) * shards * 2).astype(np.int64))

        def learn(texts: Iterator) -> Iterator[tuple]:
            units, gathered, size = _Units(vocabulary.value), [], 0

            def messages() -> Iterator[tuple]:
                together = np.concatenate(gathered)
                gathered.clear()
                together.sort()
                first = np.flatnonzero(np.diff(together, prepend=-1))
                all_keys, all_counts = together[first], np.diff(np.r_[first, len(together)])
                del together, first
                for start in range(0, len(all_keys), GATHERED // 2):
                    keys, counts = (x[start : start + GATHERED // 2] for x in (all_keys, all_counts))
                    shard = _dealt(keys, salts.value, shards)
                    order = np.argsort(shard, kind="stable")
                    keys, counts = keys[order], counts[order]
                    for s, run in _runs(shard[order]):
                        yield s, (KNOWN, None, _steps(_units(keys[run])) + _packed(counts[run], 4))

            for some in _batches((r[0] for r in texts), len):
                gathered.append(trigrams(some, units)[0])
                size += len(gathered[-1])
                if size > 4 * GATHERED:
                    yield from messages()
                    size = 0
            if gathered:
                yield from messages()

        def split(messages: Iterator) -> Iterator[tuple]:
            keys, _ = _trigrams_of(messages)
            pairs, counts = _pair_counts(keys[salts.value[keys >> 2 * WORD_BITS] > 1])
            to = _shard(pairs >> WORD_BITS, pairs & _MASK, shards)
            for s in np.unique(to).tolist():
                yield s, (PAIRS, None, _packed(np.diff(pairs[to == s], prepend=0), 5) + _packed(counts[to == s], 4))

        def copies(messages: Iterator) -> Iterator[tuple]:
            pairs, counts = _pairs_of(messages)
            times = salts.value[pairs >> WORD_BITS]
            salt = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            pairs, counts = np.repeat(pairs, times), np.repeat(counts, times)
            shard = _shard(pairs >> WORD_BITS, salt, shards)
            # Two salts may share a shard.
            code, at = np.unique(shard << 2 * WORD_BITS | pairs, return_index=True)
            pairs, counts = pairs[at], counts[at]
            for s, run in _runs(code >> 2 * WORD_BITS):
                yield s, (PAIRS, None, _packed(np.diff(pairs[run], prepend=0), 5) + _packed(counts[run], 4))

        def seen(a: np.ndarray, pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
            return np.r_[_seen(a), _seen(counts), np.bincount(pairs & _MASK, minlength=UNITS)]

        def seen_whole(messages: Iterator) -> Iterator[np.ndarray]:
            keys, a = _trigrams_of(messages)
            yield seen(a, *_pair_counts(keys[salts.value[keys >> 2 * WORD_BITS] == 1]))

        def seen_split(messages: Iterator) -> Iterator[np.ndarray]:
            yield seen(np.zeros(0, np.int64), *_pairs_of(messages))

        # One shard to a partition; all jobs that read one of these share its shuffle.
        self.known = trusted.rdd.mapPartitions(tidied(learn)).partitionBy(shards, _place)
        parted = self.known.mapPartitions(tidied(split)).partitionBy(shards, _place)
        self.pairs = parted.mapPartitions(tidied(copies)).partitionBy(shards, _place)
        # One number per unit and a few more.
        whole, halves = self.known.mapPartitions(tidied(seen_whole)), parted.mapPartitions(tidied(seen_split))
        total = whole.treeReduce(np.add) + halves.treeReduce(np.add)
        self.cuts = {3: discounts(dict(enumerate(total[:6].tolist()))), 2: discounts(dict(enumerate(total[6:12].tolist())))}
        single = total[12:].astype(float)
        self.cuts[1] = discounts(Counter(np.minimum(single, 5).astype(int).tolist()))
        cut, all_pairs = _cut(total[12:], self.cuts[1]), single.sum()
        self.single = (single - cut + cut.sum() / UNITS) / all_pairs if all_pairs else np.full(UNITS, 1 / UNITS)

    def scores(self, docs: DataFrame) -> DataFrame:
        """``key, logp, units`` per row of ``docs(key string, text string)``, texts not null."""
        context = docs.sparkSession.sparkContext
        vocabulary, salts, shards, cuts = self.vocabulary, self.salts, self.shards, self.cuts
        singles = context.broadcast(self.single)

        def ask(rows: Iterator) -> Iterator[tuple]:
            units, partition = _Units(vocabulary.value), TaskContext.get().partitionId()
            for i, some in enumerate(_batches(rows, lambda r: len(r[1]))):
                block = (partition << 32) + i
                keys, counts = trigrams([r[1] for r in some], units)
                names = [_pressed(json.dumps([r[0] for r in some]).encode()), *_packed(counts, 5)]
                yield (partition + i) % shards, (NAMES, block, names)
                order = np.argsort(keys, kind="stable")  # the owners of a trigram stay ascending
                keys, owner = keys[order], np.repeat(np.arange(len(some), dtype=np.int32), counts)[order]
                new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])])
                times = np.diff(np.r_[new, len(keys)]).astype(np.int32)
                keys, owner = keys[new], owner[new]
                shard = _dealt(keys, salts.value, shards)
                order = np.argsort(shard, kind="stable")
                keys, owner, times = keys[order], owner[order], times[order]
                for s, run in _runs(shard[order]):
                    yield s, (ASKED, block, _steps([*_units(keys[run]), owner[run]]) + _packed(times[run], 4))

        def score(messages: Iterator) -> Iterator[tuple]:
            single, known, pairs, levels = singles.value, [], [], None
            for shard, message in messages:
                kind, block, parts = message
                if kind in (KNOWN, PAIRS):
                    # These come first, as the shuffles are read in the order of the union.
                    (known if kind == KNOWN else pairs).append((shard, message))
                    continue
                if kind == NAMES:
                    yield block, -1, parts
                    continue
                if levels is None:
                    g, a = _trigrams_of(known)
                    mine = _pair_counts(g[salts.value[g >> 2 * WORD_BITS] == 1])
                    theirs = _pairs_of(pairs)
                    levels = _Level(np.r_[mine[0], theirs[0]], np.r_[mine[1], theirs[1]], cuts[2]), _Level(g, a, cuts[3])
                    del g, a, mine, theirs
                    known, pairs = None, None
                *units, owners = _from_steps(parts[:12])
                grams = _joined(*units)
                first = np.flatnonzero(np.diff(grams, prepend=-1))
                keys, last = grams[first], grams[first] & _MASK
                p = levels[0].interpolated(keys >> 2 * WORD_BITS << WORD_BITS | last, single[last])
                logs = np.repeat(np.log(levels[1].interpolated(keys, p)), np.diff(np.r_[first, len(grams)]))
                sums = np.bincount(owners, logs * _unpacked(parts[12:]))
                there = np.unique(owners)
                fine = np.maximum(np.rint(-sums[there] * FINE), 0).astype(np.int64)
                yield block, shard, _packed(np.diff(there, prepend=0), 3) + _packed(fine, 8)

        def total(sums: pd.DataFrame) -> pd.DataFrame:
            sums = sums.sort_values("shard")  # the names first
            names = sums["parts"].iloc[0]
            keys = json.loads(_plain(names[0]))
            fine = np.zeros(len(keys), np.int64)
            for parts in sums["parts"].iloc[1:]:
                fine[np.cumsum(_unpacked(parts[:3]))] += _unpacked(parts[3:])
            return pd.DataFrame({"key": keys, "logp": -fine / FINE, "units": _unpacked(names[1:])})

        asked = docs.select("key", "text").rdd.mapPartitions(tidied(ask)).partitionBy(shards, _place)
        together = self.known.union(self.pairs).union(asked)
        if together.getNumPartitions() != asked.getNumPartitions():
            raise RuntimeError("shards of counts and of questions do not meet")
        parts = docs.sparkSession.createDataFrame(
            together.mapPartitions(tidied(score)), "block long, shard long, parts array<binary>", verifySchema=False
        )
        return parts.groupBy("block").applyInPandas(total, "key string, logp double, units long")

"""Byte-pair encoding by a deterministic automaton over tokens, compiled merge by merge.

The automaton accepts exactly the token sequences that byte-pair encoding gives. Its state is the
last token read. Before any merge every base token may follow every other. The gadget of a merge
``a b -> c`` then

* forbids ``b`` right after ``a``;
* lets ``c`` follow what ``a`` could follow so far, and lets follow ``c`` what could follow ``b``.

So whether ``t2`` may follow ``t1`` comes from the gadgets that made the two, taken in reverse: the
younger of both is replaced by its inner half, until the two are base tokens or a merge made
earlier forbids them. Transitions found this way are kept in a table, so the automaton is
determinised where it is visited; the gadget tables have one row per merge of the vocabulary.

A pre-split word is encoded by the one path through the automaton that spells it. The trie of the
tokens gives the arcs at a position, the longest first; an arc that the state forbids, or that
leads nowhere, is left for the next shorter one. Arcs are labelled with token strings, and decoding
emits the labels.
"""

from __future__ import annotations

import hashlib
import json
import pickle
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qalink.llm.base import text_of, tidied

#: Entries of a per-task table before it is started anew, and signs of a word that is remembered.
MEMO_WORDS = 70_000
MEMO_ARCS = 50_000
MEMO_SIGNS = 40
#: Signs of the texts whose ids are held at once.
HELD_SIGNS = 1_000_000


class Vocabulary(NamedTuple):
    """What a tokenizer file says, as far as encoding needs it."""

    ids: dict[str, int]
    merges: list[tuple[str, str]]
    suffix: str
    special: dict[str, int]
    pattern: str


def read_vocabulary(path: str) -> Vocabulary:
    """A byte-level BPE tokenizer file with word ends, lower-casing and removed white space."""
    with open(path, encoding="utf-8") as file:  # part of the installation, not of the data
        spec = json.load(file)
    model = spec["model"]
    split = spec["pre_tokenizer"]["pretokenizers"][0]
    steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
    if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or not split["invert"] or spec["decoder"]:
        raise ValueError(f"not a tokenizer of the supported kind: {path}")
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return Vocabulary(model["vocab"], merges, model["end_of_word_suffix"], special, split["pattern"]["Regex"])


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    spare = iter(range(256, 512))
    return [letters[b] if b in letters else chr(next(spare)) for b in range(256)]


class Automaton:
    """Tables compiled from the merges, one gadget after the other."""

    def __init__(self, vocabulary: Vocabulary):
        ids, suffix = vocabulary.ids, vocabulary.suffix
        size = max(ids.values()) + 1
        self.made = [-1] * size  # number of the gadget that made a token, -1 for base tokens
        self.first, self.last = [-1] * size, [-1] * size
        self.gadgets: dict[int, int] = {}
        for number, (a, b) in enumerate(vocabulary.merges):
            left, right, whole = ids[a], ids[b], ids[a + b]
            self.gadgets.setdefault(left << 20 | right, number)
            if self.made[whole] < 0:
                self.made[whole], self.first[whole], self.last[whole] = number, left, right
        letters = byte_letters()
        self.base = [ids[c] for c in letters]
        self.final = [ids[c + suffix] for c in letters]
        self.labels = [""] * size
        for label, number in ids.items():
            self.labels[number] = label
        # The trie: its arcs read base tokens; a node may end a token.
        self.arcs: dict[int, int] = {}  # node and symbol to node
        self.ends: list[int] = [-1]
        spelled: dict[int, tuple[int, ...]] = {t: (t,) for t in [*self.base, *self.final]}
        for a, b in vocabulary.merges:
            spelled[ids[a + b]] = spelled[ids[a]] + spelled[ids[b]]
        for token, symbols in spelled.items():
            node = 0
            for symbol in symbols:
                if (after := self.arcs.get(node << 20 | symbol)) is None:
                    after = self.arcs[node << 20 | symbol] = len(self.ends)
                    self.ends.append(-1)
                node = after
            self.ends[node] = token
        self.table: dict[int, bool] = {}

    def __getstate__(self):
        return self.__dict__ | {"table": {}}

    def follows(self, state: int, token: int) -> bool:
        """Whether the automaton has an arc ``token`` in the state after the token ``state``."""
        key = state << 20 | token
        found = self.table.get(key)
        if found is None:
            if len(self.table) >= MEMO_ARCS:
                self.table.clear()
            found = self.table[key] = self._allowed(state, token)
        return found

    def _allowed(self, u: int, v: int) -> bool:
        made, gadgets = self.made, self.gadgets
        limit = len(gadgets) + 1
        while True:
            if gadgets.get(u << 20 | v, limit) < limit:
                return False
            if made[u] > made[v]:
                limit, u = made[u], self.last[u]
            elif made[v] > made[u]:
                limit, v = made[v] + 1, self.first[v]
            elif made[u] < 0:
                return True
            else:
                limit, u, v = made[u], self.last[u], self.first[v]

    def encode(self, symbols: list[int]) -> list[int]:
        """The accepted path that spells these base tokens, searched longest arc first."""
        trie, ends, table, size = self.arcs, self.ends, self.table, len(symbols)
        arcs: list[list[tuple[int, int]] | None] = [None] * size
        dead: set[tuple[int, int]] = set()
        path: list[tuple[int, int]] = []
        untried: list[int] = []
        state, at, left = -1, 0, -1
        while at < size:
            found = arcs[at]
            if found is None:
                node, found = 0, []
                for end in range(at, size):
                    node = trie.get(node << 20 | symbols[end])
                    if node is None:
                        break
                    if ends[node] >= 0:
                        found.append((ends[node], end + 1))
                arcs[at] = found
            left = len(found) if left < 0 else left
            while left:
                left -= 1
                arc = found[left]
                if state >= 0:
                    allowed = table.get(state << 20 | arc[0])
                    if not (self.follows(state, arc[0]) if allowed is None else allowed):
                        continue
                if arc not in dead:
                    path.append(arc)
                    untried.append(left)
                    state, at = arc
                    left = -1
                    break
            else:
                dead.add(path.pop())
                left = untried.pop()
                state, at = path[-1] if path else (-1, 0)
        return [token for token, _ in path]


def character_class(category: str, highest: int) -> str:
    """The inside of a character class of all code points whose category begins so."""
    ranges, start = [], None
    for code in range(highest + 2):
        member = code <= highest and unicodedata.category(chr(code)).startswith(category)
        if member and start is None:
            start = code
        elif not member and start is not None:
            ranges.append(f"\\U{start:08x}-\\U{code - 1:08x}")
            start = None
    return "".join(ranges)


#: Fixed value: the Unicode white space that the split patterns mean.
_SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def split_pattern(pattern: str, highest: int) -> str:
    """A tokenizer's split pattern, its Unicode classes spelled out up to a code point.

    The classes stand inside brackets in these patterns. Beyond the highest code point a class has
    fewer ranges to test, which matters for every word that ends.
    """
    classes = {r"\p{L}": character_class("L", highest), r"\p{N}": character_class("N", highest), r"\s": _SPACES}
    for name, inside in classes.items():
        pattern = pattern.replace(name, inside)
    return pattern


def split_patterns(vocabulary: Vocabulary) -> tuple[str, str]:
    """The split pattern for texts up to U+FFFF, and for all."""
    return split_pattern(vocabulary.pattern, 0xFFFF), split_pattern(vocabulary.pattern, sys.maxunicode)


def word_splitter(patterns: tuple[str, str]) -> Callable[[str], list[str]]:
    """Normalises a text without special tokens and cuts it into words.

    Code points are classed by Python's Unicode tables; younger ones belong to no class.
    """
    split, split_any = (re.compile(p).findall for p in patterns)
    beyond = re.compile("[\U00010000-\U0010ffff]").search

    def words(text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return split_any(text) if beyond(text) else split(text)

    return words


class _Known(dict):
    """What is known of words; asks for a word when it first comes up.

    A full table stays for one more turn, from which words in use come back, so that the frequent
    ones are not asked for again.
    """

    def __init__(self, ask: Callable[[str], object]):
        super().__init__()
        self.ask = ask
        self.before: dict[str, object] = {}

    def __missing__(self, word: str) -> object:
        found = self.before.get(word) or self.ask(word)
        if len(word) <= MEMO_SIGNS:
            if len(self) >= MEMO_WORDS:
                self.before = dict(self)
                self.clear()
            self[word] = found
        return found


class Encoder:
    """Whole texts to ids, word by word; words seen before are looked up."""

    def __init__(self, vocabulary: Vocabulary, automaton: Automaton, patterns: tuple[str, str]):
        self.automaton, self.special = automaton, vocabulary.special
        self.words = word_splitter(patterns)
        self.marks = re.compile("|".join(map(re.escape, vocabulary.special)) or "(?!)").finditer
        self.labels = list(automaton.labels)
        for label, number in vocabulary.special.items():
            self.labels += [""] * (number + 1 - len(self.labels))
            self.labels[number] = label
        self.known = _Known(lambda word: self.written(self.word_ids(word)))
        self.packed = _Known(lambda word: self.pack(self.word_ids(word)))

    def word_ids(self, word: str) -> list[int]:
        automaton, raw = self.automaton, word.encode("utf-8", "surrogatepass")
        return automaton.encode([*map(automaton.base.__getitem__, raw[:-1]), automaton.final[raw[-1]]])

    def written(self, ids: list[int]) -> tuple[int, str, str]:
        return len(ids), " ".join(map(str, ids)), self.decode(ids)

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs; ids outside the vocabulary emit nothing."""
        labels = self.labels
        return " ".join([labels[i] for i in ids if 0 <= i < len(labels) and labels[i]])

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        """Ids as 32-bit integers: half of what the written form of a word takes to remember."""
        return array("i", ids).tobytes()

    def parts(self, text: str) -> list[tuple[int, str, str]]:
        """Number of ids, ids and labels of each word and each special token of a text."""
        return self._parts(text, self.known, self.written)

    def ids(self, text: str) -> np.ndarray:
        """The ids of a text."""
        return np.frombuffer(b"".join(self._parts(text, self.packed, self.pack)), np.intc)

    def _parts(self, text: str, known: _Known, made: Callable[[list[int]], object]) -> list:
        found, at = [], 0
        for mark in self.marks(text):
            found += map(known.__getitem__, self.words(text[at : mark.start()]))
            found.append(made([self.special[mark.group()]]))
            at = mark.end()
        found += map(known.__getitem__, self.words(text[at:] if at else text))
        return found


def compile_tokenizer(spark: SparkSession, path: str) -> Callable[[], Encoder]:
    """Compiled once here; the tables, bounded by the vocabulary file, go to each task.

    They travel as bytes, a tenth of their size: workers keep a broadcast value after their task.
    """
    vocabulary = read_vocabulary(path)
    automaton = Automaton(vocabulary)
    tables = vocabulary._replace(ids={}, merges=[]), automaton, split_patterns(vocabulary)
    sent = spark.sparkContext.broadcast(pickle.dumps(tables, pickle.HIGHEST_PROTOCOL))
    return lambda: Encoder(*pickle.loads(sent.value))


def spread_texts(docs: DataFrame) -> DataFrame:
    """Deals few input splits out over the cores; a table of more splits than cores stays as it is."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``ids array<int>`` and ``decoded string``, for training and for round trips.

    Null text gives no ids. Columns of those names are replaced, all others are kept.
    """
    tokenizer = compile_tokenizer(docs.sparkSession, path)
    others = [c for c in docs.columns if c.lower() not in ("ids", "decoded")]

    def some(batch: pa.RecordBatch, encoder: Encoder) -> pa.RecordBatch:
        ids, ends, decoded = [], [0], []
        for text in batch.column(batch.num_columns - 1).to_pylist():
            ids.append(encoder.ids(text))
            ends.append(ends[-1] + len(ids[-1]))
            decoded.append(encoder.decode(ids[-1].tolist()))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids)))
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], lists, pa.array(decoded, pa.string())], names=[*others, "ids", "decoded"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer()
        for batch in batches:
            start = held = 0
            for i, size in enumerate(pc.binary_length(batch.column(batch.num_columns - 1)).to_pylist()):
                held += size
                if held >= HELD_SIGNS or i + 1 == batch.num_rows:
                    yield some(batch.slice(start, i + 1 - start), encoder)
                    start, held = i + 1, 0

    fields = [docs.schema[c] for c in others]
    added = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    read = docs.select(*[F.col(f"`{c}`") for c in others], text_of().alias("_whole_text"))
    return read.mapInArrow(tidied(run), T.StructType(fields + added))


def encoding_digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for each row of ``docs(doc_id, text)``.

    The digests are of the decimal ids joined by one space and of the decoded text. Null and empty
    texts have no ids. Rows are judged one by one, so repeated rows give repeated results; further
    columns are ignored. Nothing is shuffled but what deals a small input out over the cores.
    """
    tokenizer = compile_tokenizer(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer()
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                parts = encoder.parts(text)
                ids = hashlib.sha256(" ".join([p[1] for p in parts]).encode()).hexdigest()
                decoded = hashlib.sha256(" ".join([p[2] for p in parts]).encode()).hexdigest()
                rows.append((sum([p[0] for p in parts]), ids, decoded))
            n, ids, decoded = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    read = spread_texts(docs.select("doc_id", text_of().alias("text")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(tidied(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")

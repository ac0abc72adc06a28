"""Token ids in binary files of shuffled planes.

A file holds segments, one row each; a segment holds whole documents in order. Its ids are cut into
blocks of a fixed size. A block is transposed: all first bytes (or bits) of its ids, then all second
ones, and so on; each plane is compressed with zstandard on its own and all stand one after the
other in ``payload``. ``index`` says per block its first id, its number of ids and where each plane
ends. Ids of a narrow range leave whole planes constant, which then take no space.

Files are written by Spark's Parquet writer, uncompressed, so a lost task leaves nothing behind and
any store that Spark reaches will do. A segment can be read without its neighbours; ``index`` can be
read without any payload.
"""

from __future__ import annotations

import itertools
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qalink.llm.base import per_process, text_of
from qalink.llm.merge_automaton import read_vocabulary, split_patterns, word_splitter

BLOCK_IDS = 65_536
SEGMENT_IDS = 1 << 20
LEVEL = 3
#: Words, and pieces between white space, that a worker remembers before it starts anew.
MEMO_WORDS = 400_000
MEMO_PIECES = 800_000

_INDEX = pa.list_(pa.struct([("first_id", pa.int64()), ("n_ids", pa.int32()), ("plane_ends", pa.list_(pa.int64()))]))
_SEGMENT = pa.schema(
    [
        ("part", pa.int32()),
        ("segment", pa.int32()),
        ("first_id", pa.int64()),
        ("n_ids", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("doc_ends", pa.list_(pa.int64())),
        ("planes", pa.string()),
        ("index", _INDEX),
        ("payload", pa.binary()),
    ]
)
SEGMENT = (
    "part int, segment int, first_id long, n_ids long, doc_ids array<long>, doc_ends array<long>, planes string, "
    "index array<struct<first_id: long, n_ids: int, plane_ends: array<long>>>, payload binary"
)


def shuffled(ids: np.ndarray, planes: str) -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids: 4 of bytes or 32 of bits, the lowest first."""
    as_bytes = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        return [np.ascontiguousarray(as_bytes[:, i]).tobytes() for i in range(4)]
    bits = np.unpackbits(as_bytes, axis=1, bitorder="little")
    return [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(32)]


def unshuffled(parts: list[bytes], count: int, planes: str) -> np.ndarray:
    if planes == "byte":
        as_bytes = np.stack([np.frombuffer(p, np.uint8) for p in parts], axis=1)
    else:
        bits = [np.unpackbits(np.frombuffer(p, np.uint8), count=count, bitorder="little") for p in parts]
        as_bytes = np.packbits(np.stack(bits, axis=1), axis=1, bitorder="little")
    return np.ascontiguousarray(as_bytes).view("<u4").reshape(-1)


def pack(ids: np.ndarray, block_ids: int, planes: str, level: int) -> tuple[list[dict], bytes]:
    """Chunk index and payload of a segment's ids."""
    squeeze = zstandard.ZstdCompressor(level=level).compress
    index, pieces, end = [], [], 0
    for first in range(0, len(ids), block_ids):
        block, ends = ids[first : first + block_ids], []
        for plane in shuffled(block, planes):
            pieces.append(squeeze(plane))
            end += len(pieces[-1])
            ends.append(end)
        index.append({"first_id": first, "n_ids": len(block), "plane_ends": ends})
    return index, b"".join(pieces)


def unpack(index: list[dict], payload: bytes, planes: str) -> np.ndarray:
    expand, start, blocks = zstandard.ZstdDecompressor().decompress, 0, []
    for entry in index:
        parts = []
        for end in entry["plane_ends"]:
            parts.append(expand(payload[start:end]))
            start = end
        blocks.append(unshuffled(parts, entry["n_ids"], planes))
    return np.concatenate(blocks) if blocks else np.zeros(0, "<u4")


class LibraryEncoder:
    """The tokenizers library over the different words of the texts, each asked for once.

    Words are cut as the tokenizer cuts them and sent to the library joined by spaces; every word's
    ids end with the one id that has the mark of a word's end. Texts with special tokens, or with
    signs that are unassigned here but may be known to the library, are sent whole.
    """

    def __init__(self, path: str, prepared: tuple):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has given this task its core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.ends, patterns, special = prepared
        self.words = word_splitter(patterns)
        self.tokens = word_splitter((rf"{patterns[0]}|\n",) * 2)
        self.beyond = re.compile("[\U00010000-\U0010ffff]").search
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)").search
        self.ordinary: dict[str, bool] = {}
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.odd: set[str] = set()

    @staticmethod
    def prepare(path: str) -> tuple:
        """Which ids end a word, the split patterns, and the special tokens; made once, for all tasks."""
        vocabulary = read_vocabulary(path)
        ends = np.zeros(max([*vocabulary.ids.values(), *vocabulary.special.values()]) + 1, bool)
        ends[[i for label, i in vocabulary.ids.items() if label.endswith(vocabulary.suffix)]] = True
        return ends, split_patterns(vocabulary), [*vocabulary.special]

    def _odd(self, text: str) -> bool:
        """Whether a text holds signs that cannot be left to the cutting here."""
        signs = set(text)
        for sign in signs - self.ordinary.keys():
            # Python takes these four for white space, the tokenizer does not.
            self.ordinary[sign] = unicodedata.category(sign) != "Cn" and sign not in "\x1c\x1d\x1e\x1f"
        return not all(map(self.ordinary.__getitem__, signs))

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [found.ids for found in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 20_000):
            some = words[at : at + 20_000]
            joined = [" ".join(some[i : i + 500]) for i in range(0, len(some), 500)]
            ids = np.fromiter(itertools.chain.from_iterable(self._library(joined)), "<u4")
            ends = (np.nonzero(self.ends[ids])[0] + 1) * 4
            if len(ends) != len(some):
                raise ValueError("the library cuts words otherwise than the tokenizer's file says")
            raw, start = ids.tobytes(), 0
            for word, end in zip(some, ends.tolist()):
                self.known[word] = raw[start:end]
                start = end

    def _cut(self, pieces: list[str]) -> Iterator[list[str]]:
        """The words of each piece; the pieces are normalised and cut in one go."""
        tokens = self.tokens("\n".join(pieces))
        start = 0
        for end in itertools.chain(np.nonzero(np.array(tokens, object) == "\n")[0].tolist(), [len(tokens)]):
            yield tokens[start:end]
            start = end + 1

    def _compose(self, pieces: list[str]) -> None:
        """Learns pieces between white space from their words."""
        joined = "\n".join(pieces)
        if self._odd(joined):
            odd = {p for p in pieces if self._odd(p)}
            self.odd |= odd
            self.pieces.update(dict.fromkeys(odd, b""))
            pieces = [p for p in pieces if p not in odd]
        high = []
        if self.beyond(joined):
            high = [p for p in pieces if self.beyond(p)]
            pieces = [p for p in pieces if not self.beyond(p)]
        cut = [*(self._cut(pieces) if pieces else ()), *map(self.words, high)]
        self._learn([*set().union(*cut).difference(self.known)])
        known = self.known.__getitem__
        self.pieces.update(zip(pieces + high, [b"".join(map(known, words)) for words in cut], strict=True))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        The column is cut at ASCII white space and its pieces are numbered by Arrow, so that each
        different piece is looked up once; ids are put together by position.
        """
        if len(self.known) > MEMO_WORDS:
            self.known.clear()
        if len(self.pieces) > MEMO_PIECES:
            self.pieces.clear()
            self.odd.clear()
        # Pieces may still hold other white space, where the tokenizer cuts as well.
        split = pc.ascii_split_whitespace(texts)
        numbered = split.flatten().dictionary_encode()
        pieces = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()  # faster than to_pylist
        self._compose([piece for piece in pieces if piece not in self.pieces])
        raw = [*map(self.pieces.__getitem__, pieces)]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        place = numbered.indices.to_numpy(zero_copy_only=False)
        taken = sizes[place]
        ends = np.concatenate([[0], np.cumsum(taken)])
        shift = (np.cumsum(sizes) - sizes)[place] - ends[:-1]
        ids = np.frombuffer(b"".join(raw), "<u4")[np.repeat(shift, taken) + np.arange(ends[-1])]
        cuts = np.concatenate([[0], np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False))])
        borders = ends[cuts].tolist()
        odd = np.fromiter(map(self.odd.__contains__, pieces), bool, len(pieces)) if self.odd else np.zeros(len(pieces), bool)
        strange = np.diff(np.concatenate([[0], np.cumsum(odd[place])])[cuts]).tolist()
        return [
            np.array(self._library([text])[0], "<u4").tobytes() if alone or self.special(text) else ids[a:b].tobytes()
            for text, alone, a, b in zip(texts.to_pylist(), strange, borders, borders[1:])
        ]


def _few(texts: pa.Array, size: int = 4_000_000) -> Iterator[slice]:
    """Slices of a batch that hold about so many bytes each, one text at least."""
    start = held = 0
    for i, length in enumerate(pc.binary_length(texts).to_pylist()):
        held += length
        if held >= size:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def write_ids(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int | None = 1,
    planes: str = "byte",
    block_ids: int = BLOCK_IDS,
    segment_ids: int = SEGMENT_IDS,
) -> None:
    """Encodes ``docs(doc_id, text)`` in ascending ``doc_id`` order into files below ``path``.

    Null text is empty; each document ends with ``end_id``. Null ids come last; rows of one id
    follow in the order of a hash of their text, which also deals a hot id out over many files.
    Further columns are ignored. An empty table gives files without segments.
    """
    if planes not in ("byte", "bit"):
        raise ValueError("planes: byte or bit")
    prepared = LibraryEncoder.prepare(tokenizer)
    tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def segment(part: int, number: int, first: int, ids: list, raw: list[bytes]) -> pa.RecordBatch:
        ends = np.cumsum([len(r) // 4 for r in raw])
        values = np.frombuffer(b"".join(raw), "<u4")
        index, payload = pack(values, block_ids, planes, LEVEL)
        row = (part, number, first, len(values), ids, ends.tolist(), planes, index, payload)
        arrays = [pa.array([value], kind) for value, kind in zip(row, _SEGMENT.types)]
        return pa.RecordBatch.from_arrays(arrays, schema=_SEGMENT)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_process(f"library {tokenizer}", lambda: LibraryEncoder(tokenizer, prepared))
        part, number, first, size = TaskContext.get().partitionId(), 0, 0, 0
        ids: list = []
        raw: list[bytes] = []
        for batch in batches:
            for some in _few(batch.column(1)):
                part_of = batch.slice(some.start, some.stop - some.start)
                for doc_id, found in zip(part_of.column(0).to_pylist(), encoder.encode(part_of.column(1))):
                    ids.append(doc_id)
                    raw.append(found + tail)
                    size += len(raw[-1]) // 4
                    if size >= segment_ids:
                        yield segment(part, number, first, ids, raw)
                        number, first, size, ids, raw = number + 1, first + size, 0, [], []
        if ids:
            yield segment(part, number, first, ids, raw)

    order = [F.col("doc_id").asc_nulls_last(), F.col("tie")]
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    read = read.withColumn("tie", F.xxhash64("text"))
    dealt = read.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    dealt.mapInArrow(write, SEGMENT).write.option("compression", "none").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per block: ``part, segment, first_id, n_ids, plane_ends``; no payload is read."""
    return (
        spark.read.parquet(path)
        .select("part", "segment", F.col("first_id").alias("base"), F.inline("index"))
        .select("part", "segment", (F.col("base") + F.col("first_id")).alias("first_id"), "n_ids", "plane_ends")
    )


def _starts(spark: SparkSession, path: str) -> DataFrame:
    """Ids before each file; one number per file passes through the driver."""
    totals = spark.read.parquet(path).groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    rows, before = [], 0
    for row in totals:
        rows.append((row["part"], before))
        before += row["n"]
    return spark.createDataFrame(rows, "part int, before long")


def _documents(spark: SparkSession, path: str, value, kind: pa.DataType, name: str, schema: str) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["index"], row["payload"], row["planes"])
                ends = np.array(row["doc_ends"], np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                found = [value(ids[a:b]) for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * len(ends), pa.int32()),
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(starts + row["first_id"], pa.int64()),
                        pa.array(ends - starts, pa.int64()),
                        pa.array(found, kind),
                    ],
                    names=["part", "doc_id", "at", "n_tokens", name],
                )

    rows = spark.read.parquet(path).select("part", "first_id", "doc_ids", "doc_ends", "planes", "index", "payload")
    found = rows.mapInArrow(read, f"part int, doc_id long, at long, n_tokens long, {name} {schema}")
    before = F.broadcast(_starts(spark, path))
    return found.join(before, "part").select(
        "doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", name
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` from the files; ``start`` counts the ids of all documents before."""
    return _documents(spark, path, lambda ids: ids.tolist(), pa.list_(pa.int64()), "ids", "array<long>")


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the files: the CRC of the ids' 32-bit bytes."""
    return _documents(spark, path, lambda ids: zlib.crc32(ids.tobytes()), pa.int64(), "ids_crc32", "long")

"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are given per document. Tokens get theirs from words, and beginnings of words, that stand
for toxicity: those that are all but absent from clean documents and that occur in toxic ones with
many different neighbours. Counting neighbourhoods beside documents keeps words out that only stand
in copies of one text. A token is toxic if it has such a feature in a toxic document.

The field has two states, one chain per sentence, and hashed features of a token and of its
neighbours. Forward and backward messages are log ratios of the two states, computed for all
sentences of a batch at once, step by step. A document's score is a logistic function of what the
marginals add up to. Spans are runs of tokens with a marginal of at least one half, with offsets in
code points.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qalink.llm.base import text_of

#: The model is fitted on at most so many labelled documents, those of the smallest hash, and only
#: on texts of at most so many signs. Scoring knows no such bounds.
SAMPLE_DOCS = 4000
SAMPLE_SIGNS = 200_000
FEATURES = 1 << 20
NEIGHBOURS = 1 << 18
#: Lengths of the beginnings of a word that are features beside the word itself.
BEGINNINGS = (4, 5, 6, 7, 8)
BATCH_SIGNS = 2_400_000
MEMO_WORDS = 400_000
_STRIPPED = "\"'`.,;:!?()[]{}<>|*$%&#+-_=~/\\"


class Field(NamedTuple):
    """Weights for the toxic state against the other, transitions from and to, and the score."""

    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    bias: float
    step: np.ndarray
    score: np.ndarray


def _hashed(text: str, size: int) -> int:
    return 1 + zlib.crc32(text.encode("utf-8", "surrogatepass")) % (size - 1)


class Words(dict):
    """A number for each word as written; its features stand in the lists beside.

    Feature 0 is none: of a beginning longer than the word, and of neighbours beyond the sentence.
    """

    def __init__(self):
        super().__init__()
        self.features: list[list[int]] = []
        self.names: list[int] = []

    def __missing__(self, token: str) -> int:
        word = token.lower().strip(_STRIPPED)
        begins = [_hashed(f"{n}{word[:n]}", FEATURES) if len(word) >= n else 0 for n in BEGINNINGS]
        self.features.append([_hashed("=" + word, FEATURES), *begins])
        self.names.append(_hashed(word, NEIGHBOURS))
        found = self[token] = len(self)
        return found

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self.features, np.int64).reshape(-1, 1 + len(BEGINNINGS)), np.array(self.names, np.int64)


class Chains(NamedTuple):
    """Sentences of a batch of documents, in reading order."""

    words: np.ndarray  # number of each token's word
    doc: np.ndarray
    start: np.ndarray  # whether a sentence begins here


def chains(texts: list[str], words: Words) -> Chains:
    tokens = [text.split() for text in texts]
    counts = np.fromiter(map(len, tokens), np.int64, len(tokens))
    flat = [t for some in tokens for t in some]
    numbers = np.fromiter(map(words.__getitem__, flat), np.int64, len(flat))
    doc = np.repeat(np.arange(len(texts)), counts)
    ends = np.fromiter((t[-1] in ".!?" for t in flat), bool, len(flat))
    start = np.ones(len(flat), bool)
    start[1:] = ends[:-1] | (doc[1:] != doc[:-1])
    return Chains(numbers, doc, start)


def _neighbours(c: Chains, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    named = names[c.words]
    before, after = np.zeros_like(named), np.zeros_like(named)
    before[1:] = np.where(c.start[1:], 0, named[:-1])
    after[:-1] = np.where(c.start[1:], 0, named[1:])
    return before, after


def emissions(c: Chains, field: Field, features: np.ndarray, names: np.ndarray) -> np.ndarray:
    before, after = _neighbours(c, names)
    return field.own[features].sum(axis=1)[c.words] + field.before[before] + field.after[after] + field.bias


class Steps:
    """Tokens by their place in the sentence: those of one place are handled together."""

    def __init__(self, start: np.ndarray):
        first = np.nonzero(start)[0]
        lengths = np.diff(np.append(first, len(start)))
        order = np.argsort(-lengths, kind="stable")
        self.first, self.lengths = first[order], lengths[order]
        self.longest = int(self.lengths[0]) if len(first) else 0
        # Sentences that reach each place.
        self.alive = np.searchsorted(-self.lengths, -np.arange(self.longest), side="left")

    def at(self, place: int) -> np.ndarray:
        return self.first[: self.alive[place]] + place


def messages(e: np.ndarray, start: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward (with the token itself) and backward log ratios of toxic to not."""
    steps, forward, backward = Steps(start), e.copy(), np.zeros(len(e))
    (s00, s01), (s10, s11) = step
    for place in range(1, steps.longest):
        here = steps.at(place)
        r = forward[here - 1]
        forward[here] += np.logaddexp(s01, r + s11) - np.logaddexp(s00, r + s10)
    for place in range(steps.longest - 2, -1, -1):
        ahead = steps.at(place + 1)
        x = e[ahead] + backward[ahead]
        backward[ahead - 1] = np.logaddexp(s10, x + s11) - np.logaddexp(s00, x + s01)
    return forward, backward


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def marginals(c: Chains, field: Field, words: Words) -> np.ndarray:
    """Probability of the toxic state at each token."""
    forward, backward = messages(emissions(c, field, *words.tables()), c.start, field.step)
    return _sigmoid(forward + backward)


# Fitting.

_GROUP = 50  # documents a gradient step is taken on


def toxic_features(cut: list[Chains], labels: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Which features stand for toxicity, as a table of truth values."""
    clean: Counter[int] = Counter()
    around: dict[int, dict[int, set[tuple[int, int]]]] = defaultdict(lambda: defaultdict(set))
    toxic: set[int] = set()
    for group, c in enumerate(cut):
        bounds = np.searchsorted(c.doc, np.arange(_GROUP + 1))
        for i in range(_GROUP):
            n, numbers = group * _GROUP + i, c.words[bounds[i] : bounds[i + 1]]
            if not len(numbers):
                continue
            if not labels[n]:
                clean.update(np.unique(features[numbers]).tolist())
                continue
            toxic.add(n)
            padded = [-1, *numbers.tolist(), -1]
            for at, own in enumerate(features[numbers].tolist()):
                for f in own:
                    if f:
                        around[f][n].add((padded[at], padded[at + 2]))
    number = max(1, len(toxic))
    least, ratio = max(4, number // 40), number / max(1, len(labels) - number)
    chosen = np.zeros(FEATURES, bool)
    for f, docs in around.items():
        places = len(set().union(*docs.values()))
        often = len(docs) >= least and places >= max(least, len(docs) / 2)
        chosen[f] = often and clean[f] * ratio <= 0.1 * min(places, len(docs))
    return chosen


def fit(texts: list[str], labels: list[int], rounds: int = 6, rate: float = 0.5, decay: float = 1e-6) -> Field:
    """Conditional likelihood by stochastic gradients with adaptive steps, then the score's logistic."""
    words, label = Words(), np.array(labels, int)
    groups = range(0, len(texts), _GROUP)
    cut = [chains(texts[i : i + _GROUP], words) for i in groups]
    features, names = words.tables()
    stands = toxic_features(cut, label, features)[features].any(axis=1) if len(features) else np.zeros(0, bool)
    own, before, after = np.zeros(FEATURES), np.zeros(NEIGHBOURS), np.zeros(NEIGHBOURS)
    bias, step = -4.0, np.zeros((2, 2))
    squares = [np.full(len(w), 1e-8) for w in (own, before, after)] + [np.full((2, 2), 1e-8), 1e-8]

    def descend(w: np.ndarray, square: np.ndarray, at: np.ndarray, g: np.ndarray) -> None:
        used, place = np.unique(at, return_inverse=True)
        g = np.bincount(place.ravel(), g.ravel(), len(used)) / _GROUP + decay * w[used]
        square[used] += g * g
        w[used] -= rate * g / np.sqrt(square[used])
        w[0] = 0.0

    for _ in range(rounds):
        for n, c in enumerate(cut):
            if not len(c.words):
                continue
            y = (stands[c.words] & (label[n * _GROUP + c.doc] == 1)).astype(float)
            e = emissions(c, Field(own, before, after, bias, step, np.zeros(3)), features, names)
            forward, backward = messages(e, c.start, step)
            error = _sigmoid(forward + backward) - y
            per_token = features[c.words]
            descend(own, squares[0], per_token, np.repeat(error, per_token.shape[1]))
            for w, square, at in zip((before, after), squares[1:3], _neighbours(c, names)):
                descend(w, square, at, error)
            # Expected less observed transitions.
            inner = np.nonzero(~c.start)[0]
            x, r = e[inner] + backward[inner], forward[inner - 1]
            logs = np.stack([np.full(len(inner), step[0, 0]), step[0, 1] + x, step[1, 0] + r, step[1, 1] + r + x])
            expected = np.exp(logs - np.logaddexp.reduce(logs, axis=0)).sum(axis=1).reshape(2, 2)
            pairs = (2 * y[inner - 1] + y[inner]).astype(int)
            g = (expected - np.bincount(pairs, minlength=4).reshape(2, 2)) / _GROUP
            squares[3] += g * g
            step = step - rate * 0.2 * g / np.sqrt(squares[3])
            g = error.sum() / _GROUP
            squares[4] += g * g
            bias -= rate * 0.2 * g / np.sqrt(squares[4])
    field = Field(own.astype(np.float32), before.astype(np.float32), after.astype(np.float32), bias, step, np.zeros(3))
    rows = [signals(c, marginals(c, field, words), len(texts[i : i + _GROUP])) for i, c in zip(groups, cut)]
    return field._replace(score=_logistic(np.concatenate(rows) if rows else np.zeros((0, 3)), label))


def signals(c: Chains, m: np.ndarray, documents: int) -> np.ndarray:
    """Constant, highest marginal, and the logarithm of the expected number of toxic tokens."""
    most, total = np.zeros(documents), np.zeros(documents)
    np.maximum.at(most, c.doc, m)
    np.add.at(total, c.doc, m)
    return np.stack([np.ones(documents), most, np.log1p(total)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights by Newton's method; both signals can only raise the score."""
    w = np.zeros(3)
    if not len(y) or y.min() == y.max():
        return np.array([-4.0, 4.0, 1.0])
    keep = np.diag([1e-6, ridge, ridge])
    for _ in range(50):
        p = _sigmoid(x @ w)
        grad = x.T @ (p - y) + keep @ w
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, grad)
    w[1:] = np.maximum(w[1:], 0.0)
    return w


# On tables.


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_DOCS) -> tuple[list[str], list[int]]:
    """Texts and labels to learn from; of several labels of a document the highest counts."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select("doc_id", text_of().alias("text")).where(F.length("text") <= SAMPLE_SIGNS)
    found = texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])  # at most `limit` rows
    rows = found.orderBy("doc_id").collect()
    return [r["text"] for r in rows], [r["label"] for r in rows]


def learn(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_DOCS) -> Field:
    return fit(*sample(docs, labels, limit))


def _spans(text: str, m: np.ndarray) -> list[dict]:
    out, open_at = [], None
    for token, p in zip(re.finditer(r"\S+", text), m):
        if p >= 0.5:
            if open_at is None:
                out.append({"start": token.start(), "end": token.end(), "marginal": float(p)})
                open_at = True
            else:
                out[-1] |= {"end": token.end(), "marginal": max(out[-1]["marginal"], float(p))}
        else:
            open_at = None
    return out


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))


def tag(docs: DataFrame, field: Field) -> DataFrame:
    """``doc_id, score, spans`` for each row of ``docs(doc_id, text)``, from the whole text.

    ``spans`` is an array of ``start, end, marginal``, offsets in code points. Null and empty texts
    have no span and the score of a text without a toxic token. Nothing is shuffled; repeated rows
    give repeated results; further columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, words = sent.value, Words()
        for batch in batches:
            texts, scores, spans = batch.column(1).to_pylist(), [], []
            start = size = 0
            for i, text in enumerate([*texts, None]):
                if text is not None:
                    size += len(text)
                    if size < BATCH_SIGNS:
                        continue
                    i += 1
                some, start, size = texts[start:i], i, 0
                if not some:
                    continue
                words = Words() if len(words) > MEMO_WORDS else words
                c = chains(some, words)
                m = marginals(c, field, words)
                scores += _sigmoid(signals(c, m, len(some)) @ field.score).tolist()
                bounds = np.searchsorted(c.doc, np.arange(len(some) + 1))
                high = {int(d) for d in c.doc[m >= 0.5]}
                spans += [_spans(t, m[bounds[n] : bounds[n + 1]]) if n in high else [] for n, t in enumerate(some)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, _SPAN)], names=["doc_id", "score", "spans"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", text_of().alias("text"))
    return read.mapInArrow(
        run, f"doc_id {kind}, score double, spans array<struct<start: long, end: long, marginal: double>>"
    )


def score(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_DOCS) -> DataFrame:
    """``doc_id, held_out, score, predicted, spans``; without labels every score is low."""
    tagged = tag(docs, learn(docs, labels, limit))
    return tagged.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        "spans",
    )

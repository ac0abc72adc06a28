"""The word model behind the quality stage."""

import gc
import math
import random
import weakref
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from qalink.llm import base
from qalink.llm import kneser_ney as kn
from qalink.llm import word_model as wm
from qalink.sources.scratch import stored


def brute_logp(train, text, vocabulary):
    """Interpolated modified Kneser-Ney over dictionaries of word trigrams."""

    def windows(t):
        found = wm._WORD.findall(t)
        row, last = [wm.FIRST, wm.FIRST], None
        for w in found:
            repeats = w[0].isalnum() and w == last
            last = w if w[0].isalnum() else last
            row.append(("again", w) if repeats else vocabulary.get(w, wm.word_class(w)))
        row.append(wm.LAST)
        return [tuple(row[i : i + 3]) for i in range(len(row) - 2)]

    levels = {3: Counter(g for t in train for g in windows(t))}
    levels[2] = Counter(g[1:] for g in levels[3])
    levels[1] = Counter(g[1:] for g in levels[2])
    cuts = {k: kn.discounts(Counter(levels[k].values())) for k in levels}

    def p(g):
        k = len(g)
        if not k:
            return 1 / wm.UNITS
        same = {h: a for h, a in levels[k].items() if h[:-1] == g[:-1]}
        if not same:
            return p(g[1:])
        cut = lambda a: cuts[k][min(a, 3) - 1] if a else 0.0
        total, a = sum(same.values()), levels[k].get(g, 0)
        return (a - cut(a)) / total + sum(map(cut, same.values())) / total * p(g[1:])

    return sum(math.log(p(w)) for w in windows(text))


def test_word_scores_equal_brute_force(spark):
    rng = random.Random(3)
    words = ["the", "house", "of", "Of", "green", "green,", "water.", "runs", "x1", "...", "très", "été"]
    train = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(80)]
    asked = [*train[:5], "", "of of of", "of, of", "never seen Words", "the house of water", "🙂 ! x1" * 9]
    model = wm.WordModel(spark.createDataFrame([(t,) for t in train], "text string"))
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(asked)], "key string, text string")
    got = {r["key"]: r for r in model.scores(docs).collect()}
    assert len(got) == len(asked)
    for i, text in enumerate(asked):
        assert got[str(i)]["logp"] == pytest.approx(brute_logp(train, text, model.vocabulary.value), rel=1e-9)
        assert got[str(i)]["units"] == len(wm._WORD.findall(text)) + 1


def test_quality_drops_repeated_words(spark):
    rng = random.Random(6)
    words = [a + b for a in ("tion", "er", "the", "and", "of", "in") for b in ("", "ha", "re", "on")]
    sentence = lambda: " ".join(rng.sample(words, rng.randint(5, 12))).capitalize() + "."
    good = [(i, " ".join(sentence() for _ in range(rng.randint(2, 9))), "en") for i in range(300)]
    bad = [(1000 + i, " ".join([w] * 60), "en") for i, w in enumerate(words)]
    docs = spark.createDataFrame([*good, *bad], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(300)], "doc_id long, quality int")
    kept = [r["doc_id"] for r in kn.kept_documents(docs, labels).collect()]
    assert not [i for i in kept if i >= 1000] and len(kept) >= 290


def test_scoring_collects_no_table_of_the_corpus(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"some words and word{i}.", "en") for i in range(40)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    monkeypatch.setattr(type(docs), "toArrow", lambda self: pytest.fail("collected"))
    assert kn.judge(docs, labels).count() == 40


def test_documents_leave_a_shard_as_one_row_per_block(spark):
    docs = spark.createDataFrame([(f"k{i}", "a b c d e f g " * (i % 5)) for i in range(40)], "key string, text string")
    scores = wm.WordModel(docs.select("text")).scores(docs)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("FlatMapGroupsInPandas") == 1
    assert {r["key"]: r["units"] for r in scores.collect()} == {f"k{i}": 7 * (i % 5) + 1 for i in range(40)}


def test_messages_give_back_what_went_in():
    rng = np.random.default_rng(4)
    rows = np.unique(rng.integers(0, [3, 40, wm.UNITS, 900], (5000, 4)), axis=0)
    columns = [np.ascontiguousarray(rows[:, i]) for i in range(4)]
    for n in (0, 1, len(rows)):
        back = wm._from_steps(wm._steps([c[:n] for c in columns]))
        assert all((a[:n] == b).all() and len(b) == n for a, b in zip(columns, back))
    keys = wm._joined(*columns[:3])
    assert (wm._joined(*wm._units(keys)) == keys).all()
    many = rng.integers(0, 1 << 40, 1000)
    assert (wm._unpacked(wm._packed(many, 5)) == many).all()


def test_shuffles_of_a_model_and_its_scores_stay_below_the_texts(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {f: f.stat().st_size for d in manager.localDirsString() for f in Path(d).rglob("shuffle_*.data")}
    rng = random.Random(8)
    words = [a + b + c for a in ("tion", "er", "the", "and") for b in ("ha", "re", "on", "li") for c in ("", "s", "ed", "ing")]
    texts = [" ".join(rng.choices(words, weights=range(1, 65), k=200)) for _ in range(3000)]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "key string, text string")
    docs = stored(rows.repartition(4))
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        before = held()
        model = wm.WordModel(docs.where("key < '4'").select("text"))
        assert model.scores(docs).count() == 3000
        written = sum(size for f, size in held().items() if f not in before)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert written < 0.6 * sum(map(len, texts))


def test_sorted_counts_are_not_sorted_again(monkeypatch):
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 30, 3000))
    counts, asked = rng.integers(1, 9, len(keys)), rng.integers(0, 1 << 30, 500)
    mixed = rng.permutation(len(keys))
    unsorted = wm._Level(keys[mixed], counts[mixed], [0.5, 1.0, 1.5])
    monkeypatch.setattr(np, "argsort", lambda *a, **b: pytest.fail("sorted keys were sorted"))
    level = wm._Level(keys, counts, [0.5, 1.0, 1.5])
    asked = np.r_[asked, keys[::7]]
    shorter = np.full(len(asked), 0.25)
    assert (level.interpolated(asked, shorter) == unsorted.interpolated(asked, shorter)).all()


def test_workers_give_memory_back_after_the_last_row(monkeypatch):
    done = []

    class Pool:
        def release_unused(self):
            done.append("released")

    monkeypatch.setattr(base.pa, "default_memory_pool", Pool)
    monkeypatch.setattr(base.pa, "system_memory_pool", Pool)
    rows = base.tidied(lambda items: (2 * i for i in items))(iter([1, 2]))
    assert [(i, len(done)) for i in rows] == [(2, 0), (4, 0)] and len(done) == 2


def test_a_task_s_tables_are_gone_before_memory_is_given_back(monkeypatch):
    class Table:
        def __init__(self):
            self.owner = self

    seen, left = [], []

    def task(items):
        table = Table()
        seen.append(weakref.ref(table))
        yield from items

    class Pool:
        def release_unused(self):
            left.append(seen[0]() is not None)

    monkeypatch.setattr(base.pa, "default_memory_pool", Pool)
    monkeypatch.setattr(base.pa, "system_memory_pool", Pool)
    gc.disable()
    try:
        assert [*base.tidied(task)(iter([1, 2]))] == [1, 2] and left == [False, False]
    finally:
        gc.enable()

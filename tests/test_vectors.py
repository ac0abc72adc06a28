import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from qalink.operators import scoring as S
from qalink.operators import vectors as W
from qalink.sources import word_vectors

WORDS = {
    "one": [1.0, 0.0], "two": [0.0, 2.0], "both": [1.0, 1.0], "zero": [0.0, 0.0], "minus": [-1.0, 0.0], "also": [1.0, 1.0],
}


@pytest.fixture
def vectors(spark):
    return spark.createDataFrame(list(WORDS.items()), "word string, vector array<float>")


def test_reading(spark, tmp_path, rows):
    (tmp_path / "v.txt").write_text("3 2\none 1 0\ntwo 0 2 \none 5 5\n")
    read = word_vectors.read_word_vectors(spark, str(tmp_path))
    assert rows(read) == [("one", [5.0, 5.0]), ("two", [0.0, 2.0])]
    assert tuple(W.vector_stats(read).first()) == (2, 2)


def test_lookup(spark, vectors, rows):
    words = spark.createDataFrame([("one",), ("none",)], "word string")
    assert rows(W.lookup_vectors(words, vectors)) == [("none", False, []), ("one", True, [1.0, 0.0])]


def _words(spark, data):
    return spark.createDataFrame([(k, w) for k, ws in data.items() for w in ws], "k string, word string")


def test_sums_and_sentences(spark, vectors):
    words = _words(spark, {"s": ["one", "one", "two"], "u": ["one", "none"], "z": ["zero"], "n": ["none"], "c": ["one", "minus"]})
    sums = {r["k"]: r["vector"] for r in W.vector_sums(words, vectors, ["k"]).collect()}
    assert sums == {"s": [2.0, 2.0], "z": [0.0, 0.0], "c": [0.0, 0.0]}
    sentences = {r["k"]: r["vector"] for r in W.sentence_vectors(words, vectors, ["k"]).collect()}
    assert set(sentences) == {"s", "u"}
    assert sentences["u"] == [1.0, 0.0]
    assert sentences["s"] == pytest.approx([math.sqrt(0.5)] * 2)


def test_weights_count_as_repeats(spark, vectors):
    once = spark.createDataFrame([("s", "one", 3), ("s", "two", 1)], "k string, word string, n long")
    repeated = _words(spark, {"s": ["one"] * 3 + ["two"]})
    weighted = W.sentence_vectors(once, vectors, ["k"], weight="n").first()["vector"]
    assert weighted == pytest.approx(W.sentence_vectors(repeated, vectors, ["k"]).first()["vector"])


def test_n_similarity(spark, vectors):
    rows = [(1, "a", "one"), (1, "b", "both"), (2, "a", "one"), (2, "b", "none")]
    df = spark.createDataFrame(rows, "k long, side string, word string")
    got = {r["k"]: r["similarity"] for r in W.n_similarity(df, vectors, ["k"]).collect()}
    assert got == {1: pytest.approx(math.sqrt(0.5))}


def test_neighbors_sets_and_ties(spark, vectors):
    queries = spark.createDataFrame([(1, [1.0, 1.0]), (2, [0.0, 0.0])], "query_id long, vector array<double>")
    got = [(r["word"], r["rank"]) for r in W.nearest_neighbors(vectors, queries, 3).orderBy("rank").collect()]
    assert got == [("also", 1), ("both", 2), ("one", 3)]
    inside = spark.createDataFrame([("one",), ("both",), ("minus",)], "word string")
    outside = spark.createDataFrame([(1, "both")], "query_id long, word string")
    found = W.nearest_neighbors(vectors, queries, 5, inside, outside).orderBy("rank").collect()
    assert [r["word"] for r in found] == ["one", "minus"]


def test_word_queries(spark, vectors):
    groups = spark.createDataFrame([("g", "one"), ("g", "two"), ("u", "one"), ("u", "none")], "query_id string, word string")
    found = W.nearest_to_words(groups, vectors, 2).orderBy("rank").collect()
    assert [(r["query_id"], r["word"]) for r in found] == [("g", "also"), ("g", "both")]
    triples = spark.createDataFrame([(1, "one", "both", "minus"), (2, "one", "none", "two")], "query_id long, word1 string, word2 string, word3 string")
    found = W.analogy(triples, vectors, 1).collect()
    assert [(r["query_id"], r["word"]) for r in found] == [(1, "two")]


def test_rank(spark, vectors):
    sets = [("one", "one"), ("one", "both"), ("one", "minus"), ("two", "one"), ("two", "none"), ("none", "one")]
    got = W.rank_words(spark.createDataFrame(sets, "center string, word string"), vectors).collect()
    assert [(r["center"], r["word"]) for r in got] == [("one", "one"), ("one", "both"), ("one", "minus")]


@pytest.fixture(scope="module")
def many(spark):
    rng = np.random.default_rng(5)
    data = [(f"w{i:03d}", [float(x) for x in rng.normal(size=6)]) for i in range(120)]
    data += [(f"copy{i}", data[0][1]) for i in range(40)]
    return data, spark.createDataFrame(data, "word string, vector array<float>").repartition(3)


def test_neighbors_against_brute_force_in_both_ways(spark, many):
    data, vectors = many
    queries = [(i, data[i * 7][1]) for i in range(12)]
    df = spark.createDataFrame(queries, "query_id long, vector array<double>")
    small = W.nearest_neighbors(vectors, df, 5)
    blocks = W.nearest_neighbors(vectors, df, 5, block_bytes=300)
    matrix = np.array([np.array(v, dtype=np.float32) for _, v in data], dtype=float)
    want = []
    for query, v in queries:
        scores = np.round(matrix @ np.array(v) / np.linalg.norm(matrix, axis=1) / np.linalg.norm(v), 6)
        order = sorted(range(len(data)), key=lambda i: (-scores[i], data[i][0]))[:5]
        want += [(query, data[i][0], rank) for rank, i in enumerate(order, 1)]
    for found in (small, blocks):
        assert sorted((r["query_id"], r["word"], r["rank"]) for r in found.collect()) == sorted(want)


def test_closest_category_against_brute_force_in_both_ways(spark, many):
    data, vectors = many
    rng = random.Random(2)
    names = [w for w, _ in data] + ["unknown"]
    answers = [(a, rng.choice(names)) for a in range(30) for _ in range(rng.randint(1, 6))] + [(99, "unknown")]
    categories = [(f"c{c}", rng.choice(names)) for c in range(7) for _ in range(9)]
    words = spark.createDataFrame(answers, "a long, word string")
    category_words = spark.createDataFrame(categories, "category string, word string")
    lookup = {w: np.array(v, dtype=np.float32).astype(float) for w, v in data}

    def unit(items):
        total = sum((lookup[w] for w in items if w in lookup), np.zeros(6))
        return total / np.linalg.norm(total) if np.linalg.norm(total) > 0 else None

    centers = {c: unit([w for k, w in categories if k == c]) for c in {k for k, _ in categories}}
    want = {}
    for a in {k for k, _ in answers}:
        v = unit([w for k, w in answers if k == a])
        if v is not None:
            want[a] = min((-round(float(v @ u), 9), c) for c, u in centers.items())
    for limit in (256, 2):
        got = S.closest_category(words, category_words, vectors, ["a"], category_block=limit).collect()
        assert {r["a"]: r["category"] for r in got} == {a: c for a, (_, c) in want.items()}
        assert all(abs(r["similarity"] + want[r["a"]][0]) < 1e-6 for r in got)


def test_no_category_gives_no_rows(spark, many):
    _, vectors = many
    words = spark.createDataFrame([(1, "w001")], "a long, word string")
    nothing = spark.createDataFrame([("c", "unknown")], "category string, word string")
    assert S.closest_category(words, nothing, vectors, ["a"]).collect() == []


def test_many_categories_and_null_keys_alike(spark, many):
    data, vectors = many
    names = [w for w, _ in data]
    words = spark.createDataFrame([(None, names[0]), (None, names[1]), (1, names[2])], "a long, word string")
    categories = spark.createDataFrame([(f"c{i:03}", names[i % len(names)]) for i in range(300)], "category string, word string")
    got = [sorted(S.closest_category(words, categories, vectors, ["a"], category_block=b).collect(), key=repr) for b in (1000, 256, 1)]
    assert got[0] == got[1] == got[2] and {r["a"] for r in got[0]} == {None, 1}


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_searches_without_an_answer(spark, many, block):
    _, vectors = many
    none = spark.createDataFrame([(1, [0.0] * 6), (2, None)], "query_id long, vector array<double>")
    assert W.nearest_neighbors(vectors, none, 5, block_bytes=block).collect() == []
    assert W.nearest_neighbors(vectors, none.limit(0), 5, block_bytes=block).collect() == []
    few = vectors.limit(3)
    queries = vectors.limit(2).selectExpr("word AS query_id", "vector")
    assert W.nearest_neighbors(few, queries, 5, block_bytes=block).count() == 6


def test_groups_and_triples_with_unknown_words_have_no_result(spark, many):
    _, vectors = many
    group = spark.createDataFrame([(1, "w001"), (1, "unknown")], "query_id long, word string")
    assert W.nearest_to_words(group, vectors, 5).collect() == []
    triple = spark.createDataFrame([(1, "w001", "unknown", "w002")], "query_id long, word1 string, word2 string, word3 string")
    assert W.analogy(triple, vectors, 5).collect() == []


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_exclusions_cost_no_candidates(spark, many, block):
    data, vectors = many
    queries = spark.createDataFrame([(1, [1.0] * 6), (None, [0.5, 1.0, 0.0, 0.0, 1.0, 2.0])], "query_id long, vector array<double>")
    every = [w for w, _ in data]
    left = every[-7:]
    out = spark.createDataFrame([(i, w) for i in (1, None) for w in every if w not in left], "query_id long, word string")
    got = W.nearest_neighbors(vectors, queries, 5, out_set=out, block_bytes=block).collect()
    assert len(got) == 10 and {r["word"] for r in got} <= set(left)
    barred = queries.withColumn("excluded", F.array(*[F.lit(w) for w in every if w not in left]))
    tasks = vectors.rdd.getNumPartitions()
    found = W._candidates(vectors, barred, 5, 1 << 20)
    assert found.count() <= 5 * 2 * tasks


def test_a_word_excluded_by_very_many_queries_is_one_row(spark, many):
    data, vectors = many
    queries = spark.range(20000).select(F.col("id").alias("query_id"), F.array(*[F.lit(x) for x in data[3][1]]).alias("vector"))
    out = queries.select("query_id", F.lit(data[3][0]).alias("word"))  # every query excludes the same word
    got = W.nearest_neighbors(vectors, queries, 2, out_set=out)
    assert got.count() == 40000 and got.where(F.col("word") == data[3][0]).isEmpty()
    assert got.groupBy("query_id").agg(F.array_sort(F.collect_list("word")).alias("w")).select("w").distinct().count() == 1


def test_search_in_blocks_ships_only_cells_that_cones_allow(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(8, 6)) * 10
    data = [(f"c{k}_{i:02d}", [float(x) for x in centres[k] + rng.normal(size=6) * 0.2]) for k in range(8) for i in range(40)]
    data += [("tie_a", data[0][1]), ("tie_b", data[0][1])]  # equal scores: ties go to the smaller word
    vectors = spark.createDataFrame(data, "word string, vector array<double>").repartition(4)
    queries = spark.createDataFrame([(i, data[i * 9][1]) for i in range(30)], "query_id long, vector array<double>")
    whole = W.nearest_neighbors(vectors, queries, 5)
    blocks = W.nearest_neighbors(vectors, queries, 5, block_bytes=2000)
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, whole.collect()))
    assert 0 < W.SHIPPED["cells"] < W.SHIPPED["all"] / 2


def test_sums_of_wide_vectors_are_one_aggregate(spark):
    rng = np.random.default_rng(2)
    data = [(f"w{i}", [float(x) for x in rng.normal(size=300)]) for i in range(50)]
    vectors = spark.createDataFrame(data, "word string, vector array<double>")
    words = spark.createDataFrame([(i % 7, f"w{i}", 1 + i % 3) for i in range(50)], "k long, word string, times long")
    sums = W.vector_sums(words, vectors, ["k"], weight="times")
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" in plan and plan.count("sum(") == 0
    got = {r["k"]: np.array(r["vector"]) for r in sums.collect()}
    for k in range(7):
        want = sum((1 + i % 3) * np.array(data[i][1]) for i in range(50) if i % 7 == k)
        assert np.allclose(got[k], want, atol=1e-9)


def test_only_keys_that_are_known_as_a_whole_get_vectors(spark, vectors, monkeypatch):
    words = spark.createDataFrame(
        [("s", "one"), ("s", "two"), ("s", "one"), ("u", "one"), ("u", "none"), (None, "two"), (None, "two"), ("n", None), ("n", "one")],
        "k string, word string")
    doubled = vectors.unionByName(vectors.where("word = 'two'"))
    given = []

    def counted(rows, *a, f=W.with_vectors, **b):
        given.append(rows.count())
        return f(rows, *a, **b)

    monkeypatch.setattr(W, "with_vectors", counted)
    sums = W.vector_sums(words, doubled, ["k"])
    assert {r["k"]: r["vector"] for r in sums.collect()} == {"s": [2.0, 4.0], None: [0.0, 8.0]}
    assert given == [5]


def test_sums_of_hot_keys_equal_those_of_others(spark, vectors, monkeypatch):
    words = _words(spark, {"s": ["one"] * 30 + ["two"], "h": ["one"] * 20 + ["none"], "a": ["one", "two"], "u": ["none"]})
    found = W.hot_keys
    monkeypatch.setattr(W, "hot_keys", lambda df, on, **_: found(df, on, share=4, min_rows=10))
    sums = {r["k"]: r["vector"] for r in W.vector_sums(words, vectors, ["k"]).collect()}
    assert sums == {"s": [30.0, 2.0], "a": [1.0, 2.0]}

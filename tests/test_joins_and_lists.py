import random

import pytest
from pyspark.sql import functions as F

from qalink.operators import posts as P
from qalink.operators.joins import hot_keys, lookup_join, measured_bytes, spread_join


@pytest.fixture
def skewed(spark):
    rng = random.Random(1)
    left = [(i, "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", "x", None])) for i in range(3000)]
    left = spark.createDataFrame(left, "id long, key string")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("a", 3), ("c", 4), ("z", 5)], "key string, v int")
    return left, right


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_the_plain_join(skewed, rows, how):
    left, right = skewed
    spread = spread_join(left, right, ["key"], how, ["id"], sample=1.0, min_rows=1)
    plain = left.join(right, ["key"], how)
    assert spread.columns == plain.columns
    assert rows(spread) == rows(plain)


def test_hot_keys_are_few_and_spread(skewed):
    left, _ = skewed
    hot = {r["key"]: r["_salts"] for r in hot_keys(left, ["key"], share=4, min_rows=1).collect()}
    assert set(hot) == {"hot"}
    assert 1 < hot["hot"] <= 4
    assert hot_keys(left, ["key"]).count() == 0


def test_lookup_join_takes_either_way(skewed, rows, spark):
    left, right = skewed
    small = lookup_join(left, right, ["key"])
    large = lookup_join(left, right, ["key"], broadcast_bytes=0, store_left=True)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    assert rows(small) == rows(large)
    assert measured_bytes(right) > 0
    assert measured_bytes(right.where("false")) == 0


def test_bodies_in_bounded_lists(spark):
    posts = [(1, i, f"b{i}") for i in range(20, 0, -1)] + [(2, 5, "x"), (2, 4, "y")]
    df = spark.createDataFrame(posts, "question_id long, answer_id long, body string")
    whole = {(r["question_id"], r["chunk"]): r["bodies"] for r in P.bodies_per_question(df).collect()}
    assert whole == {(1, 0): [f"b{i}" for i in range(1, 21)], (2, 0): ["y", "x"]}
    chunked = P.bodies_per_question(df, chunk_rows=5).collect()
    hot = [r["bodies"] for r in chunked if r["question_id"] == 1]
    assert len(hot) > 1
    assert sorted(b for part in hot for b in part) == sorted(f"b{i}" for i in range(1, 21))
    assert all(part == sorted(part, key=lambda b: int(b[1:])) for part in hot)
    assert [r["bodies"] for r in chunked if r["question_id"] == 2] == [["y", "x"]]


def test_copies_of_one_row_are_cut_into_pieces(spark):
    posts = [(1, 7, "same")] * 23 + [(1, 8, "other"), (2, 1, None)]
    df = spark.createDataFrame(posts, "question_id long, answer_id long, body string")
    chunked = P.bodies_per_question(df, chunk_rows=5).collect()
    first = [b for r in chunked if r["question_id"] == 1 for b in r["bodies"]]
    assert sorted(first) == ["other"] + ["same"] * 23
    assert len([r for r in chunked if r["question_id"] == 1]) > 1
    assert [r["bodies"] for r in chunked if r["question_id"] == 2] == [[None]]


def test_questions_of_category_both_ways(spark, rows, monkeypatch):
    selected = spark.createDataFrame([(1,), (1,), (3,)], "question_id long")
    posts = spark.createDataFrame([(1, "a", "t"), (1, "b", "t"), (2, "c", "u"), (3, "d", "v")], "question_id long, title string, tags string")
    small = rows(P.questions_of_category(selected, posts, ["tags"]))
    monkeypatch.setattr(P, "BROADCAST_BYTES", -1)
    assert rows(P.questions_of_category(selected, posts, ["tags"])) == small == [(1, "t"), (3, "v")]


def test_class_report(spark, rows):
    df = spark.createDataFrame(
        [("withImport", "x")] * 2 + [("withLinks", "x")] * 3 + [("not(ImportLinks)", "x")] + [("withLinks", "y")],
        "class string, category string",
    )
    assert rows(P.class_split_report(df)) == [
        ("not(ImportLinks)", "x", 1, 6), ("withImport", "x", 2, 2), ("withLinks", "x", 3, 5), ("withLinks", "y", 1, 1)
    ]
    assert dict(rows(P.class_counts(df))) == {"withImport": 2, "withLinks": 4, "not(ImportLinks)": 1, "total": 7}


def test_post_class_order(spark):
    bodies = [("<code>import x</code><a>y</a>",), ("<a>y</a>",), ("<p>import</p>",)]
    df = spark.createDataFrame(bodies, "body string").select(P.post_class(F.col("body")).alias("c"))
    assert [r["c"] for r in df.collect()] == ["withImport", "withLinks", "not(ImportLinks)"]


def test_lists_keep_null_keys_order_and_bound(spark):
    posts = [(None, i, f"n{i}") for i in range(7)] + [(1, None, f"x{i}") for i in range(3000)] + [(2, i, f"b{i}") for i in range(12)]
    df = spark.createDataFrame(posts, "question_id long, answer_id long, body string").repartition(5)
    got = P.bodies_per_question(df, chunk_rows=5).collect()
    assert all(len(r["bodies"]) <= 5 for r in got)
    whole = {}
    for r in sorted(got, key=lambda r: r["chunk"]):
        whole.setdefault(r["question_id"], []).extend(r["bodies"])
    assert whole[None] == [f"n{i}" for i in range(7)] and whole[2] == [f"b{i}" for i in range(12)]
    assert sorted(whole[1]) == sorted(f"x{i}" for i in range(3000))
    one = P.bodies_per_question(df).where("question_id is null").collect()
    assert [r["bodies"] for r in one] == [whole[None]]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_both_ways_of_a_lookup_agree_on_null_keys(skewed, rows, how):
    left, right = skewed
    right = right.unionByName(right.sparkSession.createDataFrame([(None, 9)], "key string, v int"))
    small = lookup_join(left, right, ["key"], how)
    assert rows(small) == rows(lookup_join(left, right, ["key"], how, broadcast_bytes=0))


def test_naming_posts_are_counted_beside_their_class(spark, rows):
    df = spark.createDataFrame([("a", True), ("a", False), ("b", True), ("b", None)], "class string, named boolean")
    assert dict(rows(P.class_counts(df, "named"))) == {"a": 2, "b": 2, "total": 4, "named": 2}
    assert dict(rows(P.class_counts(df.limit(0), "named"))) == {"total": 0, "named": 0}

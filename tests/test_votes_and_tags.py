import pytest

from qalink.operators import posts as P
from qalink.operators import tags as G
from qalink.operators import votes as O
from qalink.plans import tag_mining

SCORES = "question_id long, category string, similarity double"


@pytest.mark.parametrize(
    "votes, winner",
    [
        ([("a", 0.9)], None),
        ([("a", 0.5), ("a", 0.7)], ("a", 0.6)),
        ([("a", 0.5), ("b", 0.7)], None),
        ([("a", 0.5), ("a", 0.7), ("b", 1.0)], ("a", 0.6)),
        ([("a", 0.5), ("a", 0.7), ("b", 1.0), ("c", 1.0)], None),
        ([("a", 0.3), ("a", 0.5)], ("a", 0.4)),
        ([("a", 0.3), ("a", 0.4)], None),
        ([("a", 0.5), ("a", 0.7), (None, 1.0), ("b", None)], ("a", 0.6)),
    ],
)
def test_majority(spark, votes, winner):
    df = spark.createDataFrame([(1, c, s) for c, s in votes], SCORES)
    got = [(r["category"], round(r["mean_similarity"], 9)) for r in O.majority_category(df).collect()]
    assert got == ([winner] if winner else [])


# A few labelled pairs as a person would give them.
LABELLED = [
    ("spring", "spring-mvc", 2, 2),
    ("hibernate", "spring", 1, 2),
    ("hibernate", "jpa", 1, 0),
    ("guice", "spring", 2, 2),
    ("jsf", "xml", None, None),
    ("guice", "xml", 2, 0),
]


@pytest.fixture
def labelled(spark):
    return spark.createDataFrame(LABELLED, "tag_a string, tag_b string, label_a int, label_b int")


def test_labels(spark, rows, labelled):
    assert rows(G.selected_tags(labelled)) == [("guice",), ("spring",), ("spring-mvc",)]
    assert tuple(G.label_coverage(labelled).first()) == (5, 6)
    assert rows(G.label_queue(labelled), "tag_a", "tag_b") == [("guice", "xml"), ("jsf", "xml")]
    labels = spark.createDataFrame([("spring", 2), ("hibernate", 1), ("xml", 1)], "tag string, label int")
    spread = rows(G.spread_labels(labelled, labels))
    assert ("hibernate", "spring", 1, 2) in spread
    assert ("guice", "xml", 0, 1) in spread
    assert ("spring", "spring-mvc", 2, 0) in spread
    assert len(spread) == len(LABELLED)


def test_mining_counts_distinct_tag_strings(spark, rows):
    selected = spark.createDataFrame([(1, "io"), (2, "io"), (3, "json"), (4, "io")], "question_id long, category string")
    posts = [
        (1, 10, "t, one", "b", "<java><file><io>"),
        (1, 11, "t, one", "b", "<java><file><io>"),
        (2, 12, "t2", "b", "<io><file><path>"),
        (3, 13, "t3", "b", "<io><file>"),
        (4, 14, "t4", None, "<file><io><x>"),
    ]
    posts = spark.createDataFrame(posts, "question_id long, answer_id long, title string, body string, tags string")
    posts = P.complete_rows(posts)  # dropped once, when the posts are cleaned
    pairs = tag_mining.frequent_tag_pairs(selected, posts, "io", above=0)
    assert [tuple(r) for r in pairs.collect()] == [("file", "io", 2), ("file", "path", 1), ("io", "path", 1)]
    assert G.distinct_tag_count(pairs).first()[0] == 3
    labelled = spark.createDataFrame([("file", "path", 1, 2)], "tag_a string, tag_b string, label_a int, label_b int")
    chosen = tag_mining.posts_with_selected_tags(selected, posts, labelled, "io")
    assert rows(chosen) == [(2, "t2", "<io><file><path>")]


def test_bigrams_are_ordered_and_unique(spark):
    lists = [("<d><b><a>",), ("<a><b>",), ("<b><a><c>",), ("<c><d>",)] * 2
    df = spark.createDataFrame(lists, "tags string")
    got = [tuple(r) for r in G.tag_bigrams(df, (), 0).collect()]
    assert all(a < b for a, b, _ in got)
    assert len({(a, b) for a, b, _ in got}) == len(got)
    assert {(a, b): n for a, b, n in got}[("a", "b")] == 3


def test_posts_with_few_chosen_tags_need_no_explode_and_one_distinct(spark):
    from qalink.operators import tags as G

    posts = spark.createDataFrame([(1, "<a><b>"), (1, "<a><b>"), (2, "<c>"), (3, None), (4, "<b><b>")], "question_id long, tags string")
    chosen = spark.createDataFrame([("b",), (None,), ("z",)], "tag string")
    found = G.posts_with_tags(posts, chosen)
    plan = found._jdf.queryExecution().executedPlan().toString()  # before it runs: one plan
    assert "Generate" not in plan and plan.count("Exchange") == 1
    assert sorted(map(tuple, found.collect())) == [(1, "<a><b>"), (4, "<b><b>")]

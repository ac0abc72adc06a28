"""The jobs end to end on a small set of posts, and the shape of their plans."""

import pytest

import catalog
from qalink import schemas
from qalink.operators import scoring as S
from qalink.operators import titles as T
from qalink.operators import usages as U
from qalink.operators import words as R
from qalink.plans import categories, library_use
from qalink.sources import scratch, tables

POSTS = [
    (1, 10, "Parse JSON, fast", "<p>Try</p><pre><code>import x; JsonReader parse(JsonReader reader)</code></pre>", "<java><json>"),
    (1, 11, "Parse JSON, fast", "<pre>JsonReader parse getName</pre><code>getName JsonReader</code>", "<java><json>"),
    (2, 12, "Read a file", "<pre>FileReader open close FileReader</pre><a href='x'>l</a>", "<java><file>"),
    (3, 13, "Talk", "<p>no code, but Gson</p>", "<java><talk>"),
    (4, 14, None, "<pre>JsonReader</pre>", "<java>"),
]
SYMBOLS = [
    ("org.json", "json", "1", "org.json.JsonReader", None, 1),
    ("org.json", "json", "1", "org.json.JsonReader", "parse", 2),
    ("org.json", "json", "1", "org.json.JsonReader", "getName", 3),
    ("org.io", "io", "1", "org.io.FileReader", None, 4),
    ("org.io", "io", "1", "org.io.FileReader", "open", 5),
    ("org.io", "io", "1", "org.io.FileReader", "close", 6),
]


@pytest.fixture
def data(spark):
    make = spark.createDataFrame
    return {
        "posts": make(POSTS, schemas.POSTS),
        "symbols": make(SYMBOLS, schemas.SYMBOLS),
        "selected": make([("JSON", "http://x/org.json/json"), ("I/O", "http://x/org.io/io")], schemas.LIBRARIES_SELECTED),
        "details": make([("org.json", "json", "1"), ("org.io", "io", "1")], schemas.LIBRARIES_DETAILS),
        "vectors": make(
            [("JsonReader", [1.0, 0.0]), ("parse", [1.0, 0.1]), ("FileReader", [0.0, 1.0]), ("open", [0.1, 1.0])], schemas.VECTORS
        ),
    }


def test_scores_by_vectors(data):
    scored = categories.score_answers(data["posts"], data["selected"], data["details"], data["symbols"], data["vectors"])
    got = {r["answer_id"]: (r["category"], r["title"], r["identifiers"]) for r in scored.collect()}
    assert {k: v[0] for k, v in got.items()} == {10: "json", 11: "json", 12: "i_o"}
    assert got[10][1] == "Parse JSON  fast"
    assert got[11][2] == ["JsonReader", "parse", "getName"]
    lines = {r["answer_id"]: r["identifiers"] for r in categories.similarity_lines(scored).collect()}
    assert lines[11] == "JsonReader|parse|getName"


def test_scores_by_overlap(data, rows):
    scored = categories.score_questions(data["posts"], data["selected"], data["details"], data["symbols"])
    # Question 1: (1 of 2 lower words + 2 of 2) / 2; a lone ``import`` is part of no chunk.
    assert rows(scored) == [(1, "json", 0.75), (2, "i_o", 1.0)]


@pytest.mark.parametrize("skip, want", [(False, []), (True, [(1, "c", 1.0)])])
def test_an_answer_without_lower_words(spark, rows, skip, want):
    answers = [(1, 1, ["Foo", "bar", "bar"]), (1, 2, ["Foo", "Bar", "Baz"]), (1, 3, ["short"])]
    answers = spark.createDataFrame(answers, "question_id long, answer_id long, identifiers array<string>")
    classes = spark.createDataFrame([("c", "Foo")], "category string, token string")
    methods = spark.createDataFrame([("c", "bar")], "category string, token string")
    scores = S.question_scores(answers, classes, methods, skip).first()
    assert (scores["answers"], scores["class_answers"]) == (2, 2)
    # Distinct hits over all occurrences: one half.
    assert scores["method_similarity"] == (0.5 if skip else None)
    got = rows(S.closest_category_classical(answers, classes, methods, min_method=0.4, skip_empty=skip))
    assert [(q, c) for q, c, _ in got] == [(q, c) for q, c, _ in want]


def test_usages_end_to_end(spark, data, rows):
    similarities = [(1, 10, "Parse JSON, fast", "json", 0.9), (1, 11, "Parse JSON, fast", "json", 0.8), (3, 13, "Talk", "json", 0.5), (2, 12, "Read", "io", 0.5)]
    similarities = spark.createDataFrame(similarities, schemas.SIMILARITIES)
    versions = spark.createDataFrame([("org.json", "json", "1|9"), ("org.io", "io", "1")], schemas.LIBRARY_VERSIONS)
    lexicon = spark.createDataFrame([("fast", "RB"), ("parse", "VB")], schemas.LEXICON)
    usages = library_use.extract_usages(similarities, data["posts"], versions, data["symbols"], lexicon, "json")
    assert rows(usages) == [(10, "parse json", "org.json json->2"), (11, "parse json", "org.json json->2"), (13, "talk", "")]
    assert rows(library_use.analyze_usages(usages)) == [("org.json json", "parse json")] * 2
    classified = library_use.classify_posts(similarities, data["posts"], "json")
    assert rows(classified, "answer_id", "class", "named") == [
        (10, "withImport", False), (11, "not(ImportLinks)", False), (13, "not(ImportLinks)", True)
    ]
    info = spark.createDataFrame([("JSON in Java", "http://x/org.json/json")], schemas.LIBRARY_INFO)
    assert rows(library_use.library_table(versions, info)) == [("org.json", "json", "JSON in Java")]


def test_ties_all_win_and_single_matches_never(spark, rows):
    usages = [(1, "a", 3), (1, "b", 3), (1, "c", 1), (2, "a", 1), (3, "c", 2)]
    usages = spark.createDataFrame(usages, "answer_id long, library string, matches int")
    assert rows(U.best_libraries(usages)) == [(1, "a", 3), (1, "b", 3), (3, "c", 2)]


def test_title_keywords(spark, rows):
    tagged = spark.createDataFrame([("The", "DT"), ("the", "DT"), ("the", "NN"), ("reads", "VBZ"), ("of", "IN")], "token string, tag string")
    lexicon = T.build_lexicon(tagged)
    titles = spark.createDataFrame([(1, "The parser reads, of Files"), (2, "of the"), (3, "")], "id long, title string")
    assert rows(T.title_keywords(titles, lexicon, ["id"])) == [(1, "parser reads files"), (2, ""), (3, "")]
    assert rows(T.title_keywords(titles, lexicon, ["id"], unknown_tag=None))[0] == (1, "reads")


def test_words(spark, rows):
    words = spark.createDataFrame([(1, w) for w in "b a b c a d".split()], "k long, word string")
    assert rows(R.most_frequent_words(words, ["k"], 2)) == [(1, "a", 2, 1), (1, "b", 2, 2)]
    stop = spark.createDataFrame([("a",), ("b",)], "word string")
    assert rows(R.drop_stop_words(words.withColumnRenamed("word", "token"), stop), "token") == [("c",), ("d",)]


def test_tables(spark, tmp_path, rows, data):
    path = str(tmp_path / "posts")
    tables.write_csv(data["posts"].na.drop(), path, quoted=True)
    assert rows(tables.read_csv(spark, path, schemas.POSTS, quoted=True)) == rows(data["posts"].na.drop())
    tables.write_table(data["posts"], str(tmp_path / "p"), ("question_id",))
    assert tables.read_table(spark, str(tmp_path / "p")).count() == len(POSTS)
    pairs = tmp_path / "pairs.txt"
    pairs.write_text("a,b,2,1\nc,d\n")
    assert rows(tables.read_bigrams(spark, str(pairs))) == [("a", "b", 2, 1), ("c", "d", None, None)]
    stop = tmp_path / "stop.txt"
    stop.write_text("int\ncontinue\ncontinue\n\n")
    assert rows(tables.read_stop_words(spark, str(stop))) == [("continue",), ("int",)]


def test_shared_folder_follows_the_session(spark):
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert base and scratch.shared_folder(spark).startswith(base)
    assert scratch.shared_folder(spark) != scratch.shared_folder(spark)


PYTHON_NODES = ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "MapInArrow", "FlatMapCoGroups", "FlatMapGroups")
WITH_PYTHON = {"html_blocks_parsed", "archive_entries", "nearest_neighbors", "nearest_to_words", "analogy"}


@pytest.mark.parametrize("name", sorted(catalog.all_queries()))
def test_plan_shape(spark, name):
    df = catalog.all_queries()[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    if name not in WITH_PYTHON:
        assert not any(node in plan for node in PYTHON_NODES)

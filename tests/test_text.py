import random
import re

import pytest
from pyspark.sql import functions as F

from qalink.functions import mentions as M
from qalink.functions import text as X


@pytest.mark.parametrize(
    "text, chunks, words",
    [
        ("int", [], []),
        ("int[]", [], []),
        ("x.int", ["x int"], []),
        ("String.valueOf", ["String valueOf"], ["String", "valueOf"]),
        ("ab", [], []),
        ("", [], []),
        ("a.b", ["a b"], []),
        ("foo\nbar", ["foo", "bar"], ["foo", "bar"]),
        ("foo\tbar", ["foo bar"], ["foo", "bar"]),
        ("Größe (naïve) 漢字仮", ["Größe", "naïve", "漢字仮"], ["Größe", "naïve", "漢字仮"]),
        ("abc𝒳def", ["abc def"], ["abc", "def"]),
        ("get2x", ["get x"], ["get"]),
    ],
)
def test_identifiers(one, text, chunks, words):
    assert one(X.chunk_identifiers, t=text) == chunks
    assert one(X.word_identifiers, t=text) == words


def test_chunk_words_keep_stop_words_inside_chunks(one):
    assert one(X.chunk_words, t="int x.int foo.bar") == ["int", "foo", "bar"]


def _model_chunks(text):
    cleaned = ["".join(c if c.isalpha() else " " for c in w).strip() for w in text.replace("\n", " ").split(" ")]
    return [w for w in cleaned if len(w) > 2 and w not in X.JAVA_WORDS]


def _model_words(text):
    cleaned = "".join(c if c.isalpha() else " " for c in text)
    return [w for w in cleaned.split(" ") if len(w) > 2 and w not in X.JAVA_WORDS]


def test_identifiers_follow_the_plain_definition(spark):
    rng = random.Random(3)
    pieces = ["int", "new", "foo", "Bar", "x", "é", ".", "(", "[]", " ", " ", "\n", "7", "_", "$", "public"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", X.chunk_identifiers(F.col("t")).alias("c"), X.word_identifiers(F.col("t")).alias("w"))
    for row in got.collect():
        assert row["c"] == _model_chunks(row["t"])
        assert row["w"] == _model_words(row["t"])


@pytest.mark.parametrize(
    "token, words",
    [
        ("CamelCase", "camel case"),
        ("HTTPClient", "http client"),
        ("x2", "x 2"),
        ("already lower", "already  lower"),
        ("HTTPClientFactory2x", "http client factory 2x"),
    ],
)
def test_split_camel_case(one, token, words):
    assert one(X.split_camel_case, t=token) == words


def test_tags(one):
    assert one(lambda t: X.parse_tags(t, X.GENERAL_TAGS), t="<java><c++><gson>") == ["gson"]
    assert one(X.parse_tags, t="<a><b>") == ["a", "b"]

    def pairs(tags):
        found = one(lambda t: X.tag_pairs(X.parse_tags(t)), t=tags)
        return [(p["tag_a"], p["tag_b"]) for p in found]

    assert pairs("<java>") == []
    assert pairs("<b><a>") == [("a", "b")]
    assert pairs("<b><a><b>") == [("a", "b"), ("b", "b")]
    assert pairs("<b><b><b>") == [("b", "b")]


def test_coordinates(one):
    assert tuple(one(X.url_coordinates, u="http://x/com.a/b/")) == ("com.a", "b")
    assert tuple(one(X.url_coordinates, u="single")) == (None, None)
    assert one(X.category_slug, c="I/O Utilities") == "i_o_utilities"
    assert one(X.jar_path, g="com.a.b", a="c.d", v="1.0") == "com/a/b/c/d/1.0/c.d-1.0.jar"


def test_usages(one):
    decoded = one(X.decode_usages, u="g a->2|h b->1")
    assert [tuple(u) for u in decoded] == [("g a", 2), ("h b", 1)]
    best = lambda u: X.best_usages(X.decode_usages(u))
    assert [u["library"] for u in one(best, u="a->2|b->3|c->3")] == ["b", "c"]
    assert one(best, u="a->1|b->1") == []
    assert one(best, u="") == []


def test_titles(one):
    assert one(X.title_commas_to_blanks, t="a,b, c") == "a b  c"
    assert one(X.title_without_commas, t="a,b, c") == "ab c"


# The published patterns, one match per line at most.
def _published(pattern, text):
    return len(re.findall(pattern, text))


TEXTS = [
    "Use Gson. Gson is fine\nnot gson2 but gson",
    "Gson",
    "the Gson object (Gson) <Gson> Gson!",
    "a Gson b\nGson\n. Gson.",
    "",
    "Gson.toJson(x) and Gson.toJson y\nnoGson.toJson(",
    'see <a href="u/com/Gson.html" >doc</a>\n<a>x</a> href com/Gson.html > </a>\n<a href="com/Gson.htm">x</a>',
]


@pytest.mark.parametrize("text", TEXTS)
def test_mentions(one, text):
    assert one(lambda t: M.type_mentions(t, "Gson"), t=text) == _published(r"(?i).*\bGson\b.*", text)
    simple = r".*(?:^|[a-z]+ |[.!?] |[(<])Gson(?:[>).,!?$]| [a-z]+).*"
    assert one(lambda t: M.simple_name_mentions(t, "Gson"), t=text) == _published(simple, text)
    link = r".*<a.*href.*com/Gson\.html.*>.*</a>.*"
    assert one(lambda t: M.link_mentions(t, "com", "Gson"), t=text) == _published(link, text)
    assert one(lambda t: M.method_mentions(t, "Gson", "toJson"), t=text) == _published(r".*Gson\.toJson[(| ]", text)


def test_names_are_taken_literally(one):
    assert one(lambda t: M.type_mentions(t, "a.b"), t="a.b\nacb") == 1
    assert one(lambda t: M.method_mentions(t, r"x\E", "m"), t=r"x\E.m(") == 1


def test_mentions_stay_linear_on_a_long_line(one):
    text = "<a href " * 20000
    assert one(lambda t: M.link_mentions(t, "com", "Gson"), t=text) == 0

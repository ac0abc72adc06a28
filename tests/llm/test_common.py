"""Cases that every operator has to bear: nulls, empty texts and tables, repeats, clashing columns."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from qalink.llm import (
    cuckoo, kneser_ney, merge_automaton, mixing, near_copies, norm_search, planes, surrogates, toxic_spans, url_rules,
)
from qalink.llm.queries import HOST_RULES, tokenizer_path
from qalink.sources.scratch import shared_folder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, key string, g string, `row` string"
LONG = "lorem ipsum dolor sit amet " * 4000
ROWS = [
    (1, "one two three four five six", "en", "a", 1, "x", "x", "x", "x"),
    (1, "one two three four five six", "en", "a", 1, "x", "x", "x", "x"),  # a repeated row
    (2, "one two three four five  six", "en", "b", 1, "x", "x", "x", "x"),
    (3, None, None, None, None, None, None, None, None),
    (4, "", "en", "a", 0, "x", "x", "x", "x"),
    (None, "one two three four five six", None, None, None, None, None, None, None),
    (None, None, None, None, None, None, None, None, None),
    (5, LONG, "de", "b", 1, "x", "x", "x", "x"),
    (6, " \t\n", "de", "b", 3, "x", "x", "x", "x"),
]
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (1, 1, 0), (2, 1, None), (3, None, 1), (None, 1, 1), (5, 0, 1), (99, 1, 0)]
    return spark.createDataFrame(rows, LABELS)


def by_row(df):
    return sorted(map(tuple, df.collect()), key=repr)


OPERATORS = {
    "surrogates": lambda s, d, l: surrogates.without_personal_data(d, "k"),
    "cuckoo": lambda s, d, l: cuckoo.duplicates(d),
    "mixing": lambda s, d, l: mixing.mix(d),
    "toxic": lambda s, d, l: toxic_spans.score(d, l),
    "near": lambda s, d, l: near_copies.near_copies(d),
    "quality": lambda s, d, l: kneser_ney.judge(d, l),
    "encode": lambda s, d, l: merge_automaton.encode(d, tokenizer_path()),
    "digests": lambda s, d, l: merge_automaton.encoding_digests(d, tokenizer_path()),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_result_per_row_whatever_the_rows(spark, labels, name):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert len(OPERATORS[name](spark, docs, labels).collect()) == len(ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, labels, name):
    none = spark.createDataFrame([], SCHEMA)
    assert OPERATORS[name](spark, none, spark.createDataFrame([], LABELS)).collect() == []


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_keep_columns_and_bear_all_rows(spark, labels, tmp_path, stage):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    run = dict(corpus_pipeline.STAGES)[stage]
    docs = spark.createDataFrame(ROWS, SCHEMA)
    out = run(spark, docs, str(tmp_path))
    if stage != "encoding":
        assert out.columns == docs.columns
    assert out.count() <= 2 * len(ROWS)
    assert run(spark, spark.createDataFrame([], SCHEMA), str(tmp_path)).collect() == []


def test_exact_copies(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    found = cuckoo.duplicates(docs).collect()
    texts = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert texts[2]["kept"] and texts[2]["keep_id"] == 2  # the most code points
    assert texts[2]["group_size"] == 4
    assert texts[6]["kept"] and texts[6]["group_size"] == 4  # white space, empty and null are equal
    assert sum(r["kept"] for r in found) == 3
    kept = cuckoo.without_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 5, 6]


def test_ties_between_equal_texts_go_to_the_smaller_id(spark):
    docs = spark.createDataFrame([(9, "a b"), (-3, "b a"), (4, "a\tb"), (None, "a b")], "doc_id long, text string")
    keep = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in cuckoo.duplicates(docs).collect()}
    assert keep == {9: (4, False), -3: (-3, True), 4: (4, True), None: (4, False)}


def test_cuckoo_filter_inserts_deletes_and_grows():
    import hashlib

    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    shard = cuckoo.CuckooShard(buckets=2)
    assert all(shard.insert(k) for k in keys) and not shard.insert(keys[7])
    assert shard.buckets >= 1250 and all(k in shard for k in keys)
    assert all(shard.delete(k) for k in keys[::2]) and not shard.delete(keys[0])
    assert all((k in shard) == (i % 2 == 1) for i, k in enumerate(keys))
    assert hashlib.sha256(b"other").digest() not in shard


def test_cuckoo_index_as_a_table(spark):
    digest = F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest")
    index = cuckoo.build_index(spark.range(100).select(digest), 4)
    changes = spark.range(90, 120).select(digest, (F.col("id") >= 100).alias("live"))
    index = cuckoo.update_index(index, changes, 4)
    probed = cuckoo.probe_index(index, spark.range(130).select(digest), 4)
    assert probed.where("live").count() == 110


def test_near_copies_without_words_stand_alone(spark):
    found = near_copies.near_copies(spark.createDataFrame(ROWS, SCHEMA)).collect()
    of = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert of[1]["links"] == 3 and of[1]["class_id"] == 1 == of[2]["class_id"] and of[1]["class_size"] == 4
    assert of[4]["links"] == 0 and of[4]["class_id"] == 4 and of[6]["class_id"] == 6
    assert sum(r["class_id"] is None for r in found) == 1


def test_urls(spark):
    urls = [
        (1, "HTTP://A.Example.COM/en/x?q"), (2, "https://www.example.com/en/"), (3, "https://example.com"), (4, None),
        (5, "no scheme"), (6, "http://x.net/es/"), (7, "http://notexample.com/en/"), (8, "http://x.net/ES/"), (9, "http://spam-farm.org/a"),
        (9, "http://spam-farm.org/a"), (10, "http://ads.net/fr/"), (11, "http:///example.com/en/"),
    ]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in urls], "page_id long, url string, host string, token string")
    rules = url_rules.rule_table(
        spark, url_rules.host_rules(HOST_RULES) + [(None, "block", 0, "||spam-farm."), (None, None, 0, "x"), ("e", "block", 0, "")]
    )
    got = by_row(url_rules.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict"))
    assert got == sorted([
        (1, "a.example.com", "/en/x", "example.com/en/", "block"), (2, "www.example.com", "/en/", "www.example.com/en/", "allow"),
        (3, "example.com", "", None, "allow"), (4, "", "", None, "allow"), (5, "", "", None, "allow"),
        (6, "x.net", "/es/", "net/es/", "block"), (7, "notexample.com", "/en/", "com/", "allow"), (8, "x.net", "/ES/", None, "allow"),
        (9, "spam-farm.org", "/a", None, "block"), (9, "spam-farm.org", "/a", None, "block"),
        (10, "ads.net", "/fr/", "net/fr/", "block"), (11, "", "/example.com/en/", None, "allow"),
    ], key=repr)
    assert url_rules.judge(pages.limit(0), rules).collect() == []
    assert url_rules.judge(pages, rules.limit(0)).where("verdict = 'allow'").count() == len(urls)


def test_rule_index_takes_the_rarest_whole_token(spark):
    rules = url_rules.rule_table(spark, [("r", "block", 0, "||example.com/rare/")])
    seen = spark.createDataFrame([("example.com/",), ("example.com/b",), ("x.com/rare/",)], "subject string")
    assert url_rules.rule_index(rules, seen).first()["token"] == "rare"
    assert url_rules.compile_pattern("||a.net/fr")[1] == ["a", "net"]  # fr may be the start of a longer token
    assert url_rules.compile_pattern("*/banner/*")[1] == ["banner"] and url_rules.compile_pattern("*spam*")[1] == []


def test_mixing_reaches_its_targets(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id % 7 as int)) AS text", "concat('s', id % 3) AS source")
    rows = mixing.mix(docs, weights=(5, 2, 1), total=1.5, cap=2.0).collect()
    sizes, taken, target = {}, {}, {}
    for r in rows:
        s = r["given"]["source"]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["size"] * r["copies"]
        target[s] = r["target"]
        assert r["copies"] <= 2
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert target["s0"] == 2 * sizes["s0"]
    assert all(taken[s] == pytest.approx(target[s], rel=0.05) for s in sizes)
    again = mixing.mix(docs.repartition(5), weights=(5, 2, 1), total=1.5, cap=2.0)
    assert sorted((r["given"]["doc_id"], r["copies"]) for r in again.collect()) == sorted((r["given"]["doc_id"], r["copies"]) for r in rows)
    assert mixing.emitted(again).count() == sum(r["copies"] for r in rows)


def test_source_without_words_has_no_copies(spark):
    docs = spark.createDataFrame([(1, "", "a"), (2, None, "a"), (3, "w w", "b")], "doc_id long, text string, source string")
    got = {r["given"]["doc_id"]: (r["target"], r["copies"]) for r in mixing.mix(docs).collect()}
    assert got[1] == (0.0, 0) and got[3][0] == 3.0


def test_source_mix_starts_no_python_worker(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    # Rows of a Python list become an RDD that Python workers read.
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *a, **b: pytest.fail("a list of rows"))
    assert mixing.mix(docs).count() == len(ROWS)

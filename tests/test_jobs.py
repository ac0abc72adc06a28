"""The jobs chained through files, each reading what the one before wrote."""

import os
import subprocess
import sys
import zipfile

import pytest

from qalink import jobs, schemas
from qalink.functions import text as X
from qalink.operators import libraries as L
from pyspark.sql import functions as F

from qalink.plans import tag_mining
from qalink.sources import archives, tables
from tests.test_plans import POSTS, SYMBOLS


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_chain(spark, tmp_path, rows, kind):
    folder = tmp_path / "in"
    folder.mkdir()

    def put(name, data, schema):
        df = spark.createDataFrame(data, schema).coalesce(1)
        if kind == "csv":
            tables.write_csv(df, f"{folder}/{name}", header=name != "bigrams", quoted=name != "bigrams")
        else:
            tables.write_table(df, f"{folder}/{name}")

    broken = [(5, 15, 'quote " and, comma', "<pre>line\nFileReader open</pre>", "<java><file><path>")]
    put("posts", [p for p in POSTS if p[2]] + broken, schemas.POSTS)
    put("symbols", SYMBOLS, schemas.SYMBOLS)
    put("libraries_selected", [("JSON", "http://x/org.json/json"), ("I/O", "http://x/org.io/io")], schemas.LIBRARIES_SELECTED)
    put("libraries_details", [("org.json", "json", "1"), ("org.io", "io", "1")], schemas.LIBRARIES_DETAILS)
    put("library_versions", [("org.json", "json", "1")], schemas.LIBRARY_VERSIONS)
    put("lexicon", [("fast", "RB")], schemas.LEXICON)
    put("bigrams", [("file", "path", 1, 2), ("json", "path", 2, 2)], schemas.BIGRAMS)
    (folder / "vectors").write_text("4 2\nJsonReader 1 0\nparse 1 0.1\nFileReader 0 1\nopen 0.1 1\n")

    def job(name, target, category=""):
        jobs.run(spark, name, str(folder), f"{folder}/{target}", category, kind)
        return jobs.Inputs(spark, str(folder), kind)

    scores = job("score-answers", "similarities")["similarities"]
    assert rows(scores, "answer_id", "category") == [(10, "json"), (11, "json"), (12, "i_o"), (15, "i_o")]
    chosen = job("select-questions", "selected_posts")["selected_posts"]
    assert rows(chosen, "question_id", "category") == [(1, "json")]
    job("mine-tags", "pairs", "json")
    job("select-posts", "tagged", "json")
    job("score-questions", "overlap")
    job("classify-posts", "classes", "json")
    usages = job("extract-usages", "usages", "json")["usages"]
    assert rows(usages, "answer_id", "libraries") == [(10, "org.json json->2"), (11, "org.json json->2")]
    job("analyze-usages", "titles")
    read = spark.read.parquet if kind == "parquet" else spark.read.option("header", True).csv
    assert rows(read(f"{folder}/titles"), "library") == [("org.json json",)] * 2
    assert rows(read(f"{folder}/tagged"), "title") == [("Parse JSON fast",)]
    assert rows(read(f"{folder}/classes"), "class") == [("not(ImportLinks)",), ("withImport",)]


def test_command_starts_from_another_folder(spark, tmp_path):
    tables.write_table(
        spark.createDataFrame([(1, "library->2|other->1"), (2, "")], "title string, libraries string"), f"{tmp_path}/in/usages"
    )
    script = os.path.abspath(jobs.__file__)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, script, "analyze-usages", "--input", f"{tmp_path}/in", "--output", f"{tmp_path}/out", "--work-dir", f"{tmp_path}/work"],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300,
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("library", "1")]
    assert not [name for name in os.listdir(f"{tmp_path}/work") if name.startswith("qalink-")]


def test_symbols_from_archives(spark, tmp_path, rows):
    path = spark.range(1).select(X.jar_path(F.lit("org.json"), F.lit("json"), F.lit("1.2"))).first()[0]
    jar = tmp_path / "in" / "archives" / path
    jar.parent.mkdir(parents=True)
    with zipfile.ZipFile(jar, "w") as archive:
        for name in ("org/json/", "org/json/A$B.class", "org/json/C.class", "module-info.class", "readme.txt"):
            archive.writestr(name, "")
    (jar.parent / "broken-1.jar").write_text("no archive")
    jobs.run(spark, "list-symbols", f"{tmp_path}/in", f"{tmp_path}/symbols", kind="parquet")
    got = spark.read.parquet(f"{tmp_path}/symbols")
    assert got.columns == ["group_id", "artifact_id", "version", "class_name", "member_name", "ord"]
    assert rows(got, "group_id", "artifact_id", "version", "class_name") == [
        ("org.json", "json", "1.2", "org.json.A$B"), ("org.json", "json", "1.2", "org.json.C")
    ]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{tmp_path}/in/archives")
    bad = archives.unreadable(files).collect()
    assert len(bad) == 1 and bad[0]["path"].endswith("broken-1.jar")


def test_libraries_without_details_are_named(spark, rows):
    libraries = spark.createDataFrame([("c", "g", "a"), ("c", "g", "b")], "category string, group_id string, artifact_id string")
    details = spark.createDataFrame([("g", "a", "2"), ("g", "a", "1"), ("g", "b", None)], "group_id string, artifact_id string, version string")
    assert rows(L.without_version(libraries, details), "category", "group_id", "artifact_id") == [("c", "g", "b")]


def test_tag_jobs_read_no_bodies(spark, tmp_path):
    tables.write_table(spark.createDataFrame([p for p in POSTS if p[2]], schemas.POSTS), f"{tmp_path}/posts")
    selected = spark.createDataFrame([(1, "json", 1.0)], schemas.SELECTED_POSTS)
    labels = spark.createDataFrame([("json", "path", 2, 2)], schemas.BIGRAMS)
    posts = tables.read_table(spark, f"{tmp_path}/posts")
    pairs = tag_mining.frequent_tag_pairs(selected, posts, "json", above=0)
    chosen = tag_mining.posts_with_selected_tags(selected, posts, labels, "json")
    for df in (pairs, chosen):
        assert "body" not in df._jdf.queryExecution().executedPlan().toString()

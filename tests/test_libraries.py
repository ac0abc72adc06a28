import zipfile

import pytest

from qalink import schemas
from qalink.operators import libraries as L
from qalink.sources import archives


@pytest.fixture
def symbols(spark):
    data = [
        ("g", "a", "1", "p.q.Outer$Inner", None, 1),
        ("g", "a", "1", "p.q.Outer$Inner", "<init>", 2),
        ("g", "a", "1", "p.q.Outer$Inner", "getName", 3),
        ("g", "a", "1", "p.q.Outer$Inner", "getName", 4),
        ("g", "a", "1", "p.q.Outer$Inner", "lambda$x", 5),
        ("g", "a", "2", "p.Two", None, 6),
        ("g", "a", "2", "p.Two", "getName", 7),
        ("h", "b", "1", "Top", None, 8),
        ("h", "b", "1", "Top", "a", 9),
    ]
    return spark.createDataFrame(data, schemas.SYMBOLS)


def _symbols(df):
    return [r["symbol"] for r in df.orderBy("ord").collect()]


def test_read_outs(symbols):
    assert _symbols(L.class_symbols(symbols)) == ["Outer Inner", "Two", "Top"]
    assert _symbols(L.method_symbols(symbols)) == ["<init>", "getName", "getName", "lambda$x", "getName", "a"]
    assert _symbols(L.class_and_method_symbols(symbols))[:3] == ["Outer Inner", "<init>", "getName"]
    assert _symbols(L.qualified_class_symbols(symbols)) == ["p.q.Outer.Inner", "p.Two", "Top"]
    assert _symbols(L.module_symbols(symbols)) == ["Outer$Inner", "getName", "Two", "getName", "Top", "a"]


def test_library_symbols_join_versions(symbols, rows):
    tokens = rows(L.library_symbols(symbols).where("group_id = 'g'"), "token")
    assert tokens == sorted([("<init>",), ("Inner",), ("Outer",), ("Two",), ("getName",), ("lambda$x",)], key=repr)


def test_vocabulary(spark, symbols, rows):
    libraries = [("json", "g", "a", "1"), ("json", "h", "b", "1"), ("io", "g", "a", "2")]
    libraries = spark.createDataFrame(libraries, "category string, group_id string, artifact_id string, version string")
    both = rows(L.category_vocabulary(libraries, symbols).where("category = 'json'"), "token", "n")
    assert both == sorted([("Inner", 1), ("Outer", 1), ("Top", 1), ("getName", 2), ("init", 1), ("lambda", 1), ("x", 1)], key=repr)
    assert rows(L.category_vocabulary(libraries, symbols, "classes"), "category", "token") == [
        ("io", "Two"), ("json", "Inner"), ("json", "Outer"), ("json", "Top")
    ]


def test_versions_and_lookup(spark, rows):
    versions = spark.createDataFrame([("g", "a", "1|2||"), ("h", "b", "3")], schemas.LIBRARY_VERSIONS)
    assert rows(L.library_versions(versions), "library", "version") == [("g a", "1"), ("g a", "2"), ("h b", "3")]
    selected = spark.createDataFrame([("I/O Utilities", "http://x/g/a/"), ("JSON", "http://x/none/b")], schemas.LIBRARIES_SELECTED)
    details = spark.createDataFrame([("g", "a", "2"), ("g", "a", "1"), ("h", "b", "3")], schemas.LIBRARIES_DETAILS)
    found = L.library_version_lookup(L.selected_libraries(selected), details)
    assert rows(found, "category", "group_id", "artifact_id", "version") == [("i_o_utilities", "g", "a", "1")]


def test_suffix_join_matches_longer_group_ids(spark, rows):
    info = [("Own", "http://x/com.a/b"), ("Longer", "http://x/xcom.a/b"), ("Other", "http://x/com.a/bc")]
    info = spark.createDataFrame(info, schemas.LIBRARY_INFO)
    keys = spark.createDataFrame([("com.a", "b"), ("a", "b"), ("com.a", "c"), ("zz", "b")], "group_id string, artifact_id string")
    brute = [
        (k["group_id"], k["artifact_id"], min(i["name"] for i in info.collect() if i["url"].endswith(f"{k['group_id']}/{k['artifact_id']}")))
        for k in keys.collect()
        if any(i["url"].endswith(f"{k['group_id']}/{k['artifact_id']}") for i in info.collect())
    ]
    assert rows(L.library_names(keys, info)) == sorted(brute)
    assert ("com.a", "b", "Longer") in brute


def test_archives(spark, tmp_path, rows):
    folder = tmp_path / "g" / "a"
    folder.mkdir(parents=True)
    with zipfile.ZipFile(folder / "a-1.jar", "w") as archive:
        for entry in ("META-INF/", "org/", "org/foo/", "org/foo/A$B.class", "module-info.class", "org/foo/readme.txt"):
            archive.writestr(zipfile.ZipInfo(entry), b"")
    (folder / "broken.jar").write_bytes(b"not an archive")
    (folder / "other.txt").write_text("x")
    entries = archives.archive_entries(spark, str(tmp_path))
    assert entries.count() == 6
    assert rows(L.import_lines(entries), "symbol") == [("import org.*;",), ("import org.foo.*;",)]
    assert rows(L.archive_classes(entries), "class_name") == [("org.foo.A$B",)]


def test_names_by_last_segment_equal_every_suffix(spark):
    urls = [(f"n{i}", f"http://h/{g}/{a}") for i, (g, a) in enumerate([("org.x", "core"), ("com.y", "core"), ("y", "core"),
                                                                       ("z", "io-core"), ("q", "a/b")])]
    urls += [(f"m{i}", "http://h/org.x/core") for i in range(30)] + [("e", "http://h/ends/"), ("f", "")]
    info = spark.createDataFrame(urls, "name string, url string")
    keys = [("org.x", "core"), ("x", "core"), ("y", "core"), (None, "core"), ("q", "a/b"), ("a", "b"), (None, None), ("ends", "")]
    libraries = spark.createDataFrame(keys, "group_id string, artifact_id string")
    got = sorted(map(tuple, L.library_names(libraries, info).collect()), key=repr)
    want = {}
    for g, a in set(keys):
        suffix = "/".join(p for p in (g, a) if p is not None)
        names = [n for n, u in urls if suffix and u and u.endswith(suffix)]
        if names:
            want[(g, a)] = min(names)
    assert got == sorted(((g, a, n) for (g, a), n in want.items()), key=repr)
    whole = spark.createDataFrame(keys[:3], "group_id string, artifact_id string")
    assert "Generate" not in L.library_names(whole, info)._jdf.queryExecution().executedPlan().toString()

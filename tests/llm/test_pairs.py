"""Near copies and top products against brute force; the registered SQL on the smallest tables."""

import os
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from qalink.llm import near_copies, norm_search, queries
from qalink.llm.components import components
from tests.llm.test_common import by_row


def brute_links(texts, n=5, threshold=0.8):
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    links = {i: set() for i in texts}
    for i in texts:
        for j in texts:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                    links[i].add(j)
                    links[j].add(i)
    return links


def classes(links):
    of = {}
    for i in sorted(links):
        if i in of:
            continue
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in of:
                of[j] = i
                todo += links[j]
    return of


@pytest.mark.parametrize("block", [4, 1024])
def test_near_copies_equal_brute_force(spark, block):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(500)]
    texts, number = {}, 0
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 200))]
        for copy in range(rng.choice([1, 2, 6, 20])):
            words = list(base)
            for _ in range(rng.randint(0, len(words) // 60 + 1) if copy else 0):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts[number] = " ".join(words)
            number += 1
    texts |= {number: "", number + 1: "w1 w2", number + 2: "w1 w2", number + 3: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    links = brute_links(texts)
    expected = classes(links)
    got = near_copies.near_copies(docs, block_nodes=block).collect()
    assert {r["doc_id"]: r["links"] for r in got} == {i: len(v) for i, v in links.items()}
    assert {r["doc_id"]: r["class_id"] for r in got} == expected
    stay = [r["doc_id"] for r in near_copies.one_of_each(docs).collect()]
    assert sorted(stay) == sorted(set(expected.values()))


def test_bands_reach_the_recall():
    bands, rows = near_copies.bands_for(0.8, 0.9999, 192)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 192


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def brute_top(vectors, k):
    out = []
    whole = [(i, None if v is None or any(x is None or not np.isfinite(x) for x in v) else [int(np.floor(256 * x)) for x in v]) for i, v in vectors]
    for i, q in whole:
        if i is None or i % 50 or q is None:
            continue
        found = [(-sum(a * b for a, b in zip(q, v)), j is None, j or 0, j) for j, v in whole if v is not None and j != i and len(v) == len(q)]
        out += [(i, n + 1, j, -s) for n, (s, _, _, j) in enumerate(sorted(found, key=lambda f: f[:3])[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("spread", [0.01, 1.0])
def test_top_products_equal_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(norm_search, "BUCKET_ROWS", 64)
    monkeypatch.setattr(norm_search, "QUERY_ROWS", 4)
    monkeypatch.setattr(norm_search, "PROBE_ROWS", 16)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 6))
    vectors = [(i, (base[i % 12] + spread * rng.normal(size=6)) * rng.lognormal(0, 0.8)) for i in range(400)]
    vectors = [(i, [float(x) for x in v]) for i, v in vectors]
    vectors += [(401, vectors[3][1]), (402, vectors[3][1]), (None, vectors[4][1]), (450, None), (500, [1.0, None, 0.0, 0.0, 0.0, 0.0]),
                (550, [float("nan")] * 6), (600, [float("inf")] + [0.0] * 5), (650, [0.0] * 6), (700, [1.0, 2.0]), (701, [1.0, -2.0]),
                (750, [3e4] * 6)]
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<double>, score int")
    from pyspark.sql import functions as F

    got = by_row(norm_search.top_products(df, F.col("vec_id") % 50 == 0, 5))
    assert got == brute_top(vectors, 5)
    assert norm_search.top_products(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n, (_, sql) in queries.QUERIES.items() if sql])
def test_registered_sql(spark, name):
    run, sql = queries.QUERIES[name]
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(sql)
    columns = sorted(c[0] for c in want.description)
    rounded = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    place = [[c[0] for c in want.description].index(c) for c in columns]
    expected = sorted([rounded([r[i] for i in place]) for r in want.fetchall()], key=repr)
    df = run(spark, SF)
    assert sorted(df.columns) == columns
    assert sorted([rounded(r) for r in df.select(*columns).collect()], key=repr) == expected


@pytest.mark.parametrize("name", [n for n, (_, sql) in queries.QUERIES.items() if not sql])
def test_registered_queries_answer_for_every_document(spark, name):
    found = queries.QUERIES[name][0](spark, SF)
    key, table = ("doc_id", "documents") if "doc_id" in found.columns else ("vec_id", "embeddings")
    ids = sorted(r[key] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())
    assert sorted(r[key] for r in found.collect()) == ids


def test_pipeline(spark):
    import corpus_pipeline

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    rows = corpus_pipeline.run(spark, SF).collect()
    stayed = {r["doc_id"] for r in rows}
    assert len(stayed) > 0.5 * len(docs)
    for r in rows:
        assert r["ids"] == library.encode(docs[r["doc_id"]], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])
    links = brute_links({i: docs[i] for i in stayed})
    assert not any(links.values())  # no two near copies are left
    assert max(sum(r["doc_id"] == i for r in rows) for i in stayed) <= 2


def test_batches_are_cut_before_they_leave_arrow():
    texts = ["ab" * (i % 40) for i in range(5000)] + ["x" * 3_000_000, "", "y"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    pieces = list(near_copies._slices(batch, 1))
    assert [t for p in pieces for t in p.column(1).to_pylist()] == texts
    assert max(p.num_rows for p in pieces) <= near_copies.CHUNK_ROWS
    sizes = [[len(t) for t in p.column(1).to_pylist()] for p in pieces]
    assert all(sum(s) - s[-1] < near_copies.CHUNK_SIGNS for s in sizes)
    assert list(near_copies._slices(batch.slice(0, 0), 1)) == []

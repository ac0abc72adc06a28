"""Importance resampling, product codes and near-duplicate vectors against brute force."""

import hashlib
import math
import re
import zlib

import numpy as np

from qalink.llm import codebooks, importance, projections

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def _resample_by_hand(docs, bench, buckets=10000, share=10, least=20):
    def feats(text):
        return [zlib.crc32(w.encode()) % buckets for w in WORD.findall(_lower(text))]

    s, t = [0] * buckets, [0] * buckets
    per = [(i, feats(x)) for i, x in docs]
    for _, f in per:
        for b in f:
            s[b] += 1
    for x in bench:
        for b in feats(x):
            t[b] += 1
    big_s, big_t = float(sum(s)), float(sum(t))
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (big_s + buckets) / ((s[b] + 1.0) * (big_t + buckets)))) for b in range(buckets)]
    out = []
    for i, f in per:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        if i is None:
            score = None
        else:
            h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296.0)))
        out.append([i, len(f), weight, score, None])
    eligible = sorted((r for r in out if r[1] >= least and r[3] is not None), key=lambda r: (-r[3], r[0]))
    for rank, r in enumerate(eligible[: share * len(eligible) // 100], 1):
        r[4] = rank
    return sorted(map(tuple, out), key=repr)


def test_position_tables_equal_crc32_for_any_span():
    rng = np.random.default_rng(3)
    spans = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in [1, 2, 31, 32, 33, 64, 65, 100, 5000, 7]]
    data = np.frombuffer(b"".join(spans), np.uint8)
    lengths = np.array([len(x) for x in spans])
    assert list(importance.span_crc32(data, np.cumsum(lengths) - lengths, lengths)) == [zlib.crc32(x) for x in spans]


def test_resampling_equals_brute_force_on_whole_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").select("text")
    got = sorted(map(tuple, importance.resample(docs, bench).collect()), key=repr)
    want = _resample_by_hand([(r[0], r[1]) for r in docs.collect()], [r[0] for r in bench.collect()])
    assert got == want
    assert sum(r[4] is not None for r in got) == sum(r[1] >= 20 for r in got) // 10


def test_resampling_cases(spark):
    rows = [(1, None), (2, ""), (None, "a b c " * 10), (3, "Wörter ÜBER " * 15), (3, "Wörter ÜBER " * 15),
            (4, "x" * 100_000), (5, "hello world " * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([("hello world",), (None,)], "text string")
    got = sorted(map(tuple, importance.resample(docs, bench).collect()), key=repr)
    assert got == _resample_by_hand(rows, ["hello world", None])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(empty, bench).collect() == []


def _codes_by_hand(rows, parts=4, entries=256, rounds=4):
    kept = [(i, lab, [math.floor(1024 * float(x)) for x in v]) for i, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) and abs(x) < 2**17 for x in v)]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[2]))
    dims = len(kept[0][2])
    kept = [r for r in kept if len(r[2]) == dims]
    w = dims // parts
    books = [[r[2][p * w:(p + 1) * w] for r in kept[:entries]] for p in range(parts)]

    def near(piece, book):
        d = [sum((a - b) ** 2 for a, b in zip(piece, e)) for e in book]
        return min(range(len(d)), key=lambda k: (d[k], k)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            sums = [[0] * w for _ in books[p]]
            counts = [0] * len(books[p])
            for r in kept:
                k, _ = near(r[2][p * w:(p + 1) * w], books[p])
                counts[k] += 1
                sums[k] = [a + b for a, b in zip(sums[k], r[2][p * w:(p + 1) * w])]
            books[p] = [[s // counts[k] for s in sums[k]] if counts[k] else books[p][k] for k in range(len(books[p]))]
    out, per_label = [], {}
    for i, lab, v in kept:
        found = [near(v[p * w:(p + 1) * w], books[p]) for p in range(parts)]
        err = sum(d for _, d in found)
        per_label[lab] = per_label.get(lab, 0) + err
        out.append((i, lab, "".join(f"{k:02x}" for k, _ in found), err))
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return sorted(((i, c, e, per_label[lab], digest) for i, lab, c, e in out), key=repr)


def test_exact_products_beyond_float_precision():
    rng = np.random.default_rng(5)
    a = rng.integers(-2**27, 2**27, (30, 16))
    b = rng.integers(-2**27, 2**27, (20, 16))
    want = (a.astype(object) @ b.T.astype(object)).astype(np.int64)
    assert (codebooks.exact_products(a, b) == want).all()
    assert not (np.rint(a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) == want).all()


def test_codes_equal_brute_force_on_whole_table(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label")
    got = sorted(map(tuple, codebooks.encode(vectors, entries=16, rounds=2).drop("label").collect()), key=repr)
    assert got == _codes_by_hand([tuple(r) for r in vectors.collect()], entries=16, rounds=2)


def test_code_cases(spark):
    nan = float("nan")
    rows = [(5, [0.5, -0.25, 1.0, 0.0], 1), (5, [0.5, -0.25, 1.0, 0.0], 1), (None, [0.1, 0.2, 0.3, 0.4], None),
            (1, None, 1), (2, [1.0, nan, 0.0, 0.0], 2), (3, [0.1, None, 0.0, 0.0], 2), (4, [0.9, 0.9, -0.9, 0.9], None),
            (6, [1.0, 2.0], 1), (7, [3e5, 0.0, 0.0, 0.0], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, codebooks.encode(vectors, entries=2, rounds=3).drop("label").collect()), key=repr)
    assert got == _codes_by_hand(rows, entries=2, rounds=3)
    assert codebooks.encode(vectors.limit(0)).collect() == []


def _links_by_hand(rows, threshold=0.93):
    good = []
    for n, (i, v, lab) in enumerate(rows):
        if i is None or lab is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        x = np.array(v, np.float64)
        if np.linalg.norm(x) > 0:
            good.append((n, i, lab, x / np.linalg.norm(x)))
    links = {}
    parent = {}

    def root(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for k, (n, i, lab, x) in enumerate(good):
        for m, j, lab2, y in good[k + 1:]:
            if lab == lab2 and len(x) == len(y) and float(x @ y) >= threshold:
                links[n] = links.get(n, 0) + 1
                links[m] = links.get(m, 0) + 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    out = []
    for n, (i, v, lab) in enumerate(rows):
        c = root(i) if i in parent else i
        out.append((i, links.get(n, 0), c, c == i))
    return sorted(out, key=repr)


def test_near_vectors_find_planted_copies_and_a_dense_cluster(spark):
    rng = np.random.default_rng(11)
    centre = rng.standard_normal(16)
    rows = [(i, (centre + 0.05 * rng.standard_normal(16)).tolist(), 1) for i in range(300)]  # one dense cluster
    rows += [(1000 + i, rng.standard_normal(16).tolist(), i % 3) for i in range(600)]
    base = rng.standard_normal(16)
    rows += [(5000, base.tolist(), 2), (5001, (base + 0.01).tolist(), 2), (5002, (base + 0.01).tolist(), 0),
             (5003, base.tolist(), 2), (5003, base.tolist(), 2), (5004, None, 1), (5005, [0.0] * 16, 1),
             (None, base.tolist(), 2), (5006, base.tolist(), None), (5007, [float("inf")] + [0.0] * 15, 2)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, projections.near_vectors(vectors).collect()), key=repr)
    assert got == _links_by_hand(rows)
    assert projections.near_vectors(vectors.limit(0)).collect() == []


def test_extra_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "one two", 5, "x", 7), (2, None, 1, "y", 8)],
                                 "doc_id long, text string, score long, `rank` string, _p int")
    bench = spark.createDataFrame([("two", 1)], "text string, buckets int")
    assert sorted(r["doc_id"] for r in importance.resample(docs, bench).collect()) == [1, 2]
    vectors = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 1.0], 0, "a", 3), (2, [1.0, 0.0, 0.0, 1.0], 0, "b", 4)],
                                    "vec_id long, embedding array<double>, label int, x string, rep int")
    assert [r["n_links"] for r in projections.near_vectors(vectors).orderBy("vec_id").collect()] == [1, 1]
    assert codebooks.encode(vectors.withColumnRenamed("x", "code")).count() == 2


def test_near_vectors_lose_no_link_between_far_projections(spark):
    """Pairs just above the threshold in a crowd of few directions: partners stand far apart in a sorted projection."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(60):
        x, y = rng.standard_normal((2, 8))
        x /= np.linalg.norm(x)
        y -= x * (x @ y)
        y /= np.linalg.norm(y)
        rows += [(2 * k, x.tolist(), 1), (2 * k + 1, (0.931 * x + math.sqrt(1 - 0.931 ** 2) * y).tolist(), 1)]
    rows += [(1000 + i, rng.standard_normal(8).tolist(), 1) for i in range(2500)]
    rows += [(7, rng.standard_normal(8).tolist(), 1)]  # an id that comes again with another vector
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, projections.near_vectors(vectors).collect()), key=repr)
    assert got == _links_by_hand(rows)


def test_near_vectors_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(projections, "ROW_BLOCK", 16)
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((5, 12))
    rows = [(i, (centres[i % 5] + 0.12 * rng.standard_normal(12)).tolist(), i % 2) for i in range(300)]
    rows += [(i, v, lab) for i, v, lab in rows[:20]] + [(900, [1.0, 2.0], 1), (901, [1.0, 2.1], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, projections.near_vectors(vectors).collect()), key=repr)
    assert got == _links_by_hand(rows)

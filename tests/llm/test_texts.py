"""Encoding, plane files, surrogates, toxicity and language model against plain versions of themselves."""

import hashlib
import math
import random
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from qalink.llm import kneser_ney as kn
from qalink.llm import merge_automaton, planes, surrogates, toxic_spans
from qalink.llm.queries import tokenizer_path
from qalink.sources.scratch import shared_folder

TEXTS = [
    "", "The cat's hat; it'll rain, we've 1234 reasons!", "aaaaaaa aaaa hahahahaha", "<|startoftext|>hello<|endoftext|> <|x|>",
    "ΣΑΣ ὈΔΥΣΣΕΎΣ İstanbul é ñ Straße", "日本語 👍🏽 x\x1cy\x85z w", "ab Ᲊx ₞.a", "zq" * 500, "\x00\x01 ​",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    made = ["".join(rng.choice("abcdetnoi' .!") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    return [*TEXTS, *made, *[t or "" for t in docs]]


def test_automaton_encodes_and_decodes_like_the_library(texts, library):
    vocabulary = merge_automaton.read_vocabulary(tokenizer_path())
    encoder = merge_automaton.Encoder(vocabulary, merge_automaton.Automaton(vocabulary), merge_automaton.split_patterns(vocabulary))
    for text in texts:
        if "Ᲊ" in text:  # younger than Python's Unicode tables
            continue
        parts, want = encoder.parts(text), library.encode(text, add_special_tokens=False).ids
        assert [int(i) for p in parts for i in p[1].split()] == want
        assert " ".join(p[2] for p in parts) == library.decode(want, skip_special_tokens=False)


def test_encoding_digests(spark, texts, library):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in merge_automaton.encoding_digests(docs, tokenizer_path()).collect()}
    for i, text in [*enumerate(texts), (-1, "")]:
        if "Ᲊ" in text:
            continue
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_plane_files_give_back_all_ids(spark, texts, library, kind):
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(5, "again", "x"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tie string")
    folder = shared_folder(spark)
    planes.write_ids(docs, folder, tokenizer_path(), planes=kind, block_ids=100, segment_ids=300)
    got = planes.read_documents(spark, folder).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted([*range(len(texts)), 5]) + [None]
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids"][-1] == 1
        if r["doc_id"] not in (5, None):
            assert r["ids"][:-1] == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        at += r["n_tokens"]
    sums = {(r["start"], r["ids_crc32"]) for r in planes.read_checksums(spark, folder).collect()}
    assert sums == {(r["start"], zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in got}
    index = planes.read_index(spark, folder)
    assert index.agg(F.sum("n_ids")).first()[0] == at and index.agg(F.max("n_ids")).first()[0] <= 100


def test_plane_files_of_an_empty_table(spark):
    folder = shared_folder(spark)
    planes.write_ids(spark.createDataFrame([], "doc_id long, text string"), folder, tokenizer_path())
    assert planes.read_documents(spark, folder).collect() == []


def test_surrogates_keep_form_identity_and_distinctness(spark):
    texts = [
        "Mr. John Smith and Mrs. Smith; Frau Anna Weber. Господин Иван Петров!",
        "mail A.B@Mail.Example.COM or a.b@mail.example.com, not a@b",
        "+1 (017) 555-7713 and +1 017 555 7713", "card 4556-7375-8689-9855 4556737586899855 10.0.0.1 999.1.1.1",
        'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" TOKEN = "24BE64439E3E49CF46B2D7C90F3602A3D0B907FF"', None, "", "nothing here",
    ]
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(texts)], "doc_id long, text string, key string, replaced int")
    got = {r["doc_id"]: r for r in surrogates.without_personal_data(docs, "secret").collect()}
    assert [got[i]["replaced"] for i in range(8)] == [4, 2, 2, 3, 2, 0, 0, 0]
    assert [got[i]["text"] for i in (5, 6, 7)] == texts[5:]
    names = got[0]["text"].replace(";", "").replace(".", "").replace("!", "").split()
    assert names[0] == "Mr" and names[2] == names[5] != "Smith"  # one family name, one surrogate
    assert names[1] in surrogates.NAMES["male", "latin"] and names[7] in surrogates.NAMES["female", "latin"]
    assert names[-2] in surrogates.NAMES["male", "cyrillic"]
    upper, lower = got[1]["text"].split()[1], got[1]["text"].split()[3].rstrip(",")
    assert upper.lower() == lower != "a.b@mail.example.com" and upper.endswith(".Example.COM")
    one, two = got[2]["text"].split(" and ")
    assert one.startswith("+1 (") and [c for c in one if c.isdigit()] == [c for c in two if c.isdigit()]
    grouped, plain, address, rest = got[3]["text"].split()[1:]
    assert grouped.replace("-", "") == plain != "4556737586899855" and grouped[4] == "-" and rest == "999.1.1.1"
    digits = [int(c) for c in plain[::-1]]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    a, b = got[4]["text"].split('"')[1::2]
    assert a.upper() == b and len(a) == 40 and a != "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    other = {r["doc_id"]: r["text"] for r in surrogates.without_personal_data(docs, "other").collect()}
    assert other[3] != got[3]["text"] and other[7] == texts[7]


def test_surrogates_stay_distinct_where_names_are_few(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = [a.upper() + b + c for a in "bcdfg" for b in letters for c in letters[:4]]
    entities = spark.createDataFrame([("family", n.lower()) for n in names], "kind string, canonical string")
    made = surrogates.assigned(entities, "k").collect()
    assert len({r["made"] for r in made}) == len(made) == len(names)
    assert not {r["made"] for r in made} & {r["canonical"] for r in made}


def test_toxic_words_are_found_in_held_out_documents(spark):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        text = [rng.choice(words) + rng.choice(["", "", ".", ","]) for _ in range(rng.randint(5, 60))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(2):
                text.insert(rng.randrange(len(text)), rng.choice(["Grumbly", "snarkish,", "MEANIE!"]))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame([*rows, (5000, None), (5001, "")], "doc_id long, text string")
    got = toxic_spans.score(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] < 900]
    assert {r["held_out"] for r in got} == {zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in got}
    assert len(held) > 100 and all(r["predicted"] == (r["doc_id"] % 6 == 0) for r in held)
    for r in held:
        for span in r["spans"]:
            assert any(w in rows[r["doc_id"]][1][span["start"] : span["end"]].lower() for w in ("grumbly", "snarkish", "meanie"))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in got if r["doc_id"] >= 5000)


def test_forward_backward_equals_the_sum_over_all_paths():
    rng = np.random.default_rng(1)
    start = np.array([True, False, False, True, False])
    e, step = rng.normal(size=5), rng.normal(size=(2, 2))
    forward, backward = toxic_spans.messages(e, start, step)
    got = 1 / (1 + np.exp(-(forward + backward)))
    for first, length in ((0, 3), (3, 2)):
        mass = np.zeros(length)
        total = 0.0
        for path in range(2**length):
            states = [(path >> i) & 1 for i in range(length)]
            weight = math.exp(sum(e[first + i] * s for i, s in enumerate(states)) + sum(step[a, b] for a, b in zip(states, states[1:])))
            total += weight
            mass += weight * np.array(states)
        assert got[first : first + length] == pytest.approx(mass / total)


def brute_perplexity(train, text, order=kn.ORDER):
    """Interpolated modified Kneser-Ney over dictionaries."""

    def windows(t):
        units = [kn.START] * (order - 1) + [ord(c) + 2 for c in t] + [kn.END]
        return [tuple(units[i : i + order]) for i in range(len(units) - order + 1)]

    levels = [None] * (order + 1)
    levels[order] = Counter(w for t in train for w in windows(t))
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    cut = [None] + [kn.discounts(Counter(levels[k].values())) for k in range(1, order + 1)]

    def p(g):
        k = len(g)
        if not k:
            return 1 / kn.UNITS
        same = {h: a for h, a in levels[k].items() if h[:-1] == g[:-1]}
        if not same:
            return p(g[1:])
        back = lambda a: cut[k][min(a, 3) - 1] if a else 0.0
        total, a = sum(same.values()), levels[k].get(g, 0)
        return (a - back(a)) / total + sum(map(back, same.values())) / total * p(g[1:])

    return math.exp(-sum(math.log(p(w)) for w in windows(text)) / (len(text) + 1))


def test_perplexity_equals_brute_force_both_ways(spark):
    rng = random.Random(2)
    train = ["".join(rng.choice("abcab ") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    asked = ["abcab", "zzz", "", "ab ab ab", "cab\U0001f44d"[:3], "a" * 200]
    model = kn.Model(spark.createDataFrame([(t,) for t in train], "text string"))
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(asked)], "key string, text string")
    near = {r["key"]: r["perplexity"] for r in kn.perplexities(docs, model).collect()}
    far = {r["key"]: r["perplexity"] for r in kn.perplexities(docs, model, broadcast_grams=0).collect()}
    for i, text in enumerate(asked):
        assert near[str(i)] == pytest.approx(brute_perplexity(train, text), rel=1e-9)
        assert far[str(i)] == pytest.approx(near[str(i)], rel=1e-12)


def test_quality_keeps_text_like_the_trusted_and_drops_junk(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["the", "house", "of", "green", "water", "runs", "small"])
    good = [(i, " ".join(word() for _ in range(rng.randint(5, 50))), "en") for i in range(200)]
    bad = [(1000 + i, "".join(rng.choice("%$&#QXZ!") for _ in range(80)), "en") for i in range(20)]
    docs = spark.createDataFrame([*good, *bad], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 200, 2)], "doc_id long, quality int")
    kept = [r["doc_id"] for r in kn.kept_documents(docs, labels).collect()]
    assert not [i for i in kept if i >= 1000] and len(kept) >= 195
    assert kn.kept_documents(docs, labels.limit(0)).count() == 220  # nothing trusted, nothing dropped


def test_surrogates_of_further_forms(spark):
    said = {
        "Mr. Smith-Jones": "Jones", "Mr John Fitzgerald Kennedy": "Kennedy", "Mrs McDonald": "McDonald", "Mr. O'Neil": "Neil",
        "Dr. Jane Roe": "Roe", "(743) 555-3824": "555-3824", "743-555-3824": "555", "0171 5557713": "5557713",
        "3782-822463-10005": "822463", "2001:db8::8a2e:370:7334": "8a2e", "DE89 3704 0044 0532 0130 00": "3704",
        "078-05-1120": "1120", "ab1" * 60: "ab1ab1", "aB3f" * 10: "aB3faB3f",
    }
    docs = spark.createDataFrame([(i, f"see {m}, so") for i, m in enumerate(said)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in surrogates.without_personal_data(docs, "k").collect()}
    for i, (mention, part) in enumerate(said.items()):
        assert got[i]["replaced"] == 1 and part not in got[i]["text"], mention
        assert got[i]["text"].startswith("see ") and got[i]["text"].endswith(", so"), mention
    iban = got[list(said).index("DE89 3704 0044 0532 0130 00")]["text"][4:-4].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def test_encoder_remembers_few_short_words(monkeypatch):
    monkeypatch.setattr(merge_automaton, "MEMO_WORDS", 10)
    asked = Counter()
    known = merge_automaton._Known(lambda word: (asked.update([word]), (1, word, word))[1])
    for i in range(300):
        assert known["the"] == (1, "the", "the") and known[f"w{i}"][1] == f"w{i}"
        assert len(known) + len(known.before) <= 20
    assert asked["the"] == 1  # a word in use is not forgotten with the others
    assert known["x" * 1000][2] == "x" * 1000 and "x" * 1000 not in known


def test_encoder_tables_hold_no_object_per_node():
    vocabulary = merge_automaton.read_vocabulary(tokenizer_path())
    automaton = merge_automaton.Automaton(vocabulary)
    assert not any(isinstance(x, dict) for held in vars(automaton).values() if isinstance(held, (list, dict)) for x in (held.values() if isinstance(held, dict) else held))


def test_packed_ids_are_the_library_s_and_take_less_to_remember(texts, library):
    vocabulary = merge_automaton.read_vocabulary(tokenizer_path())
    encoder = merge_automaton.Encoder(vocabulary, merge_automaton.Automaton(vocabulary), merge_automaton.split_patterns(vocabulary))
    for text in texts:
        if "Ᲊ" in text:
            continue
        want = library.encode(text, add_special_tokens=False).ids
        ids = encoder.ids(text)
        assert ids.tolist() == want
        assert encoder.decode(ids.tolist()) == library.decode(want, skip_special_tokens=False)
        encoder.parts(text)
    held = sum(map(sys.getsizeof, encoder.packed.values()))
    assert encoder.packed.keys() == encoder.known.keys()
    assert held < sum(sys.getsizeof(v) + sum(map(sys.getsizeof, v[1:])) for v in encoder.known.values()) / 2


def test_plane_encoder_cuts_the_pieces_of_a_batch_at_once(texts, library):
    encoder = planes.LibraryEncoder(tokenizer_path(), planes.LibraryEncoder.prepare(tokenizer_path()))
    cut, odd = [], []
    tokens, encoder_odd = encoder.tokens, encoder._odd
    encoder.tokens = lambda text: (cut.append(text), tokens(text))[1]
    encoder._odd = lambda text: (odd.append(text), encoder_odd(text))[1]
    for some in (["a b  c", " x y ", "", "b it's", "a\tb c"], texts, ["a\x1fb c", "c d\x1d"], texts[::-1], []):
        got = encoder.encode(pa.array(some, pa.string()))
        assert [np.frombuffer(ids, "<u4").tolist() for ids in got] == [
            library.encode(text, add_special_tokens=False).ids for text in some
        ]
    assert len(cut) <= 5 and odd[0] == cut[0] and sorted(odd[0].split()) == ["a", "b", "c", "it's", "x", "y"]


def test_a_worker_keeps_the_encoder_s_tables_as_bytes(spark, library):
    tokenizer = merge_automaton.compile_tokenizer(spark, tokenizer_path())
    first, second = tokenizer(), tokenizer()
    assert first.automaton is not second.automaton and first.labels == second.labels
    assert first.ids("It's a test").tolist() == library.encode("It's a test", add_special_tokens=False).ids

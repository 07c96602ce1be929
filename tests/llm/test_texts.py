import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reedbed.llm import bpe, packing, subjects

DOC = "doc_id long, text string, ids string, size long, subject string"
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def own():
    return bpe.encoder(bpe.vocabulary_path())


@pytest.fixture(scope="module")
def other():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(bpe.vocabulary_path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return lambda text: found.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text("aeinst ", max_size=120) | st.text("的は。、ж. \n\t'sré", max_size=60))
def test_any_text_is_encoded_as_by_the_library_and_comes_back(text):
    own = bpe.encoder(bpe.vocabulary_path())
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(bpe.vocabulary_path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    assert own.encode(text) == found.encode(text, add_special_tokens=False).ids
    assert own.decode(own.encode(text)) == text


def test_special_and_long_texts(own, other):
    for text in ("<|endoftext|> <|endoftext|>", " " * 3000, "a" * 3000, "\x1c\x85\xa0　x", "word " * 20000, "été 2031's"):
        assert own.encode(text) == other(text)
    assert own.encode(None) == own.encode("") == []


def test_starting_over_changes_nothing(other, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 50)
    small = bpe.Encoder(bpe.vocabulary_path())
    text = "The quick brown foxes jump over 1,234 lazy dogs; naïve Straße, 東京."
    assert small.encode(text * 5) == other(text * 5)


def test_streaming_decoder_is_the_usual_one():
    rng = random.Random(4)
    for _ in range(2000):
        raw = bytes(rng.choice([rng.randrange(256), rng.randrange(0x80, 0xC0), 0xE3, 0x81, 0xF0, 0x9F, 0xED, 65]) for _ in range(rng.randrange(12)))
        decoder = bpe.StreamingDecoder(lambda b: bytes((b,)))
        assert "".join([*map(decoder.feed, raw), decoder.end()]) == raw.decode("utf-8", "replace")


def test_encoded_rows(spark):
    df = spark.createDataFrame([(1, "Hello world", "", 0, ""), (2, None, "", 0, ""), (3, "", "", 0, ""), (3, "", "", 0, ""), (None, "x", "", 0, "")], DOC)
    got = [(r.doc_id, r.ids) for r in bpe.encoded(df, bpe.vocabulary_path()).collect()]
    assert got == [(1, [15496, 995]), (2, []), (3, []), (3, []), (None, [87])]
    assert bpe.encoded(df.limit(0), bpe.vocabulary_path()).collect() == []
    assert {(r.n_tokens, r.same) for r in bpe.round_trips(df, bpe.vocabulary_path()).collect()} == {(2, True), (0, True), (1, True)}


def check_packed(items, got, capacity):
    rooms = {}
    for doc, _, size, container, start in got:
        assert 0 <= start <= start + size <= capacity and container >= 1
        rooms.setdefault(container, []).append((start, size))
    for parts in rooms.values():
        at = 0
        for start, size in sorted(x for x in parts if x[1]):
            assert start == at
            at += size
    by_doc = {}
    for doc, part, size, _, _ in got:
        by_doc.setdefault(doc, []).append((part, size))
    assert {d: sum(s for _, s in v) for d, v in by_doc.items()} == dict(items)
    for doc, size in items:
        assert len(by_doc[doc]) == max(1, -(-size // capacity))
        assert sorted(p for p, _ in by_doc[doc]) == list(range(len(by_doc[doc])))
    return len(rooms)


def test_containers(spark):
    rng = random.Random(9)
    items = [(n, rng.choice([0, 7, 7, 7, 100, rng.randrange(1, 90), 101, 250])) for n in range(900)]
    df = spark.createDataFrame(items, "doc_id long, size long")
    got = [tuple(r) for r in packing.packed(df, 100).collect()]
    used = check_packed(items, got, 100)
    assert used <= -(-sum(s for _, s in items) // 100) * 1.02 + 1
    assert packing.packed(df.limit(0), 100).collect() == []
    assert [tuple(r) for r in packing.packed(spark.createDataFrame([(1, 0), (2, 0)], df.schema), 100).orderBy("doc_id").collect()] == [(1, 0, 0, 1, 0), (2, 0, 0, 1, 0)]
    assert len({r.container_id for r in packing.packed(spark.createDataFrame([(5, 250)], df.schema), 100).collect()}) == 3


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(0, 300), min_size=c + 1, max_size=c + 1))))
def test_plans_hold_every_item(case):
    capacity, histogram = case
    used = np.zeros(capacity + 1, int)
    for number, pattern in packing.plan(np.array(histogram), capacity):
        assert number > 0 and sum(a * n for a, n in pattern) <= capacity
        for a, n in pattern:
            used[a] += number * n
    assert used[1:].tolist() == histogram[1:]


def found(text):
    own = subjects.matcher()
    n, sentences = own.evidence(text)
    return set(own.found(n, own.scores(sentences), {}))


@pytest.mark.parametrize(
    "text, want",
    [
        ("Courts connect lawsuits.", {"law"}),
        ("Courts support stadiums. Medals show rackets.", {"sport"}),
        ("Windows support habits through crystals.", set()),
        ("Through tractors, seeds limit fertilizers.", {"farming"}),
        ("Les cellules solaires remplacent les vieilles cartes.", {"science"}),
        ("Les cellules remplacent les vaccins.", {"medicine"}),
        ("die vertrage verandern die fenster.", {"law"}),
        ("ПЕНАЛЬТИ И ОТЧЁТЫ ЗАЩИЩАЮТ СБОРЫ.", {"sport"}),
        ("チーズを通じて、古地図は細胞を支える。", {"medicine"}),
        ("Los cÃ©sped... Las cÃ©lulas limitan los antibiÃ³ticos.", {"medicine"}),
        ("Re­cipe­s suppot vegatables.", {"food"}),
        ("<p>Bonds\nchange\nloans.</p>", {"finance"}),
        ("Soups test plans. Rooms test plans. Rooms test plans. Rooms test plans.", set()),
        ("Soups test plans. Rooms test plans. Rooms test plans.", {"food"}),
        ("The judge describes a hypothesis.", {"law", "science"}),
        ("Electrons via hospitals by means of banks.", {"science"}),
        ("Ärzte prüfen mittels Mikroskope Patienten.", {"medicine"}),
        ("", set()),
        (None, set()),
        (" … — 9. \t", set()),
    ],
)
def test_subjects(text, want):
    assert found(text) == want


def test_a_third_counts_whole_texts():
    text = "Servers test caches. " * 3 + "Rooms show plans. " * 7
    assert subjects.matcher().evidence(text)[0] == 10 and found(text) == {"software"}
    assert found(text + "Rooms show plans.") == set()
    assert found("Rooms show plans. " * 7000 + "Servers test caches. " * 3000) == {"software"}


def test_subject_rows(spark, rows):
    df = spark.createDataFrame([(1, "Courts connect lawsuits.", "", 0, "x"), (1, "Courts connect lawsuits.", "", 0, "x"), (2, None, "", 0, ""), (3, "", "", 0, "")], DOC)
    assert rows(subjects.subjects(df)) == [(1, "law"), (1, "law")]
    assert rows(subjects.subjects(df.limit(0))) == []


def test_thresholds_are_calibrated():
    """Documents with strong sentences only have the subject by their labels; of equal thresholds the smallest is taken."""
    strong, weak = [{"law": 0.9}] * 3, [{"law": 0.2}] * 3
    docs = [(5, strong, {"law"})] * 10 + [(5, weak, set())] * 10 + [(5, [{"food": 0.4}] * 4, {"food"}), (5, [{"food": 0.8}] * 4, {"food"})]
    assert subjects.calibrated(docs) == {"law": 0.9, "food": 0.0}
    assert subjects.calibrated([]) == {}


def test_every_score_is_tried():
    docs = [(1, [{"law": k / 64}], {"law"} if k >= 35 else set()) for k in range(64)]
    assert subjects.calibrated(docs) == {"law": 35 / 64}


def test_thresholds_come_from_all_labels(spark):
    """However many labels there are, of whatever documents: the first by its hash has 20,000 others."""
    strong, weak = "Courts connect lawsuits. " * 2, "Courts show rooms. " * 2
    docs = spark.createDataFrame([(k, strong if k % 2 else weak, "", 0, "") for k in range(40)], DOC)
    first = docs.selectExpr("min_by(doc_id, xxhash64(doc_id)) AS x").first().x
    many = spark.range(20_000).selectExpr(f"CAST({first} AS BIGINT) AS doc_id", "'a' || id AS subject")
    labels = many.union(spark.createDataFrame([(k, "law") for k in range(1, 40, 2)], "doc_id long, subject string"))
    got = [r.doc_id for r in subjects.subjects(docs, labels).collect()]
    assert sorted(got) == list(range(1, 40, 2))


def test_thresholds_of_a_table_are_those_of_a_list(spark):
    rng, own = random.Random(5), subjects.matcher()
    by = [[own.numbers[x] for x in own.names if s in own.subjects[x]] for s in ("law", "food", "sport")]
    rows = []
    for _ in range(400):
        terms = [[rng.choice(rng.choice(by)) for _ in range(rng.randrange(1, 4))] for _ in range(rng.randrange(5))]
        rows.append((len(terms) + rng.randrange(3), terms, rng.sample(["law", "food", "none"], rng.randrange(1, 4))))
    rarity = [rng.random() for _ in own.names]
    df = spark.createDataFrame(rows, "sentences int, terms array<array<int>>, labels array<string>")
    want = subjects.calibrated([(n, own.scores(terms, rarity), set(x)) for n, terms, x in rows])
    assert subjects._calibrated(df, subjects.TERMS, rarity, subjects.SHARE) == want and set(want) == {"law", "food"}


def test_rarity_falls_with_document_frequency():
    rare = subjects._rarity({0: 1, 1: 50, 2: 1000}, 1000, 4)
    assert 1 == rare[3] > rare[0] > rare[1] > rare[2] > 0


def test_held_out_labels():
    """Thresholds fitted on every other labelled document, measured on the rest, a few of whose labels are wrong."""
    import os

    import pyarrow.parquet as pq

    folder = "/root/testdata/sf0.01"
    if not os.path.exists(folder):
        pytest.skip("no test data")
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    labels = {}
    for r in pq.read_table(f"{folder}/subject_label.parquet").to_pylist():
        if r["subject"]:
            labels.setdefault(r["doc_id"], set()).add(r["subject"])
    own = subjects.matcher()
    rows = [(*own.evidence(texts[d]), x) for d, x in sorted(labels.items())]
    rows = [(n, own.scores(s), x) for n, s, x in rows]
    thresholds = subjects.calibrated(rows[::2])
    got = [(set(own.found(n, s, thresholds)), x) for n, s, x in rows[1::2]]
    both = sum(len(a & b) for a, b in got)
    assert both / sum(len(b) for _, b in got) > 0.93 and both / sum(len(a) for a, _ in got) > 0.93

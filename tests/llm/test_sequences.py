import random

import numpy as np
import pyarrow as pa
import pytest

from reedbed.llm import format_duplicates, match_groups, near_duplicates, similarity_clusters

SEQ = "row_no long, id int, bytes binary, record string, letters string, block int"
EDGE = "row_no long, seqi int, seqj int, dist int, id string, vector string"


def grams(raw):
    text = near_duplicates.letters_of(raw)
    return {text[k : k + 8] for k in range(len(text) - 7)}


def brute(items):
    sets = [(i, grams(b)) for i, b in items if b is not None and i is not None]
    sets = [(i, s) for i, s in sets if s]
    return sorted({(min(i, j), max(i, j)) for n, (i, s) in enumerate(sets) for j, t in sets[n + 1 :] if i != j and 10 * len(s & t) >= 6 * len(s | t)})


def family(rng, n, length, edits):
    base = [rng.choice("ACGT") for _ in range(length)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            k = rng.randrange(len(copy))
            copy[k : k + 1] = rng.choice([[], [rng.choice("ACGT")], [copy[k], rng.choice("ACGTN")]])
        out.append("".join(copy).encode())
    return out


def test_near_duplicates_match_brute_force(spark, rows):
    rng = random.Random(7)
    texts = [b for _ in range(25) for b in family(rng, rng.randint(1, 8), rng.randint(60, 300), 12)]
    # One family holds a third of all rows; some of it are copies in another writing.
    big = family(rng, 50, 200, 9)
    texts += big + [b[:60].lower() + b"-.\n" + b[60:] for b in big[:15]]
    texts += [None, b"", b"-...", b"ACGTACG", b"ACGTACGT", b"acgt-acgt", "Ä1234567".encode(), b"A" * 5000, b"A" * 9, rng.randbytes(400)]
    items = list(enumerate(texts, 1))
    data = [(n, i, b, "x", None, 1) for n, (i, b) in enumerate([*items, *items[:40], (None, b"ACGTACGTACGT")])]
    df = spark.createDataFrame(data, SEQ)
    assert rows(near_duplicates.similar_pairs(df)) == sorted(brute(items), key=repr)
    # Blocks that are cut into a grid give the same.
    assert rows(near_duplicates.similar_pairs(df, tree=10)) == sorted(brute(items), key=repr)


def test_near_duplicates_of_little(spark, rows):
    assert rows(near_duplicates.similar_pairs(spark.createDataFrame([], SEQ))) == []
    assert rows(near_duplicates.similar_pairs(spark.createDataFrame([(1, 5, b"ACGTTGCA", "", "", 1), (2, 4, b"acgt tgca", "", "", 1)], SEQ))) == [(4, 5)]


def test_trees_match_direct_comparison():
    rng = random.Random(1)
    texts = [near_duplicates.letters_of(b) for _ in range(12) for b in family(rng, 20, 150, 10)]
    texts += [b"ACGTACGTNN", b"ACGTACGTNNN", b"A" * 3000, b"A" * 2000 + b"C", bytes(rng.choices(b"ACGT", k=20_000))]
    items = near_duplicates.packed(texts)
    i, j = near_duplicates.block_pairs(np.zeros(len(items), int), items, leaf=3)
    direct = {(min(a, b), max(a, b)) for a, b in brute(list(enumerate(texts)))}
    assert {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())} == direct
    # In blocks: the pairs of each block, whatever its size.
    block = np.sort(np.array([rng.randrange(40) for _ in texts]))
    block = np.unique(block, return_inverse=True)[1]
    i, j = near_duplicates.block_pairs(block, items)
    assert {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())} == {(a, b) for a, b in direct if block[a] == block[b]}


def test_traversal_prunes_pairs_of_nodes():
    """Families that are together by chance: nearly all pairs of leaves and of records go without an exact comparison."""
    rng = random.Random(3)
    texts = [near_duplicates.letters_of(b) for _ in range(60) for b in family(rng, 8, 200, 6)]
    tally = []
    i, _ = near_duplicates.block_pairs(np.zeros(len(texts), int), near_duplicates.packed(texts), tally=tally)
    assert len(i) > 1000
    (leaves, followed), (_, records) = tally[-3], tally[-1]
    assert followed < leaves / 5 and records < len(texts) ** 2 / 2 / 20 and records >= len(i)


def test_near_duplicates_by_record(spark, rows):
    rng = random.Random(4)
    texts = family(rng, 6, 200, 4)
    data = [(n, i, b, "", "", 1) for n, (i, b) in enumerate([*enumerate(texts, 1), *((k, texts[0]) for k in range(50, 90)), (1, texts[0])])]
    pairs, copies = near_duplicates.similar_records(spark.createDataFrame(data, SEQ).repartition(4))
    distinct = list(enumerate(dict.fromkeys(texts)))
    assert len(set(rows(pairs.select("a", "b")))) == len(brute(distinct)) > 3
    of = {i: b for _, i, b, *_ in data}
    several = {i for i, b in of.items() if list(of.values()).count(b) > 1}
    assert {r.id for r in copies.collect()} == several and len(several) >= 41


def test_packing_of_letters():
    texts = [b"ACGTACGTA", b"ACGTNACGTXYZ", b"ACGTACGT", b"Z" * 9, b"ACGTACGTACG"]
    buffer, starts, lens = near_duplicates.unpacked(near_duplicates.packed(texts))
    assert [buffer[s : s + n].tobytes() for s, n in zip(starts, lens)] == texts


RAW = "rec_no long, id string, attrs string, bytes binary, key string, keep_rec long"


def test_tokens_are_worked_on_a_piece_at_a_time(monkeypatch):
    """Whatever comes in a batch, so that they stay in a core's cache."""
    rng, sizes = random.Random(8), []
    texts = [bytes(rng.choices(b"ACGT", k=40)) for _ in range(1500)]
    long_runs = near_duplicates.long_runs
    monkeypatch.setattr(near_duplicates, "long_runs", lambda buffer, starts, lens: sizes.append(len(lens)) or long_runs(buffer, starts, lens))
    monkeypatch.setattr(near_duplicates.TaskContext, "get", lambda: type("", (), {"partitionId": lambda self: 0})())
    letters = pa.array(near_duplicates.packed(texts), pa.binary())
    ids, keys = pa.array(range(len(texts)), pa.int32()), pa.array([b"%04d" % k for k in range(len(texts))], pa.binary())
    got = list(near_duplicates._records([pa.record_batch([ids, keys, letters], names=["id", "key", "letters"])]))
    counts = np.concatenate([np.frombuffer(x, np.uint32)[:-1] for x in got[-1].column(2).to_pylist()])
    assert counts.sum() == 1500 * 25 and sum(sizes) == 1500
    list(near_duplicates._anchors(np.empty(0, np.int64), 3)([pa.record_batch([ids.cast(pa.int64()), letters], names=["record", "letters"])]))
    assert sum(sizes) == 3000 and max(sizes) <= near_duplicates.PIECE


def test_kernels_match_plain_python():
    rng = random.Random(3)
    texts = [bytes(rng.choices(b"ACGT" if k % 3 else b"ACGTNRY", k=rng.randrange(8, 90))) for k in range(200)] + [b"ACACACACACACACACACAC", b"N" * 30]
    buffer, starts, lens = near_duplicates.unpacked(near_duplicates.packed(texts))
    assert [buffer[s : s + n].tobytes() for s, n in zip(starts, lens)] == texts

    def runs(text):
        return [sum((c & 31) << 5 * (7 - k) for k, c in enumerate(text[at : at + 8])) for at in range(len(text) - 7)]

    token, counts = near_duplicates.tokens(buffer, starts, lens)
    assert token.tolist() == [x for t in texts for x in runs(t)] and counts.tolist() == [len(t) - 7 for t in texts]
    few = [k for k, t in enumerate(texts) if len({x * 0x9E3779B97F4A7C15 % 2**64 >> 58 for x in runs(t)}) <= near_duplicates.FEW]
    assert near_duplicates._few(buffer, starts, lens).tolist() == few
    for words in (8, 16, 128):
        x, y = np.frombuffer(rng.randbytes(8 * words * 30), np.uint64).reshape(2, 15, words).copy()
        x[0] = y[0] = np.uint64(2**64 - 1)
        assert near_duplicates._common(x, y).tolist() == [sum((a & b).bit_count() for a, b in zip(u, v)) for u, v in zip(x.tolist(), y.tolist())]


def test_written_differently(spark, rows):
    data = [
        (1, "S12", "sample=a1;run=x-2", b"AC-GT"),
        (2, " s1,2\n", '{"run": "X2", "sample": "A_1"}', b"acgt"),
        (3, "S12", "run : x2 | sample : a1 | run=x2", b"AC\r\nGT"),
        (4, "S12", "sample=a1;run=x3", b"ACGT"),
        (5, None, None, None),
        (6, "", " ; ", b""),
        (7, "K", "", b"--"),  # a sign whose lower case is an ASCII letter
        (8, "12S", "sample=a1;run=x2", b"ACGT"),
        (9, "S12", "sample=a1 run=x2", b"ACGT" * 20000),
        (10, "s12", "RUN=x2,SAMPLE=a1", b"acgt" * 20000),
        (None, "S12", "sample=a1;run=x2", b"ACGT"),
        (1, "S12", "sample=a1;run=x-2", b"AC-GT"),
    ]
    df = spark.createDataFrame([(*r, "k", 0) for r in data], RAW)
    got = format_duplicates.same_records(df)
    assert rows(got.distinct()) == sorted([(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 5), (7, 5), (8, 8), (9, 9), (10, 9)], key=repr)
    assert rows(format_duplicates.same_records(df.limit(0))) == []


def test_a_run_over_many_partitions(spark):
    rng = random.Random(5)
    keys = ["hot"] * 3000 + [f"k{rng.randrange(500)}" for _ in range(3000)]
    rng.shuffle(keys)
    df = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "key string, rec_no long")
    first = {}
    for n, k in enumerate(keys):
        first.setdefault(k, n)
    got = {r.rec_no: r.keep_rec for r in format_duplicates.first_of_each(df, 16).collect()}
    assert got == {n: first[k] for n, k in enumerate(keys)}


def components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return sorted(((v, find(v)) for v in parent), key=repr)


@pytest.mark.parametrize("cell_edges", [20, 10**6])
def test_groups_match_union_find(spark, rows, cell_edges):
    rng = random.Random(2)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(1000, k) for k in range(1001, 1200)] + [(k, k + 1) for k in range(2000, 2100)] + [(-5, -6)]
    data = [*pairs, *pairs[:50], *[(b, a) for a, b in pairs[:50]], (None, 3), (4, None), (7777, 7777)]
    df = spark.createDataFrame([(a, b, "x") for a, b in data], "i int, j int, v string")
    assert rows(match_groups.groups(df, "i", "j", cell_edges)) == components([p for p in pairs if p[0] != p[1]])
    assert rows(match_groups.groups(df.limit(0), "i", "j")) == []


def planted(rng):
    """Edges with clusters, bridges between them, a hub, and sets that just miss; and the true members."""
    edges, truth, at = {}, [], 1

    def link(a, b, d):
        edges[min(a, b), max(a, b)] = d

    for size in (5, 5, 6, 9, 14, 30):
        ids = list(range(at, at + size))
        at += size
        for n, a in enumerate(ids):
            for b in ids[n + 1 :]:
                link(a, b, rng.randint(0, 300))
        spare = {i: (size - 1) - -(-2 * (size - 1) // 3) for i in ids}
        for _ in range(size):
            a, b = rng.sample(ids, 2)
            if (min(a, b), max(a, b)) in edges and spare[a] and spare[b]:
                del edges[min(a, b), max(a, b)]
                spare[a] -= 1
                spare[b] -= 1
        truth.append(ids)
    for a, b in zip(truth, truth[1:]):
        link(a[0], b[-1], 250)
    for k in range(200, 500):
        link(3, k, 100)
    for k in range(600, 604):
        for m in range(k + 1, 604):
            link(k, m, 10)
    return edges, truth


def test_clusters_match_the_definition(spark, rows):
    rng = random.Random(11)
    edges, truth = planted(rng)
    data = [(n, *rng.sample((a, b), 2), d) for n, ((a, b), d) in enumerate(edges.items())]
    data += [(9000, a, b, d + 7) for _, a, b, d in data[:100]] + [(9001, b, a, d) for _, a, b, d in data[:100]]
    data += [(9002, 1, None, 5), (9003, None, None, None), (9004, 8, 8, 0), (9005, 1, 20, -1), (9006, 2, 21, 10001), (9007, 4, 22, 301)]
    want = []
    for ids in truth:
        near = {i: [edges[min(i, j), max(i, j)] for j in ids if (min(i, j), max(i, j)) in edges] for i in ids}
        best = min(ids, key=lambda i: (-len(near[i]), sum(near[i]), i))
        want += [(best, i) for i in ids]
    df = spark.createDataFrame([(*r, "x", "y") for r in data], EDGE)
    assert rows(similarity_clusters.clusters(df)) == sorted(want, key=repr)


def test_no_clusters(spark, rows):
    assert rows(similarity_clusters.clusters(spark.createDataFrame([], EDGE))) == []
    assert rows(similarity_clusters.clusters(spark.createDataFrame([(1, 1, 2, 5, "", "")], EDGE))) == []


def sets_by_definition(ids, near):
    """All largest sets of at least five ids, each close to two thirds of the others."""
    found = []
    masks = [sum(1 << k for k, j in enumerate(ids) if j in near[i]) for i in ids]
    for mask in sorted(range(1 << len(ids)), key=int.bit_count, reverse=True):
        n = mask.bit_count()
        if n < 5:
            break
        if all(3 * (masks[k] & mask).bit_count() >= 2 * (n - 1) for k in range(len(ids)) if mask >> k & 1) and not any(mask & other == mask for other in found):
            found.append(mask)
    return [[i for k, i in enumerate(ids) if mask >> k & 1] for mask in found]


def loose(seed, first):
    """Edges of a dozen ids from first on with clusters that just hold together, bridges and close pairs between them."""
    rng = random.Random(seed)
    ids = list(range(first, first + 12))
    rng.shuffle(ids)
    edges = {}
    for part in (ids[:5], ids[5:11]):
        pairs = [tuple(sorted((a, b))) for n, a in enumerate(part) for b in part[n + 1 :]]
        degree = dict.fromkeys(part, len(part) - 1)
        rng.shuffle(pairs)
        for a, b in pairs:
            if all(3 * (degree[x] - 1) >= 2 * (len(part) - 1) for x in (a, b)):
                degree[a] -= 1
                degree[b] -= 1
            else:
                edges[a, b] = rng.randint(0, 300)
    for _ in range(rng.randint(2, 12)):
        edges.setdefault(tuple(sorted(rng.sample(ids, 2))), rng.randint(0, 300))
    return ids, edges


def apart(vectors, links, *salt):
    """Seeds that find nothing: each id is its own centroid."""
    return vectors.selectExpr("id", "id AS seed")


@pytest.mark.parametrize("seeds", [None, apart])
def test_loose_clusters_match_brute_force(spark, rows, monkeypatch, seeds):
    if seeds:
        monkeypatch.setattr(similarity_clusters, "k_means", seeds)
    data, want = [], set()
    for seed in range(150):
        ids, edges = loose(seed, 1 + 20 * seed)
        near = {i: {a + b - i for a, b in edges if i in (a, b)} for i in ids}
        sets = sets_by_definition(sorted(ids), near)
        if len({i for s in sets for i in s}) == sum(map(len, sets)):
            data += [(0, a, b, d, "", "") for (a, b), d in edges.items()]
            want |= {frozenset(s) for s in sets}
    assert len(want) > 50
    got = {}
    for typical, member in rows(similarity_clusters.clusters(spark.createDataFrame(data, EDGE))):
        got.setdefault(typical, set()).add(member)
    assert {frozenset(s) for s in got.values()} == want


def test_clusters_grow_until_no_more_come_in(spark, rows, monkeypatch):
    monkeypatch.setattr(similarity_clusters, "k_means", lambda vectors, links, *salt: vectors.selectExpr("id", "IF(id <= 5, 1, id) AS seed"))
    # 6 is close to four of five; 7 to three of five, but to four of six.
    close = [(a, b) for a in range(1, 6) for b in range(a + 1, 6)] + [(k, 6) for k in (1, 2, 3, 4)] + [(k, 7) for k in (1, 2, 5, 6)]
    df = spark.createDataFrame([(0, a, b, 100, "", "") for a, b in close], EDGE)
    assert rows(similarity_clusters.clusters(df)) == [(1, k) for k in range(1, 8)]


def test_lone_pairs_with_a_conserved_stretch_share_a_block():
    """A third of the tokens is frequent, and the others' similarity is 0.4."""
    rng = random.Random(3)
    letters = lambda n: bytes(rng.choices(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", k=n))
    conserved = letters(100)
    run, _ = near_duplicates.long_runs(np.frombuffer(conserved, np.uint8), np.array([0]), np.array([100]))
    frequent = np.unique(run >> near_duplicates._BIN).astype(np.int64)
    texts = []
    for _ in range(3000):
        both = letters(105)
        texts += [conserved + both + letters(80), conserved + both + letters(80)]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(near_duplicates.packed(texts), pa.binary())], names=["record", "letters"])
    blocks = {}
    for found in near_duplicates._stars(near_duplicates._anchors(frequent, 1)([batch])):
        for lead, record, _ in zip(*(c.to_pylist() for c in found.columns)):
            blocks.setdefault(record, set()).add(lead)
            blocks.setdefault(lead, set()).add(lead)
    missed = [k for k in range(0, len(texts), 2) if not blocks.get(k, set()) & blocks.get(k + 1, set())]
    assert missed == []

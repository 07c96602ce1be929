import random
from fractions import Fraction

import pytest

from reedbed.operators import linkage, representatives
from reedbed.operators.components import components
from reedbed.operators.distances import compare_blocks, distance_profile, nearest_seeds, order_breaks, pair_distances, pairs_without_overlap, scaled_distances

EDGES = [(1, 2, 0), (1, 3, 1), (1, 4, 2), (1, 5, 3), (2, 3, 4), (2, 4, 5), (2, 5, 6)]


def sets(labels):
    out = {}
    for i, c in labels:
        out.setdefault(c, set()).add(i)
    return sorted(map(sorted, out.values()))


def frame(spark, edges):
    return spark.createDataFrame(edges, "i int, j int, dist int")


def snapshots(spark, method, cutoffs, psi=None):
    ids = spark.createDataFrame([(k,) for k in range(1, 6)], "id int")
    got = linkage.snapshots(linkage.linkage(frame(spark, EDGES), method, psi), ids, cutoffs).collect()
    return {c: sets([(r.id, r.cluster) for r in got if r.cutoff == c]) for c in cutoffs}


def test_worked_example(spark):
    assert snapshots(spark, "complete", [0, 4]) == {0: [[1, 2], [3], [4], [5]], 4: [[1, 2, 3], [4], [5]]}
    assert snapshots(spark, "single", [0, 2, 4]) == {0: [[1, 2], [3], [4], [5]], 2: [[1, 2, 3, 4], [5]], 4: [[1, 2, 3, 4, 5]]}
    merges = linkage.linkage(frame(spark, EDGES), "average", 6).orderBy("step").collect()
    assert [round(m.dist, 6) for m in merges] == [round(float(x), 6) for x in (0, Fraction(5, 2), Fraction(13, 3), Fraction(21, 4))]
    assert linkage.newick(linkage.linkage(frame(spark, EDGES[:2]), "single")).first().newick == "((1:0,2:0):1,3:1);"


def naive(edges, method, psi):
    clusters = {x: {x} for e in edges for x in e[:2]}
    d = {frozenset(e[:2]): e[2] for e in edges}
    out = []
    while True:
        best = None
        for a in clusters:
            for b in clusters:
                if a < b:
                    seen = [d[frozenset((x, y))] for x in clusters[a] for y in clusters[b] if frozenset((x, y)) in d]
                    n = len(clusters[a]) * len(clusters[b])
                    if not seen or (method == "complete" and len(seen) < n):
                        continue
                    dist = max(seen) if method == "complete" else Fraction(sum(seen) + psi * (n - len(seen)), n)
                    best = min(best or (dist, a, b), (dist, a, b))
        if not best:
            return out
        dist, a, b = best
        clusters[a] |= clusters.pop(b)
        out.append((a, b, float(dist), len(clusters[a])))


def random_graph(rng, method):
    n = rng.randint(3, 12)
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.6]
    distances = rng.sample(range(1, 5000), len(pairs))
    return sorted(((i, j, d) for (i, j), d in zip(pairs, distances)), key=lambda e: (e[2], e[:2]))


def test_average_matches_the_definition():
    rng = random.Random(3)
    for _ in range(60):
        edges = random_graph(rng, "average")
        if edges:
            assert linkage._average(edges, 6000) == naive(edges, "average", 6000)


def test_average_with_ties_and_any_psi_is_that_of_merges_one_by_one():
    rng = random.Random(4)
    for top, psi in [(2, 2), (3, 3), (3, 5), (50, 50), (50, 20), (4000, 4000)] * 20:
        n = rng.randint(2, 12)
        edges = sorted(((i, j, rng.randint(0, top)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5), key=lambda e: (e[2], e[:2]))
        assert linkage._average(edges, psi) == linkage._average_in_order(edges, psi)
        if psi >= top and n < 9:
            assert linkage._average(edges, psi) == naive(edges, "average", psi)


def test_a_hub_costs_average_linkage_no_more_than_its_links(monkeypatch):
    import heapq
    import types

    pushed = []
    counted = {"heappush": lambda h, x: (pushed.append(1), heapq.heappush(h, x)), "heapreplace": lambda h, x: (pushed.append(1), heapq.heapreplace(h, x))}
    monkeypatch.setattr(linkage, "heapq", types.SimpleNamespace(**{k: counted.get(k, getattr(heapq, k)) for k in heapq.__all__}))
    edges = [(0, k, k % 700) for k in range(1, 2001)] + [(k, k + 1, 800) for k in range(1, 2000, 2)]
    assert len(linkage._average(edges, 1000)) == 2000
    assert len(pushed) < 20 * len(edges)


def test_text_of_a_deep_tree_is_written_once(spark):
    import time

    n = 100_000
    merges = spark.range(1, n + 1).selectExpr("0L AS component", "cast(id AS int) AS step", "0L AS a", "id AS b", "cast(id AS double) AS dist", "cast(id + 1 AS int) AS members")
    began = time.time()
    text = linkage.newick(merges).first().newick
    assert time.time() - began < 15
    assert text.startswith("(" * n + "0:1,1:1):1,2:2)") and text.endswith(f",{n}:{n:g});") and text.count(",") == n


@pytest.mark.parametrize("band", [1, 10**6])
def test_complete_in_bands_matches_the_definition(spark, band, monkeypatch):
    rng = random.Random(3)
    edges, want = [], {}
    for k in range(12):
        one = [(i + 20 * k, j + 20 * k, d) for i, j, d in random_graph(rng, "complete")]
        edges += one
        want |= {(a, b): (d, n) for a, b, d, n in naive(one, "complete", 0)}
    # All graphs in one component, by edges too far apart to matter.
    edges += [(20 * k, 20 * k + 20, 9000 + k) for k in range(11)]
    monkeypatch.setattr(linkage, "_bands", lambda e, least, real=linkage._bands: real(e, least) if least > 1 else [700, 1800, 3000, 9999])
    got = linkage.linkage(frame(spark, edges), "complete", band=band).collect()
    assert {(m.a, m.b): (m.dist, m.members) for m in got if m.dist < 9000} == want
    assert sorted(m.step for m in got if m.component == 0) == list(range(1, 1 + sum(m.component == 0 for m in got)))


def test_single_merges_are_those_of_the_spanning_forest(spark, rows):
    rng = random.Random(5)
    pairs = {(min(a, b), max(a, b)) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(200)) if a != b}
    edges = [(a, b, rng.randint(0, 30)) for a, b in pairs] + [(100, 100 + k, k % 3) for k in range(1, 40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    want = []
    for i, j, d in sorted(edges, key=lambda e: (e[2], e[:2])):
        if find(i) != find(j):
            parent[find(i)] = find(j)
            want.append((i, j, d))
    assert rows(linkage.spanning_forest(frame(spark, edges).repartition(3))) == sorted(want, key=repr)
    assert rows(linkage.spanning_forest(frame(spark, []))) == []


def test_components(spark, rows):
    chain = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (50, None)]
    got = rows(components(spark.createDataFrame(chain, "i long, j long")))
    assert got == sorted([(k, 1) for k in range(1, 41)] + [(100, 100), (101, 100)], key=repr)
    assert rows(components(spark.createDataFrame([], "i long, j long"))) == []


def test_distances_of_the_worked_example(spark, rows):
    texts = ["ACTGACTG", "AGGGGGGG", "CCCCCCCC", "TTTTTTTT", "TTTTGGGG"]
    mm, ov = compare_blocks(texts, texts)
    assert scaled_distances(mm, ov)[0].tolist() == [0, 6250, 7500, 7500, 7500] and (ov == 8).all()
    mm, ov = compare_blocks(["AC-GT"], ["ACTG-"])
    assert mm[0, 0] == 0 and ov[0, 0] == 3
    seqs = spark.createDataFrame([*enumerate(texts), (9, None), (10, "")], "id int, bases string")
    assert rows(pair_distances(seqs, 5000, 8, block=2)) == [(1, 4, 5000), (3, 4, 5000)]
    assert rows(pair_distances(seqs, 10000)) == []
    assert rows(nearest_seeds(spark.createDataFrame([(1, "TTTTGGGG"), (2, "----"), (3, None)], "id int, bases string"), list(enumerate(texts)))) == [(1, 4, 0)]
    ties = nearest_seeds(spark.createDataFrame([(1, "AAAAAAAA")], "id int, bases string"), [(7, "AAAATTTT"), (8, "TTTTAAAA"), (9, "A-------")])
    assert rows(ties) == [(1, 7, 5000), (1, 8, 5000)]


def test_long_sequences_and_case(spark, rows):
    long = "ACGT" * 5000
    seqs = spark.createDataFrame([(1, long), (2, long.lower()), (3, "T" + long[1:])], "id int, bases string")
    assert rows(pair_distances(seqs, 100)) == [(1, 2, 0), (1, 3, 1), (2, 3, 1)]


def grid(spark):
    """Sequences of many lengths, some with gaps, few letters or none, and all their (i, j, mismatches, overlap)."""
    rng = random.Random(6)
    texts = {k: "".join(rng.choice("ACGTacgtN" + "-." * rng.randint(0, 3)) for _ in range(rng.choice([0, 3, 20, 60, 90]))) for k in range(60)}
    texts |= {100 + k: texts[k][:-1] + "A" for k in range(0, 60, 5) if texts[k]}
    met = []
    for i in texts:
        for j in texts:
            if i < j:
                both = [(x.upper(), y.upper()) for x, y in zip(texts[i], texts[j]) if x.isalpha() and y.isalpha()]
                met.append((i, j, sum(x != y for x, y in both), len(both)))
    return spark.createDataFrame([*texts.items(), (999, None)], "id int, bases string"), met


@pytest.mark.parametrize("block", [2, 7, 500])
def test_no_sequence_is_sent_to_each_cell_of_the_grid(spark, rows, block):
    seqs, met = grid(spark)
    near = pair_distances(seqs, 3000, 12, block=block)
    assert "bases" not in near._jdf.queryExecution().optimizedPlan().toString()
    want = [(i, j, (mm * 20000 + ov) // (2 * ov)) for i, j, mm, ov in met if ov >= 12]
    assert rows(near) == sorted((e for e in want if e[2] <= 3000), key=repr)


@pytest.mark.parametrize("block", [7, 500])
def test_sums_of_all_pairs_come_from_stored_blocks(spark, rows, block):
    seqs, met = grid(spark)
    profile = distance_profile(seqs, 12, block=block)
    assert "bases" not in profile._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for _, _, mm, ov in met:
        if ov >= 12:
            sums = want.setdefault((mm * 20000 + ov) // (2 * ov) // 100, [0, 0, 0])
            want[(mm * 20000 + ov) // (2 * ov) // 100] = [a + b for a, b in zip(sums, (1, mm, ov))]
    assert rows(profile) == sorted(((k, *v) for k, v in want.items()), key=repr)


@pytest.mark.parametrize("least, letters, block", [(12, 0, 7), (12, 40, 3), (25, 40, 500), (70, 40, 7)])
def test_pairs_without_overlap_compare_sequences_of_few_letters_only(spark, rows, monkeypatch, least, letters, block):
    from reedbed.operators import distances

    seqs, met = grid(spark)
    long = spark.createDataFrame([(2000 + k, "ACGT" * 20) for k in range(letters)], "id int, bases string")
    seqs = seqs.unionByName(long)
    met += [(i, 2000 + k, 0, ov) for k in range(letters) for i, ov in [(r.id, sum(c.isalpha() for c in r.bases[:80])) for r in seqs.where("id < 900").collect()]]
    met += [(2000 + i, 2000 + j, 0, 80) for i in range(letters) for j in range(i + 1, letters)]
    grids = []
    monkeypatch.setattr(distances, "_all_pairs", lambda *a, real=distances._all_pairs: (grids.append(1), real(*a))[1])
    assert rows(pairs_without_overlap(seqs, least, block=block)) == sorted(((i, j, ov) for i, j, _, ov in met if ov < least), key=repr)
    assert bool(grids) == (least == 70 or not letters)


@pytest.mark.parametrize("size", [3, 500])
def test_members_of_large_groups_are_stored_once(spark, rows, monkeypatch, size):
    monkeypatch.setattr(representatives, "SLICE", size)
    monkeypatch.setattr(representatives, "RUN", 4)
    seqs, met = grid(spark)
    groups = seqs.dropna().selectExpr("id % 2 AS g", "cast(id % 3 = 0 AS string) AS h", "id", "bases").where("h = 'true' OR id % 5 = 0 OR g = 1 AND id < 4")
    of = {r.id: (r.g, r.h) for r in groups.collect()}
    dist = {(i, j): (mm * 20000 + ov) // (2 * ov) if ov else 10000 for i, j, mm, ov in met}
    want = []
    for i, key in of.items():
        others = [dist[min(i, j), max(i, j)] for j in of if j != i and of[j] == key]
        want.append((*key, i, sum(d * d for d in others), max(others, default=0)))
    got = representatives.squared_sums(groups, ["g", "h"])
    assert got.columns == ["g", "h", "id", "score", "farthest"] and rows(got) == sorted(want, key=repr)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Generate" in x and "bases" in x for x in plan.splitlines()) and "own" not in plan


def test_preferred_members_of_large_groups_come_from_stored_slices(spark, rows, monkeypatch):
    stored = []
    monkeypatch.setattr(representatives, "SLICE", 4)
    monkeypatch.setattr(representatives, "stored_blocks", lambda r, real=representatives.stored_blocks: (stored.append(r.count()), real(r))[1])
    seqs, _ = grid(spark)
    groups = seqs.dropna().selectExpr("id % 3 AS g", "id", "bases").where("id < 40")
    liked = spark.createDataFrame([(k,) for k in (3, 6, 7)], "id int")
    score = {(r.g, r.id): r.score for r in representatives.squared_sums(groups, ["g"]).collect()}
    want = {g: min((i not in (3, 6, 7), s, i) for (h, i), s in score.items() if h == g)[2] for g in range(3)}
    stored.clear()
    assert {r.g: r.id for r in representatives.medoids(groups, ["g"], liked).collect()} == want
    assert stored == [40]


def test_order_breaks(spark, rows):
    df = spark.createDataFrame([(k, d) for k, d in enumerate([1, 2, 5, 3, 4, 4, 2, 9])], "row_no long, dist int")
    assert rows(order_breaks(df, "row_no").select("row_no", "previous")) == [(3, 5), (6, 4)]


@pytest.mark.parametrize("method", ["complete", "average"])
def test_a_linkage_that_never_merges_is_found_out(spark, rows, method):
    edges, ids = frame(spark, EDGES), spark.createDataFrame([(k,) for k in range(1, 6)], "id int")
    merges = linkage.linkage(edges, method)
    assert rows(linkage.mergeable(linkage.snapshots(merges, ids, [0, 3, 6]), edges, method)) == []
    none = linkage.snapshots(merges.limit(0), ids, [0, 1])
    assert rows(linkage.mergeable(none, edges, method)) == [(0, 1, 2), (1, 1, 2), (1, 1, 3)]


@pytest.mark.parametrize("name", ["complete", "upgma"])
def test_snapshots_at_every_step(spark, name):
    import os

    from reedbed.plans.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    if not os.path.exists(folder):
        pytest.skip("no test data")
    got = QUERIES[f"{name}_snapshots"](spark, folder)
    assert got.columns == ["cutoff", "cluster", "id"]
    times = {r["cutoff"]: r["count"] for r in got.groupBy("cutoff").count().collect()}
    assert set(times) == {r.cutoff for r in QUERIES["cutoff_series"](spark, folder).collect()}
    assert len(set(times.values())) == 1

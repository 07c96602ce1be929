"""Clusters of mutually close records: k-means over hashed weighted neighbour features, checked exactly.

Method: an id's features are itself and the ids close to it, hashed into signed dimensions, with weights that fall
with the distance. Seeds are oversampled in parallel rounds among the ids that are far from all seeds so far, and
of neighbours drawn together the one with the smallest hash is kept. An id's vector is compared with those of the
seeds close to it. Seeds that see the same neighbourhood are merged, ids go to the seed with the largest cosine,
centroids are recomputed from their members and ids assigned again. Each k-means cluster is then checked exactly: members
with the fewest close partners in it go until all that are left are close to enough of the others; ids outside
that are close to enough members come in; members are ranked for the most typical. What belongs to no checked
cluster runs through all of this again, until a pass finds nothing.

All of this is joins and aggregations of links, keyed by id or centroid, whatever the size of what hangs together. Ids with
fewer close partners than a member needs are dropped first, which takes a hub's leaves away. What a pass of k-means leaves
is sifted by exact conditions and searched around each of its ids, until that finds nothing either.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reedbed.plans.runtime import materialise, release, shuffle_partitions, table

#: Largest distance of a close pair; fewest members; share of the others that a member is close to.
CLOSE, LEAST, SHARE = 300, 5, (2, 3)
#: Dimensions of the hashed features, a power of two.
DIMENSIONS = 64
#: Seeds drawn in a round for each id; seeds with at least this cosine are one.
OVERSAMPLING, SAME_SEED = 0.5, 0.35
LLOYD_ROUNDS = 1
#: Rounds of oversampling; in the last, all that is left becomes a seed.
ROUNDS = 4


def close_pairs(edges: DataFrame, limit: int = CLOSE) -> DataFrame:
    """(a, b, d), a < b: each close pair's smallest distance in any of its rows, in either order."""
    i, j = F.col("seqi").cast("int"), F.col("seqj").cast("int")
    return (
        edges.where(F.col("dist").between(0, limit) & (F.col("seqi") != F.col("seqj")))
        .select(F.least(i, j).alias("a"), F.greatest(i, j).alias("b"), F.col("dist").cast("int").alias("d"))
        .groupBy("a", "b")
        .agg(F.min("d").alias("d"))
    )


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.inline(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other"), "d"), F.struct(F.col("b").alias("id"), F.col("a").alias("other"), "d"))))


def _needed(members: int) -> int:
    """Close partners that a member of a cluster of that size has at least."""
    return -(-SHARE[0] * (members - 1) // SHARE[1])


def pruned(pairs: DataFrame) -> DataFrame:
    """Pairs whose ends both have as many close partners as the smallest cluster's members need; what goes can be
    in no cluster."""
    enough = _both_ways(pairs).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= _needed(LEAST)).select("id")
    return pairs.join(enough.withColumnRenamed("id", "a"), "a", "left_semi").join(enough.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b", "d")


def _dense(ids: np.ndarray, others: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order, and for each the hashed features: a dimension and a sign for each of the others."""
    h = others.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    names, at = np.unique(ids, return_inverse=True)
    place = at * DIMENSIONS + (h >> np.uint64(40) & np.uint64(DIMENSIONS - 1)).astype(np.int64)
    signed = np.where(h >> np.uint64(63), weights, -weights)
    return names, np.bincount(place, signed, len(names) * DIMENSIONS).reshape(-1, DIMENSIONS)


def _bytes_of(vectors: np.ndarray) -> pa.Array:
    """Rows scaled to eight-bit integers; only their directions count."""
    scaled = np.rint(vectors * (127 / np.maximum(np.abs(vectors).max(1, keepdims=True), 1e-9))).astype(np.int8)
    return pa.array([x.tobytes() for x in scaled], pa.binary())


def _rows_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(-1, DIMENSIONS).astype(np.float32)


def _vectorise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (id, other, d), sorted by id -> (id, vector). An id is a feature of itself, with the weight 1."""

    def run(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        ids, others, d = rows
        own = np.unique(ids)
        names, found = _dense(np.concatenate([ids, own]), np.concatenate([others, own]), np.concatenate([1 - d / (2 * CLOSE), np.ones(len(own))]))
        yield pa.record_batch([pa.array(names, pa.int32()), _bytes_of(found)], names=["id", "vector"])

    yield from _in_groups(batches, run)


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, seed, vector, centroid) -> (id, seed, cosine)."""
    for batch in batches:
        if batch.num_rows:
            x, y = _rows_of(batch.column(2)), _rows_of(batch.column(3))
            cosine = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
            yield pa.record_batch([*batch.columns[:2], pa.array(cosine.astype(np.float64))], names=["id", "seed", "cosine"])


def _means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seed, vector) in any order -> (seed, sum, members): sums of the members' unit vectors, batch by batch, so that a
    centroid's members are added up before they are sent."""
    for batch in batches:
        if batch.num_rows:
            names, at = np.unique(batch.column(0).to_numpy(), return_inverse=True)
            x = _rows_of(batch.column(1))
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
            order = np.argsort(at, kind="stable")
            sums = np.add.reduceat(x[order], np.searchsorted(at[order], np.arange(len(names))), axis=0).astype(np.float32)
            yield pa.record_batch([pa.array(names, pa.int32()), pa.array([v.tobytes() for v in sums], pa.binary())], names=["seed", "sum"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums (seed, sum), sorted by seed -> (seed, centroid), the direction of the sum."""
    own, total = None, None

    def done(seeds: list[int], sums: list[np.ndarray]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(seeds, pa.int32()), _bytes_of(np.array(sums))], names=["seed", "centroid"])

    for batch in batches:
        seeds, sums = [], []
        for seed, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(part, np.float32)
            if seed == own:
                total = total + part
                continue
            if own is not None:
                seeds.append(own)
                sums.append(total)
            own, total = seed, part
        if seeds:
            yield done(seeds, sums)
    if own is not None:
        yield done([own], [total])


def _uniform(key: Column, *salts: int) -> Column:
    """A number from 0 up to 1 that depends on the key and the salts only, so that reruns agree."""
    return F.pmod(F.xxhash64(key, *map(F.lit, salts)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _best(cosines: DataFrame) -> DataFrame:
    """(id, seed, cosine): each id's seed of the largest cosine, then the smallest seed. Cosine and seed go into one
    number, so that the maximum needs no sorting."""
    both = F.shiftleft(((F.col("cosine") + 1) * (1 << 20)).cast("long"), 32) + (F.lit((1 << 31) - 1) - F.col("seed").cast("long"))
    best = cosines.groupBy("id").agg(F.max(both).alias("m"))
    return best.select(
        "id",
        (F.lit((1 << 31) - 1) - F.col("m").bitwiseAND((1 << 32) - 1)).cast("int").alias("seed"),
        (F.shiftright("m", 32) / float(1 << 20) - 1).alias("cosine"),
    )


def _compared(pairs: DataFrame, vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """(id, seed) with their cosine."""
    met = pairs.join(vectors, "id").join(centroids, "seed").select("id", "seed", "vector", "centroid")
    return met.mapInArrow(_cosines, "id int, seed int, cosine double")


def seeded(vectors: DataFrame, links: DataFrame, salt: int, oversampling: float = OVERSAMPLING) -> list[DataFrame]:
    """(id, seed, cosine), a written table a round: seeds by oversampling, met by the ids close to them, until every id has
    the cosine SAME_SEED with a seed, itself perhaps. Another salt draws other seeds."""
    met: list[DataFrame] = []
    open_, turn = materialise(vectors.select("id", F.lit(1.0).alias("cost")), "open"), 0
    while True:
        cost, count = open_.agg(F.sum("cost"), F.count("*")).first()
        if not count:
            return met
        turn += 1
        if turn < ROUNDS:
            # In each round more of what is left is drawn.
            chance = F.col("cost") * (oversampling * turn * count / cost)
            rank = F.xxhash64("id", F.lit(-turn), F.lit(salt))
            drawn = open_.where(_uniform(F.col("id"), turn, salt) < chance).select("id", rank.alias("rank"))
            beaten = (
                links.join(drawn, "id")
                .join(drawn.select(F.col("id").alias("other"), F.col("rank").alias("against")), "other")
                .where((F.col("against") < F.col("rank")) | ((F.col("against") == F.col("rank")) & (F.col("other") < F.col("id"))))
                .select("id")
            )
            new = materialise(drawn.join(beaten, "id", "left_anti").select(F.col("id").alias("seed")), "seeds")
        else:
            # The few that are still far from all seeds are seeds; those that see the same ids are merged afterwards.
            new = materialise(open_.select(F.col("id").alias("seed")), "seeds")
        pairs = links.join(new.withColumnRenamed("seed", "other"), "other").select("id", F.col("other").alias("seed")).unionByName(new.select(F.col("seed").alias("id"), "seed"))
        found = materialise(_compared(pairs, vectors, vectors.select(F.col("id").alias("seed"), F.col("vector").alias("centroid"))), "met")
        met.append(found)
        covered = found.groupBy("id").agg(F.max("cosine").alias("cosine")).where(F.col("cosine") >= SAME_SEED)
        after = materialise(open_.join(covered, "id", "left_anti"), "open")
        release(open_, new)
        open_ = after


def k_means(vectors: DataFrame, links: DataFrame, salt: int) -> DataFrame:
    """(id, seed): the centroid of each id, named by a seed. Written as a table."""
    rounds = seeded(vectors, links, salt)
    met = reduce(DataFrame.unionByName, rounds)
    # Oversampling leaves several seeds in a cluster: each takes the name of the smallest that meets the same ids.
    other = met.select("id", F.col("seed").alias("to"))
    alike = met.select("id", "seed").join(other, "id").where("to < seed").select(F.col("seed").alias("id"), F.col("to").alias("seed")).distinct()
    alike = _compared(alike, vectors, vectors.select(F.col("id").alias("seed"), F.col("vector").alias("centroid")))
    named = materialise(alike.where(F.col("cosine") >= SAME_SEED).groupBy(F.col("id").alias("seed")).agg(F.min("seed").alias("to")), "named")
    met = materialise(met.join(named, "seed", "left").select("id", F.coalesce("to", "seed").alias("seed"), "cosine"), "met")
    release(*rounds)
    assigned = materialise(_best(met).select("id", "seed"), "assigned")
    for _ in range(LLOYD_ROUNDS):
        members = assigned.join(vectors, "id").select("seed", "vector")
        sums = members.mapInArrow(_means, "seed int, sum binary").repartition(shuffle_partitions(members.sparkSession), "seed").sortWithinPartitions("seed")
        centroids = sums.mapInArrow(_summed, "seed int, centroid binary")
        pairs = met.select("id", "seed").unionByName(assigned).distinct()
        assigned = materialise(_best(_compared(pairs, vectors, centroids)).select("id", "seed"), "assigned")
    release(named, met)
    return assigned


def _checked(nodes: np.ndarray, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, int] | None:
    """The members that remain of a k-means cluster (positions), and the most typical one's; None if too few do."""
    n = len(nodes)
    inside = np.ones(n, bool)
    degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
    start = np.argsort(np.concatenate([a, b]), kind="stable")
    partner = np.concatenate([b, a])[start]
    ends = np.cumsum(np.bincount(np.concatenate([a, b]), minlength=n))
    left = n
    while left >= LEAST:
        worst = int(np.where(inside, degree, n + 1).argmin())
        if degree[worst] * SHARE[1] >= SHARE[0] * (left - 1):
            break
        inside[worst] = False
        left -= 1
        degree[partner[ends[worst - 1] if worst else 0 : ends[worst]]] -= 1
    if left < LEAST:
        return None
    both = inside[a] & inside[b]
    total = np.bincount(a[both], d[both], n) + np.bincount(b[both], d[both], n)
    members = np.flatnonzero(inside)
    typical = members[np.lexsort((nodes[members], total[members], -degree[members]))[0]]
    return members, int(typical)


def _in_groups(batches: Iterator[pa.RecordBatch], run: Callable[[list[np.ndarray]], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Calls ``run`` with the columns of whole groups of the first one, by which the rows are sorted."""
    parts: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        parts.append([c.to_numpy() for c in batch.columns])
        if sum(len(p[0]) for p in parts) > 200_000:
            rows = [np.concatenate(x) for x in zip(*parts)]
            whole = int(np.searchsorted(rows[0], rows[0][-1]))
            parts = [[x[whole:] for x in rows]]
            if whole:
                yield from run([x[:whole] for x in rows])
    if parts:
        yield from run([np.concatenate(x) for x in zip(*parts)])


def _check_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (seed, a, b, d), sorted by seed -> (seed, typical, id) of the checked clusters, one after the other."""

    def run(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero(np.concatenate([[True], rows[0][1:] != rows[0][:-1], [True]]))
        for s, e in zip(cuts, cuts[1:]):
            nodes, at = np.unique(np.concatenate([rows[1][s:e], rows[2][s:e]]), return_inverse=True)
            if len(nodes) >= LEAST and (found := _checked(nodes, at[: e - s], at[e - s :], rows[3][s:e])):
                seed, typical = np.full(len(found[0]), rows[0][s]), np.full(len(found[0]), nodes[found[1]])
                yield pa.record_batch([pa.array(x, pa.int32()) for x in (seed, typical, nodes[found[0]])], names=["seed", "typical", "id"])

    yield from _in_groups(batches, run)


def _check(pairs: DataFrame, assigned: DataFrame) -> DataFrame:
    inner = (
        pairs.join(assigned.select(F.col("id").alias("a"), "seed"), "a")
        .join(assigned.select(F.col("id").alias("b"), F.col("seed").alias("seed_b")), "b")
        .where("seed = seed_b")
        .select("seed", "a", "b", "d")
    )
    return inner.repartition(shuffle_partitions(pairs.sparkSession), "seed").sortWithinPartitions("seed").mapInArrow(_check_all, "seed int, typical int, id int")


def _grown(pairs: DataFrame, links: DataFrame, found: DataFrame) -> DataFrame:
    """(seed, typical, id) of checked clusters, each grown on its own until no more ids come in: those close to enough
    members are drawn in and all checked again. Clusters may overlap afterwards."""
    done: list[DataFrame] = []
    while True:
        sizes = found.groupBy("seed").agg(F.count("*").alias("n"))
        more = materialise(
            links.join(found.select("seed", F.col("id").alias("other")), "other")
            .groupBy("id", "seed")
            .agg(F.count("*").alias("close"))
            .join(sizes, "seed")
            .where(F.col("close") * SHARE[1] >= SHARE[0] * F.col("n"))
            .join(found.select("id", "seed"), ["id", "seed"], "left_anti")
            .select("id", "seed"),
            "more",
        )
        larger = None
        if not more.isEmpty():
            wider = found.select("id", "seed").join(more.select("seed").distinct(), "seed", "left_semi").select("id", "seed").unionByName(more)
            tried = materialise(_check(pairs, wider), "clusters")
            larger = materialise(tried.groupBy("seed").agg(F.count("*").alias("m")).join(sizes, "seed").where("m > n").select("seed"), "larger")
        if larger is None or larger.isEmpty():
            for part in done:
                found = found.unionByName(part)
            return found
        done.append(materialise(found.join(larger, "seed", "left_anti").select("seed", "typical", "id"), "clusters"))
        found = materialise(tried.join(larger, "seed", "left_semi").select("seed", "typical", "id"), "clusters")
        release(more, tried, larger)


def _apart(found: DataFrame) -> DataFrame:
    """(typical, id): of clusters (seed, typical, id) that overlap the largest, then the one of the smallest typical member
    and seed. One is kept if no member is in a better one; the best of all always is."""
    ranked = found.join(found.groupBy("seed", "typical").agg(F.count("*").alias("n")), ["seed", "typical"])
    ranked = ranked.select("seed", "typical", "id", F.struct(-F.col("n"), "typical", "seed").alias("key"))
    best = ranked.groupBy("id").agg(F.min("key").alias("best"))
    beaten = ranked.join(best, "id").where("key <> best").select("seed", "typical").distinct()
    return materialise(found.join(beaten, ["seed", "typical"], "left_anti").select("typical", "id"), "clusters")


def _sifted(pairs: DataFrame) -> DataFrame:
    """The pairs that exact conditions leave, as :meth:`Component._triangles` has them: both ends have enough partners
    and at least one in common. Written as a table."""
    kept, before = materialise(pruned(pairs), "sifted"), -1
    while (n := kept.count()) != before:
        before = n
        links = _both_ways(kept).select("id", "other")
        degrees = links.groupBy("id").agg(F.count("*").alias("n"))
        # Partners are listed from the end that has fewer, so a hub's don't all meet.
        low = (
            kept.join(degrees.select(F.col("id").alias("a"), F.col("n").alias("na")), "a")
            .join(degrees.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
            .select("a", "b", F.when(F.col("na") <= F.col("nb"), F.col("a")).otherwise(F.col("b")).alias("x"), F.when(F.col("na") <= F.col("nb"), F.col("b")).otherwise(F.col("a")).alias("y"))
        )
        closed = (
            low.join(links.select(F.col("id").alias("x"), F.col("other").alias("common")), "x")
            .join(links.select(F.col("id").alias("y"), F.col("other").alias("common")), ["y", "common"], "left_semi")
            .select("a", "b")
            .distinct()
        )
        after = materialise(pruned(materialise(kept.join(closed, ["a", "b"], "left_semi").select("a", "b", "d"), "closed")), "sifted")
        release(kept)
        kept = after
    return kept


def _balls(pairs: DataFrame) -> DataFrame:
    """(component, a, b, d): for each id all pairs among it and the ids of no lower rank that may be in a cluster with it.
    Those are its partners and, as any two members that aren't partners have three in common, the ids that share
    three with it. A cluster lies whole in the ball of its member of the lowest rank. Ranks follow the number of partners,
    which keeps the balls of hubs small."""
    links = _both_ways(pairs).select("id", "other")
    ranks = materialise(links.groupBy("id").agg((F.count("*") * (1 << 32) + F.col("id")).alias("rank")), "ranks")
    ranked = materialise(
        links.join(ranks, "id").join(ranks.select(F.col("id").alias("other"), F.col("rank").alias("other_rank")), "other"), "ranked"
    )
    first = ranked.where("other_rank > rank").select(F.col("id").alias("ball"), F.col("rank").alias("least"), F.col("other").alias("id"))
    second = (
        first.join(ranked.select("id", "other", "other_rank"), "id")
        .where("other_rank > least")
        .groupBy("ball", "other")
        .agg(F.count("*").alias("n"))
        .where("n >= 3")
        .select("ball", F.col("other").alias("id"))
    )
    inside = materialise(first.select("ball", "id").unionByName(second).unionByName(first.select("ball", F.col("ball").alias("id"))).distinct(), "balls")
    return (
        inside.withColumnRenamed("id", "a")
        .join(pairs, "a")
        .join(inside.withColumnRenamed("id", "b"), ["ball", "b"], "left_semi")
        .select(F.col("ball").cast("long").alias("component"), "a", "b", "d")
    )


def _left_over(core: DataFrame) -> DataFrame:
    """(seed, typical, id): clusters in what k-means leaves, which may overlap. Pairs are sifted, and each id's ball of
    them is searched."""
    sifted = _sifted(core)
    if sifted.isEmpty():
        return sifted.select(F.col("a").alias("seed"), F.col("a").alias("typical"), F.col("a").alias("id"))
    found = _searched(_balls(sifted))
    apart = _apart(found.select(F.col("component").alias("seed"), "typical", "id"))
    return apart.select(F.col("typical").alias("seed"), "typical", "id")


def _without(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs of which no end is in a cluster found."""
    for end in ("a", "b"):
        pairs = pairs.join(found.select(F.col("id").alias(end)), end, "left_anti")
    return pairs.select("a", "b", "d")


def clusters_of(pairs: DataFrame) -> DataFrame:
    """(typical, id): the clusters of close pairs (a, b, d): those that k-means over all pairs leads to, then those that the
    exact search finds in what it leaves, until it finds none. Every round but the last takes a cluster away."""
    spark = pairs.sparkSession
    core = materialise(pruned(pairs), "core")
    out: DataFrame | None = None
    by_search = False
    while not core.isEmpty():
        links = _both_ways(core)
        if by_search:
            new = _left_over(core)
            if new.isEmpty():
                break
        else:
            vectors = links.select("id", "other", "d").repartition(shuffle_partitions(spark), "id").sortWithinPartitions("id")
            vectors = materialise(vectors.mapInArrow(_vectorise, "id int, vector binary"), "vectors")
            new = materialise(_check(core, k_means(vectors, links, 1)), "clusters")
            release(vectors)
            by_search = True
        new = _apart(_grown(core, links, new))
        out = new if out is None else out.unionByName(new)
        left = materialise(pruned(_without(core, new)), "core")
        release(core)
        core = left
    return spark.createDataFrame([], "typical int, id int") if out is None else out


class Component:
    """One connected component of close pairs, by positions of its ids."""

    def __init__(self, a: np.ndarray, b: np.ndarray, d: np.ndarray):
        self.ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        self.a, self.b, self.d = at[: len(a)], at[len(a) :], d
        self.near = np.zeros((len(self.ids), len(self.ids)), bool)
        self.near[self.a, self.b] = self.near[self.b, self.a] = True

    def k_means(self, inside: np.ndarray, salt: int) -> list[np.ndarray]:
        """Positions of the members of each k-means cluster of the ids inside, by the steps of the distributed form."""
        own = np.flatnonzero(inside)
        both = inside[self.a] & inside[self.b]
        a, b, w = self.a[both], self.b[both], 1 - self.d[both] / (2 * CLOSE)
        _, x = _dense(np.concatenate([a, b, own]), self.ids[np.concatenate([b, a, own])], np.concatenate([w, w, np.ones(len(own))]))
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        near = self.near[np.ix_(own, own)] | np.eye(len(own), dtype=bool)
        rank = np.random.default_rng([salt, int(self.ids[own[0]])])
        seeds: list[int] = []
        nearest = np.zeros(len(own))
        turn = 0
        while (open_ := nearest < SAME_SEED).any():
            turn += 1
            cost = np.where(open_, 1 - nearest, 0)
            chance = cost * OVERSAMPLING * turn * len(own) / cost.sum() if turn < 3 else np.where(open_, np.inf, 0)
            order = rank.permutation(len(own))
            drawn = np.flatnonzero(open_ & (rank.random(len(own)) < chance))
            met = near[np.ix_(drawn, drawn)] & (order[drawn][None, :] < order[drawn][:, None])
            new = drawn[~met.any(1)]
            if len(new):
                seeds += new.tolist()
                nearest = np.maximum(nearest, np.where(near[:, new], x @ x[new].T, 0).max(1))
        # Seeds that see the same ids are one: each takes the name of the smallest such seed.
        s = np.array(sorted(seeds))
        named = s[((x[s] @ x[s].T) >= SAME_SEED).argmax(1)]
        cosine = np.where(near[:, s], x @ x[s].T, -1)
        assigned = named[cosine.argmax(1)]
        for _ in range(LLOYD_ROUNDS):
            centers = np.unique(assigned)
            sums = (assigned[None, :] == centers[:, None]) @ x
            sums /= np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
            assigned = centers[(x @ sums.T).argmax(1)]
        return [own[assigned == c] for c in np.unique(assigned)]

    def check(self, members: np.ndarray) -> tuple[np.ndarray, int] | None:
        inside = np.zeros(len(self.ids), bool)
        inside[members] = True
        both = inside[self.a] & inside[self.b]
        place = np.cumsum(inside) - 1
        found = _checked(self.ids[inside], place[self.a[both]], place[self.b[both]], self.d[both])
        return found and (np.flatnonzero(inside)[found[0]], int(np.flatnonzero(inside)[found[1]]))

    def drawn_in(self, members: np.ndarray, free: np.ndarray) -> np.ndarray:
        """Members and the free ids that are close to enough of them."""
        close = self.near[:, members].sum(1)
        return np.union1d(members, np.flatnonzero(free & (close * SHARE[1] >= SHARE[0] * len(members))))

    def _triangles(self, inside: np.ndarray) -> list[np.ndarray]:
        """What exact conditions leave of the ids inside, by connected parts: a close pair in a cluster has a common
        partner in it, and a member as many partners as the smallest cluster asks for."""
        near = self.near & inside & inside[:, None]
        while True:
            count = near.astype(np.float32) @ near.astype(np.float32)
            kept = near & (count > 0)
            enough = kept.sum(1) >= _needed(LEAST)
            kept &= enough & enough[:, None]
            if (kept == near).all():
                break
            near = kept
        parts, left = [], near.any(1)
        while left.any():
            part = np.zeros(len(self.ids), bool)
            front = np.zeros(len(self.ids), bool)
            front[left.argmax()] = True
            while front.any():
                part |= front
                front = near[front].any(0) & ~part
            parts.append(np.flatnonzero(part))
            left &= ~part
        return parts

    def clusters(self) -> list[tuple[np.ndarray, int]]:
        """(positions, most typical) of every cluster. Passes of k-means until one finds nothing; what they leave is
        searched by the exact conditions once more."""
        free, found, salt = np.ones(len(self.ids), bool), [], 0
        while free.sum() >= LEAST:
            salt += 1
            candidates = self.k_means(free, salt)
            new = [c for c in (self._grown(x, free) for x in candidates if len(x) >= LEAST) if c]
            if not new:
                new = [c for c in (self._grown(x, free) for x in self._triangles(free)) if c]
            if not new:
                break
            for members, typical in new:
                if free[members].all():
                    free[members] = False
                    found.append((members, typical))
        return found

    def _grown(self, members: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, int] | None:
        found = self.check(members)
        while found:
            larger = self.drawn_in(found[0], free)
            if len(larger) == len(found[0]):
                return found
            again = self.check(larger)
            if not again or len(again[0]) <= len(found[0]):
                return found
            found = again
        return None


def _by_component(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (component, a, b, d), sorted by component -> (component, typical, id)."""

    def run(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero(np.concatenate([[True], rows[0][1:] != rows[0][:-1], [True]]))
        component, typical, members = [], [], []
        for s, e in zip(cuts, cuts[1:]):
            part = Component(*(x[s:e] for x in rows[1:]))
            for inside, best in part.clusters():
                members.append(part.ids[inside])
                typical.append(np.full(len(inside), part.ids[best]))
                component.append(np.full(len(inside), rows[0][s]))
        if members:
            columns = [pa.array(np.concatenate(component), pa.int64()), pa.array(np.concatenate(typical), pa.int32()), pa.array(np.concatenate(members), pa.int32())]
            yield pa.record_batch(columns, names=["component", "typical", "id"])

    yield from _in_groups(batches, run)


def _searched(placed: DataFrame) -> DataFrame:
    """Pairs (component, a, b, d) -> (component, typical, id), each component by one task."""
    return placed.repartition(shuffle_partitions(placed.sparkSession), "component").sortWithinPartitions("component").mapInArrow(_by_component, "component long, typical int, id int")


def clusters(edges: DataFrame) -> DataFrame:
    """(seqi, seqj, dist) -> (typical, id): every cluster's members, the most typical one among them. Ids are INT.

    Rows with a null, with equal ends or with a distance outside 0 to CLOSE tell nothing; repeated rows and either
    order are one pair, with the smallest distance. Ties for the most typical member go to the smaller sum of
    distances, then to the smaller id. Without clusters, or on an empty table, there are no rows. Other columns
    are not read.
    """
    return clusters_of(close_pairs(edges))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "thin_edge")).select(F.col("typical").alias("typical_id"), F.col("id").alias("seq_id"))


def p5_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cluster by its most typical member, with its size."""
    return p5_found(spark, sf_dir).groupBy("typical_id").agg(F.count("*").alias("members"))


def p5_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the clusters, by faults: clusters that are too small; members close to too few others; typical
    members that aren't; ids outside that are close enough to be in; and ids that with all their partners are a cluster of
    which none was found."""
    pairs = materialise(close_pairs(table(spark, sf_dir, "thin_edge")), "pairs")
    found = materialise(clusters_of(pairs), "found")
    links = _both_ways(pairs)
    size = found.groupBy("typical").agg(F.count("*").alias("n"))
    enough = lambda close, n: F.col(close) * SHARE[1] >= SHARE[0] * (F.col(n) - 1)
    near = links.join(found.select("typical", F.col("id").alias("other")), "other").groupBy("typical", "id").agg(F.count("*").alias("close"), F.sum("d").alias("total"))
    inside = found.join(near, ["typical", "id"], "left").fillna(0, ["close", "total"]).join(size, "typical")
    best = Window.partitionBy("typical").orderBy(F.col("close").desc(), "total", "id")
    joins = near.join(size, "typical").join(found.select("typical", "id"), ["typical", "id"], "left_anti").where(F.col("close") * SHARE[1] >= SHARE[0] * F.col("n"))
    around = links.select(F.col("id").alias("center"), "other").unionByName(links.select(F.col("id").alias("center"), F.col("id").alias("other")).distinct())
    met = around.join(links.select(F.col("id").alias("other"), F.col("other").alias("third")), "other").join(around.select("center", F.col("other").alias("third")), ["center", "third"], "left_semi")
    ball = around.groupBy("center").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)
    loose = around.join(met.groupBy("center", "other").agg(F.count("*").alias("close")), ["center", "other"], "left").fillna(0, ["close"]).join(ball, "center").where(~enough("close", "n"))
    missed = ball.join(loose.select("center").distinct(), "center", "left_anti").join(found.select(F.col("id").alias("center")), "center", "left_anti")
    count = lambda df, name: df.agg(F.count("*").alias("faults")).select(F.lit(name).alias("what"), "faults")
    return (
        count(size.where(F.col("n") < LEAST), "small")
        .unionByName(count(inside.where(~enough("close", "n")), "loose"))
        .unionByName(count(inside.withColumn("k", F.row_number().over(best)).where("k = 1 AND id <> typical"), "typical"))
        .unionByName(count(joins, "outside"))
        .unionByName(count(missed, "missed"))
    )


QUERIES = {"p5_found": p5_found, "p5_sizes": p5_sizes, "p5_checked": p5_checked}
ORACLES = {"p5_checked": "SELECT UNNEST(['small', 'loose', 'typical', 'outside', 'missed']) AS what, 0 AS faults"}

"""Linkage of a sparse distance matrix into nested clusters, snapshots at cutoffs, trees.

Clusters are named by their smallest member. A merge of ``a`` and ``b``, a < b, lets ``a`` stand for both, so the
merges are a forest: every name but a root's goes away once, at one distance, and distances don't fall on the way
up. Single linkage needs no order, only the spanning forest of the shortest edges, which is found in joins. Complete linkage
merges two clusters at the last of their edges, so edges are taken in bands of their distances: only clusters that the
band's own edges join can merge in it, and what it saw is kept as counts. Average linkage clusters each connected
component on its own.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reedbed.operators.components import components
from reedbed.plans.runtime import materialise, release, shuffle_partitions

MERGES = "component long, step int, a long, b long, dist double, members int"


def _complete(events: list[tuple[int, int, int, int, int]], seen_before: list[tuple[int, int, int]], sizes: dict[int, int]) -> list[tuple[int, int, int, int, int, int]]:
    """Events (dist, i, j, a, b) in order, counts (a, b, n) of the pairs of their clusters seen before, and the clusters'
    sizes, to merges (a, b, dist, i, j, members): two clusters merge once all pairs of their members have been seen, at the
    distance of the last one."""
    name = {x: x for x in sizes}
    parts = {x: [x] for x in sizes}
    members = dict(sizes)
    seen: dict[int, dict[int, int]] = {x: {} for x in sizes}
    for a, b, n in seen_before:
        seen[a][b] = seen[b][a] = n
    out = []
    for dist, i, j, x, y in events:
        a, b = sorted((name[x], name[y]))
        if a == b:
            continue
        count = seen[a].get(b, 0) + 1
        seen[a][b] = seen[b][a] = count
        if count < members[a] * members[b]:
            continue
        for part in parts[b]:
            name[part] = a
        parts[a] += parts.pop(b)
        members[a] += members.pop(b)
        del seen[a][b]
        for c, n in seen.pop(b).items():
            if c != a:
                del seen[c][b]
                seen[a][c] = seen[c][a] = seen[a].get(c, 0) + n
        out.append((a, b, dist, i, j, members[a]))
    return out


def _average(edges: list[tuple[int, int, int]], psi: int) -> list[tuple[int, int, float, int]]:
    """The pair with the smallest mean distance merges; pairs of members without an edge count as ``psi``. Clusters
    without any edge between them don't merge. Equal means are the same number, and ties go by name.

    With w the sum of ``psi`` less the distance over the edges between two clusters, their mean is psi - w / pairs. Of a
    cluster's links, which is nearest doesn't depend on its own size, so each cluster has a heap of its links, in which a
    link may only look nearer than it is, and a hub's other links aren't touched when it grows. Two clusters that are each
    other's nearest merge sooner or later in any order, so they are found along chains of nearest ones and put in order at
    the end. Means of ``psi`` itself, which names alone decide, come last."""
    if any(dist > psi for _, _, dist in edges):
        return _average_in_order(edges, psi)
    links: dict[int, dict[int, int]] = {}
    for i, j, dist in edges:
        links.setdefault(i, {})[j] = links.setdefault(j, {})[i] = psi - dist
    name = {x: x for x in links}
    size = dict.fromkeys(links, 1)
    heaps: dict[int, list[tuple[float, int, int]]] = {x: [(-w, y, y) for y, w in to.items() if w] for x, to in links.items()}
    for heap in heaps.values():
        heapq.heapify(heap)

    def nearest(x: int) -> int | None:
        heap, to = heaps[x], links[x]
        while heap:
            held, _, y = heap[0]
            if y not in to:
                heapq.heappop(heap)
                continue
            now = (-to[y] / size[y], name[y], y)
            if now == heap[0]:
                return y
            heapq.heapreplace(heap, now) if held <= now[0] else heapq.heappop(heap)
        return None

    def key(x: int, y: int) -> tuple[float, int, int]:
        pairs, a, b = size[x] * size[y], name[x], name[y]
        return (psi * pairs - links[x][y]) / pairs, min(a, b), max(a, b)

    out: list[tuple[int, int, float, int]] = []
    for start in list(links):
        chain = [start] if start in links else []
        while chain:
            x = chain[-1]
            y = nearest(x)
            if len(chain) < 2 or y is not None and key(x, y) < key(x, chain[-2]):
                if y is None:
                    break
                chain.append(y)
                continue
            y = chain[-2]
            del chain[-2:]
            dist, a, b = key(x, y)
            if len(links[x]) < len(links[y]):
                x, y = y, x
            # x stands for both; only the links of y, which has fewer, are gone through.
            del links[x][y], links[y][x], heaps[y]
            size[x] += size.pop(y)
            name[x] = a
            to, heap = links[x], heaps[x]
            for c, w in links.pop(y).items():
                del links[c][y]
                w += to.get(c, 0)
                to[c] = links[c][x] = w
                if w:
                    heapq.heappush(heap, (-w / size[c], name[c], c))
                    heapq.heappush(heaps[c], (-w / size[x], a, x))
            out.append((a, b, dist, size[x]))
            if not chain:
                chain = [x]
    done: set[int] = set()
    for x in sorted(links, key=name.__getitem__):
        if x not in done:
            done.add(x)
            n, due = size[x], [(name[y], y) for y in links[x]]
            heapq.heapify(due)
            while due:
                b, y = heapq.heappop(due)
                if y not in done:
                    done.add(y)
                    n += size[y]
                    out.append((name[x], b, psi / 1, n))
                    for z in links[y]:
                        if z not in done:
                            heapq.heappush(due, (name[z], z))
    return _in_order(out)


def _in_order(merges: list[tuple[int, int, float, int]]) -> list[tuple[int, int, float, int]]:
    """Merges, each after those that made its clusters, as they come if the first by (dist, a, b) of all that can be made is next."""
    last: dict[int, int] = {}
    waits, after = [0] * len(merges), [-1] * len(merges)
    for k, (a, b, _, _) in enumerate(merges):
        for x in (a, b):
            if x in last:
                after[last[x]] = k
                waits[k] += 1
        last[a] = k
    due = [(dist, a, b, k) for k, (a, b, dist, _) in enumerate(merges) if not waits[k]]
    heapq.heapify(due)
    out = []
    while due:
        k = heapq.heappop(due)[3]
        out.append(merges[k])
        if (up := after[k]) >= 0:
            waits[up] -= 1
            if not waits[up]:
                a, b, dist, _ = merges[up]
                heapq.heappush(due, (dist, a, b, up))
    return out


def _average_in_order(edges: list[tuple[int, int, int]], psi: int) -> list[tuple[int, int, float, int]]:
    """:func:`_average` for any ``psi``, one merge after the other, each of which looks at all links of the new cluster."""
    size: dict[int, int] = {}
    links: dict[int, dict[int, tuple[int, int]]] = {}
    for i, j, dist in edges:
        for x, y in ((i, j), (j, i)):
            size[x] = 1
            links.setdefault(x, {})[y] = (dist, 1)

    def mean(a: int, b: int) -> float:
        total, n = links[a][b]
        pairs = size[a] * size[b]
        return (total + psi * (pairs - n)) / pairs

    heap = [(mean(a, b), a, b, 1, 1) for a in links for b in links[a] if a < b]
    heapq.heapify(heap)
    out = []
    while heap:
        dist, a, b, na, nb = heapq.heappop(heap)
        if a not in size or b not in size or (size[a], size[b]) != (na, nb) or b not in links[a]:
            continue
        del links[a][b], links[b][a]
        for c, (total, n) in links.pop(b).items():
            del links[c][b]
            t, m = links[a].get(c, (0, 0))
            links[a][c] = links[c][a] = (t + total, m + n)
        size[a] += size.pop(b)
        for c in links[a]:
            x, y = min(a, c), max(a, c)
            heapq.heappush(heap, (mean(x, y), x, y, size[x], size[y]))
        out.append((a, b, dist, size[a]))
    return out


def _single(edges: list[tuple[int, int, int]], psi: int) -> list[tuple[int, int, float, int]]:
    parent: dict[int, int] = {}
    size: dict[int, int] = {}

    def find(x: int) -> int:
        parent.setdefault(x, x)
        size.setdefault(x, 1)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j, dist in edges:
        a, b = sorted((find(i), find(j)))
        if a != b:
            parent[b] = a
            size[a] += size[b]
            out.append((a, b, float(dist), size[a]))
    return out


METHODS = ("complete", "average", "single")
#: Edges that a band of complete linkage has at least.
BAND_EDGES = 200_000
_MERGED = "a long, b long, dist int, i long, j long, members int"


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """Columns of all rows of each component, by which the rows are sorted; it is the first column."""
    own, held = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        at = 0
        while at < batch.num_rows:
            name = columns[0][at]
            end = bisect_right(columns[0], name, at)
            part = [c[at:end] for c in columns]
            if held and name == own:
                for column, more in zip(held, part):
                    column.extend(more)
            else:
                if held:
                    yield held
                own, held = name, part
            at = end
    if held:
        yield held


def _per_component(rows: DataFrame, order: list[str], kernel: Callable[[list[list]], list[tuple]], schema: str) -> DataFrame:
    """What the kernel makes of each component's rows, in order, many components a task. ``component`` is the first column."""
    fields = [x.split() for x in schema.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for held in _whole(batches):
            out += kernel(held)
            if len(out) > 10_000:
                yield pa.record_batch([pa.array(c, types[t]) for c, (_, t) in zip(zip(*out), fields)], names=[n for n, _ in fields])
                out = []
        if out:
            yield pa.record_batch([pa.array(c, types[t]) for c, (_, t) in zip(zip(*out), fields)], names=[n for n, _ in fields])

    return rows.repartition(shuffle_partitions(rows.sparkSession), "component").sortWithinPartitions("component", *order).mapInArrow(run, schema)


def _merge_band(rows: list[list]) -> list[tuple]:
    """Columns component, kind, x, y, z, a, b, na, nb: events (kind 0: dist, i, j, the clusters and their sizes), then counts
    seen before (kind 1: x of a and b)."""
    _, kind, x, y, z, a, b, na, nb = rows
    n = bisect_right(kind, 0)
    sizes = dict(zip(a[:n], na)) | dict(zip(b[:n], nb))
    return _complete(list(zip(x[:n], y, z, a, b)), list(zip(a[n:], b[n:], x[n:])), sizes)


def _bands(edges: DataFrame, least: int) -> list[int]:
    """Upper ends of bands of distances with about so many edges as there may be without most of the clusters hanging
    together: two fifths of the ids', and ``least`` of them anyway."""
    wanted = max(least, int(0.4 * edges.select(F.explode(F.array("i", "j"))).distinct().count()))
    ends, held = [], 0
    for dist, n in edges.groupBy("dist").count().orderBy("dist").collect():  # at most SCALE + 1 rows
        held += n
        ends.append(dist)
        if held < wanted:
            ends.pop()
        else:
            held = 0
    return [*ends, dist] if held else ends


def _complete_merges(edges: DataFrame, least: int) -> DataFrame:
    """(a, b, dist, i, j, members) of complete linkage, by bands of edges. In each, edges get their clusters' names, and the
    clusters that they join, with the counts of pairs seen between those before, are one piece of work."""
    spark = edges.sparkSession
    if edges.isEmpty():
        return spark.createDataFrame([], _MERGED)
    seen = moved = out = None
    low = -1
    for high in _bands(edges, least):
        band = edges.where((F.col("dist") > low) & (F.col("dist") <= high))
        low = high
        if moved is not None:
            a, b = moved.select(F.col("id").alias("i"), F.col("cluster").alias("a"), F.col("size").alias("na")), moved.select(F.col("id").alias("j"), F.col("cluster").alias("b"), F.col("size").alias("nb"))
            band = band.join(a, "i", "left").join(b, "j", "left")
            band = band.select("i", "j", "dist", F.coalesce("a", "i").alias("a"), F.coalesce("b", "j").alias("b"), F.coalesce("na", F.lit(1)).alias("na"), F.coalesce("nb", F.lit(1)).alias("nb"))
        else:
            band = band.select("i", "j", "dist", F.col("i").alias("a"), F.col("j").alias("b"), F.lit(1).alias("na"), F.lit(1).alias("nb"))
        band = materialise(band.where("a <> b"), "band")
        part = materialise(components(band, "a", "b"), "parts")
        rows = band.join(part.select(F.col("id").alias("a"), "component"), "a").select("component", F.lit(0).alias("kind"), F.col("dist").cast("long").alias("x"), F.col("i").alias("y"), F.col("j").alias("z"), "a", "b", "na", "nb")
        if seen is not None:
            old = seen.join(part.select(F.col("id").alias("a"), "component"), "a").join(part.select(F.col("id").alias("b"), F.col("component").alias("other")), "b").where("component = other")
            rows = rows.unionByName(old.select("component", F.lit(1).alias("kind"), F.col("n").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(0).cast("long").alias("z"), "a", "b", F.lit(0).alias("na"), F.lit(0).alias("nb")))

        merges = materialise(_per_component(rows, ["kind", "x", "y", "z"], _merge_band, _MERGED), "merges")
        out = merges if out is None else out.unionByName(merges)
        # Ids of clusters of several: those of before under their new names, and those that were alone.
        to = components(merges, "a", "b").select(F.col("id").alias("cluster"), F.col("component").alias("to"))
        alone = to.select(F.col("cluster").alias("id"), F.col("to").alias("cluster"))
        if moved is not None:
            kept = moved.select("id", "cluster").join(to, "cluster", "left").select("id", F.coalesce("to", "cluster").alias("cluster"))
            alone = kept.unionByName(alone.join(moved.select("id"), "id", "left_anti"))
        alone = materialise(alone, "moved")
        moved = materialise(alone.join(alone.groupBy("cluster").agg(F.count("*").cast("int").alias("size")), "cluster").select("id", "cluster", "size"), "moved")
        counted = band.select("a", "b", F.lit(1).cast("long").alias("n"))
        counted = counted if seen is None else counted.unionByName(seen.select("a", "b", "n"))
        for end in ("a", "b"):
            counted = counted.join(to.select(F.col("cluster").alias(end), "to"), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        before = seen
        seen = materialise(counted.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("n").alias("n")), "seen")
        release(band, part, alone, *([before] if before is not None else []))
    return out


def _forest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (i, j, dist) of a task without those that close a circle of shorter ones. They are reduced whenever many have
    come together, so memory follows the task's ids."""

    def reduced(rows: list[np.ndarray]) -> list[np.ndarray]:
        i, j, dist = (x[np.lexsort((rows[1], rows[0], rows[2]))] for x in rows)
        ids, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        parent = list(range(len(ids)))
        keep = np.zeros(len(i), bool)
        for k, (x, y) in enumerate(zip(at[: len(i)].tolist(), at[len(i) :].tolist())):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            while parent[y] != y:
                parent[y] = y = parent[parent[y]]
            if x != y:
                parent[max(x, y)] = min(x, y)
                keep[k] = True
        return [x[keep] for x in (i, j, dist)]

    held: list[list[np.ndarray]] = []
    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        if sum(len(x[0]) for x in held) > 1_000_000:
            held = [reduced([np.concatenate(x) for x in zip(*held)])]
    if held:
        yield pa.record_batch([pa.array(x) for x in reduced([np.concatenate(x) for x in zip(*held)])], names=["i", "j", "dist"])


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(i, j, dist): of each component the edges by which single linkage merges, with ties taken by (dist, i, j).

    Tasks drop what closes a circle among their own edges first. Then, in rounds, each cluster takes its shortest edge to
    another, and clusters so joined are one; at least half of them go in every round. No task holds a component."""
    typed = edges.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("dist").cast("int").alias("dist"))
    left = materialise(typed.mapInArrow(_forest_rows, "i long, j long, dist int").withColumn("a", F.col("i")).withColumn("b", F.col("j")), "forest")
    out = edges.sparkSession.createDataFrame([], "i long, j long, dist int")
    while not left.isEmpty():
        ends = left.select(F.inline(F.array(F.struct(F.col("a").alias("cluster"), "dist", "i", "j"), F.struct(F.col("b").alias("cluster"), "dist", "i", "j"))))
        nearest = ends.groupBy("cluster").agg(F.min(F.struct("dist", "i", "j")).alias("e")).select("e.i", "e.j", "e.dist").distinct()
        chosen = materialise(left.join(nearest, ["i", "j", "dist"], "left_semi"), "forest")
        out = out.unionByName(chosen.select("i", "j", "dist"))
        to = materialise(components(chosen, "a", "b"), "joined")
        after = left
        for end in ("a", "b"):
            after = after.join(to.withColumnRenamed("id", end), end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
        after = materialise(after.where("a <> b").select("i", "j", "dist", "a", "b"), "forest")
        release(left, to)
        left = after
    return out


def linkage(edges: DataFrame, method: str, psi: int | None = None, band: int = BAND_EDGES) -> DataFrame:
    """(i, j, dist), one row a pair, to merges (component, step, a, b, dist, members).

    Edges are taken by (dist, i, j), so ties have one order. ``psi`` (average only) stands for pairs without an edge;
    by default the largest distance of all edges. Complete linkage takes edges in bands of at least ``band``; a task has the
    edges of a band that hang together. For average linkage one component's edges must fit a Python worker, for the
    order of single linkage's merges one component's ids.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    edges = edges.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("dist").cast("int").alias("dist"))
    edges = materialise(edges, "edges")
    of = components(edges)
    if method == "complete":
        step = F.row_number().over(Window.partitionBy("component").orderBy("dist", "i", "j"))
        merges = _complete_merges(edges, band).join(of.withColumnRenamed("id", "a"), "a")
        return merges.select("component", step.alias("step"), "a", "b", F.col("dist").cast("double").alias("dist"), "members")
    far = psi if psi is not None else (edges.agg(F.max("dist")).first()[0] or 0)
    kernel = _average if method == "average" else _single
    placed = (edges if method == "average" else spanning_forest(edges)).join(of.withColumnRenamed("id", "i"), "i")

    def run(rows: list[list]) -> list[tuple]:
        component, dist, i, j = rows
        return [(component[0], step, *m) for step, m in enumerate(kernel(list(zip(i, j, dist)), far), 1)]

    return _per_component(placed.select("component", "dist", "i", "j"), ["dist", "i", "j"], run, MERGES)


def labels_at(merges: DataFrame, ids: DataFrame, cutoff: float) -> DataFrame:
    """(id, cluster): each id's cluster after all merges up to the cutoff; ids that no merge names are their own."""
    found = components(merges.where(F.col("dist") <= cutoff), "a", "b")
    return ids.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("component", F.col("id").cast("long")).alias("cluster"))


def snapshots(merges: DataFrame, ids: DataFrame, cutoffs: list[int]) -> DataFrame:
    """(cutoff, id, cluster) for each of the cutoffs. An id at a cutoff is a vertex of its own, so one search for
    components finds the clusters of all."""
    if not cutoffs:
        return ids.select(F.lit(0).alias("cutoff"), "id", F.col("id").cast("long").alias("cluster")).limit(0)
    n = len(cutoffs)
    listed = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("cutoff")) for k, c in enumerate(cutoffs)])
    due = merges.select("a", "b", "dist", F.inline(listed)).where("dist <= cutoff")
    found = components(due.select((F.col("a") * n + F.col("k")).alias("a"), (F.col("b") * n + F.col("k")).alias("b")), "a", "b")
    at = ids.select(F.col("id")).distinct().select("id", F.inline(listed)).withColumn("vertex", F.col("id").cast("long") * n + F.col("k"))
    named = at.join(found.withColumnRenamed("id", "vertex"), "vertex", "left")
    return named.select("cutoff", "id", F.when(F.col("component").isNull(), F.col("id").cast("long")).otherwise(((F.col("component") - F.col("k")) / n).cast("long")).alias("cluster"))


def mergeable(snap: DataFrame, edges: DataFrame, method: str, psi: int | None = None) -> DataFrame:
    """(cutoff, a, b), a < b: clusters of snapshots (cutoff, id, cluster) of complete or average linkage that should be one at
    the cutoff, as all pairs of their members have edges up to it, or as their mean distance is at most it."""
    far = psi if psi is not None else (edges.agg(F.max("dist")).first()[0] or 0)
    size = snap.groupBy("cutoff", "cluster").agg(F.count("*").alias("n"))
    i, j = snap.select("cutoff", F.col("id").alias("i"), F.col("cluster").alias("a")), snap.select("cutoff", F.col("id").alias("j"), F.col("cluster").alias("b"))
    between = edges.select("i", "j", "dist").join(i, "i").join(j, ["cutoff", "j"]).where("a <> b")
    if method == "complete":
        between = between.where("dist <= cutoff")
    met = between.groupBy("cutoff", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("seen"), F.sum("dist").alias("total"))
    met = met.join(size.select("cutoff", F.col("cluster").alias("a"), F.col("n").alias("na")), ["cutoff", "a"]).join(size.select("cutoff", F.col("cluster").alias("b"), F.col("n").alias("nb")), ["cutoff", "b"])
    pairs = F.col("na") * F.col("nb")
    due = F.col("seen") == pairs if method == "complete" else F.col("total") + far * (pairs - F.col("seen")) <= F.col("cutoff") * pairs
    return met.where(due).select("cutoff", "a", "b")


def between(merges: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, step, seen, total, na, nb): for each merge the edges between its two clusters as they were then, the sum
    of their distances, and the clusters' sizes, counted anew from the edges of the smaller one's members."""
    placed = edges.join(merges.select(F.col("component").alias("own"), F.explode(F.array("a", "b")).alias("i")).distinct(), "i")

    def run(log: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[tuple[int, int]]] = {}
        for i, j, dist in zip(rows["i"].tolist(), rows["j"].tolist(), rows["dist"].tolist()):
            near.setdefault(i, []).append((j, dist))
            near.setdefault(j, []).append((i, dist))
        members = {x: [x] for x in near}
        home = {x: x for x in near}
        out = []
        log = log.sort_values("step")
        for component, step, a, b in zip(*(log[c].tolist() for c in ("component", "step", "a", "b"))):
            na, nb = len(members[a]), len(members[b])
            small, large = (a, b) if na < nb else (b, a)
            met = [dist for x in members[small] for y, dist in near[x] if home[y] == home[members[large][0]]]
            out.append((component, step, len(met), sum(met), na, nb))
            for x in members[small]:
                home[x] = home[members[large][0]]
            members[large] += members.pop(small)
            members[a] = members.pop(large)
        return pd.DataFrame(out, columns=["component", "step", "seen", "total", "na", "nb"])

    grouped = merges.groupBy("component").cogroup(placed.groupBy("own"))
    return grouped.applyInPandas(run, "component long, step int, seen long, total long, na long, nb long")


def single_labels(edges: DataFrame, ids: DataFrame, cutoff: int) -> DataFrame:
    """Single linkage at a cutoff: the components of the edges up to it."""
    return labels_at(edges.select(F.col("i").alias("a"), F.col("j").alias("b"), "dist"), ids, cutoff)


def _text(root: tuple) -> str:
    """A node, two of (node or leaf, branch), as text; without recursion, and each part is written once, as trees can be as
    deep as they have leaves."""
    out, due = [], [root]
    while due:
        node = due.pop()
        if isinstance(node, str):
            out.append(node)
        else:
            (left, branch), (right, other) = node
            due += [other + ")", right, branch + ",", left, "("]
    return "".join(out)


def newick(merges: DataFrame) -> DataFrame:
    """(component, newick): a tree for each component; several if its merges leave several roots, joined by blanks.
    A node's branch is its parent's height less its own."""

    def run(rows: list[list]) -> list[tuple]:
        tree: dict[int, tuple[tuple | None, float]] = {}
        for a, b, dist in zip(*rows[2:5]):
            parts = [(x, *tree.pop(x, (None, 0.0))) for x in (a, b)]
            tree[a] = (tuple((node or str(x), f":{dist - height:g}") for x, node, height in parts), dist)
        return [(rows[0][0], " ".join(_text(node) + ";" for _, (node, _) in sorted(tree.items(), key=lambda e: e[0])))]

    return _per_component(merges.select("component", "step", "a", "b", "dist"), ["step"], run, "component long, newick string")

"""Groups of records linked directly or through others: union-find over a two-dimensional grid of blocks.

Method: vertices are hashed into ``g`` blocks and an edge goes to the cell of its two blocks. Each cell runs
union-find on its own edges and reports each of its vertices' local representative, the smallest id. A
vertex then takes the smallest of the representatives from its row and column of cells as its parent, and
unequal representatives become the edges of the next round, until none is left. A hub's edges spread over
its whole row, so no task gets more than a ``g``-th of them; before the first shuffle, each partition
reduces its edges to a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reedbed.plans.runtime import materialise, release, table

#: Edges that a cell of the grid holds on average.
CELL_EDGES = 200_000
_STARS = "v long, r long"


def local_union(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over arrays of edge ends: the vertices in order, and each one's smallest linked vertex.

    Roots are hooked under smaller roots for all edges at once and paths are then halved until flat, so
    the number of passes is about the logarithm of the longest chain."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    parent = np.arange(len(nodes))
    while True:
        pa_, pb = parent[a], parent[b]
        open_ = pa_ != pb
        if not open_.any():
            return nodes, nodes[parent]
        a, b, pa_, pb = a[open_], b[open_], pa_[open_], pb[open_]
        np.minimum.at(parent, np.maximum(pa_, pb), np.minimum(pa_, pb))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of one partition -> (v, r) for each of its vertices. Every 2 million edges are reduced
    to their forest, so memory follows the partition's vertices rather than its edges."""
    us: list[np.ndarray] = []
    vs: list[np.ndarray] = []

    def reduced() -> tuple[np.ndarray, np.ndarray]:
        return local_union(np.concatenate(us), np.concatenate(vs))

    for batch in batches:
        us.append(batch.column(0).to_numpy(zero_copy_only=False))
        vs.append(batch.column(1).to_numpy(zero_copy_only=False))
        if sum(map(len, us)) > 2_000_000:
            v, r = reduced()
            us, vs = [v], [r]
    if us:
        v, r = reduced()
        yield pa.record_batch([pa.array(v, pa.int64()), pa.array(r, pa.int64())], names=["v", "r"])


def _cell(grid: int) -> Column:
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(grid))
    x, y = block("u"), block("v")
    return F.least(x, y) * grid + F.greatest(x, y)


def groups(links: DataFrame, a: str, b: str, cell_edges: int = CELL_EDGES) -> DataFrame:
    """(vertex, group): every vertex with at least one link, and the smallest vertex linked to it directly or
    through others.

    Rows with a null end or with two equal ends link nothing. Repeated rows and either order are the same
    link. An empty table gives no rows; further columns are not read. Ends may be any integers.
    """
    spark = links.sparkSession
    ends = links.select(F.col(f"`{a}`").cast("long").alias("u"), F.col(f"`{b}`").cast("long").alias("v")).where("u <> v")
    edges = materialise(ends.mapInArrow(_stars, _STARS).select(F.col("v").alias("u"), F.col("r").alias("v")).where("u <> v").distinct(), "links")
    maps = []
    while (n := edges.count()) or not maps:
        grid = max(1, math.ceil(math.sqrt(2 * n / cell_edges)))
        cells = grid * (grid + 1) // 2
        stars = edges.repartition(cells, _cell(grid)).select("u", "v").mapInArrow(_stars, _STARS)
        # A vertex has at most one representative from each partition that holds cells of its row and column.
        seen = materialise(
            stars.groupBy("v").agg(F.min("r").alias("p"), F.collect_set("r").alias("all")), "representatives"
        )
        maps.append(seen.select(F.col("v"), F.col("p")))
        after = materialise(
            seen.where(F.size("all") > 1)
            .select("p", F.explode("all").alias("r"))
            .where("p <> r")
            .select(F.col("r").alias("u"), F.col("p").alias("v"))
            .distinct(),
            "links",
        )
        release(edges)
        edges = after
    found = maps.pop()
    while maps:
        later = found.select(F.col("v").alias("p"), F.col("p").alias("q"))
        found = maps.pop().join(later.hint("shuffle_hash"), "p", "left").select("v", F.coalesce("q", "p").alias("p"))
    return found.select(F.col("v").alias("vertex"), F.col("p").alias("group"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "thin_edge").where("dist BETWEEN 0 AND 1500")
    return groups(links, "seqi", "seqj").select(F.col("vertex").cast("int").alias("seq_id"), F.col("group").cast("int").alias("group_id"))


def p4_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each group."""
    return p4_found(spark, sf_dir).groupBy("group_id").agg(F.count("*").alias("members"))


QUERIES = {"p4_found": p4_found, "p4_sizes": p4_sizes}

_GROUPS = """
WITH RECURSIVE l AS (SELECT DISTINCT seqi AS a, seqj AS b FROM thin_edge WHERE seqi <> seqj AND dist BETWEEN 0 AND 1500),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(v, g) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.g FROM r JOIN e ON r.v = e.a WHERE r.g < e.b),
m AS (SELECT v AS seq_id, MIN(g) AS group_id FROM r GROUP BY v)"""
ORACLES = {
    "p4_found": f"{_GROUPS} SELECT seq_id, group_id FROM m",
    "p4_sizes": f"{_GROUPS} SELECT group_id, COUNT(*) AS members FROM m GROUP BY group_id",
}

"""Connected components of an edge list by rounds of joining edges in tasks and roots between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reedbed.plans.runtime import materialise, release

#: Edges that a task joins.
TASK_EDGES = 200_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of some edges, in order, and for each the smallest one joined to it by them."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return nodes, nodes[root]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (v, u) of one task -> (v, least vertex joined to it), roots too. Edges are reduced whenever a million have
    come together, so memory follows the task's vertices."""
    parts: list[list[np.ndarray]] = []
    for batch in batches:
        parts.append([c.to_numpy() for c in batch.columns])
        if sum(len(p[0]) for p in parts) > 1_000_000:
            parts = [list(forest(*(np.concatenate(x) for x in zip(*parts))))]
    if parts:
        v, u = forest(*(np.concatenate(x) for x in zip(*parts)))
        yield pa.record_batch([pa.array(v), pa.array(u)], names=["v", "u"])


def components(edges: DataFrame, i: str = "i", j: str = "j") -> DataFrame:
    """(id, component): each vertex of an edge, and the smallest vertex of its component.

    Null ends and self-edges join nothing. Each task joins the edges that it has; a vertex then takes the least of the
    vertices that the tasks gave it, and where they differ, these are the edges of the next round. Edges are dealt
    out at random, so a hub's edges are spread evenly, and a vertex meets at most one root for each task.
    """
    a, b = F.col(i).cast("long"), F.col(j).cast("long")
    left = materialise(edges.where(a != b).select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).mapInArrow(_stars, "v long, u long").where("v <> u").distinct(), "edges")
    rounds: list[DataFrame] = []
    while (n := left.count()) or not rounds:
        # As few tasks as their size allows: edges that meet in a task need no further round.
        stars = left.repartition(-(-n // TASK_EDGES) or 1, F.xxhash64("v", "u")).mapInArrow(_stars, "v long, u long")
        met = materialise(stars.groupBy("v").agg(F.min("u").alias("root"), F.collect_set("u").alias("roots")), "roots")
        rounds.append(met.select("v", "root"))
        after = met.where(F.size("roots") > 1).select(F.explode("roots").alias("v"), F.col("root").alias("u")).where("v <> u").distinct()
        release(left)
        left = materialise(after, "edges")
    found = rounds.pop()
    while rounds:
        later = found.select(F.col("v").alias("root"), F.col("root").alias("top"))
        found = rounds.pop().join(later, "root", "left").select("v", F.coalesce("top", "root").alias("root"))
    return found.select(F.col("v").alias("id"), F.col("root").alias("component"))

"""Packing texts into containers of fixed capacity by patterns of lengths.

Method: only the histogram of lengths matters, and it has at most as many entries as the capacity. Patterns that fill
a container exactly with few different lengths are enumerated, the number of times to use each is fitted to the
histogram by non-negative least squares and rounded down, and what is left is packed best-fit, largest first, on the
histogram too. Items then get ranks within their length, and a rank tells the container by arithmetic. The driver
works on the histogram and the plan alone, both bounded by the capacity; items never meet in one task.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reedbed.llm.bpe import encoder, vocabulary_path
from reedbed.plans.runtime import materialise, table

#: Tokens that a container holds.
CAPACITY = 2048
#: Steps of the least-squares fit, and patterns that it takes at most; of more, evenly spread ones are tried.
STEPS, PATTERNS = 400, 500_000

_SIZED = "doc_id long, part int, size int, chunk int, nth long"
Pattern = tuple[tuple[int, int], ...]


def patterns(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and how often each is taken, three of either in a row; unused places have the length 0.

    Up to three items of any lengths, and any number of one length with up to one item of another, all filling
    the container exactly. What patterns leave is packed anyway, so those left out above PATTERNS cost room only."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    rows: list[np.ndarray] = []
    below = np.cumsum(there)
    seconds = np.where(3 * lengths > capacity, below[lengths - 1] - below[np.maximum(0, np.minimum((capacity - lengths) // 2, lengths - 1))], 0)
    every = max(1, -(-int(np.maximum(seconds, 0).sum() + (capacity // lengths).sum()) // PATTERNS))
    for size in lengths:
        times = np.arange(1, capacity // size + 1, every)
        rest = capacity - times * size
        ok = there[rest] & (rest != size) | (rest == 0)
        n = ok.sum()
        rows.append(np.column_stack([np.full(n, size), rest[ok], np.zeros(n, int), times[ok], (rest[ok] > 0).astype(int), np.zeros(n, int)]))
        second = lengths[(lengths < size) & (2 * lengths > capacity - size)] if 3 * size > capacity else lengths[:0]
        second = second[::every]
        third = capacity - size - second
        ok = (third > 0) & (third < second)
        ok[ok] = there[third[ok]]
        n = ok.sum()
        rows.append(np.column_stack([np.full(n, size), second[ok], third[ok], np.ones((n, 3), int)]))
    both = np.unique(np.concatenate(rows), axis=0)
    return both[:, :3], both[:, 3:]


def fitted(histogram: np.ndarray, which: np.ndarray, times: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradient: how often to use each pattern so that the use of
    each length comes nearest to the histogram."""
    size = len(histogram)
    used = lambda x: np.bincount(which.ravel(), (times * x[:, None]).ravel(), size) * (np.arange(size) > 0)
    # The largest step that is safe follows from the largest eigenvalue, found by power iteration.
    v = np.ones(len(which))
    for _ in range(30):
        v = (times * used(v)[which]).sum(1)
        v /= np.linalg.norm(v) or 1
    largest = np.linalg.norm((times * used(v)[which]).sum(1)) or 1.0
    x = y = np.zeros(len(which))
    t = 1.0
    for _ in range(steps):
        after = np.maximum(0, y - (times * (used(y) - histogram)[which]).sum(1) / (1.05 * largest))
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y = after + (before - 1) / t * (after - x)
        x = after
    return x


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[int, Pattern]]:
    """Containers for a histogram, the largest lengths first, each into the open container with the least room that
    takes it. Containers that are alike are one entry with their number, so the time follows the lengths."""
    open_: list[tuple[int, int]] = []  # room, entry
    entries: list[list] = []  # number, pattern

    def put(number: int, pattern: list[tuple[int, int]], room: int) -> None:
        if number:
            entries.append([number, pattern])
            insort(open_, (room, len(entries) - 1))

    for size in range(capacity, 0, -1):
        n = int(left[size])
        while n:
            k = bisect_left(open_, (size, -1))
            if k < len(open_):
                room, entry = open_.pop(k)
                number, pattern = entries[entry]
                entries[entry][0] = 0
            else:
                each = capacity // size
                room, number, pattern = capacity, -(-n // each), []
            each = min(room // size, n)
            full = min(number, n // each)
            put(full, [*pattern, (size, each)], room - each * size)
            n -= full * each
            if full < number and 0 < n < each:
                put(1, [*pattern, (size, n)], room - n * size)
                full, n = full + 1, 0
            put(number - full, pattern, room)
    return [(number, tuple(pattern)) for number, pattern in entries if number and pattern]


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, Pattern]]:
    """(number of containers, ((length, items of it in each), ...)): all items of the histogram (by length, from 0)."""
    left = np.array(histogram, np.int64)
    left[0] = 0
    lengths = np.flatnonzero(left)
    out: list[tuple[int, Pattern]] = []
    if len(lengths):
        which, times = patterns(lengths, capacity)
        if len(which):
            x = fitted(left.astype(float), which, times)
            for k in np.argsort(-x, kind="stable"):
                if x[k] < 1:
                    break
                taken = [(int(a), int(n)) for a, n in zip(which[k], times[k]) if a and n]
                number = min(int(x[k]), *(int(left[a]) // n for a, n in taken))
                if number > 0:
                    for a, n in taken:
                        left[a] -= number * n
                    out.append((number, tuple(taken)))
        out += best_fit(left, capacity)
    return out


class Places:
    """Where the item of some rank within its length goes."""

    def __init__(self, planned: list[tuple[int, Pattern]], capacity: int):
        by_size: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)  # first rank, first container, items in each, first token
        ranks, self.containers = np.zeros(capacity + 1, np.int64), 0
        for number, pattern in planned:
            at = 0
            for size, each in pattern:
                by_size[size].append((int(ranks[size]), self.containers, each, at))
                ranks[size] += number * each
                at += size * each
            self.containers += number
        self.by_size = {size: np.array(rows, np.int64) for size, rows in by_size.items()}

    def find(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Containers from 1 and first tokens. Items without tokens take no room and are dealt out in turn."""
        container, start = rank % max(self.containers, 1), np.zeros(len(rank), np.int64)
        for value in np.unique(size[size > 0]):
            mine = np.flatnonzero(size == value)
            rows = self.by_size[int(value)]
            first, begun, each, at = rows[np.searchsorted(rows[:, 0], rank[mine], "right") - 1].T
            container[mine] = begun + (rank[mine] - first) // each
            start[mine] = at + (rank[mine] - first) % each * value
        return container + 1, start


def token_sizes(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, size): tokens of each whole text; 0 for null and empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([len(encode(x)) for x in batch.column(1).to_pylist()], pa.int64())], names=["doc_id", "size"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, size long")


def _numbered(capacity: int):
    """Splits what is longer than the capacity and numbers the items of each length within the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            size = batch.column(1).to_numpy()
            parts = np.maximum(1, -(-size // capacity))
            ends = np.cumsum(parts)
            part = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - parts, parts)
            own = np.minimum(np.repeat(size, parts) - part * capacity, capacity)
            order = np.argsort(own, kind="stable")
            counts = np.bincount(own, minlength=capacity + 1)
            nth = np.empty(len(own), np.int64)
            nth[order] = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(seen, counts)
            seen += counts
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(size)), parts)))
            yield pa.record_batch([ids, pa.array(part, pa.int32()), pa.array(own, pa.int32()), pa.array(np.full(len(own), chunk), pa.int32()), pa.array(nth)], names=["doc_id", "part", "size", "chunk", "nth"])

    return run


def packed(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, size) -> (doc_id, part, size, container_id, start): every item once, in a container from 1, from a
    token of it on. Only an item longer than the capacity is split, into full containers and a rest.

    Items of size 0 (null and empty texts) are dealt out over the containers; if there are no others, they all get
    container 1. Equal doc_ids are items of their own. An empty table gives no rows. A length that a third of all
    items have is ranked by partition first and the partitions' counts are summed, so it needs no common task.
    """
    sized = sizes.select("doc_id", F.greatest(F.col("size").cast("long"), F.lit(0)).alias("size"))
    items = materialise(sized.mapInArrow(_numbered(capacity), _SIZED), "items")
    counts = items.groupBy("chunk", "size").agg(F.count("*").alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for size, n in counts.groupBy("size").agg(F.sum("n")).collect():
        histogram[size] = n
    places = Places(plan(histogram, capacity), capacity)
    before = Window.partitionBy("size").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("chunk", "size", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = items.join(firsts, ["chunk", "size"]).select("doc_id", "part", "size", (F.col("first") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            container, start = places.find(batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy())
            yield pa.record_batch([*batch.columns[:3], pa.array(container), pa.array(start, pa.int32())], names=["doc_id", "part", "size", "container_id", "start"])

    return ranked.mapInArrow(place, "doc_id long, part int, size int, container_id long, start int")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(token_sizes(table(spark, sf_dir, "documents"), vocabulary_path()))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are: items, tokens and room left over of each fill."""
    each = p7_containers(spark, sf_dir).groupBy("container_id").agg(F.count("*").alias("items"), F.sum("size").alias("tokens"))
    return each.groupBy((F.lit(CAPACITY) - F.col("tokens")).alias("room")).agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"))


def p7_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the containers: documents in all; containers over the capacity or with overlapping items;
    documents split though they fit; and whether there are at most a hundredth more containers than tokens need."""
    items = materialise(p7_containers(spark, sf_dir), "containers")
    each = items.groupBy("container_id").agg(F.sum("size").alias("tokens"), F.max(F.col("start") + F.col("size")).alias("end"))
    wrong = each.agg(F.sum(((F.col("tokens") > CAPACITY) | (F.col("tokens") != F.col("end"))).cast("int")).cast("int").alias("wrong"), F.count("*").alias("containers"), F.sum("tokens").alias("tokens"))
    docs = items.agg(F.sum((F.col("part") == 0).cast("long")).alias("docs"))
    split = items.groupBy("doc_id").agg(F.sum("size").alias("tokens"), F.max("part").alias("part"))
    split = split.agg(F.sum(((F.col("part") > 0) & (F.col("tokens") <= CAPACITY)).cast("int")).cast("int").alias("split"))
    full = F.col("containers") <= F.greatest(F.lit(1), F.ceil(F.ceil(F.col("tokens") / CAPACITY) * 1.01))
    return docs.join(wrong).join(split).select("docs", "wrong", "split", full.alias("full"))


QUERIES = {"p7_containers": p7_containers, "p7_fill": p7_fill, "p7_checked": p7_checked}
ORACLES = {"p7_checked": "SELECT COUNT(*) AS docs, 0 AS wrong, 0 AS split, true AS full FROM documents"}

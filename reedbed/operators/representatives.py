"""Representatives of groups of sequences: (group, id, bases) rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reedbed.functions.sequences import SCALE, unaligned
from reedbed.operators.distances import RUN, compare_blocks, scaled_distances, stored_blocks
from reedbed.plans.runtime import materialise, shuffle_partitions

#: Members that a task compares with members at a time.
SLICE = 500


def squared_sums(rows: DataFrame, keys: list[str], min_overlap: int = 1) -> DataFrame:
    """keys, id -> score (sum of squared scaled distances to the other members) and farthest (the largest distance).

    Groups of up to SLICE members are sent to tasks as they are. A larger one is cut into slices of about so many, which are
    written once into the shared folder; a slice and up to RUN others are a piece of work of their own, so that a large
    group is spread over tasks, and partial sums are added. Members that share fewer columns than ``min_overlap`` have
    no distance and count as farthest apart, so that one that overlaps nobody isn't in the middle of all."""
    spark = rows.sparkSession
    rows = materialise(rows.select(*keys, "id", "bases").dropna(subset=keys), "members")
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / SLICE).cast("long").alias("slices")).where("slices > 1")
    large = materialise(sizes.withColumn("base", F.sum("slices").over(Window.orderBy(*keys)) - F.col("slices")), "groups")
    own = F.col("base") + F.pmod(F.xxhash64("id"), F.col("slices"))
    _, read = stored_blocks(rows.join(F.broadcast(large), keys).select(own.alias("block"), "id", "bases"))
    n = len(keys)
    types = [rows.schema[k].dataType for k in keys]
    schema = ", ".join([*(f"`{k}` {t.simpleString()}" for k, t in zip(keys, types)), "id long, score long, farthest long"])

    def distances(a: list[str], b: list[str], same: bool) -> np.ndarray:
        mismatches, overlap = compare_blocks(a, b)
        dist = np.where(overlap >= min_overlap, scaled_distances(mismatches, overlap), SCALE)
        if same:
            np.fill_diagonal(dist, 0)
        return dist

    def batch_of(key: tuple, kinds: list[pa.DataType], ids: np.ndarray, score: np.ndarray, farthest: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array([k] * len(ids), t) for k, t in zip(key, kinds)]
        return pa.record_batch([*columns, pa.array(ids), pa.array(score), pa.array(farthest)], names=[*keys, "id", "score", "farthest"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, texts, kinds = None, [], [], None

        def flush() -> Iterator[pa.RecordBatch]:
            if key is not None:
                dist = distances(texts, texts, True)
                yield batch_of(key, kinds, np.array(ids, np.int64), (dist**2).sum(1), dist.max(1))

        for batch in batches:
            kinds = [f.type for f in batch.schema][:n]
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:n] != key:
                    yield from flush()
                    key, ids, texts = row[:n], [], []
                ids.append(row[n])
                texts.append(row[n + 1])
        yield from flush()

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [f.type for f in batch.schema][:n]
            for *key, base, x, first, last in zip(*(c.to_pylist() for c in batch.columns)):
                ids, texts = read(base + x)
                score, farthest = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
                for y in range(first, last + 1):
                    y_ids, y_texts = (ids, texts) if x == y else read(base + y)
                    dist = distances(texts, y_texts, x == y)
                    score += (dist**2).sum(1)
                    farthest = np.maximum(farthest, dist.max(1, initial=0))
                    if x != y:
                        yield batch_of(tuple(key), kinds, y_ids, (dist**2).sum(0), dist.max(0, initial=0))
                yield batch_of(tuple(key), kinds, ids, score, farthest)

    parts = shuffle_partitions(spark)
    small = rows.join(F.broadcast(large.select(*keys)), keys, "left_anti").repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(whole, schema)
    runs = large.select(*keys, "base", "slices", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("x"))
    runs = runs.withColumn("first", F.explode(F.sequence("x", F.col("slices") - 1, F.lit(RUN).cast("long")))).withColumn("last", F.least(F.col("first") + RUN - 1, F.col("slices") - 1))
    # Pieces of neighbouring slices in one task, which adds up what they have in common.
    pieces = runs.select(*keys, "base", "x", "first", "last").repartitionByRange(8 * parts, "base", "x", "first")
    sums = pieces.mapInArrow(sliced, schema).groupBy(*keys, "id").agg(F.sum("score").alias("score"), F.max("farthest").alias("farthest"))
    return small.unionByName(sums)


def medoids(rows: DataFrame, keys: list[str], preferred: DataFrame | None = None, invert: bool = False) -> DataFrame:
    """keys, id, score, farthest: the member with the smallest sum of squared distances to the others, then the smallest
    id. With ``preferred`` (id) the best of those, if a group has any; ``invert`` prefers all others."""
    scored = squared_sums(rows, keys)
    best = F.min(F.struct("score", "id", "farthest")).alias("m")
    if preferred is not None:
        liked = scored.join(preferred.select("id", F.lit(True).alias("liked")).distinct(), "id", "left")
        scored = liked.withColumn("liked", F.coalesce("liked", F.lit(False)) != F.lit(invert))
        best = F.min(F.struct((~F.col("liked")).alias("other"), "score", "id", "farthest")).alias("m")
    return scored.groupBy(*keys).agg(best).select(*keys, F.col("m.id").alias("id"), F.col("m.score").alias("score"), F.col("m.farthest").alias("farthest"))


def longest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, letters: the member with the most letters, then the smallest id."""
    sized = rows.withColumn("letters", F.length(unaligned(F.col("bases"))))
    best = sized.groupBy(*keys).agg(F.max_by(F.struct("id", "letters"), F.struct("letters", -F.col("id"))).alias("m"))
    return best.select(*keys, F.col("m.id").alias("id"), F.col("m.letters").alias("letters"))

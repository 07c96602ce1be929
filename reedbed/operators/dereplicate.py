"""Dereplication, gap columns and masks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reedbed.functions.sequences import kept_columns, model_only, unaligned
from reedbed.operators.numbering import numbered

MODES = {"unaligned": unaligned, "aligned": lambda c: c, "formatted": model_only}


def _groups(seqs: DataFrame, mode: str, mask: list[int] | None, by_size: bool) -> tuple[DataFrame, DataFrame]:
    """Rows (ord, seq_name, bases) after the mode's preparation, and the numbered groups (ex_ord, bases, size, ex_id)."""
    prepared = kept_columns(F.col("bases"), mask) if mask is not None else MODES[mode](F.col("bases"))
    rows = seqs.where(F.col("bases").isNotNull()).select("ord", "seq_name", prepared.alias("bases"))
    groups = rows.groupBy("bases").agg(F.min("ord").alias("ex_ord"), F.count("*").alias("size"))
    if not by_size:
        return rows, numbered(groups, ["ex_ord"], "ex_id")
    keyed = groups.withColumn("rank_size", -F.col("size")).withColumn("rank_ord", -F.col("ex_ord"))
    return rows, numbered(keyed, ["rank_size", "rank_ord"], "ex_id").drop("rank_size", "rank_ord")


def exemplars(seqs: DataFrame, mode: str = "unaligned", mask: list[int] | None = None, by_size: bool = False) -> DataFrame:
    """(ord, seq_name, bases) -> (ex_id, seq_name, bases, size), see :func:`dereplicate`."""
    rows, ids = _groups(seqs, mode, mask, by_size)
    return _named(rows, ids)


def _named(rows: DataFrame, ids: DataFrame) -> DataFrame:
    names = rows.select(F.col("ord").alias("ex_ord"), "seq_name")
    return ids.join(names, "ex_ord").select("ex_id", "seq_name", "bases", "size")


def dereplicate(seqs: DataFrame, mode: str = "unaligned", mask: list[int] | None = None, by_size: bool = False) -> tuple[DataFrame, DataFrame]:
    """(ord, seq_name, bases) -> exemplars (ex_id, seq_name, bases, size) and the mapping (ex_id, place, seq_name).

    Sequences are the same if their bases are, case included, after the mode's preparation (``mask``: the columns
    to keep). The exemplar is the first by ``ord``; numbers from 0 follow the exemplars' ``ord``, or with
    ``by_size`` the size descending, then the later exemplar first. Null bases are left out; empty ones are a
    group. ``ord`` must be unique. A hot group's bases combine before the shuffle; its names are numbered by
    range, never collected. :func:`exemplars` does without the mapping.
    """
    rows, ids = _groups(seqs, mode, mask, by_size)
    members = rows.join(ids.select("bases", "ex_id"), "bases").select("ex_id", "ord", "seq_name")
    placed = numbered(members, ["ex_id", "ord"], "_at")
    first = placed.groupBy("ex_id").agg(F.min("_at").alias("_first"))
    return _named(rows, ids), placed.join(first, "ex_id").select("ex_id", (F.col("_at") - F.col("_first")).alias("place"), "seq_name")


def _used_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns that hold a base in any row of the partition; and the longest row's length, as a negative number."""
    used, longest = np.zeros(0, bool), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            row = np.frombuffer(text.encode("latin-1", "replace"), np.uint8)
            longest = max(longest, len(row))
            if len(row) > len(used):
                used = np.concatenate([used, np.zeros(len(row) - len(used), bool)])
            used[: len(row)] |= (row != ord("-")) & (row != ord("."))
    yield pa.record_batch([pa.array(np.concatenate([np.flatnonzero(used) + 1, [-longest]]), pa.int32())], names=["column"])


def used_columns(seqs: DataFrame) -> DataFrame:
    """(column): columns, from 1, in which any sequence has a base, and minus the length of the longest row. What
    is shuffled is bounded by the width and the partitions."""
    return seqs.where(F.col("bases").isNotNull()).select("bases").mapInArrow(_used_columns, "column int").distinct()


def common_gaps(seqs: DataFrame) -> DataFrame:
    """(column): columns in which no sequence has a base; a row's missing end counts as gaps."""
    found = used_columns(seqs)
    width = found.agg(F.coalesce(-F.min("column"), F.lit(0)).alias("width"))
    every = width.where("width > 0").select(F.explode(F.sequence(F.lit(1), F.col("width"))).alias("column"))
    return every.join(found, "column", "left_anti")


def remove_common_gaps(seqs: DataFrame) -> DataFrame:
    """Sequences without their common gap columns. The kept columns, bounded by the width, are read first."""
    kept = sorted(r[0] for r in used_columns(seqs).where("column > 0").collect())
    return seqs.withColumn("bases", kept_columns(F.col("bases"), kept))


def mask_columns(seqs: DataFrame, mask: str) -> DataFrame:
    """Sequences at the columns where the mask sequence has a base."""
    return seqs.withColumn("bases", kept_columns(F.col("bases"), [k for k, c in enumerate(mask, 1) if c not in "-."]))


def length_check(seqs: DataFrame) -> DataFrame:
    """(bases_length, seqs): aligned sequences have one row here."""
    return seqs.groupBy(F.length("bases").alias("bases_length")).agg(F.count("*").alias("seqs"))

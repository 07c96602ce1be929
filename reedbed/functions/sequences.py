"""Expressions on sequences, distances and cutoffs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Gap characters, and the whole numbers that stand for a distance of 1.
GAPS = "-."
SCALE = 10000


def clean_bases(raw: Column) -> Column:
    """Letters and gaps of raw bytes; line ends and all else go."""
    return F.regexp_replace(raw.cast("string"), "[^A-Za-z.-]", "")


def unaligned(bases: Column) -> Column:
    """Without gaps."""
    return F.translate(bases, GAPS, "")


def model_only(bases: Column) -> Column:
    """Columns of the model: upper-case letters and ``-``; lower case and ``.`` are insertions."""
    return F.regexp_replace(bases, "[a-z.]", "")


def runs(positions: Sequence[int]) -> list[tuple[int, int]]:
    """Ascending positions as (first, length) of their runs."""
    out: list[tuple[int, int]] = []
    for p in positions:
        if out and sum(out[-1]) == p:
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((p, 1))
    return out


def kept_columns(bases: Column, positions: Sequence[int]) -> Column:
    """The columns at the positions (from 1), one ``substring`` for each of their runs."""
    parts = [F.substring(bases, first, n) for first, n in runs(positions)]
    return F.concat(*parts) if parts else F.when(bases.isNotNull(), F.lit(""))


def scaled(distance: Column) -> Column:
    """A distance in whole numbers, half a unit rounded up, in single precision."""
    return F.floor(distance.cast("float") * F.lit(float(SCALE)).cast("float") + F.lit(0.5).cast("float")).cast("int")


def unscaled(dist: Column) -> Column:
    return (dist / F.lit(SCALE)).cast("float")


def scaled_ratio(mismatches: Column, overlap: Column) -> Column:
    """The scaled distance of mismatches in an overlap, by whole numbers only, so that every engine agrees."""
    return ((mismatches * F.lit(2 * SCALE) + overlap) / (overlap * F.lit(2))).cast("long").cast("int")


def up_to_step(dist: Column, step: int) -> Column:
    """The first multiple of the step that is not below the distance."""
    return (F.ceil(dist / F.lit(step)) * F.lit(step)).cast("int")


def same_cutoff(distance: Column) -> Column:
    """Cutoffs are equal if they agree to three decimals."""
    return (F.round(distance * 1000) * 10).cast("int")


def file_stem(path: Column) -> Column:
    """The last part of a path without its last suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")

"""Records that differ only in how they are written: canonical form, external sort, scan of adjacent runs.

Method: every record gets a canonical key; the rows are range-partitioned by (hash of the key, key, row
number) and sorted externally by Spark; each partition is then scanned once and adjacent full keys are
compared. Because the row number is part of the range key, a key that holds a third of all rows is spread
over many partitions; runs that cross partition ends are joined afterwards from one summary row a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reedbed.plans.runtime import materialise, release, shuffle_partitions, table

#: The keys that a field of attrs may have.
FIELD_KEYS = ("sample", "fwd", "rev", "run", "depth")

_SCANNED = "rec_no long, keep_rec long, part int, in_first boolean, first_key string, last_key string, one_run boolean"


def plain(text: Column, kept: str = "A-Za-z0-9") -> Column:
    """ASCII characters of the class ``kept``, in lower case; null gives an empty string. Other characters go
    before the case is changed: some of them have ASCII letters as their lower case."""
    return F.lower(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), f"[^{kept}]", ""))


def canonical_key(id_: Column, attrs: Column, bases: Column) -> Column:
    """One string that is equal exactly for records that are the same.

    A field begins at a key followed by ``=`` or ``:`` and lasts to the next one; what stands before the
    first field doesn't count. No field key is the start of another, so key and value need no mark between them.
    """
    marked = F.regexp_replace(plain(attrs, "A-Za-z0-9=:"), f"({'|'.join(FIELD_KEYS)})[=:]", "|$1")
    fields = F.slice(F.split(F.translate(marked, "=:", ""), "\\|"), 2, 1_000_000_000)
    return F.concat_ws("\u0001", plain(id_), F.array_join(F.array_sort(F.array_distinct(fields)), "|"), plain(bases, "A-Za-z"))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, rec_no) in order: each with the first rec_no of its run, then one row about the partition."""
    part = TaskContext.get().partitionId()
    first_key = last_key = keep = None
    in_first = True
    schema = pa.schema([("rec_no", pa.int64()), ("keep_rec", pa.int64()), ("part", pa.int32()), ("in_first", pa.bool_()), ("first_key", pa.string()), ("last_key", pa.string()), ("one_run", pa.bool_())])
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys, recs = batch.column(0), batch.column(1)
        starts = pa.concat_arrays([pa.array([keys[0].as_py() != last_key]), pc.not_equal(keys[1:], keys[: n - 1]).cast(pa.bool_())])
        if first_key is None:
            first_key = keys[0].as_py()
            starts = pa.concat_arrays([pa.array([True]), starts[1:]])
            after_first = pc.greater(pc.cumulative_sum(starts.cast(pa.int64())), 1)
        else:
            after_first = pc.greater(pc.cumulative_sum(starts.cast(pa.int64())), 0 if in_first else -1)
        firsts = pc.if_else(starts, recs, pa.scalar(None, pa.int64()))
        if keep is not None and not starts[0].as_py():
            firsts = pa.concat_arrays([pa.array([keep], pa.int64()), firsts[1:]])
        keeps = pc.fill_null_forward(firsts)
        in_first_rows = pc.invert(after_first)
        in_first = in_first_rows[n - 1].as_py()
        last_key, keep = keys[n - 1].as_py(), keeps[n - 1].as_py()
        none = pa.nulls(n, pa.string())
        yield pa.record_batch([recs, keeps, pa.array([part] * n, pa.int32()), in_first_rows, none, none, pa.nulls(n, pa.bool_())], schema=schema)
    if first_key is not None:
        yield pa.record_batch([pa.array([x], f.type) for x, f in zip([None, keep, part, False, first_key, last_key, in_first], schema)], schema=schema)


def first_of_each(keyed: DataFrame, partitions: int | None = None) -> DataFrame:
    """(key, rec_no) -> (rec_no, keep_rec): the smallest rec_no with the same key. Rows without rec_no are left out.

    Two passes over the sorted rows' small results: one row a partition is ordered by partition number, in
    one task, to carry the first rec_no of a run over partition ends; the number of partitions bounds it.
    """
    spark = keyed.sparkSession
    order = ["order", "key", "rec_no"]
    # Written first: finding the ranges reads the rows once more, and keys cost more to make than to read.
    written = materialise(keyed.where(F.col("rec_no").isNotNull()).withColumn("order", F.xxhash64("key")), "keys")
    ranged = (
        written.repartitionByRange(partitions or shuffle_partitions(spark), *order)
        .sortWithinPartitions(*order)
    )
    scanned = materialise(ranged.select("key", "rec_no").mapInArrow(_scan, _SCANNED), "runs")
    release(written)
    by_part = Window.orderBy("part")
    before = by_part.rowsBetween(Window.unboundedPreceding, -1)
    joins = F.coalesce(F.col("first_key") == F.lag("last_key").over(by_part), F.lit(False))
    ends = (
        scanned.where(F.col("rec_no").isNull())
        .withColumn("joins", joins)
        .withColumn("own", F.when(~(F.col("joins") & F.col("one_run")), F.col("keep_rec")))
        .withColumn("carried", F.when(F.col("joins"), F.last("own", ignorenulls=True).over(before)))
        .where("joins")
        .select("part", "carried")
    )
    rows = scanned.where(F.col("rec_no").isNotNull()).select("rec_no", "keep_rec", "part", "in_first")
    return rows.join(F.broadcast(ends), "part", "left").select(
        "rec_no", F.when(F.col("in_first"), F.coalesce("carried", "keep_rec")).otherwise(F.col("keep_rec")).alias("keep_rec")
    )


def same_records(records: DataFrame) -> DataFrame:
    """(rec_no, id, attrs, bytes) -> (rec_no, keep_rec) for every record.

    Null, empty and blank columns are all the same empty value; a record without anything in any column is
    the same as every other such record. An empty table gives no rows; further columns are not read. Texts of
    any length count whole. Rows with the same rec_no and content are one record.
    """
    return first_of_each(records.select(canonical_key(F.col("id"), F.col("attrs"), F.col("bytes")).alias("key"), "rec_no"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_records(table(spark, sf_dir, "raw_seq")).where("keep_rec < rec_no").select("keep_rec", F.col("rec_no").alias("copy_rec"))


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct record once, with the number of its copies, itself among them."""
    return same_records(table(spark, sf_dir, "raw_seq")).groupBy("keep_rec").agg(F.count("*").alias("copies"))


QUERIES = {"p3_found": p3_found, "p3_counts": p3_counts}

_KEYED = """
WITH k AS (SELECT rec_no,
    lower(regexp_replace(COALESCE(id, ''), '[^A-Za-z0-9]', '', 'g')) AS a,
    list_aggregate(list_sort(list_distinct(list_slice(str_split(translate(regexp_replace(lower(regexp_replace(COALESCE(attrs, ''),
      '[^A-Za-z0-9=:]', '', 'g')), '(sample|fwd|rev|run|depth)[=:]', '|\\1', 'g'), '=:', ''), '|'), 2, 1000000))), 'string_agg', '|') AS b,
    lower(regexp_replace(COALESCE(decode(bytes), ''), '[^A-Za-z]', '', 'g')) AS c
  FROM raw_seq WHERE rec_no IS NOT NULL),
g AS (SELECT rec_no, MIN(rec_no) OVER (PARTITION BY a, COALESCE(b, ''), c) AS keep_rec FROM k)"""
ORACLES = {
    "p3_found": f"{_KEYED} SELECT keep_rec, rec_no AS copy_rec FROM g WHERE keep_rec < rec_no",
    "p3_counts": f"{_KEYED} SELECT keep_rec, COUNT(*) AS copies FROM g GROUP BY keep_rec",
}

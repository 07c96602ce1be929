"""Cluster snapshots as tables, matrices and documents. A snapshot row: (cutoff, cluster_no, sample, seq_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample_label(sample: Column) -> Column:
    """Without the marks of preprocessing in the name."""
    return F.replace(F.replace(sample, F.lit("aligned_")), F.lit("_trimmed"))


def counts(snap: DataFrame) -> DataFrame:
    """(cutoff, cluster_no, sample, n)."""
    return snap.groupBy("cutoff", "cluster_no", "sample").agg(F.countDistinct("seq_id").alias("n"))


def dense(snap: DataFrame) -> DataFrame:
    """Counts with a row of 0 for each sample that a cluster of the cutoff has no member of.

    Every cluster of a cutoff meets every sample of that cutoff by an equi-join on the cutoff."""
    found = counts(snap)
    clusters = found.select("cutoff", "cluster_no").distinct()
    samples = found.select("cutoff", "sample").distinct()
    return clusters.join(samples, "cutoff").join(found, ["cutoff", "cluster_no", "sample"], "left").select("cutoff", "cluster_no", "sample", F.coalesce("n", F.lit(0)).alias("n"))


def weighted(snap: DataFrame, weights: DataFrame) -> DataFrame:
    """(cutoff, cluster_no, sample, n): sums of weights (seq_id, weight), cut to whole numbers. An id without a weight
    is an error in the reports that need one, so it gives null here rather than a silent 0."""
    rows = snap.distinct().join(weights, "seq_id", "left")
    total = F.when(F.count(F.when(F.col("weight").isNull(), 1)) == 0, F.sum("weight")).cast("int")
    return rows.groupBy("cutoff", "cluster_no", "sample").agg(total.alias("n"))


def at_cutoff(cutoffs: DataFrame, requested: int) -> DataFrame:
    """(requested, found): the last listed cutoff that is not above the requested one, else the first listed."""
    return cutoffs.agg(F.coalesce(F.max(F.when(F.col("cutoff") <= requested, F.col("cutoff"))), F.min("cutoff")).alias("found")).select(F.lit(requested).alias("requested"), "found")


def table_range(snap: DataFrame, start: int, end: int, step: int = 100) -> DataFrame:
    """(requested, cluster_no, sample, n): the table of each cutoff from start to end; 10000 is a distance of 1."""
    if not 0 <= start <= end <= 5000:
        raise ValueError("cutoffs must be from 0 to 0.5, the first not above the last")
    listed = snap.select("cutoff").distinct()
    wanted = snap.sparkSession.range(start, end + 1, step).select(F.col("id").cast("int").alias("requested"))
    below = wanted.join(F.broadcast(listed), F.col("cutoff") <= F.col("requested"), "left").groupBy("requested").agg(F.max("cutoff").alias("below"))
    first = listed.agg(F.min("cutoff").alias("first"))
    found = below.join(F.broadcast(first)).select("requested", F.coalesce("below", "first").alias("cutoff"))
    return found.join(counts(snap), "cutoff").select("requested", "cluster_no", "sample", "n")


def otu_names(snap: DataFrame) -> DataFrame:
    """(cutoff, cluster_no, otu): OTU_ and the number, padded with zeros to the width of the cutoff's last."""
    width = snap.groupBy("cutoff").agg(F.length(F.max("cluster_no").cast("string")).alias("width"))
    return snap.select("cutoff", "cluster_no").distinct().join(width, "cutoff").select("cutoff", "cluster_no", F.concat(F.lit("OTU_"), F.lpad(F.col("cluster_no").cast("string"), F.col("width"), F.lit("0"))).alias("otu"))


def wide(snap: DataFrame, cutoff: int) -> DataFrame:
    """One row a sample, one column a cluster: the table that statistics programs read. Meant for a cutoff with few
    clusters; Spark refuses more than its limit of pivot values."""
    one = snap.where(F.col("cutoff") == cutoff)
    named = counts(one).join(otu_names(one), ["cutoff", "cluster_no"])
    return named.withColumn("sample", sample_label(F.col("sample"))).groupBy("sample").pivot("otu").agg(F.sum("n")).na.fill(0)


def rows(snap: DataFrame) -> DataFrame:
    """(cutoff, sample, otus, counts): the tables of all cutoffs, one row a sample, with arrays in place of columns, so
    without a limit of clusters. Zeros are there; otus are in order of their names."""
    named = dense(snap).join(otu_names(snap), ["cutoff", "cluster_no"]).groupBy("cutoff", sample_label(F.col("sample")).alias("sample"), "otu").agg(F.sum("n").alias("n"))
    cells = named.groupBy("cutoff", "sample").agg(F.array_sort(F.collect_list(F.struct("otu", "n"))).alias("cells"))
    return cells.select("cutoff", "sample", F.col("cells.otu").alias("otus"), F.col("cells.n").alias("counts"))


def biom_rows(snap: DataFrame) -> DataFrame:
    """(cutoff, row, column_id, value): cells of the dense matrix, clusters as rows, samples as columns."""
    return dense(snap).select("cutoff", F.concat(F.lit("cluster_"), "cluster_no").alias("row"), F.col("sample").alias("column_id"), F.col("n").alias("value"))


def biom_json(snap: DataFrame, cutoff: int, date: str) -> DataFrame:
    """(json): one line a cluster of the dense matrix document's parts: its id and its counts by sample, in order of the
    sample's name. The head with shape and columns is the first line."""
    cells = biom_rows(snap.where(F.col("cutoff") == cutoff))
    data = cells.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("column_id", "value"))).alias("cells"))
    lines = data.select(F.col("row").alias("id"), F.to_json(F.struct(F.col("row").alias("id"), F.col("cells.value").alias("data"))).alias("json"))
    columns = cells.select("column_id").distinct().agg(F.array_sort(F.collect_list("column_id")).alias("columns"))
    shape = cells.agg(F.countDistinct("row").alias("rows"), F.countDistinct("column_id").alias("cols"))
    head = columns.join(F.broadcast(shape)).select(
        F.lit("").alias("id"),
        F.to_json(F.struct(F.lit("Biological Observation Matrix 1.0.0").alias("format"), F.lit("OTU table").alias("type"), F.lit("dense").alias("matrix_type"), F.lit("int").alias("matrix_element_type"), F.lit(date).alias("date"), F.array("rows", "cols").alias("shape"), "columns")).alias("json"),
    )
    return head.unionByName(lines)

"""The test tables seen as the inputs of the library's operators, in Spark and as SQL of the same content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reedbed.functions.sequences import clean_bases
from reedbed.plans.runtime import table

#: Scaled distance up to which an edge is in the matrix.
MATRIX_CUTOFF = 1500


def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, seq_name, descr, bases): each sequence of int_seq once."""
    rows = table(spark, sf_dir, "int_seq").where("id IS NOT NULL AND bytes IS NOT NULL")
    return rows.select("id", F.concat(F.lit("s"), F.col("id")).alias("seq_name"), F.lit("").alias("descr"), clean_bases(F.col("bytes")).alias("bases")).distinct()


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, seq_name, bases): records as files gave them."""
    rows = table(spark, sf_dir, "raw_seq").where("bytes IS NOT NULL")
    return rows.select(F.col("rec_no").alias("ord"), F.concat(F.lit("r"), F.col("rec_no")).alias("seq_name"), clean_bases(F.col("bytes")).alias("bases"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, j, dist), i < j: the smallest distance of each pair that is in the matrix."""
    rows = table(spark, sf_dir, "thin_edge").where((F.col("seqi") != F.col("seqj")) & F.col("dist").between(0, MATRIX_CUTOFF))
    return rows.groupBy(F.least("seqi", "seqj").alias("i"), F.greatest("seqi", "seqj").alias("j")).agg(F.min("dist").alias("dist"))


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id): ends of edges."""
    return edges(spark, sf_dir).select(F.explode(F.array("i", "j")).alias("id")).distinct()


def id_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "id_map").select("ex_id", "place", "seq_name").dropna().distinct()


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sample_map").select("seq_name", "sample", F.col("row_no").alias("ord")).dropna()


def snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "cluster_row").select("cutoff", "cluster_no", "sample", "seq_id").dropna().distinct()


def seeds(spark: SparkSession, sf_dir: str) -> list[tuple[int, str]]:
    """The reference seeds: a fixed table of 120 rows."""
    rows = table(spark, sf_dir, "seed_seq").dropna(subset=["id", "bytes"]).select("id", clean_bases(F.col("bytes")))
    return [tuple(r) for r in rows.orderBy("id").collect()]


_BASES = "regexp_replace(decode(bytes), '[^A-Za-z.-]', '', 'g')"
SQL = {
    "seqs": f"seqs AS (SELECT DISTINCT id, 's' || id AS seq_name, '' AS descr, {_BASES} AS bases FROM int_seq WHERE id IS NOT NULL AND bytes IS NOT NULL)",
    "raw": f"raw AS (SELECT rec_no AS ord, 'r' || rec_no AS seq_name, {_BASES} AS bases FROM raw_seq WHERE bytes IS NOT NULL)",
    "edges": f"edges AS (SELECT least(seqi, seqj) AS i, greatest(seqi, seqj) AS j, MIN(dist) AS dist FROM thin_edge WHERE seqi <> seqj AND dist BETWEEN 0 AND {MATRIX_CUTOFF} GROUP BY least(seqi, seqj), greatest(seqi, seqj))",
    "linked": "linked AS (SELECT i AS id FROM edges UNION SELECT j FROM edges)",
    "ids": "ids AS (SELECT DISTINCT ex_id, place, seq_name FROM id_map WHERE ex_id IS NOT NULL AND place IS NOT NULL AND seq_name IS NOT NULL)",
    "samples": "samples AS (SELECT seq_name, sample, row_no AS ord FROM sample_map WHERE seq_name IS NOT NULL AND sample IS NOT NULL AND row_no IS NOT NULL)",
    "snap": "snap AS (SELECT DISTINCT cutoff, cluster_no, sample, seq_id FROM cluster_row WHERE cutoff IS NOT NULL AND cluster_no IS NOT NULL AND sample IS NOT NULL AND seq_id IS NOT NULL)",
    # Exemplars: of equal bases the smallest id; padded to one width, and their masks of letters.
    "padded": "padded AS (SELECT id, upper(rpad(replace(bases, '.', '-'), (SELECT CAST(MAX(length(bases)) AS INT) FROM seqs), '-')) AS b FROM (SELECT MIN(id) AS id, bases FROM seqs GROUP BY bases))",
    "enc": "enc AS (SELECT id, b, regexp_replace(b, '[A-Z]', '1', 'g') AS m, length(replace(b, '-', '')) AS n FROM padded)",
    # hamming of the bases counts mismatches and columns that only one has a letter in; of the masks, the latter.
    "pairs": "pairs AS (SELECT x.id AS a, y.id AS b, hamming(x.b, y.b) - hamming(x.m, y.m) AS mm, (x.n + y.n - hamming(x.m, y.m)) // 2 AS ov FROM enc x JOIN enc y ON x.id < y.id)",
}


def with_views(*names: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(SQL[x] for x in names)


def exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, bases): of equal bases the smallest id."""
    return seqs(spark, sf_dir).groupBy("bases").agg(F.min("id").alias("id"))

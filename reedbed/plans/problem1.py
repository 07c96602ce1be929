"""Queries of problem 1 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reedbed.operators.orphans import COLUMNS, Link, Reference, find_orphans, orphan_report, stretches
from reedbed.plans.runtime import table

REFERENCES = (
    Reference("thin_edge", "seqi", "sequence"),
    Reference("thin_edge", "seqj", "sequence"),
    Reference("cluster_row", "seq_id", "sequence"),
    Reference("id_map", "ex_id", "sequence"),
    Reference("cluster_row", "sample", "sample"),
    Reference("sample_map", "sample", "sample"),
)
#: Two levels: names whose exemplars are orphaned, and samples whose names all are.
LINKS = (Link("sample_map", "seq_name", "id_map", "seq_name"), Link("cluster_row", "sample", "sample_map", "sample"))


def _graph(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    tables = {x: table(spark, sf_dir, x) for x in dict.fromkeys(r.table for r in REFERENCES)}
    targets = {
        "sequence": stretches(table(spark, sf_dir, "int_seq"), "id", "added_at", "removed_at").unionByName(
            stretches(table(spark, sf_dir, "seed_seq"), "id")
        ),
        "sample": stretches(table(spark, sf_dir, "cluster_sample"), "name", "added_at", "removed_at"),
    }
    return tables, targets


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level 0 of the cascade."""
    return p1_cascade(spark, sf_dir).where("level = 0").select(*COLUMNS)


def p1_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct orphans, names in sample_map whose every row in id_map is orphaned, and samples in cluster_row whose every
    row in sample_map is, directly or by its name."""
    tables, targets = _graph(spark, sf_dir)
    return find_orphans(tables, REFERENCES, targets, LINKS)


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(p1_cascade(spark, sf_dir))


QUERIES = {"p1_found": p1_found, "p1_cascade": p1_cascade, "p1_report": p1_report}

_FOUND = """
WITH t AS (
  SELECT 'n' AS space, CAST(id AS VARCHAR) AS key, added_at, removed_at FROM int_seq WHERE id IS NOT NULL
  UNION ALL SELECT 'n', CAST(id AS VARCHAR), NULL, NULL FROM seed_seq WHERE id IS NOT NULL
  UNION ALL SELECT 's', name, added_at, removed_at FROM cluster_sample WHERE name IS NOT NULL),
r AS (
  SELECT 'n' AS space, 'thin_edge' AS table_name, row_no, 'seqi' AS field_name, CAST(seqi AS VARCHAR) AS key, made_at FROM thin_edge
  UNION ALL SELECT 'n', 'thin_edge', row_no, 'seqj', CAST(seqj AS VARCHAR), made_at FROM thin_edge
  UNION ALL SELECT 'n', 'cluster_row', row_no, 'seq_id', CAST(seq_id AS VARCHAR), made_at FROM cluster_row
  UNION ALL SELECT 'n', 'id_map', row_no, 'ex_id', CAST(ex_id AS VARCHAR), made_at FROM id_map
  UNION ALL SELECT 's', 'cluster_row', row_no, 'sample', sample, made_at FROM cluster_row
  UNION ALL SELECT 's', 'sample_map', row_no, 'sample', sample, made_at FROM sample_map),
j AS (
  SELECT r.table_name, r.row_no, r.field_name, r.made_at, COUNT(t.key) AS n,
    COUNT(CASE WHEN t.key IS NOT NULL AND (t.added_at IS NULL OR t.added_at <= r.made_at)
               AND (t.removed_at IS NULL OR r.made_at < t.removed_at) THEN 1 END) AS there,
    COUNT(CASE WHEN t.key IS NOT NULL AND (t.added_at IS NULL OR t.added_at <= r.made_at) THEN 1 END) AS begun
  FROM r LEFT JOIN t ON r.space = t.space AND r.key = t.key
  WHERE r.key IS NOT NULL GROUP BY r.table_name, r.row_no, r.field_name, r.made_at),
direct AS (
  SELECT table_name, row_no, field_name, COALESCE(strftime(made_at, '%Y-%m'), 'unknown') AS period,
    CASE WHEN n = 0 THEN 'missing' WHEN begun = 0 THEN 'late' ELSE 'deleted' END AS kind
  FROM j WHERE n = 0 OR (made_at IS NOT NULL AND there = 0))"""
_CASCADE = f"""{_FOUND},
dead AS (
  SELECT m.seq_name AS key FROM id_map m
  LEFT JOIN (SELECT DISTINCT row_no FROM direct WHERE table_name = 'id_map') d ON m.row_no = d.row_no
  WHERE m.seq_name IS NOT NULL GROUP BY m.seq_name HAVING COUNT(*) = COUNT(d.row_no)),
one AS (
  SELECT s.row_no FROM sample_map s WHERE s.seq_name IN (SELECT key FROM dead)),
known AS (
  SELECT DISTINCT row_no FROM direct WHERE table_name = 'sample_map'),
first AS (
  SELECT m.sample AS key FROM sample_map m LEFT JOIN known k ON m.row_no = k.row_no
  WHERE m.sample IS NOT NULL GROUP BY m.sample HAVING COUNT(*) = COUNT(k.row_no)),
second AS (
  SELECT m.sample AS key FROM sample_map m LEFT JOIN (SELECT row_no FROM known UNION SELECT row_no FROM one) k ON m.row_no = k.row_no
  WHERE m.sample IS NOT NULL GROUP BY m.sample HAVING COUNT(*) = COUNT(k.row_no)),
every AS (
  SELECT table_name, row_no, field_name, period, kind, 0 AS level FROM direct
  UNION ALL SELECT 'sample_map', s.row_no, 'seq_name', COALESCE(strftime(s.made_at, '%Y-%m'), 'unknown'), 'inherited', 1
  FROM sample_map s WHERE s.row_no IN (SELECT row_no FROM one)
  UNION ALL SELECT 'cluster_row', c.row_no, 'sample', COALESCE(strftime(c.made_at, '%Y-%m'), 'unknown'), 'inherited',
    CASE WHEN c.sample IN (SELECT key FROM first) THEN 1 ELSE 2 END
  FROM cluster_row c WHERE c.sample IN (SELECT key FROM second))"""
ORACLES = {
    "p1_found": f"{_FOUND} SELECT table_name, row_no, field_name, period, kind FROM direct",
    "p1_cascade": f"{_CASCADE} SELECT table_name, row_no, field_name, period, kind, level FROM every",
    "p1_report": f"{_CASCADE} SELECT table_name, field_name, period, kind, COUNT(*) AS orphans FROM every GROUP BY table_name, field_name, period, kind",
}

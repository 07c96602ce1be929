"""Text formats: FASTA, mappings, cluster files, foreign cluster lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reedbed.functions.sequences import file_stem


def fasta_record(name: Column, descr: Column, bases: Column) -> Column:
    head = F.concat(F.lit(">"), F.replace(name, F.lit(" "), F.lit("_")), F.when(F.length(F.coalesce(descr, F.lit(""))) > 0, F.concat(F.lit("  "), descr)).otherwise(F.lit("")))
    return F.concat_ws("\n", head, bases)


def write_fasta(seqs: DataFrame, path: str) -> None:
    """(seq_name, descr, bases) as FASTA files, in parallel; blanks in names become underscores."""
    seqs.select(fasta_record(F.col("seq_name"), F.col("descr"), F.col("bases")).alias("value")).write.text(path)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(seq_name, descr, bases, sample, is_meta). Records are split where a line begins with ``>``, so large files are
    read in parallel; bases may span lines. The sample is the file's name; names with ``#`` are no data."""
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", F.input_file_name().alias("path"))
    record = F.regexp_replace(F.col("value"), "^>", "")
    head = F.split(F.split(record, "\n")[0], r"\s+", 2)
    bases = F.regexp_replace(F.regexp_extract(record, r"(?s)^[^\n]*\n(.*)$", 1), r"\s", "")
    return raw.where(F.length(F.trim(record)) > 0).select(
        head[0].alias("seq_name"), F.trim(F.coalesce(F.get(head, F.lit(1)), F.lit(""))).alias("descr"), bases.alias("bases"), file_stem(F.col("path")).alias("sample"), head[0].startswith("#").alias("is_meta")
    )


def quality_lines(rows: DataFrame, name: str, quality: str) -> DataFrame:
    """(line): a head and the qualities, two blanks between."""
    return rows.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.array_join(F.transform(quality, lambda q: q.cast("string")), "  ")).alias("line"))


def id_mapping_lines(id_map: DataFrame) -> DataFrame:
    """(ex_id, line): ``id name,name,...`` with the names in order of their place."""
    names = F.array_sort(F.collect_set(F.struct("place", "seq_name")))
    return id_map.groupBy("ex_id").agg(F.concat(F.col("ex_id").cast("string"), F.lit(" "), F.array_join(names["seq_name"], ",")).alias("line"))


def read_id_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(ex_id, place, seq_name); blank lines are skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(parts[0].cast("int").alias("ex_id"), F.posexplode(F.split(parts[1], ",")))
    return rows.select("ex_id", F.col("pos").alias("place"), F.col("col").alias("seq_name"))


def write_sample_mapping(samples: DataFrame, path: str) -> None:
    samples.select("seq_name", "sample").write.option("sep", "\t").option("quote", "").csv(path)


def read_sample_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(seq_name, sample): one blank or tab between."""
    parts = F.split("value", r"\s", 2)
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select(parts[0].alias("seq_name"), parts[1].alias("sample"))


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """(seq_name, weight); lines with ``#`` are comments."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(~F.col("value").startswith("#") & (F.length(F.trim("value")) > 0)).select(parts[0].alias("seq_name"), parts[1].cast("double").alias("weight"))


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """(id): trimmed lines that aren't blank."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where(F.length("id") > 0)


def cluster_lines(snap: DataFrame) -> DataFrame:
    """(cutoff, cluster_no, sample, line): the rows of a cluster file; ids in order."""
    ids = F.array_sort(F.collect_set("seq_id"))
    rows = snap.groupBy("cutoff", "cluster_no", "sample").agg(ids.alias("ids"))
    line = F.concat_ws("\t", F.col("cluster_no").cast("string"), "sample", F.size("ids").cast("string"), F.concat(F.array_join(F.col("ids").cast("array<string>"), " "), F.lit(" ")))
    return rows.select("cutoff", "cluster_no", "sample", line.alias("line"))


def cutoff_text(cutoff: Column) -> Column:
    """At least one decimal, at most four."""
    return F.regexp_replace(F.format_string("%.4f", cutoff / F.lit(10000)), "0{1,3}$", "")


def write_cluster_file(snap: DataFrame, path: str) -> None:
    """A cluster file as parts: the head, then each cutoff's head line and rows in order of cutoff and cluster."""
    samples = snap.groupBy("sample").agg(F.countDistinct("seq_id").alias("n")).agg(F.array_sort(F.collect_list(F.struct("sample", "n"))).alias("s"))
    head = samples.select(F.lit(-1).alias("cutoff"), F.lit(0).alias("cluster_no"), F.lit("").alias("sample"), F.concat(F.lit("File(s):\t"), F.array_join("s.sample", " "), F.lit("\nSequences:\t"), F.array_join(F.col("s.n").cast("array<string>"), " "), F.lit("\n")).alias("line"))
    starts = snap.groupBy("cutoff").agg(F.countDistinct("cluster_no").alias("n")).select("cutoff", F.lit(0).alias("cluster_no"), F.lit("").alias("sample"), F.concat(F.lit("distance cutoff:\t"), cutoff_text(F.col("cutoff")), F.lit("\nTotal Clusters:\t"), F.col("n").cast("string")).alias("line"))
    lines = head.unionByName(starts).unionByName(cluster_lines(snap))
    lines.orderBy("cutoff", "cluster_no", "sample").select(F.col("line").alias("value")).write.text(path)


def read_cluster_file(spark: SparkSession, path: str) -> DataFrame:
    """(cutoff, cluster_no, sample, seq_id). The file is split into blocks at ``distance cutoff:``, each block is one
    record; a row whose count and ids disagree is an error."""
    raw = spark.read.option("lineSep", "distance cutoff:").option("wholetext", "false").text(path).where(F.col("value").rlike(r"^\t[0-9.]+\n"))
    block = raw.select((F.round(F.regexp_extract("value", r"^\t([0-9.]+)", 1).cast("double") * 10000)).cast("int").alias("cutoff"), F.explode(F.split("value", "\n")).alias("line"))
    cells = block.where(F.col("line").rlike(r"^\d+\t")).select("cutoff", F.split("line", "\t").alias("c"))
    ids = F.split(F.trim(F.col("c")[3]), " ")
    ok = F.when(F.size(ids) != F.col("c")[2].cast("int"), F.raise_error(F.lit("a cluster's count differs from its ids"))).otherwise(ids)
    return cells.where(F.col("c")[2].cast("int") > 0).select("cutoff", F.col("c")[0].cast("int").alias("cluster_no"), F.col("c")[1].alias("sample"), F.explode(ok.cast("array<int>")).alias("seq_id"))


def parse_clstr(lines: DataFrame) -> DataFrame:
    """(line_no, value) -> (cluster_no, length, name, is_rep, identity): a foreign cluster list. The header of a cluster
    is carried forward to its members; lines of another shape are skipped. One file is one sequence of lines, so the
    window runs over each ``file`` on its own if there is such a column."""
    by = Window.partitionBy("file") if "file" in lines.columns else Window.partitionBy(F.lit(0))
    header = F.when(F.col("value").startswith(">Cluster"), F.regexp_extract("value", r"(\d+)", 1).cast("int"))
    filled = lines.withColumn("cluster_no", F.last(header, ignorenulls=True).over(by.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))
    pattern = r"^\d+\s+(\d+)(?:nt|aa),\s+>(\S+?)\.\.\.\s+(\*|at\s+\S+)\s*$"
    rows = filled.where(F.col("value").rlike(pattern))
    identity = F.regexp_extract("value", r"/?([0-9.]+)%\s*$", 1)
    return rows.select("cluster_no", F.regexp_extract("value", pattern, 1).cast("int").alias("length"), F.regexp_extract("value", pattern, 2).alias("name"), (F.regexp_extract("value", pattern, 3) == "*").alias("is_rep"), F.when(identity != "", identity.cast("double")).alias("identity"))

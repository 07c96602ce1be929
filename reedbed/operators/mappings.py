"""Identity and sample mappings: checks, joins through them, and their upkeep.

id mapping: (ex_id, place, seq_name), place 0 the exemplar. Sample mapping: (seq_name, sample, ord).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NO_SAMPLE = "no_sample"


def mapping_faults(id_map: DataFrame) -> DataFrame:
    """(fault, value, times): names of several exemplars, and places that an exemplar gives more than once."""
    names = id_map.groupBy("seq_name").agg(F.countDistinct("ex_id").alias("times")).where("times > 1").select(F.lit("name of several exemplars").alias("fault"), F.col("seq_name").alias("value"), "times")
    places = id_map.groupBy("ex_id", "place").agg(F.countDistinct("seq_name").alias("times")).where("times > 1").select(F.lit("place given twice").alias("fault"), F.concat_ws(":", "ex_id", "place").alias("value"), "times")
    return names.unionByName(places)


def validated(id_map: DataFrame) -> DataFrame:
    """The mapping, or an error at run time if a name has several exemplars."""
    seen = id_map.groupBy("seq_name").agg(F.countDistinct("ex_id").alias("n"), F.min("ex_id").alias("ex"))
    ok = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("name in several mappings: "), F.col("seq_name")))).otherwise(F.lit(True))
    return id_map.join(seen.where(ok.cast("boolean")).select("seq_name"), "seq_name", "left_semi").select(*id_map.columns)


def sample_dimension(samples: DataFrame) -> DataFrame:
    """(sample, sample_ord, names): samples in order of their first row."""
    return samples.groupBy("sample").agg(F.min("ord").alias("sample_ord"), F.countDistinct("seq_name").alias("names"))


def sample_of(samples: DataFrame) -> DataFrame:
    """(seq_name, sample): of a name in several samples, the one whose first row comes last."""
    order = sample_dimension(samples).select("sample", "sample_ord")
    return samples.select("seq_name", "sample").distinct().join(order, "sample").groupBy("seq_name").agg(F.max_by("sample", F.struct("sample_ord", "sample")).alias("sample"))


def merged(*maps: DataFrame) -> DataFrame:
    """Union of sample mappings, each (seq_name, sample) once."""
    out = maps[0].select("seq_name", "sample")
    for other in maps[1:]:
        out = out.unionByName(other.select("seq_name", "sample"))
    return out.distinct()


def demultiplexed(rows: DataFrame, key: str, samples: DataFrame, id_map: DataFrame) -> DataFrame:
    """Each row of results once for each replicate of its exemplar, with the sample of the exemplar's own name.
    Rows whose key or sample isn't known are left out; writing by partition of ``sample`` gives a file for each."""
    names = id_map.select(F.col("ex_id").alias(key), F.col("seq_name").alias("replicate"))
    exemplar = id_map.where("place = 0").select(F.col("ex_id").alias(key), "seq_name").join(sample_of(samples), "seq_name").select(key, "sample")
    return rows.join(exemplar.distinct(), key).join(names.distinct(), key)


def exploded(seqs: DataFrame, id_map: DataFrame, samples: DataFrame, warn_only: bool = False) -> DataFrame:
    """(ex_id, bases) -> (sample, seq_name, ex_id, bases): a row for each replicate, under its sample or no_sample.

    An exemplar without a mapping is an error, or with ``warn_only`` a replicate of its own name."""
    names = id_map.select("ex_id", "seq_name").distinct()
    joined = seqs.join(names, "ex_id", "left")
    own = F.concat(F.lit("s"), F.col("ex_id"))
    missing = own if warn_only else F.raise_error(F.concat(F.lit("no mapping for "), F.col("ex_id"))).cast("string")
    named = joined.withColumn("seq_name", F.when(F.col("seq_name").isNull(), missing).otherwise(F.col("seq_name")))
    return named.join(sample_of(samples), "seq_name", "left").select(F.coalesce("sample", F.lit(NO_SAMPLE)).alias("sample"), "seq_name", "ex_id", "bases")


def refreshed(seqs: DataFrame, id_map: DataFrame, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mappings of the exemplars that are still among the sequences (ex_id), and the samples of their names."""
    kept = id_map.join(seqs.select("ex_id").distinct(), "ex_id", "left_semi").select("ex_id", "place", "seq_name").distinct()
    return kept, samples.join(kept.select("seq_name").distinct(), "seq_name", "left_semi").select("seq_name", "sample").distinct()


def filtered(seqs: DataFrame, ids: DataFrame, remove: bool = True, key: str = "id") -> DataFrame:
    """Sequences without those listed, or with ``remove=False`` only those."""
    return seqs.join(ids.select(key).distinct(), key, "left_anti" if remove else "left_semi")


def sample_counts(samples: DataFrame, id_map: DataFrame) -> DataFrame:
    """(sample, n): mapped names of each sample."""
    named = samples.select("seq_name", "sample").distinct().join(id_map.select("seq_name").distinct(), "seq_name", "left_semi")
    return named.groupBy("sample").agg(F.count("*").alias("n"))

"""Registered queries of the library's operators, each over its whole tables, with SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reedbed.functions import sequences as sf
from reedbed.operators import dereplicate as derep
from reedbed.operators import distances, linkage, mappings, otu, representatives
from reedbed.operators.numbering import numbered
from reedbed.plans import views
from reedbed.plans.runtime import materialise, shared_dir, shuffle_partitions, table
from reedbed.plans.views import with_views
from reedbed.sources import binary, text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _path(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_dir(spark).rstrip('/')}/reedbed/{name}-{uuid.uuid4().hex}"


# Sources and sinks


@query(with_views("seqs") + " SELECT seq_name, bases FROM seqs WHERE bases <> ''")
def scan_sequences(spark, d):
    """Sequences written as FASTA and read again."""
    path = _path(spark, "fasta")
    text.write_fasta(views.seqs(spark, d).where("bases <> ''"), path)
    return text.read_fasta(spark, path).where("NOT is_meta").select("seq_name", "bases")


@query(with_views("seqs") + " SELECT id, '>' || seq_name || chr(10) || bases AS line FROM seqs")
def fasta_lines(spark, d):
    return views.seqs(spark, d).select("id", text.fasta_record(F.col("seq_name"), F.col("descr"), F.col("bases")).alias("line"))


@query("SELECT DISTINCT source, regexp_replace(list_extract(str_split('/data/' || source || '.fa', '/'), -1), '\\.[^.]*$', '') AS sample FROM documents WHERE source IS NOT NULL")
def sample_from_path(spark, d):
    rows = table(spark, d, "documents").select("source").dropna().distinct()
    return rows.select("source", sf.file_stem(F.concat(F.lit("/data/"), "source", F.lit(".fa"))).alias("sample"))


@query("SELECT '>v' || vec_id || chr(10) || list_aggregate(list_transform(embedding, lambda x: CAST(CAST(floor(x * 100) AS INT) AS VARCHAR)), 'string_agg', '  ') AS line FROM embeddings")
def quality_lines(spark, d):
    rows = table(spark, d, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id")).alias("name"), F.transform("embedding", lambda x: F.floor(x * 100).cast("int")).alias("q"))
    return text.quality_lines(rows, "name", "q")


@query(with_views("ids") + " SELECT ex_id, ex_id || ' ' || string_agg(seq_name, ',' ORDER BY place, seq_name) AS line FROM ids GROUP BY ex_id")
def idmapping_lines(spark, d):
    return text.id_mapping_lines(views.id_map(spark, d))


@query(
    with_views("ids")
    + " SELECT 'name of several exemplars' AS fault, seq_name AS value, COUNT(DISTINCT ex_id) AS times FROM ids GROUP BY seq_name HAVING COUNT(DISTINCT ex_id) > 1"
    + " UNION ALL SELECT 'place given twice', ex_id || ':' || place, COUNT(DISTINCT seq_name) FROM ids GROUP BY ex_id, place HAVING COUNT(DISTINCT seq_name) > 1"
)
def idmapping_validate(spark, d):
    return mappings.mapping_faults(views.id_map(spark, d))


@query(with_views("samples") + " SELECT DISTINCT seq_name || chr(9) || sample AS line FROM samples")
def sample_lines(spark, d):
    return views.samples(spark, d).select(F.concat_ws("\t", "seq_name", "sample").alias("line")).distinct()


@query(with_views("samples") + " SELECT sample, MIN(ord) AS sample_ord, COUNT(DISTINCT seq_name) AS names FROM samples GROUP BY sample")
def sample_dim(spark, d):
    return mappings.sample_dimension(views.samples(spark, d))


@query(with_views("edges") + " SELECT i, j, dist FROM edges")
def edges_roundtrip(spark, d):
    path = _path(spark, "edges")
    binary.write_edges(views.edges(spark, d), path)
    return binary.unpacked_edges(spark.read.parquet(path))


@query(with_views("snap") + " SELECT cutoff, cluster_no, sample, seq_id FROM snap WHERE sample <> '' AND NOT contains(sample, chr(9))")
def clusterfile_roundtrip(spark, d):
    path = _path(spark, "clusters")
    text.write_cluster_file(views.snap(spark, d).where("sample <> '' AND instr(sample, '\t') = 0"), path)
    return text.read_cluster_file(spark, path)


@query(with_views("snap") + " SELECT cutoff, cluster_no, sample, cluster_no || chr(9) || sample || chr(9) || COUNT(*) || chr(9) || string_agg(seq_id, ' ' ORDER BY seq_id) || ' ' AS line FROM snap GROUP BY cutoff, cluster_no, sample")
def clusterfile_lines(spark, d):
    return text.cluster_lines(views.snap(spark, d))


_CLSTR = "cl AS (SELECT cutoff, cluster_no, seq_id, ROW_NUMBER() OVER (PARTITION BY cutoff, cluster_no ORDER BY seq_id) AS k FROM (SELECT DISTINCT cutoff, cluster_no, seq_id FROM snap))"


def _clstr(spark: SparkSession, d: str) -> DataFrame:
    """Each cutoff's clusters as the lines of a foreign cluster list."""
    members = views.snap(spark, d).select("cutoff", "cluster_no", "seq_id").distinct()
    k = F.row_number().over(Window.partitionBy("cutoff", "cluster_no").orderBy("seq_id"))
    mark = F.when(F.col("k") == 1, F.lit("*")).otherwise(F.lit("at +/97.50%"))
    rows = members.withColumn("k", k).select("cutoff", "cluster_no", "k", F.concat(F.col("k") - 1, F.lit("\t"), F.col("seq_id") % 100 + 200, F.lit("nt, >s"), F.col("seq_id"), F.lit("... "), mark).alias("value"))
    heads = members.select("cutoff", "cluster_no").distinct().select("cutoff", "cluster_no", F.lit(0).alias("k"), F.concat(F.lit(">Cluster "), F.col("cluster_no")).alias("value"))
    line = F.col("cluster_no").cast("long") * 1_000_000 + F.col("k")
    return rows.unionByName(heads).select(F.col("cutoff").alias("file"), line.alias("line_no"), "value")


@query(with_views("snap") + f", {_CLSTR} SELECT cluster_no, CAST(seq_id % 100 + 200 AS INT) AS length, 's' || seq_id AS name, k = 1 AS is_rep, CASE WHEN k > 1 THEN 97.5 END AS identity FROM cl")
def forward_fill_parse(spark, d):
    return text.parse_clstr(_clstr(spark, d))


@query(with_views("snap", "ids", "samples") + f", {_CLSTR}, one AS (SELECT seq_name, arg_max(sample, o || sample) AS sample FROM (SELECT DISTINCT s.seq_name, s.sample, lpad(CAST(m.o AS VARCHAR), 12, '0') AS o FROM samples s JOIN (SELECT sample, MIN(ord) AS o FROM samples GROUP BY sample) m ON s.sample = m.sample) GROUP BY seq_name) SELECT cl.cluster_no, one.sample, COUNT(*) AS n FROM cl JOIN (SELECT DISTINCT ex_id, seq_name FROM ids) i ON i.ex_id = cl.seq_id JOIN one ON one.seq_name = i.seq_name GROUP BY cl.cluster_no, one.sample")
def import_otu_table(spark, d):
    """A foreign cluster list as counts: names to exemplars, to replicates, to samples."""
    rows = text.parse_clstr(_clstr(spark, d)).select("cluster_no", F.substring("name", 2, 20).cast("int").alias("ex_id"))
    names = views.id_map(spark, d).select("ex_id", "seq_name").distinct()
    return rows.join(names, "ex_id").join(mappings.sample_of(views.samples(spark, d)), "seq_name").groupBy("cluster_no", "sample").agg(F.count("*").alias("n"))


# Expressions, filters


@query(with_views("seqs") + " SELECT id, replace(replace(bases, '-', ''), '.', '') AS bases FROM seqs")
def unalign(spark, d):
    return views.seqs(spark, d).select("id", sf.unaligned(F.col("bases")).alias("bases"))


@query(with_views("seqs") + " SELECT id, regexp_replace(bases, '[a-z.]', '', 'g') AS bases FROM seqs")
def formatted_mask(spark, d):
    return views.seqs(spark, d).select("id", sf.model_only(F.col("bases")).alias("bases"))


_MASK = "mask AS (SELECT bases AS m FROM seqs WHERE bases LIKE '%-%' ORDER BY id LIMIT 1), cols AS (SELECT k FROM (SELECT UNNEST(range(1, length(m) + 1)) AS k, m FROM mask) WHERE substr(m, k, 1) NOT IN ('-', '.'))"


@query(with_views("seqs") + f", {_MASK} SELECT id, COALESCE(string_agg(substr(bases, k, 1), '' ORDER BY k), '') AS bases FROM seqs, cols GROUP BY id")
def mask_columns(spark, d):
    """All sequences at the model columns of the first one that has a gap."""
    seqs = views.seqs(spark, d)
    mask = seqs.where("bases LIKE '%-%'").select(F.min_by("bases", "id")).first()[0]
    return derep.mask_columns(seqs, mask).select("id", "bases")


@query(with_views("seqs") + " , w AS (SELECT MAX(length(bases)) + 3 AS w FROM seqs), used AS (SELECT DISTINCT k FROM (SELECT bases, UNNEST(range(1, length(bases) + 1)) AS k FROM seqs) WHERE substr(bases, k, 1) NOT IN ('-', '.')) SELECT CAST(k AS INT) AS \"column\" FROM (SELECT UNNEST(range(1, w + 1)) AS k FROM w) WHERE k NOT IN (SELECT k FROM used)")
def common_gaps(spark, d):
    """With three gap columns added, so that there is something to find."""
    return derep.common_gaps(views.seqs(spark, d).withColumn("bases", F.concat("bases", F.lit("-.."))))


@query(with_views("seqs") + ", used AS (SELECT DISTINCT k FROM (SELECT bases, UNNEST(range(1, length(bases) + 1)) AS k FROM seqs) WHERE substr(bases, k, 1) NOT IN ('-', '.')) SELECT id, COALESCE(string_agg(substr(bases, k, 1), '' ORDER BY k), '') AS bases FROM (SELECT id, bases || '-..' AS bases FROM seqs), used GROUP BY id")
def remove_common_gaps(spark, d):
    return derep.remove_common_gaps(views.seqs(spark, d).withColumn("bases", F.concat("bases", F.lit("-..")))).select("id", "bases")


@query(with_views("seqs") + " SELECT CAST(length(bases) AS INT) AS bases_length, COUNT(*) AS seqs FROM seqs GROUP BY length(bases)")
def length_check(spark, d):
    return derep.length_check(views.seqs(spark, d))


@query("SELECT row_no, CAST(floor(CAST(CAST(dist AS FLOAT) / CAST(10000 AS FLOAT) AS FLOAT) * CAST(10000 AS FLOAT) + CAST(0.5 AS FLOAT)) AS INT) AS again FROM thin_edge WHERE dist BETWEEN 0 AND 10000")
def distance_scaling(spark, d):
    rows = table(spark, d, "thin_edge").where("dist BETWEEN 0 AND 10000")
    return rows.select("row_no", sf.scaled(F.col("dist").cast("float") / F.lit(10000.0).cast("float")).alias("again"))


@query(with_views("seqs") + " SELECT id, seq_name, bases FROM seqs WHERE id NOT IN (SELECT seq_id FROM cluster_row WHERE seq_id IS NOT NULL)")
def filter_seqs_remove(spark, d):
    listed = table(spark, d, "cluster_row").select(F.col("seq_id").alias("id")).dropna()
    return mappings.filtered(views.seqs(spark, d), listed).select("id", "seq_name", "bases")


@query(with_views("seqs") + " SELECT id, seq_name, bases FROM seqs WHERE id IN (SELECT seq_id FROM cluster_row)")
def filter_seqs_keep(spark, d):
    listed = table(spark, d, "cluster_row").select(F.col("seq_id").alias("id")).dropna()
    return mappings.filtered(views.seqs(spark, d), listed, remove=False).select("id", "seq_name", "bases")


# Dereplication


def _derep_sql(prepared: str, order: str = "ord") -> str:
    return with_views("raw") + f", g AS (SELECT {prepared} AS bases, MIN(ord) AS ord, COUNT(*) AS size FROM raw GROUP BY {prepared}) SELECT ROW_NUMBER() OVER (ORDER BY {order}) - 1 AS ex_id, 'r' || ord AS seq_name, bases, size FROM g"


_UNALIGNED = "replace(replace(bases, '-', ''), '.', '')"


@query(_derep_sql("bases"))
def derep_aligned(spark, d):
    return derep.exemplars(views.raw(spark, d), "aligned")


@query(_derep_sql(_UNALIGNED))
def derep_unaligned(spark, d):
    return derep.exemplars(views.raw(spark, d))


@query(_derep_sql("regexp_replace(bases, '[a-z.]', '', 'g')"))
def derep_model(spark, d):
    return derep.exemplars(views.raw(spark, d), "formatted")


@query(_derep_sql(_UNALIGNED, "size DESC, ord DESC"))
def derep_sorted(spark, d):
    return derep.exemplars(views.raw(spark, d), by_size=True)


@query(with_views("raw") + f", g AS (SELECT {_UNALIGNED} AS u, MIN(ord) AS o FROM raw GROUP BY {_UNALIGNED}), n AS (SELECT u, ROW_NUMBER() OVER (ORDER BY o) - 1 AS ex_id FROM g) SELECT ex_id, ROW_NUMBER() OVER (PARTITION BY ex_id ORDER BY ord) - 1 AS place, seq_name FROM raw JOIN n ON n.u = {_UNALIGNED}")
def derep_mapping(spark, d):
    return derep.dereplicate(views.raw(spark, d))[1]


# Distances and edges


@query(with_views("seqs", "padded", "enc", "pairs") + " SELECT a AS i, b AS j, (mm * 20000 + ov) // (2 * ov) AS dist FROM pairs WHERE ov >= 25 AND (mm * 20000 + ov) // (2 * ov) <= 1500")
def pair_distance_cutoff(spark, d):
    return distances.pair_distances(views.exemplars(spark, d), views.MATRIX_CUTOFF)


@query(with_views("seqs", "padded", "enc", "pairs") + " SELECT CAST((mm * 20000 + ov) // (2 * ov) // 100 AS INT) AS bucket, COUNT(*) AS pairs, CAST(SUM(mm) AS BIGINT) AS mismatches, CAST(SUM(ov) AS BIGINT) AS overlap FROM pairs WHERE ov >= 25 GROUP BY (mm * 20000 + ov) // (2 * ov) // 100")
def pair_distance(spark, d):
    return distances.distance_profile(views.exemplars(spark, d))


@query(with_views("seqs", "padded", "enc", "pairs") + " SELECT a AS i, b AS j, ov AS overlap FROM pairs WHERE ov < 25")
def pairs_no_overlap(spark, d):
    return distances.pairs_without_overlap(views.exemplars(spark, d))


@query("WITH n AS (SELECT COUNT(DISTINCT id) AS n FROM int_seq WHERE bytes IS NOT NULL), b AS (SELECT UNNEST(range(0, (n + 1999) // 2000)) AS b FROM n) SELECT x.b AS x, y.b AS y FROM b x JOIN b y ON x.b <= y.b")
def block_pairs(spark, d):
    """Block pairs of the whole pair matrix in blocks of 2000."""
    n = views.seqs(spark, d).select("id").distinct().count()
    return distances.blocks(spark, n, 2000)


@query(with_views("seqs") + " SELECT ROW_NUMBER() OVER (ORDER BY id, bases) - 1 AS place, id, (ROW_NUMBER() OVER (ORDER BY id, bases) - 1) // 1000 AS block FROM seqs")
def block_slice(spark, d):
    """The place of each sequence in a store of blocks of a thousand, numbered without one common task."""
    return numbered(views.seqs(spark, d).select("id", "bases"), ["id", "bases"], "place").select("place", "id", F.floor(F.col("place") / 1000).cast("long").alias("block"))


@query(with_views("edges") + " SELECT i // 500 AS block_i, j // 500 AS block_j, COUNT(*) AS edges, CAST(SUM(dist) AS BIGINT) AS total FROM edges WHERE (i // 500 * 31 + j // 500 * 17) % 4 = 0 GROUP BY i // 500, j // 500")
def sample_blocks(spark, d):
    """A sample of blocks by a fixed hash of the block: the sampling operator, so a part of the edges is its purpose."""
    routed = distances.route_to_blocks(views.edges(spark, d), 500).where("(block_i * 31 + block_j * 17) % 4 = 0")
    return routed.groupBy("block_i", "block_j").agg(F.count("*").alias("edges"), F.sum("dist").cast("long").alias("total"))


@query(with_views("edges") + " SELECT i, j, dist, i // 500 AS block_i, j // 500 AS block_j FROM edges")
def range_route(spark, d):
    return distances.route_to_blocks(views.edges(spark, d), 500)


@query(with_views("edges") + " SELECT i // 500 AS block_i, j // 500 AS block_j, COUNT(*) AS edges, MIN(i) AS min_i, MAX(i) AS max_i, MIN(j) AS min_j, MAX(j) AS max_j, CAST(SUM(dist) AS BIGINT) AS total FROM edges GROUP BY i // 500, j // 500")
def block_summary(spark, d):
    return distances.block_summary(views.edges(spark, d), 500)


@query(with_views("edges") + " SELECT ROW_NUMBER() OVER (ORDER BY dist, i, j) - 1 AS place, i, j, dist FROM edges")
def edges_sorted(spark, d):
    return numbered(views.edges(spark, d), ["dist", "i", "j"], "place").select("place", "i", "j", "dist")


@query("SELECT row_no, seqi, seqj, dist, previous FROM (SELECT row_no, seqi, seqj, dist, lag(dist) OVER (ORDER BY row_no) AS previous FROM thin_edge WHERE dist IS NOT NULL) WHERE previous > dist")
def edges_order_check(spark, d):
    rows = table(spark, d, "thin_edge").where("dist IS NOT NULL").select("row_no", "seqi", "seqj", "dist")
    return distances.order_breaks(rows, "row_no")


@query(with_views("edges") + " SELECT i, j, dist FROM edges")
def edges_range_partitioned(spark, d):
    """Edges in ranges of their distance, one range a partition."""
    return views.edges(spark, d).repartitionByRange(shuffle_partitions(spark), "dist").sortWithinPartitions("dist", "i", "j")


@query(with_views("edges") + ", r AS (SELECT dist, ROW_NUMBER() OVER (ORDER BY dist) AS k, COUNT(*) OVER () AS n FROM edges) SELECT p.p AS part, MIN(dist) AS bound FROM r, (SELECT UNNEST([1, 2, 3, 4, 5]) AS p) p WHERE k >= n * p.p / 6.0 GROUP BY p.p")
def dist_quantiles(spark, d):
    """Bounds of six ranges of equal numbers of edges; from counts by distance, of which there are at most 10001."""
    by_dist = views.edges(spark, d).groupBy("dist").agg(F.count("*").alias("n"))
    upto = by_dist.withColumn("upto", F.sum("n").over(Window.orderBy("dist"))).withColumn("all", F.sum("n").over(Window.partitionBy(F.lit(0))))
    parts = upto.withColumn("part", F.explode(F.sequence(F.lit(1), F.lit(5)))).where(F.col("upto") >= F.col("all") * F.col("part") / 6.0)
    return parts.groupBy("part").agg(F.min("dist").alias("bound"))


@query(with_views("edges") + " SELECT MAX(dist) AS psi FROM edges")
def psi(spark, d):
    return views.edges(spark, d).agg(F.max("dist").alias("psi"))


@query(with_views("edges") + " SELECT i, j, dist FROM edges")
def dump_edges(spark, d):
    """Edges with their distances as written in texts, read back as whole numbers."""
    written = views.edges(spark, d).select(F.concat_ws("\t", F.col("i").cast("string"), F.col("j").cast("string"), sf.unscaled(F.col("dist")).cast("string")).alias("value"))
    parts = F.split("value", "\t")
    return written.select(parts[0].cast("int").alias("i"), parts[1].cast("int").alias("j"), sf.scaled(parts[2].cast("float")).alias("dist"))


_SEEDS = "sd AS (SELECT id, upper(rpad(replace(regexp_replace(decode(bytes), '[^A-Za-z.-]', '', 'g'), '.', '-'), (SELECT CAST(MAX(n) AS INT) FROM w), '-')) AS b FROM seed_seq), s AS (SELECT id, b, regexp_replace(b, '[A-Z]', '1', 'g') AS m, length(replace(b, '-', '')) AS n FROM sd)"
_QUERIES = "w AS (SELECT greatest((SELECT MAX(length(bases)) FROM seqs), (SELECT MAX(length(decode(bytes))) FROM seed_seq)) AS n), qd AS (SELECT id, upper(rpad(replace(bases, '.', '-'), (SELECT CAST(n AS INT) FROM w), '-')) AS b FROM seqs), q AS (SELECT id, b, regexp_replace(b, '[A-Z]', '1', 'g') AS m, length(replace(b, '-', '')) AS n FROM qd)"


@query(with_views("seqs") + f", {_QUERIES}, {_SEEDS}, p AS (SELECT q.id, s.id AS seed_id, q.n AS qn, hamming(q.b, s.b) - hamming(q.m, s.m) AS mm, (q.n + s.n - hamming(q.m, s.m)) // 2 AS ov FROM q CROSS JOIN s), r AS (SELECT id, seed_id, (mm * 20000 + ov) // (2 * ov) AS dist FROM p WHERE ov >= greatest(1, qn // 2)) SELECT id, seed_id, dist FROM (SELECT *, MIN(dist) OVER (PARTITION BY id) AS least FROM r) WHERE dist = least")
def nearest_seed_ties(spark, d):
    return distances.nearest_seeds(views.seqs(spark, d), views.seeds(spark, d))


# Mappings


@query(with_views("samples") + ", m AS (SELECT sample, MIN(ord) AS o FROM samples GROUP BY sample) SELECT seq_name, arg_max(sample, o) AS sample FROM (SELECT DISTINCT s.seq_name, s.sample, m.o FROM samples s JOIN m ON s.sample = m.sample) GROUP BY seq_name")
def sample_of_id(spark, d):
    return mappings.sample_of(views.samples(spark, d))


@query("SELECT DISTINCT seq_name, sample FROM (SELECT seq_name, sample FROM sample_map UNION ALL SELECT 's' || seq_id, sample FROM cluster_row) WHERE seq_name IS NOT NULL AND sample IS NOT NULL")
def merge_sample_mapping(spark, d):
    rows = table(spark, d, "cluster_row").select(F.concat(F.lit("s"), F.col("seq_id")).alias("seq_name"), "sample").dropna()
    return mappings.merged(views.samples(spark, d), rows)


_ONE = "m AS (SELECT sample, MIN(ord) AS o FROM samples GROUP BY sample), one AS (SELECT seq_name, arg_max(sample, o) AS sample FROM (SELECT DISTINCT s.seq_name, s.sample, m.o FROM samples s JOIN m ON s.sample = m.sample) GROUP BY seq_name)"


@query(with_views("ids", "samples") + f", {_ONE}, e AS (SELECT DISTINCT i.ex_id, one.sample FROM ids i JOIN one ON one.seq_name = i.seq_name WHERE i.place = 0), r AS (SELECT DISTINCT ex_id, seq_name AS replicate FROM ids) SELECT c.row_no, c.seq_id, e.sample, r.replicate FROM cluster_row c JOIN e ON e.ex_id = c.seq_id JOIN r ON r.ex_id = c.seq_id")
def demultiplex(spark, d):
    rows = table(spark, d, "cluster_row").select("row_no", "seq_id")
    return mappings.demultiplexed(rows, "seq_id", views.samples(spark, d), views.id_map(spark, d)).select("row_no", "seq_id", "sample", "replicate")


@query(with_views("seqs", "ids", "samples") + f", {_ONE}, x AS (SELECT q.id AS ex_id, q.bases, COALESCE(i.seq_name, 's' || q.id) AS seq_name FROM seqs q LEFT JOIN (SELECT DISTINCT ex_id, seq_name FROM ids) i ON i.ex_id = q.id) SELECT COALESCE(one.sample, 'no_sample') AS sample, x.seq_name, x.ex_id, x.bases FROM x LEFT JOIN one ON one.seq_name = x.seq_name")
def explode_mappings(spark, d):
    return mappings.exploded(views.seqs(spark, d).select(F.col("id").alias("ex_id"), "bases"), views.id_map(spark, d), views.samples(spark, d), warn_only=True)


@query(with_views("seqs", "ids", "samples") + " SELECT DISTINCT s.seq_name, s.sample FROM samples s WHERE s.seq_name IN (SELECT seq_name FROM ids WHERE ex_id IN (SELECT id FROM seqs))")
def refresh_mappings(spark, d):
    return mappings.refreshed(views.seqs(spark, d).select(F.col("id").alias("ex_id")), views.id_map(spark, d), views.samples(spark, d))[1]


@query(with_views("ids", "samples") + " SELECT sample, COUNT(DISTINCT seq_name) AS n FROM samples WHERE seq_name IN (SELECT seq_name FROM ids) GROUP BY sample")
def sample_counts(spark, d):
    return mappings.sample_counts(views.samples(spark, d), views.id_map(spark, d))


# Clusters


_COMPONENTS = """l AS (SELECT i AS a, j AS b FROM edges WHERE dist <= {c} UNION SELECT j, i FROM edges WHERE dist <= {c}),
r(v, g) AS (SELECT DISTINCT a, a FROM l UNION SELECT l.b, r.g FROM r JOIN l ON r.v = l.a WHERE r.g < l.b),
k AS (SELECT v, MIN(g) AS g FROM r GROUP BY v),
lab AS (SELECT linked.id, COALESCE(k.g, linked.id) AS cluster FROM linked LEFT JOIN k ON k.v = linked.id)"""


def _clusters_sql(cutoff: int) -> str:
    return with_views("edges", "linked", recursive=True) + ", " + _COMPONENTS.format(c=cutoff)


@query(_clusters_sql(500) + " SELECT id, cluster FROM lab")
def single_clusters(spark, d):
    """Single linkage at a distance of 0.05."""
    return linkage.single_labels(views.edges(spark, d), views.linked(spark, d), 500)


@query(_clusters_sql(500) + " SELECT DENSE_RANK() OVER (ORDER BY alone, cluster) AS cluster_no, id FROM (SELECT id, cluster, COUNT(*) OVER (PARTITION BY cluster) = 1 AS alone FROM lab)")
def cluster_snapshot_single(spark, d):
    """Numbered clusters: those with links first, then single ids, by the smallest member."""
    labels = linkage.single_labels(views.edges(spark, d), views.linked(spark, d), 500)
    sizes = labels.groupBy("cluster").agg((F.count("*") == 1).alias("alone"))
    return labels.join(numbered(sizes, ["alone", "cluster"], "cluster_no", 1), "cluster").select("cluster_no", "id")


@query(_clusters_sql(100) + " SELECT least(x.cluster, y.cluster) AS ci, greatest(x.cluster, y.cluster) AS cj, CAST(SUM(dist) AS BIGINT) AS total, COUNT(*) AS edges FROM edges JOIN lab x ON x.id = i JOIN lab y ON y.id = j WHERE x.cluster <> y.cluster GROUP BY least(x.cluster, y.cluster), greatest(x.cluster, y.cluster)")
def thick_edges(spark, d):
    edges = views.edges(spark, d)
    return distances.thick_edges(edges, linkage.single_labels(edges, views.linked(spark, d), 100))


@query(_clusters_sql(500) + " SELECT COUNT(DISTINCT cluster) AS clusters, COUNT(*) AS ids FROM lab")
def cluster_counts(spark, d):
    return single_clusters(spark, d).agg(F.countDistinct("cluster").alias("clusters"), F.count("*").alias("ids"))


@query(with_views("edges") + " SELECT DISTINCT CAST(ceil(dist / 100.0) * 100 AS INT) AS cutoff FROM edges UNION SELECT 0")
def cutoff_series(spark, d):
    """Cutoffs at which complete linkage lists its clusters."""
    zero = spark.range(1).select(F.lit(0).alias("cutoff"))
    return views.edges(spark, d).select(sf.up_to_step(F.col("dist"), 100).alias("cutoff")).unionByName(zero).distinct()


@query()
def complete_merges(spark, d):
    return linkage.linkage(views.edges(spark, d), "complete")


@query()
def upgma_merges(spark, d):
    return linkage.linkage(views.edges(spark, d), "average")


def _snapshots(spark: SparkSession, d: str, method: str) -> DataFrame:
    """(cutoff, cluster, id) at every cutoff of the series."""
    cutoffs = sorted(r.cutoff for r in cutoff_series(spark, d).collect())
    return linkage.snapshots(linkage.linkage(views.edges(spark, d), method), views.linked(spark, d), cutoffs).select("cutoff", "cluster", "id")


@query()
def complete_snapshots(spark, d):
    return _snapshots(spark, d, "complete")


@query()
def upgma_snapshots(spark, d):
    return _snapshots(spark, d, "average")


#: Cutoffs whose clusters are paired with all edges in one query.
CUTOFFS_AT_ONCE = 4


def _violations(spark: SparkSession, d: str, method: str) -> DataFrame:
    """For each cutoff of the series: ids in all; ids in other than one cluster; pairs of clusters that should be one by
    then; and for complete linkage the pairs in one cluster that are farther apart than the cutoff. A method that merges too
    little shows in the third, one that merges too much in the fourth."""
    edges = materialise(views.edges(spark, d), "edges")
    snap = materialise(_snapshots(spark, d, method), "snapshots")
    times = snap.groupBy("cutoff", "id").agg(F.count("*").alias("n")).groupBy("cutoff").agg(F.count("*").alias("ids"), F.sum((F.col("n") != 1).cast("long")).alias("astray"))
    # A few cutoffs at a time: each pairs all edges with its clusters, and those shuffles go when their counts are written.
    cutoffs = sorted(r.cutoff for r in snap.select("cutoff").distinct().collect())
    apart = spark.createDataFrame([], "cutoff int, left_apart long")
    for at in range(0, len(cutoffs), CUTOFFS_AT_ONCE):
        some = snap.where(F.col("cutoff").isin(cutoffs[at : at + CUTOFFS_AT_ONCE]))
        apart = apart.unionByName(materialise(linkage.mergeable(some, edges, method).groupBy("cutoff").agg(F.count("*").alias("left_apart")), "apart"))
    times = times.join(apart, "cutoff", "left").withColumn("left_apart", F.coalesce("left_apart", F.lit(0).cast("long")))
    if method != "complete":
        return times.select("cutoff", "ids", "astray", "left_apart")
    size = snap.groupBy("cutoff", "cluster").agg(F.count("*").alias("n")).groupBy("cutoff").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"))
    i, j = snap.select("cutoff", F.col("id").alias("i"), F.col("cluster").alias("a")), snap.select("cutoff", F.col("id").alias("j"), F.col("cluster").alias("b"))
    near = edges.join(i, "i").join(j, ["cutoff", "j"]).where("a = b AND dist <= cutoff").groupBy("cutoff").agg(F.count("*").alias("near"))
    return times.join(size, "cutoff").join(near, "cutoff", "left").select("cutoff", "ids", "astray", "left_apart", (F.col("pairs") - F.coalesce("near", F.lit(0))).alias("too_far"))


_SERIES = "series AS (SELECT DISTINCT CAST(ceil(dist / 100.0) * 100 AS INT) AS cutoff FROM edges UNION SELECT 0)"


@query(with_views("edges", "linked") + f", {_SERIES} SELECT cutoff, COUNT(*) AS ids, 0 AS astray, 0 AS left_apart, 0 AS too_far FROM linked, series GROUP BY cutoff")
def complete_clusters(spark, d):
    return _violations(spark, d, "complete")


@query(with_views("edges", "linked") + f", {_SERIES} SELECT cutoff, COUNT(*) AS ids, 0 AS astray, 0 AS left_apart FROM linked, series GROUP BY cutoff")
def upgma_clusters(spark, d):
    return _violations(spark, d, "average")


@query(_clusters_sql(1000) + " SELECT id, cluster FROM lab")
def replay_cluster(spark, d):
    """Clusters at a cutoff from a stored merge log, here of single linkage."""
    merges = materialise(linkage.linkage(views.edges(spark, d), "single"), "log")
    return linkage.labels_at(merges, views.linked(spark, d), 1000)


_CUTS = (0, 300, 700, 1500)


@query(
    with_views("edges", "linked", recursive=True)
    + f""", cuts AS (SELECT UNNEST({list(_CUTS)}) AS cutoff),
l AS (SELECT cutoff, i AS a, j AS b FROM edges, cuts WHERE dist <= cutoff UNION SELECT cutoff, j, i FROM edges, cuts WHERE dist <= cutoff),
r(c, v, g) AS (SELECT DISTINCT cutoff, a, a FROM l UNION SELECT r.c, l.b, r.g FROM r JOIN l ON r.v = l.a AND r.c = l.cutoff WHERE r.g < l.b),
k AS (SELECT c, v, MIN(g) AS g FROM r GROUP BY c, v)
SELECT CAST(cuts.cutoff AS INT) AS cutoff, linked.id, COALESCE(k.g, linked.id) AS cluster FROM linked CROSS JOIN cuts LEFT JOIN k ON k.v = linked.id AND k.c = cuts.cutoff"""
)
def replay_series(spark, d):
    """The same log replayed over a series of cutoffs."""
    merges = materialise(linkage.linkage(views.edges(spark, d), "single"), "log")
    return linkage.snapshots(merges, views.linked(spark, d), list(_CUTS))


@query(with_views("edges", "linked", recursive=True) + ", " + _COMPONENTS.format(c=10000) + " SELECT COUNT(*) - COUNT(DISTINCT cluster) AS merges, COUNT(DISTINCT cluster) AS roots, 0 AS wrong, 0 AS falls FROM lab")
def upgma_checked(spark, d):
    """Merges of average linkage: how many there are, and how many clusters they leave; those whose distance isn't the mean
    over the two clusters' pairs, counted anew from the edges; and those that lie below one that their cluster came from."""
    edges = materialise(views.edges(spark, d), "edges")
    merges = materialise(linkage.linkage(edges, "average"), "merges")
    far = edges.agg(F.max("dist")).first()[0] or 0
    met = linkage.between(merges, edges)
    pairs = F.col("na") * F.col("nb")
    wrong = merges.join(met, ["component", "step"], "left").where(F.col("seen").isNull() | (F.abs(F.col("dist") - (F.col("total") + far * (pairs - F.col("seen"))) / pairs) > 0.000001))
    below = merges.select("component", F.col("step").alias("earlier"), F.explode(F.array("a", "b")).alias("x"), F.col("dist").alias("low"))
    falls = merges.select("component", "step", "dist", F.explode(F.array("a", "b")).alias("x")).join(below, ["component", "x"]).where("earlier < step AND low > dist + 0.000001")
    ids = views.linked(spark, d).agg(F.count("*").alias("ids"))
    return (
        merges.agg(F.count("*").alias("merges")).join(ids).join(wrong.agg(F.count("*").cast("int").alias("wrong"))).join(falls.agg(F.count("*").cast("int").alias("falls")))
        .select("merges", (F.col("ids") - F.col("merges")).alias("roots"), "wrong", "falls")
    )


@query(with_views("edges", "linked", recursive=True) + ", " + _COMPONENTS.format(c=10000) + " SELECT cluster AS component, id AS leaf FROM lab")
def tree_leaves(spark, d):
    """The leaves of the trees of average linkage, read back from their texts."""
    trees = linkage.newick(linkage.linkage(views.edges(spark, d), "average"))
    return trees.select("component", F.explode(F.expr(r"regexp_extract_all(newick, '[(,](\\d+):', 1)")).alias("leaf")).select("component", F.col("leaf").cast("int").alias("leaf"))


@query()
def newick(spark, d):
    return linkage.newick(linkage.linkage(views.edges(spark, d), "average"))


# Reports


@query(with_views("snap") + ", n AS (SELECT cutoff, cluster_no, sample, COUNT(*) AS n FROM snap GROUP BY cutoff, cluster_no, sample) SELECT c.cutoff, c.cluster_no, s.sample, COALESCE(n.n, 0) AS n FROM (SELECT DISTINCT cutoff, cluster_no FROM n) c JOIN (SELECT DISTINCT cutoff, sample FROM n) s ON s.cutoff = c.cutoff LEFT JOIN n ON n.cutoff = c.cutoff AND n.cluster_no = c.cluster_no AND n.sample = s.sample")
def otu_dense(spark, d):
    return otu.dense(views.snap(spark, d))


@query(with_views("snap") + ", w AS (SELECT cutoff, length(CAST(MAX(cluster_no) AS VARCHAR)) AS w FROM snap GROUP BY cutoff) SELECT s.cutoff, replace(replace(sample, 'aligned_', ''), '_trimmed', '') AS sample, 'OTU_' || lpad(CAST(cluster_no AS VARCHAR), CAST(w AS INT), '0') AS otu, COUNT(*) AS n FROM snap s JOIN w ON w.cutoff = s.cutoff GROUP BY s.cutoff, replace(replace(sample, 'aligned_', ''), '_trimmed', ''), cluster_no, w")
def otu_pivot(spark, d):
    """Cells of the tables of all cutoffs; :func:`reedbed.operators.otu.wide` lays one out as columns."""
    snap = views.snap(spark, d)
    named = otu.counts(snap).join(otu.otu_names(snap), ["cutoff", "cluster_no"])
    return named.groupBy("cutoff", otu.sample_label(F.col("sample")).alias("sample"), "otu").agg(F.sum("n").alias("n"))


@query(with_views("snap") + ", w AS (SELECT ex_id AS seq_id, COUNT(DISTINCT seq_name) AS weight FROM id_map WHERE ex_id IS NOT NULL GROUP BY ex_id) SELECT s.cutoff, s.cluster_no, s.sample, CAST(CASE WHEN COUNT(*) = COUNT(w.weight) THEN SUM(w.weight) END AS INT) AS n FROM snap s LEFT JOIN w ON w.seq_id = s.seq_id GROUP BY s.cutoff, s.cluster_no, s.sample")
def otu_weighted(spark, d):
    """Weighted by the replicates of each exemplar."""
    weights = table(spark, d, "id_map").where("ex_id IS NOT NULL").groupBy(F.col("ex_id").alias("seq_id")).agg(F.countDistinct("seq_name").cast("double").alias("weight"))
    return otu.weighted(views.snap(spark, d), weights)


@query(with_views("snap") + ", q AS (SELECT UNNEST(range(0, 2001, 100)) AS requested), l AS (SELECT DISTINCT cutoff FROM snap), f AS (SELECT q.requested, COALESCE(MAX(l.cutoff), (SELECT MIN(cutoff) FROM l)) AS cutoff FROM q LEFT JOIN l ON l.cutoff <= q.requested GROUP BY q.requested) SELECT CAST(f.requested AS INT) AS requested, s.cluster_no, s.sample, COUNT(*) AS n FROM f JOIN snap s ON s.cutoff = f.cutoff GROUP BY f.requested, s.cluster_no, s.sample")
def otu_range(spark, d):
    return otu.table_range(views.snap(spark, d), 0, 2000)


@query(with_views("snap") + " SELECT 750 AS requested, COALESCE(MAX(CASE WHEN cutoff <= 750 THEN cutoff END), MIN(cutoff)) AS found FROM snap")
def cutoff_lookup(spark, d):
    return otu.at_cutoff(views.snap(spark, d).select("cutoff").distinct(), 750)


@query(with_views("snap") + ", n AS (SELECT cutoff, cluster_no, sample, COUNT(*) AS n FROM snap GROUP BY cutoff, cluster_no, sample) SELECT c.cutoff, 'cluster_' || c.cluster_no AS \"row\", s.sample AS column_id, COALESCE(n.n, 0) AS value FROM (SELECT DISTINCT cutoff, cluster_no FROM n) c JOIN (SELECT DISTINCT cutoff, sample FROM n) s ON s.cutoff = c.cutoff LEFT JOIN n ON n.cutoff = c.cutoff AND n.cluster_no = c.cluster_no AND n.sample = s.sample")
def biom_json(spark, d):
    """Cells of the dense matrix of every cutoff, as :func:`reedbed.operators.otu.biom_json` writes them."""
    return otu.biom_rows(views.snap(spark, d))


@query(ORACLES["biom_json"])
def biom_parsed(spark, d):
    """Cells read back from the documents of all cutoffs."""
    snap = views.snap(spark, d)
    out = None
    for r in snap.select("cutoff").distinct().orderBy("cutoff").collect():
        lines = otu.biom_json(snap, r.cutoff, "2031-01-01")
        columns = lines.where("id = ''").select(F.from_json("json", "columns array<string>").getField("columns").alias("columns"))
        data = lines.where("id <> ''").select(F.from_json("json", "id string, data array<bigint>").alias("line"))
        cells = data.join(F.broadcast(columns)).select(F.lit(r.cutoff).alias("cutoff"), F.col("line.id").alias("row"), F.inline(F.arrays_zip(F.col("columns").alias("column_id"), F.col("line.data").alias("value"))))
        cells = cells.toDF("cutoff", "row", "column_id", "value")
        out = cells if out is None else out.unionByName(cells)
    return otu.biom_rows(snap) if out is None else out


@query()
def otu_rows(spark, d):
    return otu.rows(views.snap(spark, d))


@query(with_views("edges", "linked") + ", m AS (SELECT i, j, dist FROM edges UNION ALL SELECT j, i, dist FROM edges) SELECT l.id, COUNT(m.dist) AS known, COALESCE(SUM(m.dist), 0) - (SELECT COUNT(*) FROM linked) + 1 + COUNT(m.dist) AS row_sum FROM linked l LEFT JOIN m ON m.i = l.id GROUP BY l.id")
def square_matrix(spark, d):
    """Each row of the square matrix by its known cells and its sum, with -1 for every unknown cell and 0 on the
    diagonal; unknown cells are counted rather than laid out."""
    n = views.linked(spark, d).count()
    edges = views.edges(spark, d)
    both = edges.select("i", "dist").unionByName(edges.select(F.col("j").alias("i"), "dist")).groupBy(F.col("i").alias("id")).agg(F.count("*").alias("known"), F.sum("dist").alias("sum"))
    return both.select("id", "known", (F.col("sum") - (F.lit(n - 1) - F.col("known"))).alias("row_sum"))


# Representatives

_GROUP = "grp AS (SELECT DISTINCT s.cutoff, s.cluster_no{sample}, q.id, q.bases FROM snap s JOIN seqs q ON q.id = s.seq_id)"
_SCORED = """, w AS (SELECT CAST(MAX(length(bases)) AS INT) AS w FROM seqs), e AS (SELECT g.*, upper(rpad(replace(bases, '.', '-'), (SELECT w FROM w), '-')) AS b FROM grp g),
f AS (SELECT e.*, regexp_replace(b, '[A-Z]', '1', 'g') AS m, length(replace(b, '-', '')) AS n FROM e),
p AS (SELECT x.cutoff, x.cluster_no{x}, x.id, x.id = y.id AS own, hamming(x.b, y.b) - hamming(x.m, y.m) AS mm, (x.n + y.n - hamming(x.m, y.m)) // 2 AS ov FROM f x JOIN f y ON x.cutoff = y.cutoff AND x.cluster_no = y.cluster_no{on}),
s2 AS (SELECT cutoff, cluster_no{sample}, id, CAST(SUM(CASE WHEN own THEN 0 WHEN ov >= 1 THEN ((mm * 20000 + ov) // (2 * ov)) * ((mm * 20000 + ov) // (2 * ov)) ELSE 100000000 END) AS BIGINT) AS score, MAX(CASE WHEN own THEN 0 WHEN ov >= 1 THEN (mm * 20000 + ov) // (2 * ov) ELSE 10000 END) AS farthest FROM p GROUP BY cutoff, cluster_no{sample}, id)"""


def _medoid_sql(by_sample: bool, preferred: str = "") -> str:
    s = ", sample" if by_sample else ""
    group = _GROUP.format(sample=", s.sample" if by_sample else "")
    scored = _SCORED.format(x=", x.sample" if by_sample else "", on=" AND x.sample = y.sample" if by_sample else "", sample=s)
    return with_views("seqs", "snap") + f", {group}{scored} SELECT cutoff, cluster_no{s}, id, score, farthest FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY cutoff, cluster_no{s} ORDER BY {preferred}score, id) AS k FROM s2) WHERE k = 1"


def _members(spark: SparkSession, d: str, *keys: str) -> DataFrame:
    return views.snap(spark, d).withColumnRenamed("seq_id", "id").join(views.seqs(spark, d), "id").select(*keys, "id", "bases").distinct()


@query(_medoid_sql(False))
def medoid_per_otu(spark, d):
    return representatives.medoids(_members(spark, d, "cutoff", "cluster_no"), ["cutoff", "cluster_no"])


@query(_medoid_sql(True))
def medoid_per_sample(spark, d):
    keys = ["cutoff", "cluster_no", "sample"]
    return representatives.medoids(_members(spark, d, *keys), keys)


@query(_medoid_sql(False, "id NOT IN (SELECT ex_id FROM id_map WHERE place > 0 AND ex_id IS NOT NULL), "))
def preferred_rep(spark, d):
    """Exemplars of several replicates are preferred."""
    liked = table(spark, d, "id_map").where("place > 0 AND ex_id IS NOT NULL").select(F.col("ex_id").alias("id"))
    return representatives.medoids(_members(spark, d, "cutoff", "cluster_no"), ["cutoff", "cluster_no"], liked)


@query(with_views("seqs", "snap") + ", " + _GROUP.format(sample="") + " SELECT cutoff, cluster_no, id, letters FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY cutoff, cluster_no ORDER BY letters DESC, id) AS k FROM (SELECT cutoff, cluster_no, id, CAST(length(replace(replace(bases, '-', ''), '.', '')) AS INT) AS letters FROM grp)) WHERE k = 1")
def longest_per_otu(spark, d):
    return representatives.longest(_members(spark, d, "cutoff", "cluster_no"), ["cutoff", "cluster_no"])

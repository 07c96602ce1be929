import pytest

from reedbed.operators import dereplicate as derep
from reedbed.operators import mappings, otu, representatives
from reedbed.sources import binary, text


def test_dereplication(spark, rows):
    raw = spark.createDataFrame([(1, "a", "ACGT"), (2, "b", "acgt"), (3, "c", "ACGT"), (4, "d", "AC-GT"), (5, "e", None), (6, "f", ""), (7, "g", "--")], "ord long, seq_name string, bases string")
    exemplars, mapping = derep.dereplicate(raw)
    assert rows(exemplars) == sorted([(0, "a", "ACGT", 3), (1, "b", "acgt", 1), (2, "f", "", 2)], key=repr)
    assert rows(mapping) == sorted([(0, 0, "a"), (0, 1, "c"), (0, 2, "d"), (1, 0, "b"), (2, 0, "f"), (2, 1, "g")], key=repr)
    assert [r.seq_name for r in derep.dereplicate(raw, by_size=True)[0].orderBy("ex_id").collect()] == ["a", "f", "b"]
    assert rows(derep.dereplicate(raw.limit(0))[0]) == []
    assert rows(derep.dereplicate(raw, mask=[1, 2])[0].select("bases", "size")) == sorted([("AC", 3), ("ac", 1), ("", 1), ("--", 1)], key=repr)


def test_gaps_and_masks(spark, rows):
    seqs = spark.createDataFrame([(1, "--AC"), (2, "-GAC"), (3, None)], "id int, bases string")
    assert rows(derep.common_gaps(seqs)) == [(1,)]
    assert rows(derep.remove_common_gaps(seqs)) == sorted([(1, "-AC"), (2, "GAC"), (3, None)], key=repr)
    assert rows(derep.mask_columns(seqs, "A-.A")) == sorted([(1, "-C"), (2, "-C"), (3, None)], key=repr)
    assert rows(derep.common_gaps(seqs.limit(0))) == []


def test_mappings(spark, rows):
    ids = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (2, 0, "c")], "ex_id int, place int, seq_name string")
    samples = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3), ("b", "x", 4)], "seq_name string, sample string, ord long")
    assert rows(mappings.mapping_faults(ids)) == []
    assert rows(mappings.validated(ids).distinct()) == rows(ids.distinct())
    bad = ids.unionByName(spark.createDataFrame([(3, 0, "a")], ids.schema))
    assert rows(mappings.mapping_faults(bad)) == [("name of several exemplars", "a", 2)]
    with pytest.raises(Exception, match="name in several mappings"):
        mappings.validated(bad).collect()
    assert rows(mappings.sample_of(samples)) == [("a", "y"), ("b", "x")]
    seqs = spark.createDataFrame([(1, "ACGT"), (2, "GG"), (7, "T")], "ex_id int, bases string")
    assert rows(mappings.exploded(seqs, ids, samples, warn_only=True)) == sorted([("y", "a", 1, "ACGT"), ("x", "b", 1, "ACGT"), ("no_sample", "c", 2, "GG"), ("no_sample", "s7", 7, "T")], key=repr)
    with pytest.raises(Exception, match="no mapping for 7"):
        mappings.exploded(seqs, ids, samples).collect()
    kept, left = mappings.refreshed(seqs.where("ex_id = 1"), ids, samples)
    assert rows(kept) == [(1, 0, "a"), (1, 1, "b")] and rows(left) == sorted([("a", "x"), ("a", "y"), ("b", "x")], key=repr)


def test_tables(spark, rows):
    snap = spark.createDataFrame([(100, 1, "x", 1), (100, 1, "x", 2), (100, 12, "y", 3), (300, 1, "y", 1)], "cutoff int, cluster_no int, sample string, seq_id int")
    assert rows(otu.dense(snap).where("cutoff = 100")) == sorted([(100, 1, "x", 2), (100, 1, "y", 0), (100, 12, "x", 0), (100, 12, "y", 1)], key=repr)
    assert rows(otu.wide(snap, 100)) == [("x", 2, 0), ("y", 0, 1)] and otu.wide(snap, 100).columns == ["sample", "OTU_01", "OTU_12"]
    listed = snap.select("cutoff").distinct()
    assert [otu.at_cutoff(listed, c).first().found for c in (50, 100, 299, 900)] == [100, 100, 100, 300]
    assert rows(otu.table_range(snap, 0, 200).where("cluster_no = 12")) == [(0, 12, "y", 1), (100, 12, "y", 1), (200, 12, "y", 1)]
    with pytest.raises(ValueError):
        otu.table_range(snap, 300, 200)
    assert otu.biom_json(snap, 100, "2031-01-01").count() == 3


def test_representatives(spark, rows):
    members = [(1, 1, "AAAA"), (1, 2, "AAAT"), (1, 3, "AATT"), (1, 4, "AAA-A-"), (2, 9, "C")]
    df = spark.createDataFrame(members, "grp int, id int, bases string")
    assert [(r.grp, r.id) for r in representatives.medoids(df, ["grp"]).orderBy("grp").collect()] == [(1, 4), (2, 9)]
    assert [(r.grp, r.id) for r in representatives.longest(df, ["grp"]).orderBy("grp").collect()] == [(1, 1), (2, 9)]
    liked = spark.createDataFrame([(3,), (77,)], "id int")
    assert [(r.grp, r.id) for r in representatives.medoids(df, ["grp"], liked).orderBy("grp").collect()] == [(1, 3), (2, 9)]
    assert [(r.grp, r.id) for r in representatives.medoids(df, ["grp"], liked, invert=True).orderBy("grp").collect()] == [(1, 4), (2, 9)]
    # Of three alike and one that shares no column with them, the odd one isn't in the middle.
    odd = spark.createDataFrame([(1, 1, "----TT"), (1, 2, "ACGT--"), (1, 3, "ACGA--"), (1, 4, "ACGT--")], "grp int, id int, bases string")
    assert [r.id for r in representatives.medoids(odd, ["grp"]).collect()] == [2]


def test_formats(spark, rows, tmp_path):
    seqs = spark.createDataFrame([("a b", "first one", "AC-GT"), ("c", "", "acgt" * 500)], "seq_name string, descr string, bases string")
    text.write_fasta(seqs, f"{tmp_path}/fa")
    assert rows(text.read_fasta(spark, f"{tmp_path}/fa").select("seq_name", "descr", "bases")) == [("a_b", "first one", "AC-GT"), ("c", "", "acgt" * 500)]
    (tmp_path / "pond.7.fa").write_text(">x one\nAC\nGT\n>#mask\nxx--\n>y\n-A\n")
    assert rows(text.read_fasta(spark, f"{tmp_path}/pond.7.fa").select("seq_name", "bases", "sample", "is_meta")) == sorted([("x", "ACGT", "pond.7", False), ("#mask", "xx--", "pond.7", True), ("y", "-A", "pond.7", False)], key=repr)
    ids = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "ex_id int, place int, seq_name string")
    text.id_mapping_lines(ids).select("line").write.text(f"{tmp_path}/ids")
    assert rows(text.read_id_mapping(spark, f"{tmp_path}/ids")) == rows(ids)
    samples = spark.createDataFrame([("a", "x"), ("b", "y")], "seq_name string, sample string")
    text.write_sample_mapping(samples, f"{tmp_path}/samples")
    assert rows(text.read_sample_mapping(spark, f"{tmp_path}/samples")) == rows(samples)
    (tmp_path / "weights").write_text("# none\na 2.5\n\nb\t1\n")
    assert rows(text.read_weights(spark, f"{tmp_path}/weights")) == [("a", 2.5), ("b", 1.0)]
    (tmp_path / "list").write_text(" a \n\nb\n")
    assert rows(text.read_id_list(spark, f"{tmp_path}/list")) == [("a",), ("b",)]
    snap = spark.createDataFrame([(0, 1, "x", 5), (0, 1, "x", 3), (0, 2, "y", 4), (350, 1, "x", 3)], "cutoff int, cluster_no int, sample string, seq_id int")
    text.write_cluster_file(snap, f"{tmp_path}/clust")
    assert rows(text.read_cluster_file(spark, f"{tmp_path}/clust")) == rows(snap)
    (tmp_path / "bad.clust").write_text("distance cutoff:\t0.1\nTotal Clusters:\t1\n1\tx\t3\t5 6 \n")
    with pytest.raises(Exception, match="count differs"):
        text.read_cluster_file(spark, f"{tmp_path}/bad.clust").collect()


def test_edge_files(spark, rows, tmp_path):
    edges = spark.createDataFrame([(1, 2, 0), (2, 300000, 1499), (-5, 7, 3)], "i int, j int, dist int")
    binary.export_edges(edges, f"{tmp_path}/edges")
    assert rows(binary.read_edges(spark, f"file://{tmp_path}/edges")) == rows(edges)
    with pytest.raises(Exception, match="joins an id with itself"):
        binary.packed_edges(spark.createDataFrame([(1, 1, 0)], "i int, j int, dist int")).collect()


def test_logs_and_stores(spark, rows, tmp_path):
    log = [(True, 7, None, 0, None), (True, 9, None, 1, None), (False, 0, 1, 2, 1499)]
    (tmp_path / "a.log").write_bytes(binary.merge_log(log))
    got = binary.read_merge_logs(spark, f"file://{tmp_path}/*.log").orderBy("step").collect()
    assert [tuple(r)[2:] for r in got] == log
    items = [(0, b"ACTGACTG"), (-1, b"AGGGGGGG"), (4, b"TTTTGGGG")]
    raw = binary.sequence_store(items)
    assert binary.parse_sequence_store(raw) == items and binary.parse_sequence_store(raw, 1, 5) == items[1:]
    with pytest.raises(ValueError):
        binary.parse_sequence_store(raw[:-1])
    with pytest.raises(ValueError):
        binary.sequence_store([(1, b"A"), (2, b"AC")])


def test_foreign_clusters(spark, rows):
    lines = [">Cluster 0", "0\t402nt, >N1... *", "1\t400nt, >N2... at +/99.75%", "junk", ">Cluster 1", "0\t10aa, >N3... at 97.5%"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, value string")
    assert rows(text.parse_clstr(df)) == sorted([(0, 402, "N1", True, None), (0, 400, "N2", False, 99.75), (1, 10, "N3", False, 97.5)], key=repr)


def test_stream(spark, rows, tmp_path):
    from reedbed.streaming.dereplication import first_seen, windowed_counts

    source = spark.createDataFrame([("a", "AC-GT", "2031-01-01 00:00:00"), ("b", "ACGT", "2031-01-01 01:00:00"), ("c", "TT", "2031-01-02 00:00:00")], "seq_name string, bases string, t string").selectExpr("seq_name", "bases", "CAST(t AS timestamp) AS t").coalesce(1)
    source.write.parquet(f"{tmp_path}/in")
    for name, f, mode in (("first", lambda s: first_seen(s, "t"), "append"), ("counts", lambda s: windowed_counts(s, "t", "bases"), "complete")):
        stream = spark.readStream.schema(source.schema).parquet(f"{tmp_path}/in")
        query = f(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp-{name}").trigger(availableNow=True).start()
        query.awaitTermination(60)
    assert sorted(r.bases for r in spark.table("first").collect()) in (["AC-GT", "TT"], ["ACGT", "TT"])
    assert sum(r.n for r in spark.table("counts").collect()) == 3


def test_rows_are_the_wide_table(spark):
    data = [(100, 1, "aligned_s", 1), (100, 1, "aligned_s", 2), (100, 12, "t", 3), (200, 1, "t", 1)]
    snap = spark.createDataFrame(data, "cutoff int, cluster_no int, sample string, seq_id int")
    got = {r.sample: dict(zip(r.otus, r.counts)) for r in otu.rows(snap).where("cutoff = 100").collect()}
    want = {r.sample: {k: v for k, v in r.asDict().items() if k != "sample"} for r in otu.wide(snap, 100).collect()}
    assert got == want == {"s": {"OTU_01": 2, "OTU_12": 0}, "t": {"OTU_01": 0, "OTU_12": 1}}


def test_documents_come_back_as_their_cells(spark, rows):
    import os

    from reedbed.plans.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    if not os.path.exists(folder):
        pytest.skip("no test data")
    got, want = QUERIES["biom_parsed"](spark, folder), QUERIES["biom_json"](spark, folder)
    assert got.dtypes == want.dtypes
    assert rows(got) == rows(want) != []

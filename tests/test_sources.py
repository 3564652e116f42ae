"""Readers and sinks on small files."""

import pytest

from lociweave.sources import midas, sinks


def test_site_matrices(spark, tmp_path):
    (tmp_path / "snps_depth.txt").write_text("site_id\tA\tB\naccn|x|7\t10\t0\nc|8|A\t20\t5\n")
    (tmp_path / "snps_ref_freq.txt").write_text("site_id\tA\tB\nc|8|A\t0.75\t1\naccn|x|7\t0.5\t0\n")
    got = {(r["contig"], r["pos"], r["sample"]): (r["depth"], r["alt"]) for r in midas.site_counts(spark, str(tmp_path), "s", ".txt").collect()}
    assert got == {("accn|x", 7, "A"): (10, 5), ("accn|x", 7, "B"): (0, 0), ("c", 8, "A"): (20, 5), ("c", 8, "B"): (5, 0)}


def test_duplicate_site_fails(spark, tmp_path):
    (tmp_path / "m.txt").write_text("site_id\tA\nc|1\t1\nc|1\t2\n")
    with pytest.raises(Exception, match="duplicate key"):
        midas.unique_keys(midas.wide(spark, str(tmp_path / "m.txt")), "site_id").collect()


def test_lz4(spark, tmp_path):
    import pyarrow as pa

    with pa.output_stream(str(tmp_path / "a.lz4"), compression="lz4") as f:
        f.write(b"one\ntwo\n\nthree")
    assert [r["value"] for r in midas.lz4_lines(spark, str(tmp_path / "a.lz4")).collect()] == ["one", "two", "", "three"]


def test_gene_sets_round_trip(spark, tmp_path):
    (tmp_path / "core.txt").write_text("sp1: g2, g1\nsp2: N/A\n")
    sets = midas.gene_sets(spark, str(tmp_path / "core.txt"), "core")
    assert sorted(map(tuple, sets.collect())) == [("sp1", "core", "g1"), ("sp1", "core", "g2")]
    assert [r["value"] for r in sinks.gene_set_lines(sets).collect()] == ["sp1: g1, g2"]


def test_packed_round_trip(spark):
    df = spark.createDataFrame([("A", 1.0, 5.0), ("A", 2.0, 7.0), ("B", 1.0, 1.0)], "sample string, depth double, n double")
    lines = sinks.packed(df, ["sample"], ["depth"], ["depth", "n"])
    assert sorted(map(tuple, midas.packed_cells(lines, ["sample"], ["depth", "n"]).collect())) == sorted(map(tuple, df.collect()))


def test_fasta_clades_newick(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">g1 some gene\nACG\nTT\n>g2\nA\n")
    assert sorted(map(tuple, midas.fasta(spark, str(tmp_path / "x.fa")).collect())) == [("g1", "ACGTT"), ("g2", "A")]
    (tmp_path / "clades.txt").write_text("sp_a\n1 s1\n2 s2\n-----\n3 s3\nsp_b\n1 s4\n")
    assert sorted(map(tuple, midas.manual_clades(spark, str(tmp_path / "clades.txt")).collect())) == [("sp_a", 1, "s1"), ("sp_a", 1, "s2"), ("sp_a", 2, "s3"), ("sp_b", 1, "s4")]
    assert midas.newick_leaves("((a:1,b:2):3,(c,d)e);") == ["a", "b", "c", "d"]


def test_phylip(spark):
    p = spark.createDataFrame([("a", "b", 0.5)], "sample_1 string, sample_2 string, d double")
    assert sinks.phylip(p, "d") == "2\na 0 0.5\nb 0.5 0"


def test_site_and_gene_tables(spark, tmp_path):
    line = "c|5\tA\tG\tx\ty\t4D\tg.1\n"
    (tmp_path / "snps_info.txt.bz2").write_bytes(__import__("bz2").compress(b"site_id\tmajor\tminor\ta\tb\tsite_type\tgene_id\n" + line.encode() + b"c|6\tA\tG\tx\ty\t1D\tNA\n"))
    got = sorted(map(tuple, midas.site_info(spark, str(tmp_path)).collect()))
    assert got == [("c", 5, "4D", "g.1"), ("c", 6, "1D", None)]
    (tmp_path / "genes_reads.txt").write_text("gene_id\tA\tB\ng1\t3\t4\ng2\t0\t1\n")
    (tmp_path / "genes_depth.txt").write_text("gene_id\tB\tA\ng1\t0.4\t0.3\ng2\t0.1\t0\n")
    (tmp_path / "genes_summary.txt").write_text("sample_id\ta\tb\tc\td\tmarker_coverage\nA\t1\t1\t1\t1\t20\nB\t1\t1\t1\t1\t30.5\n")
    got = {(r["gene_id"], r["sample"]): (r["reads"], r["depth"], r["marker_coverage"]) for r in midas.gene_counts(spark, str(tmp_path), "s", ".txt").collect()}
    assert got == {("g1", "A"): (3, 0.3, 20.0), ("g1", "B"): (4, 0.4, 30.5), ("g2", "A"): (0, 0.0, 20.0), ("g2", "B"): (1, 0.1, 30.5)}


def test_profiles_pathways_metadata(spark, tmp_path):
    (tmp_path / "coverage.txt").write_text("species_id\tA\tB\nsp1\t1.5\t\nsp2\t0\t7\n")
    assert sorted(map(tuple, midas.species_profile(spark, str(tmp_path / "coverage.txt")).collect())) == [("sp1", "A", 1.5), ("sp2", "A", 0.0), ("sp2", "B", 7.0)]
    (tmp_path / "pan.txt").write_text("gene_id\tgenome_id\tcentroid_99\tcentroid_95\ng1\tx\tc1\tk1\ng3\tx\tc1\tk1\ng2\ty\tc2\tk1\n")
    ref = spark.createDataFrame([("g1",)], "gene_id string")
    assert {r["name"] for r in midas.centroid_map(spark, str(tmp_path / "pan.txt"), ref).collect()} == {"g1"}
    assert {r["name"] for r in midas.centroid_map(spark, str(tmp_path / "pan.txt")).collect()} == {"g3"}
    (tmp_path / "meta.tsv").write_text("sample\ttissue_type\nA\tCecum\nB\tInoculum\n")
    assert {r["sample"]: r["ord"] for r in midas.metadata(spark, str(tmp_path / "meta.tsv")).collect()} == {"A": 4, "B": 1}
    (tmp_path / "bad.tsv").write_text("sample\ttissue_type\nA\tMoon\n")
    with pytest.raises(Exception, match="unknown site Moon"):
        midas.metadata(spark, str(tmp_path / "bad.tsv")).collect()
    a, b = spark.createDataFrame([("s1", "x"), ("s2", "x")], "sample string, country string"), spark.createDataFrame([("s2", "y")], "sample string, continent string")
    assert sorted((r["sample"], r["country"], r["continent"]) for r in midas.cohorts([a, b]).collect()) == [("s1", "x", None), ("s2", None, "y")]


def test_windowed_frequency_of_a_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from lociweave.streaming import sites

    rows = spark.createDataFrame([("2024-01-01 01:00:00", "a", "h", True), ("2024-01-01 09:00:00", "a", "h", False), ("2024-01-02 01:00:00", "a", "h", True)], "at string, species string, subject_id string, derived boolean")
    rows.select(F.to_timestamp("at").alias("ts"), "species", "subject_id", "derived").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, species string, subject_id string, derived boolean").parquet(str(tmp_path / "in"))
    query = sites.windowed_frequency(stream).writeStream.format("memory").queryName("windowed").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination(60)
    got = {(str(r["start"])[:10], r["freq"], r["n"]) for r in spark.table("windowed").collect()}
    assert got == {("2024-01-01", 0.5, 2), ("2024-01-02", 1.0, 1)}


def test_matrices_round_trip(spark, tmp_path):
    rows = [("s", "c", 7, "A", 10, 5), ("s", "c", 7, "B", 0, 0), ("s", "accn|x", 8, "A", 3, 1), ("s", "accn|x", 8, "B", 20, 20)]
    counts = spark.createDataFrame(rows, "species string, contig string, pos long, sample string, depth long, alt long")
    sinks.site_matrices(counts, ["A", "B"], str(tmp_path))
    assert any(f.name.endswith(".bz2") for f in (tmp_path / "snps_depth.txt").iterdir())
    assert sorted(map(tuple, midas.site_counts(spark, str(tmp_path), "s", ".txt").collect())) == sorted(rows)


@pytest.mark.parametrize("sep,compression,end", [("\t", "bzip2", ".bz2"), (",", "bzip2", ".bz2"), (",", "gzip", ".gz")])
def test_tables_round_trip(spark, tmp_path, sep, compression, end):
    rows = [("sp 1", "S1", 0.1234567890123, 5, None), ("sp,2", "S\t2", -1.0, 0, 'a "quoted" name')]
    df = spark.createDataFrame(rows, "species string, sample string, freq double, n long, note string")
    sinks.csv(df, str(tmp_path / "out"), sep, compression)
    assert any(f.name.endswith(end) for f in (tmp_path / "out").iterdir())
    got = spark.read.csv(str(tmp_path / "out"), sep=sep, header=True, schema=df.schema, escape="\\")
    assert sorted(map(tuple, got.collect())) == sorted(rows)


def test_private_snvs_and_haplotypes(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "sp.txt.gz", "wt") as f:
        f.write("contig, location, gene, type, host\nc, 7, g1, 4D, H1\nd, 8, g2, 1D, H2\n")
    assert sorted(map(tuple, midas.private_snvs(spark, str(tmp_path / "sp.txt.gz")).collect())) == [("c", 7, "g1", "4D", "H1"), ("d", 8, "g2", "1D", "H2")]
    folder = tmp_path / "haplotypes"
    folder.mkdir()
    head = "contig,gene_id,site_pos,site_type,A,B\n"
    (folder / "c_haplotypes.csv").write_text(head + "c,g1,7,4D,0,1\nc,g1,9,1D,,1\n")
    (folder / "d_haplotypes.csv").write_text(head + "d,g2,3,4D,1,0\n")
    got = sorted(map(tuple, midas.haplotypes(spark, f"{folder}/*_haplotypes.csv").collect()))
    assert got == [("c", "g1", 7, "4D", "A", 0), ("c", "g1", 7, "4D", "B", 1), ("c", "g1", 9, "1D", "B", 1), ("d", "g2", 3, "4D", "A", 1), ("d", "g2", 3, "4D", "B", 0)]
    assert midas.haplotypes(spark, f"{folder}/*_haplotypes.csv", ["B"]).select("sample").distinct().collect()[0][0] == "B"


def test_lines_as_the_format_lays_them_out(spark):
    from lociweave.sources import packed

    # a line of each format, as its description gives it
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    assert sorted(map(tuple, packed.from_cells(lines("S1\t3,7\t10,1"), ["sample"], {"depth": "bigint", "n": "bigint"}).collect())) == [("S1", 3, 7), ("S1", 10, 1)]
    totals, changes = packed.from_ragged(lines("sp,A,B,100,0.5,g1;7;0.1;0.9,g2;8;0.9;0", "sp,A,C,50,0.25"), ["species", "sample_1", "sample_2"], {"gene_id": "string", "pos": "bigint", "f1": "double", "f2": "double"})
    assert sorted(map(tuple, totals.collect())) == [("sp", "A", "B", 100, 0.5), ("sp", "A", "C", 50, 0.25)]
    assert sorted(map(tuple, changes.collect())) == [("sp", "A", "B", "g1", 7, 0.1, 0.9), ("sp", "A", "B", "g2", 8, 0.9, 0.0)]


def test_general_numbers_are_those_of_printf(spark):
    import math

    from pyspark.sql import functions as F

    from lociweave.sources import packed

    numbers = [0.0, -0.0, 0.01, -999.99, 9999.99, 123456.5, 1234565.0, 1234575.0, 100000.5, 999999.5, 1e-4, 2.5e-5, 1234.565, 1e22, 5e-324, 1e300, math.inf, -math.inf, math.nan]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate([*numbers, None])], "id int, v double")
    got = dict(rows.select("id", packed.general(F.col("v"))).collect())
    assert got == {**{k: "%g" % x for k, x in enumerate(numbers)}, len(numbers): None}
    assert rows.filter("id = 12").select(packed.general(F.col("v"), 3)).first()[0] == "1.23e+03"


def test_a_line_is_not_split_again_for_each_of_its_cells(spark):
    from lociweave.sources import packed

    lines = spark.createDataFrame([("a,b,1:2;3:4",)], "value string")
    made = [
        packed.from_contig_lists(lines), packed.from_ragged(lines, ["x"], {"y": "string"})[1], packed.from_ratio_cells(lines, ["x"], "bin"),
        packed.from_snp_lines(lines), packed.from_set_lines(lines, "x", "y"), packed.from_cells(lines, ["x"], {"y": "bigint"}),
    ]
    for rows in made:
        above = rows._jdf.queryExecution().optimizedPlan().toString().split("Generate explode")
        assert len(above) == 2 and "split(value" not in above[0]

import glob
import gzip

from pyspark.sql import functions as F

from helixtab.sources import sinks
from helixtab.sources import text_files as S
from helixtab.streaming import incremental

BED = """# comment
chr1\t100\t900\tgene1\tNA\t+

chr1\t1000\t1400\tTE1#LTR/Copia~LTRlen:100;CUT_BY:TE2#LTR/Gypsy\tACGTA\t+\tnew_TE
too\tshort
chr1\t1400\t2000\tTE2#LTR/Gypsy~LTRlen:50;NESTED_IN:TE1\tTTGCA\t-
chr2\t1\t50\tTE3_FRAG#DNA/Helitron\tNA\t+
"""


def put(folder, name, text):
    p = folder / name
    if name.endswith(".gz"):
        with gzip.open(p, "wt") as f:
            f.write(text)
    else:
        p.write_text(text)
    return str(p)


def test_features(spark, tmp_path):
    put(tmp_path, "gen100_final.bed", BED)
    put(tmp_path, "burnin.bed.gz", "c\t1\t2\tgene9\tNA\t+\n")
    rows = S.read_features(spark, str(tmp_path)).orderBy("sample_id", "line_no").collect()
    assert [(r["sample_id"], r["generation"], r["line_no"], r["start"]) for r in rows] == [("burnin", 0, 0, 1), ("gen100_final", 100, 0, 100), ("gen100_final", 100, 1, 1000), ("gen100_final", 100, 2, 1400), ("gen100_final", 100, 3, 1)]
    assert [r["tag"] for r in rows] == [None, None, "new_TE", None, None]


def test_lines_over_several_splits(spark, tmp_path):
    n = 20_000
    put(tmp_path, "long.bed", "".join(f"chr1\t{k}\t{k + 5}\tgene{k}\tNA\t+\n" for k in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 3
        assert S.read_features(spark, str(tmp_path)).filter("line_no != start").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_four_columns(spark, tmp_path):
    put(tmp_path, "genes.bed", "chr1\t5\t9\tgene1\n")
    r = S.read_features(spark, str(tmp_path), cols=4).first()
    assert (r["name"], r["tsd"], r["strand"]) == ("gene1", "NA", "+")


def test_sequences(spark, tmp_path):
    put(tmp_path, "a.fa", ">one first\nACGT\nacg\n>two#LTR/Copia\n\nTT\n>three\n")
    rows = S.read_sequences(spark, str(tmp_path)).orderBy("record_no").collect()
    assert [(r["header"], r["seq"]) for r in rows] == [("one", "ACGTacg"), ("two#LTR/Copia", "TT"), ("three", "")]
    assert S.read_sequences(spark, str(tmp_path), header="full", upper=True).orderBy("record_no").first()["header"] == "one first"


def test_gff(spark, tmp_path):
    row = "chr1\tx\tTE\t10\t20\t.\t+\t.\t"
    put(tmp_path, "a.gff", "##gff\n" + row + "ID=b_TE001#x;Name=TEa_1;Classification=LTR/Copia;Integrity=1.0;TSD_5=None;TSD_3=ACG\n" + row + "ID=c_TE7_z;Name=TEb_2;Classification=DNA/hAT;Nest_in=TE001;Cut_by=q_TE5\n" + row + "Note=nothing\nshort\n")
    names = [(r["name"], r["tsd"]) for r in S.gff_to_features(S.read_gff(spark, str(tmp_path))).orderBy("line_no").collect()]
    assert names == [("TEa#LTR/Copia", "ACG"), ("TEb_FRAG#DNA/hAT;CUT_BY:q;NESTED_IN:TEa#LTR/Copia", "NA")]


def test_calls_of_either_layout(spark, tmp_path):
    put(tmp_path, "a.scn", "# x\n20 10 " + "0 " * 9 + "chr1\nbad row\n")
    put(tmp_path, "b.list", "chr2:5..9 x\nchr3:9..5\nnone\n")
    got = {(r["sample_id"], r["chrom"], r["start"], r["end"], r["idx"]) for r in S.read_calls(spark, str(tmp_path)).collect()}
    assert got == {("a", "chr1", 10, 20, 0), ("b", "chr2", 5, 9, 0), ("b", "chr3", 5, 9, 1)}


def test_alignments_and_tables(spark, tmp_path):
    for k in ("paf", "fai", "w", "div", "hsp", "rep", "mut", "st"):
        (tmp_path / k).mkdir()
    put(tmp_path / "paf", "a.paf", "\t".join(["q", "100", "7", "50", "+", "t", "200", "3", "60", "40", "50", "60", "cg:Z:5M2I3D"]) + "\nshort\n")
    assert S.read_paf(spark, str(tmp_path / "paf")).first()[2:4] == ("q", 7)
    assert S.read_paf(spark, str(tmp_path / "paf"), "target").first()["aln_start"] == 3
    put(tmp_path / "fai", "g.fai", "chr1\t100\t5\nchr2\t50\t5\n")
    assert S.read_fai(spark, str(tmp_path / "fai")).agg(F.sum("length")).first()[0] == 150
    put(tmp_path / "w", "r.tsv", "#c\nLTR Copia 3 0\nDNA hAT 1 0\n")
    assert [(r["intact"], r["fragment"]) for r in S.read_weights(spark, str(tmp_path / "w")).orderBy(F.desc("intact")).collect()] == [(0.75, 0.5), (0.25, 0.5)]
    put(tmp_path / "div", "gen5_LTR.tsv", "e1\t100\t90\t1\t1\t0\t0.1\t5\tNA\t6\t0.2\t7\n")
    put(tmp_path / "div", "head.tsv", "#qseqid\tIdentity\nx\t0.9\n")
    got = {r["element"]: (r["generation"], r["values"]) for r in S.read_divergence(spark, str(tmp_path / "div")).collect()}
    assert got["e1"][0] == 5 and got["e1"][1]["k2p_d"] == 0.2 and got["e1"][1]["jc69_d"] is None and got["x"][1] == {"identity": 0.9}
    put(tmp_path / "hsp", "h.tsv", "a\tb\t1\t2\t3\t4\t5\t6\t7\t8\t5AG\nshort\n")
    assert S.read_hsps(spark, str(tmp_path / "hsp")).first()["btop"] == "5AG"
    put(tmp_path / "rep", "p.report", "Generation\tTE_inserts(nest/nonnest)\tC\tA\n10000\t154(50/104)\t30\t29\n")
    assert S.read_report(spark, str(tmp_path / "rep")).first()[2:] == (10000, 154, 50, 104, 30, 29)
    put(tmp_path / "mut", "gen7_mut.txt", "Genome size: 1000\nTotal mutations: 20\nRecurrent mutations: 1\nMutions / site: 0.02\n")
    r = S.read_mutation_reports(spark, str(tmp_path / "mut")).first()
    assert (r["genome_size"], r["per_site"], r["generation"]) == (1000.0, 0.02, 7)
    put(tmp_path / "st", "s.txt", "SAMPLE: 1\nTotal: 5\nLTR: 3\nSAMPLE: 2\nTotal: 1\n")
    assert [tuple(r)[1:] for r in S.read_stat_blocks(spark, str(tmp_path / "st")).orderBy("sample", "n").collect()] == [("1", "LTR", 3), ("1", "Total", 5), ("2", "Total", 1)]


def test_sinks_read_back(spark, tmp_path):
    put(tmp_path, "gen1_final.bed", BED)
    f = S.read_features(spark, str(tmp_path / "gen1_final.bed"))
    sinks.write_features(f, str(tmp_path / "out"), tag=True)
    lines = [x for p in sorted(glob.glob(f"{tmp_path}/out/sample_id=gen1_final/*.txt")) for x in open(p).read().splitlines()]
    assert [x.split("\t")[1] for x in lines] == ["100", "1000", "1400", "1"] and lines[1].endswith("new_TE")
    s = spark.createDataFrame([("s", 0, "h", "ACGT" * 40)], "sample_id string, record_no long, header string, seq string")
    sinks.write_sequences(s, str(tmp_path / "fa"))
    text = open(glob.glob(f"{tmp_path}/fa/sample_id=s/*.txt")[0]).read().splitlines()
    assert text[0] == ">h" and [len(x) for x in text[1:]] == [60, 60, 40]
    long = spark.createDataFrame([("LTR", "gen1_final", 3), ("DNA", "gen2_final", 1)], "category string, file string, n long")
    sinks.write_wide_stats(long, str(tmp_path / "wide"), ["category"], ["gen1_final", "gen2_final"])
    back = S.read_wide_stats(spark, str(tmp_path / "wide"), ["category"])
    assert {(r["category"], r["generation"], r["n"]) for r in back.collect()} == {("LTR", 1, 3), ("LTR", 2, 0), ("DNA", 1, 0), ("DNA", 2, 1)}
    sinks.write_tsv(spark.createDataFrame([(1.23456, 7.9)], "d double, t double"), str(tmp_path / "tsv"), {"d": 4}, ("t",))
    assert "1.2346\t7" in open(glob.glob(f"{tmp_path}/tsv/*.csv")[0]).read()


def test_incremental_statistics(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    put(src, "gen1_final.bed", BED)
    run = lambda: incremental.statistics(spark, str(src), out, str(tmp_path / "cp")).awaitTermination()
    run()
    put(src, "gen2_final.bed", BED.replace("TE3_FRAG", "TE3"))
    run()
    got = {(r["sample_id"], r["category"]): r["n"] for r in spark.read.parquet(f"{out}/categories").collect()}
    assert got == {("gen1_final", "Intact gene"): 1, ("gen1_final", "Fragmented TE"): 2, ("gen1_final", "Intact TE"): 1, ("gen2_final", "Intact gene"): 1, ("gen2_final", "Fragmented TE"): 1, ("gen2_final", "Intact TE"): 2}
    assert {r["generation"] for r in incremental.by_generation(spark.read.parquet(f"{out}/categories")).collect()} == {1, 2}


def test_features_that_begin_at_one_place_keep_their_order(spark, tmp_path):
    """Written from rows in any order; without line numbers, in order of their text."""
    rows = [("a", "chr1", 7 if k < 900 else k, 1000 + k * 389 % 1009, f"gene{k * 71 % 997}", k) for k in range(1000)]
    f = spark.createDataFrame(rows, "sample_id string, chrom string, start bigint, end bigint, name string, line_no bigint").withColumns({"tsd": F.lit("NA"), "strand": F.lit("+")})
    f = f.repartition(7, F.xxhash64("name"))
    sinks.write_features(f, str(tmp_path / "numbered"), ranges=3)
    assert {r["line_no"]: r["name"] for r in S.read_features(spark, str(tmp_path / "numbered")).collect()} == {r[5]: r[4] for r in rows}
    written = []
    for name, parts in (("x", 3), ("y", 5)):
        sinks.write_features(f.drop("line_no").repartition(parts), str(tmp_path / name), ranges=2)
        written.append([r["name"] for r in S.read_features(spark, str(tmp_path / name)).orderBy("line_no").collect()])
    assert written[0] == written[1]


def test_both_anchors_of_paf_rows_come_from_one_reading(spark, tmp_path):
    put(tmp_path, "a.paf", "q\t9\t7\t8\t+\tt\t9\t3\t4\t5\t5\t60\tNM:i:1\tcg:Z:5M\nq\t9\tx\t8\t-\tu\t9\t6\t4\t5\t5\t60\tcg:Z:7M\nq\t9\t1\t8\t-\tu\t9\t6\t4\t5\t5\t60\tNM:i:0\n")
    both = S.read_paf(spark, str(tmp_path), "both")
    assert sorted((r["line_no"], r["anchor"], r["chrom"], r["aln_start"], r["cigar"]) for r in both.collect()) == [(0, "query", "q", 7, "5M"), (0, "target", "t", 3, "5M"), (1, "target", "u", 6, "7M")]
    for anchor in ("query", "target"):
        one = S.read_paf(spark, str(tmp_path), anchor)
        assert sorted(map(str, one.collect())) == sorted(map(str, both.filter(F.col("anchor") == anchor).drop("anchor").collect()))


def test_of_repeated_attributes_the_last_counts(spark):
    rows = spark.createDataFrame([("ID=a;Name=b=c;ID=d",), ("ID:a; Name=b",), ("",), (None,)], "a string")
    assert [r[0] for r in rows.select(S.attribute_map(F.col("a"))).collect()] == [{"ID": "d", "Name": "b=c"}, {"ID": "a", "Name": "b"}, {}, None]

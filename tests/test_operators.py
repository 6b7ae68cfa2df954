"""Edge cases of operators that work over whole groups, libraries or files."""

import math

import pytest
from pyspark.sql import functions as F

from helixtab import scratch
from helixtab.functions import names as N
from helixtab.functions.arrays import let, running
from helixtab.operators import alignments, classify, density, ordering, reports, sampling, sequences
from helixtab.sources import sinks
from helixtab.sources import text_files as S


def test_running_equals_a_plain_fold(spark):
    sizes = (0, 1, 63, 64, 65, 128, 5000)
    df = spark.createDataFrame([(n, [(k * 7919) % 101 - 50 for k in range(n)]) for n in sizes], "n int, x array<int>")
    for step, plain in ((lambda a, b: a + b, lambda a, b: a + b), (lambda a, b: F.greatest(a, b), max)):
        for r in df.withColumn("y", running(F.col("x"), F.lit(0), step)).collect():
            want = [0]
            for v in r["x"]:
                want.append(plain(want[-1], v))
            assert r["y"] == want
    assert spark.range(1).select(let(F.lit(3), lambda x: x * x).alias("y")).first()["y"] == 9


def test_long_cigars(spark):
    n = 100_000
    df = spark.createDataFrame([("3M2I" * n, 10), ("", 0), (None, 0), ("5M", 1)], "cigar string, aln_start bigint")
    got = alignments.indel_events(df).groupBy("kind").agg(F.count("*").alias("n"), F.max("position").alias("p"), F.sum("size").alias("s")).collect()
    assert [(r["kind"], r["n"], r["p"], r["s"]) for r in got] == [("I", n, 10 + 3 * n, 2 * n)]


def test_two_valued_lengths(spark):
    df = spark.createDataFrame([("DNAauto", "pile", "A" * n) for n in (2, 3, 9, 10)] + [("DNA", "dth", "AAA"), ("x", None, "AAAAA"), (None, None, "NA")], "class string, superfamily string, tsd string")
    assert [r["tsd_ok"] for r in sequences.with_tsd_rule(df).collect()] == [True, False, False, True, True, True, False]


def test_density_equals_all_pairs(spark):
    xs = [(k * k) % 97 + 0.25 * (k % 3) for k in range(80)]
    df = spark.createDataFrame([("a", float(x)) for x in xs] + [("b", 1.0), ("b", 1.0), ("c", 5.0)], "g string, x double")
    hist = density.histogram(df, "x", ["g"])
    at = spark.createDataFrame([("a", 10.0), ("a", -1e6), ("b", 1.0), ("c", 5.0)], "g string, at double")
    got = {(r["g"], r["at"]): r["density"] for r in density.density_at(at, hist, ["g"]).collect()}
    mean = sum(xs) / len(xs)
    bw = len(xs) ** -0.2 * math.sqrt(sum((x - mean) ** 2 for x in xs) / (len(xs) - 1))
    want = sum(math.exp(-0.5 * ((10 - x) / bw) ** 2) for x in xs) / (len(xs) * bw * math.sqrt(2 * math.pi))
    assert abs(got["a", 10.0] - want) < 1e-12 and got["a", -1e6] == 0 and got["b", 1.0] is None and got["c", 5.0] is None


def test_members_of_categories_and_of_all(spark):
    library = spark.createDataFrame([(10 * k, "xy"[k % 2]) for k in range(50)], "member bigint, category string")
    draws = spark.createDataFrame([(k, c) for k, c in enumerate("xyz" * 40)], "draw bigint, category string")
    got = sampling.pick_members(draws, library, 3).collect()
    assert len(got) == 120 and all((r["member"] // 10) % 2 == "xy".index(r["category"]) for r in got if r["category"] != "z") and len({r["member"] for r in got if r["category"] == "z"}) > 10


def test_log_records(spark):
    total = "Total TE insertions performed: {} (Nested: 1, Non-nested: 2)"
    lines = ["Selected 3 removal events", total.format(1), "noise Selected", "Calculated number of TE excisions: 7", "Selected 4 removal events", "Calculated number of TE excisions: 8", "Updated FASTA written to gen5_final.fasta", "Selected 9 removal events",
             "Updated FASTA written to gen6_final.fasta", total.format(2), total.format(3), "Calculated number of TE excisions: 1", "Updated FASTA written to gen9_x", total.format(4), "Calculated number of TE excisions: 2"]
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate(lines)] + [("b", 0, None)], "source string, line_no bigint, value string")
    got = sorted((r["generation"], r["inserts"], r["deletions_calc"], r["deletions_actual"]) for r in reports.log_sessions(df).collect())
    assert got == [(5, 1, 8, 4), (9, 3, 1, 0)]


def test_names_are_numbered_in_order(spark):
    df = spark.createDataFrame([(k * 70_000, "ab"[k % 2], "ACGT") for k in range(6)], "line_no bigint, header string, seq string")
    got = {r["line_no"] // 70_000: r["unique_name"] for r in sequences.uniquify_names(df).collect()}
    assert got == {0: "a", 1: "b", 2: "a_1", 3: "b_1", 4: "a_2", 5: "b_2"}
    both = df.unionByName(spark.createDataFrame([(999_999, "a", "ACGT"), (999_998, "a", "TT")], df.schema))
    assert {(r["header"], r["seq"], r["line_no"]) for r in sequences.dedupe_sequences(both).collect()} == {("a", "ACGT", 0), ("b", "ACGT", 70_000), ("a", "TT", 999_998)}


def test_totals_of_groups(spark):
    df = spark.createDataFrame([("g", k * 40_000, 1.5) for k in range(5)] + [("h", 1, 2.0)], "g string, at bigint, w double")
    got = {(r["g"], r["at"]): (r["before"], r["all"]) for r in ordering.with_prefix(df, ["g"], [ordering.part_of("at")], ["at"], F.col("w"), "before", total="all").collect()}
    assert got["g", 120_000] == (4.5, 7.5) and got["h", 1] == (None, 2.0)


def test_runs_of_candidates_over_parts(spark):
    """Every second row is a candidate around the border of two parts; each row serves in one group."""
    host = "gene1"
    rows = [("s", k, host if k % 2 == 0 else "TE1#LTR/Gypsy;NESTED_IN:gene1", "NA", "+") for k in range(65_530, 65_545)]
    df = spark.createDataFrame(rows, "sample_id string, line_no bigint, name string, tsd string, strand string")
    got = {r["line_no"]: r["nest_group"] for r in classify.nest_groups(df).collect()}
    middles = sorted({g for g in got.values() if g is not None})
    assert middles == [65_531, 65_535, 65_539, 65_543] and all(abs(k - g) <= 1 for k, g in got.items() if g is not None)


def test_folders_of_samples_are_read_back(spark, tmp_path):
    n = 3000
    df = spark.range(n).select((F.concat(F.lit("gen"), (F.col("id") % 2 * 100).cast("string"))).alias("sample_id"), F.lit("c").alias("chrom"), F.col("id").alias("start"), (F.col("id") + 5).alias("end"), F.lit("gene1").alias("name"), F.lit(None).cast("string").alias("tsd"), F.lit("-").alias("strand"))
    sinks.write_features(df, f"file://{tmp_path}/bed")
    got = S.read_features(spark, f"file://{tmp_path}/bed").collect()
    assert len(got) == n and all(r["start"] == 2 * r["line_no"] + (r["sample_id"] == "gen100") and r["generation"] == int(r["sample_id"][3:]) and r["tsd"] == "NA" for r in got)


def test_filter_ltr_modes(spark):
    df = spark.createDataFrame([("TE1#LTR/Gypsy~LTRlen:5", "Intact TE"), ("TE2#LTR/Gypsy", "Fragmented TE"), ("LTRx#DNA/hAT", "Intact TE"), ("plain", "Intact TE"), (None, None)], "header string, category string").withColumn("feature_id", F.col("header"))
    assert [N.filter_ltr(df, m).count() for m in ("header", "class", "length")] == [3, 1, 4]
    with pytest.raises(ValueError):
        N.filter_ltr(df, "other")


def test_scratch_is_shared_or_refused():
    class Fake:
        def __init__(self, master, folder=None):
            self.sparkContext, self.conf, self.folder = self, self, folder
            self.master, self.applicationId = master, "app-1"

        def get(self, key, default=None):
            return self.folder

    assert scratch.scratch_root(Fake("spark://h:1", "hdfs://x/")) == "hdfs://x" and scratch.scratch_root(Fake("local[4]")).endswith("app-1")
    for master in ("spark://h:1", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            scratch.scratch_root(Fake(master))

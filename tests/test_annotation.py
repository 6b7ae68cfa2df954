"""Operators on small tables: worked examples and the rules that are easily got wrong."""

import pytest
from pyspark.sql import functions as F

from helixtab.functions import names as N
from helixtab.operators import aggregates as A
from helixtab.operators import alignments as L
from helixtab.operators import classify as C
from helixtab.operators import intervals as I
from helixtab.operators import liftover, overlap, sampling
from helixtab.operators import reports as R
from helixtab.operators import sequences as S


def table(spark, rows):
    """(name, tsd, strand[, chrom, start, end]) in line order."""
    full = [("s", k, *(r[3:] or ("chr1", 10 * k, 10 * k + 10)), *r[:3]) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, "sample_id string, line_no long, chrom string, start long, end long, name string, tsd string, strand string")


def categories(df, **kw):
    return [r["category"] for r in C.classify(df, **kw).orderBy("line_no").collect()]


def test_base_categories(spark):
    rows = [("gene1", "NA", "+"), ("gene2;CUT_BY:x", "NA", "+"), ("T#LTR/Copia~LTRlen:5_SOLO", "A", "+"), ("T_FRAG#DNA/hAT", "C", "+"), ("T#LTR/Copia;CUT_BY:y", "G", "+"), ("T#LTR/Copia;NESTED_IN:a;CUT_BY:y", "T", "+"), ("T_FRAG#LTR/Copia_SOLO", "TT", "+")]
    assert categories(table(spark, rows)) == ["Intact gene", "Fragmented gene", "SoloLTR", "Fragmented TE", "Fragmented TE", "Intact TE", "SoloLTR"]
    assert categories(table(spark, rows), frag_first=True)[-1] == "Fragmented TE"


def test_neighbours_need_an_attribute_unless_strict(spark):
    pair = [("T1#LTR/Copia", "NA", "+"), ("T1#LTR/Copia;NESTED_IN:g", "NA", "+")]
    assert categories(table(spark, pair)) == ["Intact TE", "Fragmented TE"]
    assert categories(table(spark, pair), require_attr=False) == ["Fragmented TE", "Fragmented TE"]


@pytest.mark.parametrize("gap,demoted", [(100, True), (101, False)])
def test_neighbour_distance(spark, gap, demoted):
    filler = [(f"X{k}#DNA/hAT", "C", "-") for k in range(gap - 1)]
    rows = [("T1#LTR/Copia;NESTED_IN:g", "A", "+"), *filler, ("T1#LTR/Copia;NESTED_IN:g;x", "A", "+")]
    assert (categories(table(spark, rows))[0] == "Fragmented TE") is demoted


def test_name_parts(spark):
    names = ["T#LTR/Copia~LTRlen:9", "T#LTR/Copia~LTRlen:9_SOLO", "T#LTR/Copia~LTRlen:9~LTRdiv:1", "T#DNA/hAT~LTRlen:9", "T#LTR", "gene1"]
    df = spark.createDataFrame([(n,) for n in names], "feature_id string")
    got = [tuple(r) for r in N.with_te_info(df, ltr=True).select("class", "superfamily", "ltr_len").collect()]
    assert got == [("LTR", "Copia", 9), ("LTR", "Copia", None), ("LTR", "Copia", None), ("DNA", "hAT", None), (None, None, None), (None, None, None)]
    one = df.limit(1)
    assert one.select(N.add_frag_tag(F.lit("TE_00004120#DNA/Helitron"))).first()[0] == "TE_00004120_FRAG#DNA/Helitron"
    assert one.select(N.add_solo_tag(F.lit("a#LTR/x~LTRlen:5;CUT_BY:q"))).first()[0] == "a#LTR/x~LTRlen:5_SOLO;CUT_BY:q"
    assert [one.select(N.fmt_sci(F.lit(x))).first()[0] for x in (0.045, 1234.0, 2e-10)] == ["4.5e-2", "1.2e3", "2.0e-10"]
    assert [one.select(N.generation_of(F.lit(x), s)).first()[0] for x, s in (("burnin.bed", "loose"), ("gen20_final.bed", "loose"), ("gen20_x", "exact"), ("Generation 7", "title"))] == [0, 20, None, 7]


def test_part_types(spark):
    names = ["X_LTR#LTR/Copia", "X_INT#LTR/Copia", "X_I#LTR/Copia", "GYPSYIx#LTR/Gypsy", "plain#LTR/x", "A__LTR_#LTR"]
    got = [tuple(r) for r in N.with_part_type(spark.createDataFrame([(n,) for n in names], "header string")).select("part", "base", "superfamily").collect()]
    assert got == [("ltr", "X", "Copia"), ("internal", "X", "Copia"), ("internal", "X", "Copia"), ("internal", "GYPSYx", "Gypsy"), ("unknown", "plain", "x"), ("ltr", "A", None)]


def test_end_repair_and_reverse_complement(spark):
    df = spark.createDataFrame([("x#LTR/Copia~LTRlen:4", "GCTAGCGGCACG"), ("x#LTR/Copia~LTRlen:7", "GCTAGCGGCACG")], "header string, seq string")
    assert [r["seq"] for r in S.repair_ltr_ends(df).collect()] == ["GCTAGCGGGCTA", "GCTAGCGGCACG"]
    assert df.select(S.revcomp(F.lit("AcgTN"))).first()[0] == "NAcgT"


def test_stitching(spark):
    rows = [(0, "X_I#LTR/Copia", "ii"), (1, "X_LTR#LTR/Copia", "aa"), (2, "X_LTR#LTR/Copia", "bb"), (3, "Y_I#LTR", "yy"), (4, "Z#DNA/hAT", "zz")]
    df = spark.createDataFrame(rows, "line_no long, header string, seq string")
    got = {(r["header"], r["seq"]) for r in S.stitch_parts(df).collect()}
    assert got == {("X_1#LTR/Copia", "aaiiaa"), ("X_2#LTR/Copia", "bbiibb"), ("Y_I#LTR", "yy"), ("Z#DNA/hAT", "zz")}
    assert "Y_I#LTR" not in {r["header"] for r in S.stitch_parts(df, drop_unmatched_internal=True).collect()}


def test_nest_groups_are_greedy(spark):
    host, te = "gene1;CUT_BY:x", "T#LTR/Copia;NESTED_IN:gene1"
    got = [r["subtype"] for r in C.nest_groups(table(spark, [(host, "NA", "+"), (te, "A", "+"), (host, "NA", "+"), (te, "A", "+"), (host, "NA", "+")])).orderBy("line_no").collect()]
    assert got == ["CUT_PAIR_GENE_1", "NEST_TE_IN_GENE", "CUT_PAIR_GENE_2", "NON_NEST_GROUP_TE", "NON_NEST_GROUP_GENES"]


def test_nest_groups_cross_parts_of_lines(spark, monkeypatch):
    from helixtab.operators import ordering

    rows = [("gene1", "NA", "+"), ("T#LTR/Copia;NESTED_IN:g", "A", "+"), ("gene1", "NA", "+")] * 40
    want = [r["subtype"] for r in C.nest_groups(table(spark, rows)).orderBy("line_no").collect()]
    monkeypatch.setattr(ordering, "PART", 7)
    assert [r["subtype"] for r in C.nest_groups(table(spark, rows)).orderBy("line_no").collect()] == want
    assert want.count("NEST_TE_IN_GENE") == 40


def test_consolidation_takes_the_last_end(spark):
    rows = [("gene1;CUT_BY:a", "NA", "+", "c", 0, 50), ("gene1;CUT_BY:b", "NA", "+", "c", 10, 20), ("gene1", "A", "+", "c", 30, 40)]
    got = [(r["start"], r["end"], r["name"]) for r in C.consolidate_adjacent(table(spark, rows)).orderBy("start").collect()]
    assert got == [(0, 20, "gene1"), (30, 40, "gene1")]


def test_intervals(spark):
    df = table(spark, [("a", "NA", "+", "c", 0, 10), ("b", "NA", "+", "c", 10, 20), ("c", "NA", "+", "c", 25, 30), ("d", "NA", "+", "c", 26, 27), ("e", "NA", "+", "c", 200_000, 200_010)])
    span = lambda d: sorted((r["start"], r["end"]) for r in d.collect())
    assert span(I.merge_intervals(df)) == [(0, 20), (25, 30), (200_000, 200_010)]
    size = spark.createDataFrame([("s", "c", 300_000), ("s", "empty", 7)], "sample_id string, chrom string, length long")
    assert span(I.complement_intervals(df, size)) == [(0, 7), (20, 25), (30, 200_000), (200_010, 300_000)]
    points = spark.createDataFrame([("s", "c", p) for p in (0, 20, 22, 30, 199_999, 200_005)], "sample_id string, chrom string, position long")
    inside = lambda closed: {r["position"] for r in I.points_in_intervals(points, I.merge_intervals(df), closed=closed).collect() if r["inside"]}
    assert inside(True) == {0, 20, 30, 200_005} and inside(False) == {0, 200_005}


def test_lift_over_is_strict(spark):
    df = table(spark, [("a", "NA", "+", "c", 5, 8), ("b", "NA", "+", "c", 6, 9), ("d", "NA", "+", "c", 80_000, 80_001)])
    events = spark.createDataFrame([("s", "c", 5, 2), ("s", "c", 70_000, 10)], "sample_id string, chrom string, position long, length long")
    assert sorted((r["start"], r["end"]) for r in liftover.lift_over(df, events).collect()) == [(4, 7), (5, 8), (79_988, 79_989)]


def test_insertions_cut_features(spark):
    df = table(spark, [("g", "NA", "+", "c", 0, 100), ("h", "NA", "+", "c", 50, 60), ("i", "NA", "+", "c", 100, 110)])
    events = spark.createDataFrame([("s", "c", 50, 5, "N1"), ("s", "c", 100, 7, "N2")], "sample_id string, chrom string, position long, length long, name string")
    got = sorted((r["name"], r["start"], r["end"]) for r in liftover.apply_insertions(df, events).collect())
    assert got == [("g;CUT_BY:N1", 0, 50), ("g;CUT_BY:N1", 55, 105), ("h", 55, 65), ("i", 112, 122)]
    assert {r["name"] for r in liftover.inserted_features(df, events).collect()} == {"N1;NESTED_IN:g", "N2"}


def test_overlap_takes_the_first_feature(spark):
    f = spark.createDataFrame([("s", "c", 2, 0, 100), ("s", "c", 1, 0, 100), ("s", "c", 3, 50_000, 150_000)], "sample_id string, chrom string, feature_no long, start long, end long")
    c = spark.createDataFrame([("s", "c", 1, 10, 100), ("s", "c", 2, 55_000, 150_000), ("s", "d", 3, 0, 10), ("s", "c", 4, 400, 500)], "sample_id string, chrom string, call_id long, start long, end long")
    match = lambda r: {(x["call_id"], x["feature_no"]) for x in overlap.reciprocal_overlap(c, f, r).collect()}
    assert match(0.9) == {(1, 1), (2, 3)} and match(0.96) == set() and match(0.0) == {(1, 1), (2, 1), (4, 1)}


def test_distances(spark):
    rows = [(10, 5, 85), (0, 0, 0), (90, 0, 10), (40, 30, 30)]
    got = L.distances(spark.createDataFrame(rows, "transitions int, transversions int, nident int"), 1e-8).collect()
    import math

    assert abs(got[0]["jc69_d"] + 0.75 * math.log(1 - 4 * 0.15 / 3)) < 1e-12 and abs(got[0]["k2p_d"] + 0.5 * math.log((1 - 0.2 - 0.05) * math.sqrt(0.9))) < 1e-12
    assert got[1]["raw_d"] == got[1]["jc69_d"] == got[1]["k2p_d"] == 0
    assert got[2]["jc69_d"] == got[2]["k2p_d"] == 0.9 and got[3]["k2p_d"] == 0.7


def test_odd_btop_counts_as_a_hit(spark):
    rows = [("e", "e", 1, 500, 500, 1, 500, 500, 400, 390, "5AG3"), ("e", "e", 1, 500, 500, 1, 500, 500, 400, 390, "5A3")]
    r = L.element_divergence(spark.createDataFrame(rows, "qseqid string, sseqid string, sstart int, send int, slen int, qstart int, qend int, qlen int, aln_len int, nident int, btop string"), 1e-8).first()
    assert r["hits"] == 2 and r["transitions"] == 1 and abs(r["raw_d"] - 1 / 391 / 2) < 1e-12


def test_log_sessions(spark):
    lines = [
        "Selected 9 removal events", "Total TE insertions performed: 10 (Nested: 4, Non-nested: 6)", "Total TE insertions performed: 20 (Nested: 5, Non-nested: 15)", "Calculated number of TE excisions: 3", "Selected 1 removal events", "Selected 2 removal events",
        "Updated FASTA written to gen100_final.fasta", "Selected 7 removal events", "Total TE insertions performed: 1 (Nested: 0, Non-nested: 1)", "Updated FASTA written to gen200_final.fasta",
    ]
    df = spark.createDataFrame([("r", k, v) for k, v in enumerate(lines)], "source string, line_no long, value string")
    assert [tuple(r)[2:] for r in R.log_sessions(df).collect()] == [(100, 20, 5, 15, 3, 3)]


def test_generations_and_apportionment(spark):
    g = spark.createDataFrame([(k,) for k in range(0, 60, 10)], "generation long")
    pick = lambda k: sorted(r[0] for r in A.select_generations(g, k).collect())
    assert pick(3) == [0, 20, 50] and pick(1) == [0, 50] and pick(99) == list(range(0, 60, 10))
    w = spark.createDataFrame([(k, k, x) for k, x in enumerate((100.0, 1.0, 1.0, 0.0))], "id int, rank int, weight double")
    split = lambda n, m: [r["allotted"] for r in overlap.apportion(w, n, method=m).orderBy("rank").collect()]
    assert sum(split(7, "largest")) == 7 and split(10, "min1") == [9, 0, 1, 0]
    assert split(2, "min1") == [1, 0, 1, 0]


def test_weighted_sample_is_the_same_anywhere_and_fair(spark):
    df = spark.range(300).withColumn("w", F.when(F.col("id") < 100, 9.0).otherwise(1.0))
    one = {r["id"] for r in sampling.weighted_sample(df, 60, "w", 4).collect()}
    assert one == {r["id"] for r in sampling.weighted_sample(df.repartition(7), 60, "w", 4).collect()} and len(one) == 60
    heavy = sum(len({r["id"] for r in sampling.weighted_sample(df, 60, "w", s).collect()} & set(range(100))) for s in range(5)) / 5
    assert 40 < heavy < 57


def test_nothing_in_nothing_out(spark):
    empty = table(spark, [("a", "NA", "+")]).limit(0)
    assert C.classify(empty).count() == C.nest_groups(empty).count() == C.consolidate_adjacent(empty).count() == I.merge_intervals(empty).count() == 0


def test_overlap_of_dense_intervals_is_that_of_all_pairs_without_a_table_of_pairs(spark):
    import random

    rng = random.Random(4)
    span = lambda: (a := rng.randrange(-300, 20_000), a + rng.choice([0, 1, 7, 100, 1023, 1024, 1025, 2500, 40_000]) + rng.randrange(60))
    features = [("s", rng.choice("cd"), k, *span()) for k in range(1500)] + [(None, "c", 1500, 0, 100), ("s", "c", 1501, None, 100), ("s", "c", 1502, 5000, 5600)]
    calls = [("s", rng.choice("cd"), k, *span()) for k in range(600)] + [(None, "c", 600, 0, 100), ("s", "c", 601, None, 100), ("s", "c", 602, 5000, 5600)]
    schema = "sample_id string, chrom string, {} long, start long, end long"
    f, c = spark.createDataFrame(features, schema.format("feature_no")), spark.createDataFrame(calls, schema.format("call_id"))
    for r in (0.3, 0.5, 0.9, 1.0):
        want = {}
        for s, chrom, k, a, b in calls:
            shared = [(x, no, min(b, y) - max(a, x), y - x) for s2, c2, no, x, y in features if None not in (s, s2, a, x) and c2 == chrom]
            fit = [(x, no) for x, no, n, size in shared if n > 0 and n / (b - a) >= r and n / size >= r]
            if fit:
                want[k] = min(fit)[1]
        found = overlap.reciprocal_overlap(c, f, r)
        assert {x["call_id"]: x["feature_no"] for x in found.collect()} == want and want
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_pieces_of_insertions_are_those_of_all_pairs_and_never_shuffled(spark):
    import random

    rng = random.Random(6)
    spans = [(k, a := rng.randrange(-2000, 9000), a + rng.choice([0, 1, 300, 1023, 1024, 1025, 5000])) for k in range(200)]
    points = sorted(rng.sample(range(-1900, 9000), 150))
    events = [("s", "c", p, rng.randrange(1, 90), f"N{p}") for p in points] + [("s", "c", points[7], 5, "A")]
    want = []
    for k, a, b in spans:
        inside = sorted((p, n) for _, _, p, _, n in events if a < p < b)
        at = [a, *(p for p, _ in inside), b]
        for i, (x, y) in enumerate(zip(at[:-1], at[1:], strict=True)):
            shift = sum(e[3] for e in events if e[2] <= x)
            want.append((k, i, f"f{k}" + "".join(f";CUT_BY:{n}" for _, n in inside), x + shift, y + shift))
    f = spark.createDataFrame([("s", "c", k, f"f{k}", a, b) for k, a, b in spans], "sample_id string, chrom string, line_no long, name string, start long, end long")
    out = liftover.apply_insertions(f, spark.createDataFrame(events, "sample_id string, chrom string, position long, length long, name string"))
    assert sorted((r["line_no"], r["piece"], r["name"], r["start"], r["end"]) for r in out.collect()) == sorted(want)
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    above = next(k for k, line in enumerate(plan) if "Generate explode" in line)
    assert not any("Join" in line for line in plan[:above])


def test_library_conditions_ask_for_the_length_once(spark):
    rows = [(k, "TE_00" if k % 2 else "TE_1", "MITE" if k % 5 == 0 else None if k % 7 == 0 else "LTR", n, p) for k, (n, p) in enumerate((n, p) for n in (None, 79, 80, 99, 100) for p in (None, 0.1, 0.11, 0.25, 0.26) for _ in range(4))]
    div = spark.createDataFrame(rows, "id int, name string, class string, n int, p double").withColumn("length", F.length(F.repeat(F.lit("x"), F.col("n"))))
    kept = L.library_qc(div, "^MITE$")
    good = lambda name, c, n, p: None not in (n, p) and c != "MITE" and n >= 80 and p <= 0.25 and not (p > 0.1 and (n < 100 or name == "TE_00"))
    assert {r["id"] for r in kept.collect()} == {r[0] for r in rows if good(*r[1:])}
    filters = [line for line in kept._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line]
    assert sum(line.count("repeat(") for line in filters) == 1

"""Statistics of arriving files, SQL access, records longer than a split, runs of any length, and selections that sort nothing in one task."""

import random

import pytest
from pyspark.sql import functions as F

from helixtab.functions import names as N
from helixtab.functions import sql
from helixtab.operators import aggregates as A
from helixtab.operators import classify as C
from helixtab.operators import intervals as I
from helixtab.operators import ordering, sampling
from helixtab.operators import sequences as S
from helixtab.sources import sinks
from helixtab.sources import text_files as T
from helixtab.streaming import incremental


def bed(k, name, tsd="NA"):
    return f"chr1\t{10 * k}\t{10 * k + 7}\t{name}\t{tsd}\t+\n"


def lines(n, seed):
    rng = random.Random(seed)
    kinds = ["T1#LTR/Copia", "T1#LTR/Copia;NESTED_IN:g", "gene{}", "T{}#DNA/hAT", "T2_FRAG#LTR/Gypsy", "T3#LTR/Gypsy;CUT_BY:x", "T{}#LINE/L1;NESTED_IN:T3"]
    return "".join(bed(k, rng.choice(kinds).format(rng.randrange(300)), rng.choice(("NA", "ACG", "TTT"))) + ("# note\n" if k % 50 == 7 else "") for k in range(n))


def batch_counts(spark, folder):
    rows = C.classify(T.read_features(spark, folder))
    return {(r["sample_id"], r["category"]): (r["n"], r["b"]) for r in rows.groupBy("sample_id", "category").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("b")).collect()}, {
        (r["sample_id"], c, r["class"], r["superfamily"]): r["n"] for c in ("Intact TE", "Fragmented TE") for r in A.superfamily_counts(rows, c).collect()}


def streamed(spark, out):
    cats = spark.read.parquet(f"{out}/categories").collect()
    fams = spark.read.parquet(f"{out}/superfamilies").collect()
    return {(str(r["sample_id"]), r["category"]): (r["n"], r["bases"]) for r in cats}, {(str(r["sample_id"]), r["category"], r["class"], r["superfamily"]): r["n"] for r in fams}


def test_samples_of_several_files_in_any_batches(spark, tmp_path):
    """Short and long files, one a batch; a file that arrives last stands between others by its name and corrects its sample."""
    src, out = tmp_path / "in", str(tmp_path / "out")
    sizes = {"a": [3, 450, 1, 120], "b": [0, 260]}
    late = None
    for sample, each in sizes.items():
        (src / f"sample_id={sample}").mkdir(parents=True)
        for k, n in enumerate(each):
            text = lines(n, 10 * k + len(sample))
            if (sample, k) == ("a", 2):
                late = (src / f"sample_id={sample}" / f"part-{k}.txt", text)
            else:
                (src / f"sample_id={sample}" / f"part-{k}.txt").write_text(text or "# nothing\n")
    run = lambda: incremental.statistics(spark, str(src), out, str(tmp_path / "cp"), files_per_batch=1).awaitTermination()
    run()
    assert streamed(spark, out) == batch_counts(spark, str(src))
    late[0].write_text(late[1] * 3)
    run()
    assert streamed(spark, out) == batch_counts(spark, str(src))


def test_a_batch_again_changes_nothing(spark, tmp_path):
    ledger = incremental.Ledger(spark, str(tmp_path / "ledger"))
    rows = [("s", "f1", 0, x) for x in lines(300, 1).splitlines()]
    batch = spark.createDataFrame(rows, "sample string, file string, _block long, value string").coalesce(1)
    samples = spark.createDataFrame([("s",)], "sample string")
    ledger.add(batch, 0)
    once = sorted(map(str, ledger.counts(samples).collect()))
    ledger.add(batch, 0)
    assert sorted(map(str, ledger.counts(samples).collect())) == once


# SQL


NAMES = [None, "", "a#b", "a#LTR/x~LTRlen:9_SOLO", "x#LTR/c~LTRlen:9", "#/", "a/b#c", "a#b/c/d~e~f;g", "a~b#LTR/q~LTRlen:7;z", "a#LTR/~LTRlen:5", "gene1;CUT_BY:q", "T_FRAG#DNA/hAT;x;CUT_BY:y", "a#LTR/b~LTRlen:x", "a#LTR/b~o~LTRlen:4"]


def test_sql_functions_equal_column_functions(spark):
    sql.register(spark)
    df = spark.createDataFrame([(n,) for n in NAMES], "name string")
    c = F.col("name")
    for text, column in {
        "te_info(name)": N.te_info(c), "te_info_pattern(name)": N.te_info_pattern(c), "name_attributes(name)": N.attributes(c), "feature_id(name)": N.feature_id(c), "add_frag_tag(name)": N.add_frag_tag(c),
        "add_solo_tag(name)": N.add_solo_tag(c), "revcomp(name)": S.revcomp(c), "fmt_sci(length(name) / 7.3D)": N.fmt_sci(F.length(c) / 7.3),
    }.items():
        assert df.select(F.expr(text).alias("a"), column.alias("b")).filter("not (a <=> b)").count() == 0, text
    base = df.filter("name is not null")
    for frag_first in (False, True):
        got = [r[0] for r in base.selectExpr(f"base_category(name, {str(frag_first).lower()})").collect()]
        assert got == [r["category"] for r in C.classify_base(base, frag_first).collect()]


@pytest.mark.parametrize(("strict", "radius"), [(False, 100), (True, 3)])
def test_classified_features_in_sql(spark, tmp_path, strict, radius):
    (tmp_path / "gen5_final.bed").write_text(lines(400, 4))
    sql.register(spark)
    sql.views(spark, features=str(tmp_path))
    got = [(r["line_no"], r["category"]) for r in spark.sql(f"select line_no, category from classified_features(false, {str(not strict).lower()}, {radius}) order by line_no").collect()]
    want = C.classify(T.read_features(spark, str(tmp_path)), require_attr=not strict, radius=radius).orderBy("line_no").collect()
    assert got == [(r["line_no"], r["category"]) for r in want]


def test_unknown_view(spark):
    with pytest.raises(ValueError, match="no reader"):
        sql.views(spark, nonsense="x")


# long records


def test_tiles_of_records_over_several_splits(spark, tmp_path):
    rng = random.Random(5)
    seqs = [(name, "".join(rng.choices("ACGTacgt", k=n))) for name, n in (("one first", 50_000), ("two", 0), ("three#LTR/x", 64), ("four", 120_001), ("five", 1))]
    for sample in ("a", "b"):
        (tmp_path / f"{sample}.fa").write_text("".join(f">{n}\n" + "".join(s[k : k + 61] + ("\r\n" if k % 3 else "\n") for k in range(0, len(s), 61)) + ("\n" if n == "two" else "") for n, s in seqs))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        tiled = T.read_tiles(spark, str(tmp_path), 64)
        got = {(r["sample_id"], r["record_no"], r["tile_no"]): (r["chrom"], r["bases"]) for r in tiled.collect()}
        want = {(s, k, t): (n.split()[0], x[64 * t : 64 * t + 64]) for s in "ab" for k, (n, x) in enumerate(seqs) for t in range(max(1, -(-len(x) // 64)))}
        assert got == want
        assert {r["chrom"]: r["genome_length"] for r in S.tiled_length(tiled.filter("sample_id = 'a'"), ["chrom"]).collect()} == {n.split()[0]: len(s) for n, s in seqs}
        places = spark.createDataFrame([("a", "four", 7, 60, 70_000, "-"), ("b", "one", 8, 49_990, 60_000, "+")], "sample_id string, chrom string, line_no long, start long, end long, strand string")
        out = {r["line_no"]: r["seq"] for r in S.extract_sequences(places, tiled.select("sample_id", "chrom", "tile_no", "bases"), 64).collect()}
        assert out == {7: seqs[3][1][60:70_000][::-1].translate(str.maketrans("ACGTacgt", "TGCAtgca")), 8: seqs[0][1][49_990:]}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_lines_before_the_first_header(spark, tmp_path):
    (tmp_path / "x.fa").write_text("ACGT\n>r1 d\nGG\n")
    assert [(r["record_no"], r["description"], r["bases"]) for r in T.read_tiles(spark, str(tmp_path)).collect()] == [(0, "r1 d", "GG")]


# nest groups


def nested_rows(spark, kinds):
    """c: candidate (its neighbours are equal), x: host, o: other."""
    rows = [("s", k, "chr1", k, k + 1, "g#LTR/C;NESTED_IN:q" if c == "c" else "g#LTR/C" if c == "x" else f"o{k}#LTR/C", "NA", "+") for k, c in enumerate(kinds)]
    return spark.createDataFrame(rows, "sample_id string, line_no long, chrom string, start long, end long, name string, tsd string, strand string")


def greedy(kinds):
    cand = [k for k in range(1, len(kinds) - 1) if kinds[k] == "c" and kinds[k - 1] != "o" and kinds[k + 1] != "o"]
    taken, last = [], -9
    for k in cand:
        if k - last >= 3:
            taken.append(k)
            last = k
    return taken


@pytest.mark.parametrize(("width", "at_once"), [(4, 3), (5, 2), (64, 4096)])
def test_nest_groups_equal_the_greedy_loop(spark, width, at_once):
    rng = random.Random(width)
    kinds = "x" + "c" * 70 + "".join(rng.choices("cxo", weights=[6, 3, 1], k=150)) + "o" * 40 + "xcxcxcxxcx" + "c" * 11 + "x"
    out = C.nest_groups(nested_rows(spark, kinds), width, at_once)
    assert sorted(r["line_no"] for r in out.filter("nest_group = line_no").collect()) == greedy(kinds)
    assert out.count() == len(kinds)


def test_one_endless_run(spark):
    kinds = "x" + "c" * 30_000 + "x"
    out = C.nest_groups(nested_rows(spark, kinds))
    assert sorted(r[0] for r in out.filter("nest_group = line_no").select("line_no").collect()) == greedy(kinds)


# ranges and selections


def test_ranges_split_one_position(spark):
    """All rows at one position, told apart by their key."""
    df = spark.range(5000).withColumn("at", F.lit(7)).withColumn("g", F.col("id") % 2).repartition(5)
    ranged = ordering.ranges(df, ["g", "at", "id"], 100)
    assert max(r["n"] for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect()) < 400
    assert ordering.number_ranges(ranged, ["g"], "pos", "n").filter("pos != id div 2 or n != 2500").count() == 0
    sums = ordering.with_range_prefix(df, ["g"], ["at", "id"], F.col("id"), "before", rows=100)
    assert sums.filter("coalesce(before, 0) != case when g = 0 then (id div 2) * (id div 2 - 1) else (id div 2) * (id div 2) end").count() == 0


@pytest.mark.parametrize("ties", [1, 40, 3000])
def test_nth_least_equals_sorting(spark, ties):
    rng = random.Random(ties)
    rows = [(float(rng.randrange(3000 // ties)), k) for k in rng.sample(range(10**6), 3000)]
    df, order = spark.createDataFrame(rows, "k double, t long"), sorted(rows)
    for n in (1, 2, 1500, 2999, 3000):
        assert sampling.nth_least(df, n, cut=20) == order[n - 1]
    assert sampling.nth_least(df, 3001, cut=20) is None and sampling.nth_least(df, 0) is None


def test_half_of_the_table_without_replacement(spark, monkeypatch):
    df = spark.range(4000).select("id", (F.lit(1.0) + F.col("id") % 5).alias("w"), F.when(F.col("id") % 3 == 0, F.col("id") % 30).alias("g"))
    want = {r["id"] for r in sampling.weighted_sample(df, 1300, "w", 3, group="g").collect()}
    monkeypatch.setattr(sampling, "CUT", 10)
    monkeypatch.setattr(sampling.nth_least, "__defaults__", (10,))
    assert {r["id"] for r in sampling.weighted_sample(df, 1300, "w", 3, group="g").collect()} == want and len(want) == 1300
    assert sampling.weighted_sample(df, 9999, "w", 3).count() == 4000 and sampling.weighted_sample(df, 0, "w", 3).count() == 0


def test_draws_over_many_weights(spark):
    """Ranges cut both draws and weights; no weight and no draw is met by more than its place."""
    n, w = 3000, [1.0 + k % 7 for k in range(2000)]
    weights = spark.createDataFrame([(f"c{k:05d}", x) for k, x in enumerate(w)], "category string, weight double")
    got = {r["draw"]: r["category"] for r in sampling.draw_categories(weights, n, 5, rows=150).collect()}
    us = {r["id"]: r["u"] for r in spark.range(n).select("id", I.uniform(F.col("id"), 5).alias("u")).collect()}
    at, edges = 0.0, []
    for k, x in enumerate(w):
        edges.append((at / sum(w), (at + x) / sum(w), f"c{k:05d}"))
        at += x
    assert got == {d: next(c for lo, hi, c in edges if lo <= u < hi) for d, u in us.items()}
    intervals = spark.createDataFrame([("a", "chr1", 10 * k, 10 * k + 5, x) for k, x in enumerate(w)] + [("b", "chr2", 0, 100, 1.0), ("b", "chr3", 0, 9, 0.0)], "sample_id string, chrom string, start long, end long, weight double")
    out = I.sample_positions(intervals, 5000, 2, rows=400)
    assert {r["sample_id"]: r["n"] for r in out.groupBy("sample_id").agg(F.count("*").alias("n")).collect()} == {"a": 5000, "b": 5000}
    assert out.filter("sample_id = 'a' and position % 10 >= 5 or sample_id = 'b' and chrom != 'chr2'").count() == 0
    assert I.sample_positions(intervals, 0, 2).count() == 0


def test_rollup_levels(spark):
    rows = [("s", "gene1"), ("s", "T#LTR/Copia"), ("s", "T_FRAG#LTR/Gypsy"), ("t", "T#LTR/Copia"), ("t", "plain")]
    df = spark.createDataFrame([(a, b, 10 * k, 10 * k + 3) for k, (a, b) in enumerate(rows)], "sample_id string, name string, start long, end long")
    got = {(r["level"], r["sample_id"], r["class"], r["superfamily"]): (r["features"], r["bases"], r["fragments"]) for r in A.composition_rollup(N.with_name_parts(df)).collect()}
    assert got[7, None, None, None] == (5, 15, 1) and got[3, "s", None, None] == (3, 9, 1) and got[1, "s", "LTR", None] == (2, 6, 1) and got[0, "t", "Unknown", "Unknown"] == (1, 3, 0) and len(got) == 12


def test_files_in_ranges(spark, tmp_path):
    df = spark.range(40).selectExpr("'s' as sample_id", "'c' as chrom", "id as start", "id + 1 as end", "concat('gene', id) as name", "'NA' as tsd", "'+' as strand")
    sinks.write_features(df, str(tmp_path / "x"), ranges=4)
    assert len(list((tmp_path / "x" / "sample_id=s").glob("part-*"))) > 2
    assert T.read_features(spark, str(tmp_path / "x")).filter("line_no != start").count() == 0


# densities, insertions in order of time, block gzip


def test_a_million_distinct_values_equal_all_pairs(spark):
    import math

    import numpy as np

    from helixtab.operators import density

    n = 1_000_000
    df = spark.range(n).select(F.lit("a").alias("g"), (F.pow(F.col("id") / n, F.lit(2.5)) * 5e5 + F.col("id") % 3 * 1e6).alias("x"))
    x = np.array([r["x"] for r in df.select("x").toLocalIterator()]) if n < 1000 else (np.arange(n) / n) ** 2.5 * 5e5 + np.arange(n) % 3 * 1e6
    places = [float(v) for v in np.r_[np.linspace(-4e5, 3e6, 60), x[::99_991]]]
    at = spark.createDataFrame([("a", v) for v in places], "g string, at double")
    got = {r["at"]: r["density"] for r in density.density_at(at, density.histogram(df, "x", ["g"]), ["g"]).collect()}
    bw = n**-0.2 * x.std(ddof=1)
    want = {v: np.exp(-0.5 * ((v - x) / bw) ** 2).sum() / (n * bw * math.sqrt(2 * math.pi)) for v in places}
    top = max(want.values())
    assert max(abs(got[v] - want[v]) for v in places) < 1e-12 * top < 1e-9


def one_after_another(feats, events):
    rows = [[(k, None), name, "", s, e] for k, name, s, e in feats]
    for seq, at, size, name in sorted(events):
        out, hosts = [], set()
        for key, given, tags, s, e in rows:
            if e <= at:
                out.append([key, given, tags, s, e])
            elif s >= at:
                out.append([key, given, tags, s + size, e + size])
            else:
                hosts.add((key[1] is None, key, given))
                out += [[key, given, f"{tags};CUT_BY:{name}", s, at], [key, given, f"{tags};CUT_BY:{name}", at + size, e + size]]
        inside = "".join(f";NESTED_IN:{h[2]}" for h in sorted(hosts, key=lambda h: (h[0], h[1][0] or 0, h[1][1] or 0)))
        rows = [*out, [(None, seq), name, inside, at, at + size]]
    return sorted(str((*key, given + tags, s, e)) for key, given, tags, s, e in rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_insertions_in_order_equal_one_after_another(spark, seed):
    """Also insertions into insertions, at their edges, several at one place, on chromosomes without features and without insertions."""
    from helixtab.operators import liftover

    rng, features, events, want = random.Random(seed), [], [], []
    for c in range(10):
        n = size = rng.choice([40, 300, 9000])
        own = [(k, f"T{k}", a, a + rng.randrange(1, size // 3)) for k, a in enumerate(rng.randrange(size) for _ in range(rng.randrange(8)))]
        new = []
        for k in range(rng.choice([0, 1, 2, 5, 12, 33])):
            at = rng.choice([rng.randrange(n + 1), rng.randrange(n // 4), new[-1][1] if new else 0, new[-1][1] + new[-1][2] if new else 3])
            new.append((7 * k + rng.randrange(7), at, rng.randrange(1, 30), f"N{k}"))
            n += new[-1][2]
        features += [("s", f"c{c}", *f) for f in own]
        events += [("s", f"c{c}", *e) for e in new]
        want += [f"c{c}{r}" for r in one_after_another(own, new)]
    f = spark.createDataFrame(features, "sample_id string, chrom string, line_no long, name string, start long, end long")
    e = spark.createDataFrame(events, "sample_id string, chrom string, seq long, position long, length long, name string")
    got = [r["chrom"] + str((r["line_no"], r["seq"], r["name"], r["start"], r["end"])) for r in liftover.insert_in_order(f, e).collect()]
    assert sorted(got) == sorted(want)
    assert liftover.insert_in_order(f, e.limit(0)).count() == len(features)


def block_gzip(text, size):
    import zlib

    out = b""
    for k in [*range(0, len(text), size), len(text)]:  # the last is the empty member that ends a file
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        data = text[k : k + size]
        body = z.compress(data) + z.flush()
        out += T.MEMBER + (len(T.MEMBER) + 2 + len(body) + 8 - 1).to_bytes(2, "little") + body + zlib.crc32(data).to_bytes(4, "little") + len(data).to_bytes(4, "little")
    return out


def test_block_gzip_in_several_tasks_equals_plain_text(spark, tmp_path):
    import gzip

    rng = random.Random(9)
    for folder in ("plain", "packed"):
        (tmp_path / folder).mkdir()
    for name, n, end in (("gen1_final", 3000, "\n"), ("gen2_final", 40, ""), ("gen3_final", 1, "\r\n")):
        text = ("\n".join(("# ü" if k % 97 == 5 else "" if k % 101 == 7 else bed(k, f"gene{rng.random()}").strip() + "x" * (k % 5 * 90)) for k in range(n)) + end).encode()
        (tmp_path / "plain" / f"{name}.bed").write_bytes(text)
        packed = block_gzip(text, 700)
        assert gzip.decompress(packed) == text
        (tmp_path / "packed" / f"{name}.bgz").write_bytes(packed)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = T.read_block_gzip(spark, str(tmp_path / "packed"))
        assert spark.read.option("lineSep", "x").text(str(tmp_path / "packed" / "gen1_final.bgz")).rdd.getNumPartitions() > 5
        rows = lambda df: sorted((r["sample_id"], r["generation"], r["line_no"], r["value"]) for r in df.collect())
        assert rows(got) == rows(T.read_lines(spark, str(tmp_path / "plain")))
        tell = lambda p: sorted(map(tuple, T.read_features(spark, p).collect()), key=str)
        assert tell(got) == tell(str(tmp_path / "plain"))
        whole = (tmp_path / "packed" / "gen2_final.bgz").read_bytes()
        (tmp_path / "packed" / "gen2_final.bgz").write_bytes(whole[:-10])
        with pytest.raises(Exception, match="member of"):
            T.read_block_gzip(spark, str(tmp_path / "packed")).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_strict_features(spark, tmp_path):
    """Short rows are left out, or an error on demand."""
    (tmp_path / "a.bed").write_text(bed(1, "gene1") + "too\tshort\n")
    assert T.read_features(spark, str(tmp_path)).count() == 1
    with pytest.raises(Exception, match="too few fields"):
        T.read_features(spark, str(tmp_path), strict=True).count()


def test_everything_at_one_position(spark):
    """Intervals, points, features and deletions of which most share a position."""
    from helixtab.operators import liftover

    rng = random.Random(4)
    spans = [(7, 7 + rng.randrange(1, 50)) for _ in range(500)] + [(a, a + rng.randrange(1, 9)) for a in rng.sample(range(100_000), 60)]
    df = spark.createDataFrame([("s", "c", a, b) for a, b in spans], "sample_id string, chrom string, start long, end long")
    merged = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    assert sorted([r["start"], r["end"]] for r in I.merge_intervals(df).collect()) == merged
    points = spark.createDataFrame([("s", "c", p, k) for k, p in enumerate([20] * 300 + rng.sample(range(100_000), 100) + [None])], "sample_id string, chrom string, position long, id long")
    for closed in (True, False):
        got = {r["id"]: r["inside"] for r in I.points_in_intervals(points, I.merge_intervals(df), closed=closed).collect()}
        assert got == {r["id"]: r["position"] is not None and any(a <= r["position"] <= b - (not closed) for a, b in merged) for r in points.collect()}
    events = spark.createDataFrame([("s", "c", p, 3) for p in [7] * 200 + [6, 50, 90_000]], "sample_id string, chrom string, position long, length long")
    moved = liftover.lift_over(df, events)
    assert sorted((r["start"], r["end"]) for r in moved.collect()) == sorted((a - 3 * sum(p < a for p in [7] * 200 + [6, 50, 90_000]), b - 3 * sum(p < a for p in [7] * 200 + [6, 50, 90_000])) for a, b in spans)

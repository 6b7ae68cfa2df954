"""Alignment rows: filters, substitution counts, distances, indel events and plotting offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let, running


def filter_hsps(hsps: DataFrame, min_align: int = 100, max_off: int = 20) -> DataFrame:
    """HSPs long enough that begin or end within 100 of the subject's ends; of self hits, not the perfect one, and only those whose ends lie within max_off of opposite ends."""
    ends = (F.col("sstart") < 100) | (F.col("slen") - F.col("send") < 100)
    offsets = ((F.col("sstart") < max_off) & (F.col("qlen") - F.col("qend") < max_off)) | ((F.col("qstart") < max_off) & (F.col("slen") - F.col("send") < max_off))
    alien = F.col("qseqid") != F.col("sseqid")
    return hsps.filter((F.col("aln_len") >= min_align) & ends & (alien | ((F.col("nident") != F.col("qlen")) & offsets)))


def btop_counts(hsps: DataFrame) -> DataFrame:
    """Adds transitions, transversions, indels and odd from BTOP: digits go, letters are read in pairs; a string of odd length counts nothing."""
    letters = F.regexp_replace("btop", "[0-9]", "")
    pairs = F.regexp_extract_all("_letters", F.lit("(..)"), F.lit(1))
    n = lambda keep: F.when(F.col("odd"), 0).otherwise(F.size(F.filter(F.col("_pairs"), keep)))
    out = hsps.withColumn("_letters", letters).withColumns({"odd": F.length("_letters") % 2 != 0, "_pairs": pairs})
    return out.withColumns({
        "transitions": n(lambda p: p.isin("AG", "GA", "CT", "TC")),
        "transversions": n(lambda p: p.isin("AC", "CA", "AT", "TA", "GC", "CG", "GT", "TG")),
        "indels": n(lambda p: F.contains(p, F.lit("-"))),
    }).drop("_letters", "_pairs")


def distances(df: DataFrame, miu: float, ts: str = "transitions", tv: str = "transversions", same: str = "nident") -> DataFrame:
    """Adds tot_len, raw_d, jc69_d, k2p_d and the times d / 2 miu. Jukes-Cantor below a raw distance of 0.66, else raw; Kimura where its logarithm exists, else raw;
    everything 0 for an empty alignment."""
    total = F.col(ts) + F.col(tv) + F.col(same)
    out = df.withColumn("tot_len", total)
    raw = F.when(total == 0, 0.0).otherwise((F.col(ts) + F.col(tv)) / total)
    out = out.withColumn("raw_d", raw)
    jc = F.when(F.col("raw_d") < 0.66, -0.75 * F.log(1 - 4 * F.col("raw_d") / 3)).otherwise(F.col("raw_d"))
    p, q = F.col(ts) / F.col("tot_len"), F.col(tv) / F.col("tot_len")
    a, b = 1 - 2 * p - q, 1 - 2 * q
    k2p = F.when((a > 0) & (b > 0), -0.5 * F.log(a * F.sqrt(b))).otherwise(F.col("raw_d"))
    zero = lambda c: F.when(F.col("tot_len") == 0, 0.0).otherwise(c)
    out = out.withColumns({"jc69_d": zero(jc), "k2p_d": zero(k2p)})
    return out.withColumns({f"{k}_t": F.col(f"{k}_d") / (2 * miu) for k in ("raw", "jc69", "k2p")})


def element_divergence(hsps: DataFrame, miu: float, min_align: int = 100, max_off: int = 20) -> DataFrame:
    """Per element, means over its kept HSPs (those with an odd BTOP count in the number and add nothing), sums of transitions and transversions and the number of HSPs."""
    d = distances(btop_counts(filter_hsps(hsps, min_align, max_off)), miu)
    mean = lambda c: (F.sum(F.when(~F.col("odd"), F.col(c)).otherwise(0)) / F.count("*")).alias(c)
    return d.groupBy("qseqid").agg(*map(mean, ("tot_len", "raw_d", "k2p_d", "jc69_d", "raw_t", "k2p_t", "jc69_t")), F.sum("transitions").alias("transitions"), F.sum("transversions").alias("transversions"), F.count("*").alias("hits"))


def indel_events(paf: DataFrame, cigar: str = "cigar", start: str = "aln_start") -> DataFrame:
    """One row per insertion or deletion: kind, position on the reference (start of the alignment + what M, =, X and D before it cover) and size."""
    pieces = F.regexp_extract_all(cigar, F.lit("[0-9]+[MIDNSHP=X]"), F.lit(0))
    pairs = F.transform(pieces, lambda x: F.struct(F.substr(x, F.lit(1), F.length(x) - 1).cast("bigint").alias("n"), F.right(x, F.lit(1)).alias("op")))
    covered = lambda x: F.when(x["op"].isin("M", "=", "X", "D"), x["n"]).otherwise(0)

    def of(ops: Column) -> Column:
        starts = running(F.transform(ops, covered), F.lit(0).cast("bigint"), lambda at, n: at + n)
        each = let(starts, lambda at: F.transform(ops, lambda x, i: F.struct(x["op"].alias("kind"), F.get(at, i).alias("pos"), x["n"].alias("size"))))
        return F.filter(each, lambda e: e["kind"].isin("I", "D"))

    events = let(pairs, of)
    held = [c for c in paf.columns if c != cigar]
    return paf.select(*held, F.explode(events).alias("_e")).select(*held, F.col("_e.kind").alias("kind"), (F.col(start) + F.col("_e.pos")).alias("position"), F.col("_e.size").alias("size"))


def chrom_offsets(fai: DataFrame, gap: int = 1_000_000, by: list[str] | None = None) -> DataFrame:
    """Adds offset of each chromosome when all are laid in a row, `gap` between them; fai(idx, chrom, length), one row a chromosome."""
    w = Window.partitionBy(*(by or [])).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return fai.withColumn("offset", F.coalesce(F.sum(F.col("length") + gap).over(w), F.lit(0)))


def library_qc(div: DataFrame, excluded: str | None = None) -> DataFrame:
    """Library entries that stay: dropped are length < 80, length < 100 with p > 0.10, names TE_00* with p > 0.10, p > 0.25, and classes that match `excluded`.
    div(name, class, length, p)."""
    p, n = F.col("p"), F.col("length")
    bad = p > 0.25
    if excluded:
        bad |= F.coalesce(F.col("class").rlike(excluded), F.lit(False))
    bad |= F.startswith("name", F.lit("TE_00")) & (p > 0.10)
    # the length comes last and once: it may be that of a sequence made for it
    bad |= n < F.when(p > 0.10, 100).otherwise(80)
    return div.filter(~bad)


def select_divergence(df: DataFrame, use_identity: bool = False) -> DataFrame:
    """Adds `divergence` by the columns that a file has: 1 - Identity if wanted, else Insertion_Time, else K2P_d; null and, unless a time, values outside [0, 1] go."""
    have = {c.lower(): c for c in df.columns}
    if use_identity and "identity" in have:
        value, bounded = 1 - F.col(have["identity"]), True
    elif "insertion_time" in have:
        value, bounded = F.col(have["insertion_time"]), False
    elif "k2p_d" in have:
        value, bounded = F.col(have["k2p_d"]), True
    else:
        raise ValueError("no divergence column")
    out = df.withColumn("divergence", value.cast("double")).filter(F.col("divergence").isNotNull() & ~F.isnan("divergence"))
    return out.filter(F.col("divergence").between(0, 1)) if bounded else out


def divergence_by_generation(df: DataFrame, model: str = "k2p") -> DataFrame:
    """generation, distance and time of the chosen model (raw, k2p, jc69), null distances dropped; x_limit: 1.1 times the largest distance of all."""
    if model not in ("raw", "k2p", "jc69"):
        raise ValueError(f"unknown model {model!r}")
    out = df.select("generation", F.col(f"{model}_d").alias("distance"), F.col(f"{model}_t").alias("time")).filter("distance is not null")
    top = out.agg((F.max("distance") * 1.1).alias("x_limit"))
    return out.join(F.broadcast(top))



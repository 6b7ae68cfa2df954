"""Counts, shares and rates per sample or generation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import te_info, with_name_parts
from .classify import CATEGORIES, classify_base


def category_counts(df: DataFrame, by: str = "sample_id") -> DataFrame:
    """Features per sample and category, one column a category, zero where there are none. df has `category`."""
    return df.groupBy(by).pivot("category", list(CATEGORIES)).agg(F.count(F.lit(1))).fillna(0)


def superfamily_counts(df: DataFrame, category: str, by: str = "sample_id") -> DataFrame:
    """(sample, class, superfamily, n) of one category; names without both are left out."""
    te = df.filter(F.col("category") == category).withColumn("_te", te_info(F.col("feature_id")))
    return te.filter("_te.class is not null").groupBy(by, F.col("_te.class").alias("class"), F.col("_te.superfamily").alias("superfamily")).agg(F.count("*").alias("n"))


def superfamily_matrix(counts: DataFrame, samples: list[str], by: str = "sample_id") -> DataFrame:
    """One row per class and superfamily, one column per sample, zero-filled. `samples` bounds the columns."""
    return counts.groupBy("class", "superfamily").pivot(by, samples).agg(F.sum("n")).fillna(0)


def feature_fraction(df: DataFrame, lengths: DataFrame, by: str = "sample_id") -> DataFrame:
    """Bases per category by name alone (no demotion), their percentage of the genome, all together and the rest; lengths(sample, genome_length)."""
    bp = classify_base(df).groupBy(by).agg(*(F.sum(F.when(F.col("category") == c, F.col("end") - F.col("start")).otherwise(0)).alias(c) for c in CATEGORIES))
    out = bp.join(lengths, by, "left").withColumn("genome_length", F.coalesce("genome_length", F.lit(0)))
    percent = lambda c: F.when(F.col("genome_length") > 0, c / F.col("genome_length") * 100).otherwise(F.lit(0.0))
    total = sum((F.col(c) for c in CATEGORIES[1:]), F.col(CATEGORIES[0]))
    out = out.select(by, "genome_length", *CATEGORIES, *(percent(F.col(c)).alias(f"{c} %") for c in CATEGORIES), percent(total).alias("combined %"))
    return out.withColumn("rest %", F.greatest(F.lit(0.0), 100 - F.col("combined %")))


def solo_intact_ratio(df: DataFrame, by: str = "generation") -> DataFrame:
    """Solo LTRs, intact LTR elements and their ratio (0 without intact ones): fragments are skipped, class LTR without _SOLO is intact, cut or not."""
    d = with_name_parts(df).filter(~F.contains("feature_id", F.lit("_FRAG")))
    solo = F.contains("feature_id", F.lit("_SOLO"))
    d = d.groupBy(by).agg(F.count_if(solo).alias("solo"), F.count_if(~solo & F.coalesce(te_info(F.col("feature_id"))["class"] == "LTR", F.lit(False))).alias("intact"))
    return d.withColumn("ratio", F.when(F.col("intact") > 0, F.col("solo") / F.col("intact")).otherwise(F.lit(0.0)))


def genome_trajectory(seqs: DataFrame) -> DataFrame:
    """Genome length per generation, in order."""
    return seqs.groupBy("generation").agg(F.sum(F.length("seq")).alias("genome_length")).orderBy(F.col("generation").asc_nulls_last())


def composition(df: DataFrame, lengths: DataFrame, by: str = "sample_id") -> DataFrame:
    """Genes and TEs of a genome: counts, bases and percentages, TEs split by the _FRAG mark."""
    d = with_name_parts(df).withColumn("_n", F.col("end") - F.col("start"))
    gene, frag = F.startswith("feature_id", F.lit("gene")), F.contains("feature_id", F.lit("_FRAG"))
    kinds = {"gene": gene, "te": ~gene, "intact": ~gene & ~frag, "frag": ~gene & frag}
    d = d.groupBy(by).agg(*(x for k, on in kinds.items() for x in (F.count_if(on).alias(f"{k}_count"), F.sum(F.when(on, F.col("_n")).otherwise(0)).alias(f"{k}_bp"))))
    d = d.join(lengths, by)
    return d.withColumns({f"{k}_percent": F.when(F.col("genome_length") > 0, F.col(f"{k}_bp") / F.col("genome_length") * 100).otherwise(F.lit(0.0)) for k in kinds})


def composition_rollup(df: DataFrame, by: str = "sample_id") -> DataFrame:
    """Features, bases and fragments per sample, class and superfamily with subtotals per class, per sample and of all, from one aggregation: `level` is the grouping id (0 a superfamily, 1 a
    class, 3 a sample, 7 all), and columns that a subtotal runs over are null. Genes are of class `gene`, names without a class of `Unknown`."""
    te, gene = te_info(F.col("feature_id")), F.startswith("feature_id", F.lit("gene"))
    kind = lambda c: F.when(gene, "gene").otherwise(F.coalesce(te[c], F.lit("Unknown")))
    d = with_name_parts(df).select(by, kind("class").alias("class"), kind("superfamily").alias("superfamily"), (F.col("end") - F.col("start")).alias("_n"), F.contains("feature_id", F.lit("_FRAG")).alias("_frag"))
    return d.rollup(by, "class", "superfamily").agg(F.grouping_id().cast("bigint").alias("level"), F.count("*").alias("features"), F.sum("_n").alias("bases"), F.count_if("_frag").alias("fragments"))


def indel_rates(report: DataFrame, lengths: DataFrame) -> DataFrame:
    """Insertion and deletion rates per base: report(generation, inserts, deletions) over lengths(generation, genome_length); null without a genome."""
    d = report.join(lengths, "generation", "left")
    rate = lambda c: F.when(F.col("genome_length") > 0, F.col(c) / F.col("genome_length"))
    return d.select("generation", "inserts", "deletions", rate("inserts").alias("insertion_rate"), rate("deletions").alias("deletion_rate"))


def accumulated_mutations(reports: DataFrame, upto: bool = False) -> DataFrame:
    """Adds accumulated: the sum of `per_site` over all reports of the series, later ones included, or up to and with its generation."""
    w = Window.partitionBy("series")
    w = w.orderBy("generation").rangeBetween(Window.unboundedPreceding, Window.currentRow) if upto else w
    return reports.withColumn("accumulated", F.sum("per_site").over(w))


def mutation_summary(reports: DataFrame) -> DataFrame:
    """Adds mutations per site, unique sites, their rate, and the closed form G (1 - exp(-n / G)) from genome_size, mutations, recurrent."""
    g, n = F.col("genome_size"), F.col("mutations")
    return reports.withColumns({"per_site": n / g, "unique_sites": n - F.col("recurrent"), "unique_per_site": (n - F.col("recurrent")) / g, "expected_unique": g * (1 - F.exp(-n / g))})


def sample_category_matrix(long: DataFrame, categories: list[str]) -> DataFrame:
    """(sample, category, n) -> one row per sample, a column per category, zero-filled, and the total."""
    m = long.groupBy("sample").pivot("category", categories).agg(F.sum("n")).fillna(0)
    return m.withColumn("total", sum((F.col(f"`{c}`") for c in categories[1:]), F.col(f"`{categories[0]}`")))


def select_generations(gens: DataFrame, k: int) -> DataFrame:
    """k evenly spaced of the distinct generations, first and last among them; k is at least 2 and at most all, places are rounded half to even, repeats dropped.
    gens(generation): one row a generation."""
    g = gens.select("generation").distinct()
    g = g.withColumns({"_at": F.row_number().over(Window.orderBy("generation")) - 1, "_n": F.count("*").over(Window.partitionBy())})
    k_ = F.least(F.greatest(F.lit(k), F.lit(2)), F.col("_n"))
    places = F.when(F.col("_n") == 1, F.array(F.lit(0).cast("bigint"))).otherwise(F.transform(F.sequence(F.lit(0), F.lit(max(k, 2) - 1)), lambda i: F.when(i < k_, F.bround(i * ((F.col("_n") - 1) / F.greatest(F.lit(1), k_ - 1))).cast("bigint"))))
    return g.filter(F.array_contains(places, F.col("_at").cast("bigint"))).select("generation")


def length_p95(candidates: DataFrame, by: list[str]) -> DataFrame:
    """95th percentile of lengths, linearly interpolated."""
    return candidates.groupBy(*by).agg(F.percentile(F.col("end") - F.col("start"), F.lit(0.95)).alias("l95"))


def candidate_weights(candidates: DataFrame, k: float, by: list[str], bias: float = 1.0, selection: float = 0.0, generations: float = 0.0, length: str = "p95") -> DataFrame:
    """Adds weight: exp(-k (1 - min(L, L95) / L95)), times `bias` where `inside` holds, times 1 + selection * gene_weight * generations for TEs nested in genes.
    candidates have start, end, subtype, inside (boolean) and gene_weight (null: 1). length=max takes the longest instead of L95."""
    size = F.col("end") - F.col("start")
    top = length_p95(candidates, by) if length == "p95" else candidates.groupBy(*by).agg(F.max(size).cast("double").alias("l95"))
    d = candidates.join(top, by)
    w = F.exp(-k * (1 - F.least(size, F.col("l95")) / F.col("l95"))) * F.when(F.col("inside"), float(bias)).otherwise(1.0)
    nested = F.col("subtype") == "NEST_TE_IN_GENE"
    return d.withColumn("weight", w * F.when(nested, 1 + selection * F.coalesce("gene_weight", F.lit(1.0)) * generations).otherwise(1.0))

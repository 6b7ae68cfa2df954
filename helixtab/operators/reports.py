"""Run logs to records, and reports to long and wide tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import generation_of
from .ordering import part_of, with_prefix

TOTAL = r"Total TE insertions performed: (\d+) \(Nested: (\d+), Non-nested: (\d+)\)"
CALCULATED = r"Calculated number of TE excisions: (\d+)"
SELECTED = r"Selected (\d+) removal events"
CLOSED = r"Updated FASTA written to .*?gen(\d+)_"


def log_sessions(lines: DataFrame, source: str = "source") -> DataFrame:
    """Records of a log (source, line_no, value). A line with the total of insertions opens one; the calculated deletions are the last given; actual ones add up; the line that names
    the generation closes it. Records without calculated deletions and unfinished ones are dropped. Opening and closing lines before a line are counted by one prefix sum over parts of the log,
    of lines that hold one of the four phrases; the lines of a record have as many closing lines before them as the one that opens it."""
    phrases = {TOTAL: "Total TE insertions performed: ", CALCULATED: "Calculated number of TE excisions: ", SELECTED: "Selected ", CLOSED: "Updated FASTA written to "}
    has = {p: F.contains("value", F.lit(phrase)) for p, phrase in phrases.items()}
    # a pattern is tried on lines with its phrase alone
    got = lambda p, k=1: F.when(has[p], F.regexp_extract("value", p, k).try_cast("bigint"))
    some = has[TOTAL] | has[CALCULATED] | has[SELECTED] | has[CLOSED]
    e = lines.filter(some).select(source, "line_no", got(TOTAL).alias("inserts"), got(TOTAL, 2).alias("nested"), got(TOTAL, 3).alias("nonnested"), got(CALCULATED).alias("calc"), got(SELECTED).alias("removed"), got(CLOSED).alias("gen"))
    opens, closes = F.when(F.col("inserts").isNotNull(), F.lit(1 << 32)).otherwise(0), F.when(F.col("gen").isNotNull(), 1).otherwise(0)
    e = with_prefix(e, [source], [part_of("line_no")], ["line_no"], opens + closes, "_c").withColumn("_c", F.coalesce("_c", F.lit(0)))
    e = e.withColumns({"session": F.shiftright("_c", 32) + F.when(F.col("inserts").isNotNull(), 1).otherwise(0), "_closed": F.col("_c").bitwiseAND(F.lit((1 << 32) - 1))}).filter("session > 0")
    out = e.groupBy(source, "session", "_closed").agg(
        F.max("gen").alias("generation"), F.max("inserts").alias("inserts"), F.max("nested").alias("nested"), F.max("nonnested").alias("nonnested"),
        F.max_by("calc", F.when(F.col("calc").isNotNull(), F.col("line_no"))).alias("deletions_calc"), F.coalesce(F.sum("removed"), F.lit(0)).alias("deletions_actual"))
    # what follows the closing line belongs to no record, and has no opening line
    return out.filter("inserts is not null and generation is not null and deletions_calc is not null").drop("_closed")


LABELS = {"calculated": "Calculated deletions", "actual": "Actual deletions", "nested": "Nest TE insertions", "nonnested": "Non-nest TE insertions", "total": "TE insertions"}


def report_long(report: DataFrame, collapse: bool = False) -> DataFrame:
    """Report rows (generation, inserts, nested, nonnested, deletions_calc, deletions_actual) as (generation_m, type, count_k): generations in millions, counts in thousands."""
    k = lambda c, name: (F.col(c) / 1e3).alias(LABELS[name])
    kinds = [("deletions_calc", "calculated"), ("deletions_actual", "actual"), *([("inserts", "total")] if collapse else [("nested", "nested"), ("nonnested", "nonnested")])]
    wide = report.select((F.col("generation") / 1e6).alias("generation_m"), *(k(*x) for x in kinds))
    return wide.unpivot(["generation_m"], [LABELS[n] for _, n in kinds], "type", "count_k")


def stats_long(wide: DataFrame, keys: list[str]) -> DataFrame:
    """Wide statistics (one `<file>_Count` column a file) as keys, file, generation, n."""
    files = [c for c in wide.columns if c not in keys]
    long = wide.select(*keys, *(F.col(f"`{c}`").cast("bigint").alias(c) for c in files)).unpivot(keys, [f"`{c}`" for c in files], "file", "n")
    return long.withColumn("generation", generation_of(F.col("file")))


def stats_matrix(long: DataFrame, generations: list[int], key: str) -> DataFrame:
    """One row per key, one column per generation in numeric order, zero-filled."""
    return long.groupBy(key).pivot("generation", sorted(generations)).agg(F.sum("n")).fillna(0)


def category_lines(long: DataFrame, key: str = "category") -> DataFrame:
    """(category, generation, n) in numeric order of generations, those without a number last."""
    return long.groupBy(key, "generation").agg(F.sum("n").alias("n")).orderBy(key, F.col("generation").asc_nulls_last())


def order_generations(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("generation").asc_nulls_last())



"""Writers: one folder of text files per sample, rows in order within each file. Each sample is hashed to one task's file, or to several in
order of range where a table has few samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_lines(lines: DataFrame, path: str, order: list[str], mode: str = "overwrite", compression: str = "none", whole: bool = False, ranges: int | None = None) -> None:
    """lines(sample_id, order..., value): ranges of (sample_id, order) are files of the sample's folder, whose names sort in that order. whole: one file a sample, written by one task; ranges: how many
    ranges there are."""
    dealt = lines.repartition("sample_id") if whole else lines.repartitionByRange(*([ranges] if ranges else []), "sample_id", *order)
    dealt.sortWithinPartitions("sample_id", *order).select("sample_id", "value").write.partitionBy("sample_id").mode(mode).option("compression", compression).text(path)


def write_features(df: DataFrame, path: str, tag: bool = False, mode: str = "overwrite", compression: str = "none", whole: bool = False, ranges: int | None = None) -> None:
    """BED of 6 columns, or 7 with the tag where there is one, in order of chromosome and start; features that begin at one place in order of line_no, if they have it, else of their text."""
    cells = [F.col("chrom"), F.col("start").cast("string"), F.col("end").cast("string"), F.col("name"), F.coalesce("tsd", F.lit("NA")), F.coalesce("strand", F.lit("+"))]
    value = F.concat_ws("\t", *cells, *([F.col("tag")] if tag else []))
    last = "line_no" if "line_no" in df.columns else "value"
    lines = df.withColumn("value", value).select("sample_id", "chrom", "start", *(["line_no"] if last == "line_no" else []), "value")
    write_lines(lines, path, ["chrom", "start", last], mode, compression, whole, ranges)


def write_sequences(seqs: DataFrame, path: str, width: int = 60, mode: str = "overwrite") -> None:
    """FASTA, lines of `width` bases, records in order of record_no."""
    body = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    write_lines(seqs.select("sample_id", "record_no", F.concat(F.lit(">"), F.col("header"), F.lit("\n"), body).alias("value")), path, ["record_no"], mode)


def write_wide_stats(long: DataFrame, path: str, keys: list[str], files: list[str], mode: str = "overwrite") -> None:
    """keys, file, n -> one `<file>_Count` column per file, zero-filled, keys sorted. `files` bounds the columns."""
    wide = long.groupBy(*keys).pivot("file", files).agg(F.sum("n")).fillna(0)
    wide.select(*keys, *(F.col(f"`{f}`").alias(f"{f}_Count") for f in files)).orderBy(*keys).write.csv(path, sep="\t", header=True, mode=mode)


def write_tsv(df: DataFrame, path: str, decimals: dict[str, int] | None = None, whole: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """Tab-separated with a header, in files of even size, one where the table is small; `decimals` fixes places, `whole` cuts off fractions."""
    fixed = {c: F.format_string(f"%.{n}f", F.col(c)) for c, n in (decimals or {}).items()} | {c: F.col(c).cast("bigint") for c in whole}
    df.withColumns(fixed).hint("rebalance").write.csv(path, sep="\t", header=True, mode=mode)

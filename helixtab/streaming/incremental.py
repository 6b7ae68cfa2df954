"""Incremental statistics of annotation files that arrive in any batches, any number of files a sample.

What a row counts as depends on the rows at most RADIUS lines away in its sample, whose lines run on from file to file in order of their paths. So most of a file is decided when it
arrives, and only the rows near its ends wait for the files before and after it. The state is a ledger in Parquet, a folder a sample and batch: `files` (lines of each file),
`inner` (counts of the rows that are decided) and `edges` (the first and last 2 x RADIUS rows of each file, whatever its length). A batch writes its files' part of the ledger and then counts the
samples that it touched anew: inner counts summed, and the edges of all their files classified together. A file that arrives late, between others by its name, corrects its sample. A batch that runs
again after a failure overwrites what it wrote. No watermark: samples stay open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.names import generation_of, te_info
from ..operators.classify import RADIUS, classify
from ..operators.ordering import number_rows, part_of
from ..scratch import written
from ..sources.text_files import sample_of

GROUP = ["category", "class", "superfamily"]
COLUMNS = ["chrom", "start", "end", "name", "tsd", "strand"]


def _features(batch: DataFrame) -> DataFrame:
    """Rows of each file, numbered from 0 within it, blank lines, comments and short rows left out."""
    trimmed = F.regexp_replace("value", r"^\s+|\s+$", "")
    rows = batch.withColumn("_id", F.monotonically_increasing_id()).withColumn("_f", F.split(trimmed, "\t")).filter((F.size("_f") >= 6) & ~F.startswith(trimmed, F.lit("#")))
    rows = number_rows(rows, ["sample", "file"], [F.col("_block"), part_of("_id")], ["_id"], "line")
    at = lambda k: F.get("_f", F.lit(k))
    return rows.select("sample", "file", "line", at(0).alias("chrom"), at(1).try_cast("bigint").alias("start"), at(2).try_cast("bigint").alias("end"), at(3).alias("name"), at(4).alias("tsd"), at(5).alias("strand"))


def _classified(rows: DataFrame, by: Column, line: str) -> DataFrame:
    """Rows with the category that they have among the rows of the same `by`; class and superfamily of TEs."""
    out = classify(rows.withColumns({"sample_id": by, "line_no": F.col(line)}))
    te = te_info(F.col("feature_id"))
    named = F.endswith("category", F.lit("TE"))
    return out.withColumns({"class": F.when(named, te["class"]), "superfamily": F.when(named, te["superfamily"])})


def _counted(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by, *GROUP).agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("bases"))


def near_end(line: str, lines: str, reach: int) -> Column:
    """Whether a row is one of the first or last `reach` of its file."""
    return (F.col(line) < reach) | (F.col(line) >= F.col(lines) - reach)


class Ledger:
    """The state in `root`. Tables are partitioned by sample and batch, so that a batch overwrites its own part alone and a sample is read without the others."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def put(self, df: DataFrame, name: str, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sample", "batch").parquet(f"{self.root}/{name}")

    def read(self, name: str, schema: str, samples: DataFrame) -> DataFrame:
        table = self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}")
        return table.join(F.broadcast(samples), "sample", "left_semi")  # samples that one batch touched: at most its files

    def add(self, batch: DataFrame, number: int) -> None:
        numbered = _features(batch).persist()
        files = numbered.groupBy("sample", "file").agg(F.count("*").alias("lines")).persist()  # a row a file of the batch
        rows = numbered.join(F.broadcast(files), ["sample", "file"]).persist()
        try:
            self.put(files, "files", number)
            self.put(rows.filter(near_end("line", "lines", 2 * RADIUS)), "edges", number)
            inner = _classified(rows, F.col("file"), "line").filter(~near_end("line", "lines", RADIUS))
            self.put(_counted(inner, ["sample", "file"]), "inner", number)
        finally:
            for table in (rows, files, numbered):
                table.unpersist()

    def counts(self, samples: DataFrame) -> DataFrame:
        """samples(sample) -> (sample, category, class, superfamily, n, bases) over all their files so far."""
        files = self.read("files", "sample string, file string, lines bigint, batch int", samples)
        # a row a file
        files = files.withColumn("_before", F.coalesce(F.sum("lines").over(Window.partitionBy("sample").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        edges = self.read("edges", "sample string, file string, line bigint, chrom string, start bigint, end bigint, name string, tsd string, strand string, lines bigint, batch int", samples)
        edges = edges.join(files.select("sample", "file", "_before"), ["sample", "file"]).withColumn("_line", F.col("line") + F.col("_before"))
        edges = written(edges)  # read several times: a table, not a plan
        ends = _counted(_classified(edges, F.col("sample"), "_line").filter(near_end("line", "lines", RADIUS)), ["sample"])
        inner = self.read("inner", "sample string, file string, category string, class string, superfamily string, n bigint, bases bigint, batch int", samples)
        both = ends.unionByName(inner.select(*ends.columns))
        return both.groupBy("sample", *GROUP).agg(F.sum("n").alias("n"), F.sum("bases").alias("bases"))


def statistics(spark: SparkSession, folder: str, out: str, checkpoint: str, files_per_batch: int = 50) -> StreamingQuery:
    """Starts a query over the files now in `folder`: `out/categories` (sample_id, category, n, bases) and `out/superfamilies` (sample_id, category, class, superfamily, n), partitioned by
    sample_id, equal to those of a batch query over all files that have arrived. The ledger is in `out/ledger`. A sample is a folder `sample_id=x`, or else a file by its name."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    sample = F.col("sample_id").cast("string") if "sample_id" in lines.columns else sample_of(F.col("_metadata.file_name"))
    lines = lines.select("value", sample.alias("sample"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"))
    ledger = Ledger(spark, f"{out}/ledger")

    def put(df: DataFrame, name: str) -> None:
        df.withColumnRenamed("sample", "sample_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sample_id").parquet(f"{out}/{name}")

    def each(batch: DataFrame, number: int) -> None:
        ledger.add(batch, number)
        touched = spark.read.schema("sample string, file string, lines bigint, batch int").option("basePath", f"{out}/ledger/files").parquet(f"{out}/ledger/files").filter(F.col("batch") == number).select("sample").distinct()
        done = ledger.counts(touched).persist()
        try:
            put(done.groupBy("sample", "category").agg(F.sum("n").alias("n"), F.sum("bases").alias("bases")), "categories")
            put(done.filter("class is not null").groupBy("sample", *GROUP).agg(F.sum("n").alias("n")), "superfamilies")
        finally:
            done.unpersist()

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def by_generation(stats: DataFrame) -> DataFrame:
    """Adds the generation that the sample's name gives."""
    return stats.withColumn("generation", generation_of(F.concat("sample_id", F.lit(".bed"))))

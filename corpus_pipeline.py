"""A training-data pipeline over `documents`: quality, near-duplicates, benchmark leaks, personal data, mix.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents: doc_id, text, lang, source, n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixtab.llm import decontam, jaccard_join, mixing, pii, quality
from helixtab.llm.common import Scratch, table, without

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts have the score of the bias."""
    rows = docs.select(*COLUMNS)
    return quality.score(rows, quality.fit(rows, table(spark, sf_dir, "labels"))).filter(F.col("quality_score") >= quality.THRESHOLD).select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays; documents with a null id stay. Rows that repeat the id
    of the one that stays are told apart by nothing and stay."""
    same = jaccard_join.similar(docs)
    gone = same.filter("doc_id != component_id").select(F.col("doc_id").alias("gone")).distinct()
    return without(docs.select(*COLUMNS), "doc_id", gone)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark, with the same or other values, go."""
    found = decontam.contaminated_ids(docs, table(spark, sf_dir, "benchmark"))
    return without(docs.select(*COLUMNS), "doc_id", found)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; n_chars follows the text."""
    out = pii.find(docs.select(*COLUMNS), keep=COLUMNS)
    out = out.withColumn("masked", pii.redact(F.col("text"), F.col("spans")))
    return out.select("doc_id", F.col("masked").alias("text"), "lang", "source", F.when(F.size("spans") > 0, F.length("masked").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the number of times."""
    return mixing.mix_documents(docs).filter("epochs > 0").select("doc_id", "source", "size", "source_size", F.round("target", 6).alias("target"), "epochs", "taken")


STAGES = [
    ("quality_classifier", keep_quality),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("pii", mask_personal_data),
    ("source_mixing", mix_sources),
]

#: The classifier, the near-duplicate components and the trained span classifier have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, scratch.write(stage(spark, docs, sf_dir), name)
        if hasattr(before, "_scratch_path"):
            scratch.drop(before)
    return docs

import corpus_pipeline
from helixtab.llm import decontam, jaccard_join, mixing, quality
from helixtab.llm.common import Scratch
from tests.llm.test_operators import brute_similar

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_take_effect(spark):
    sf = "/root/testdata/sf0.01"
    scratch, docs = Scratch(spark), spark.read.parquet(f"{sf}/documents.parquet").limit(300)
    docs = scratch.write(docs, "docs")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.write(stage(spark, docs, sf), name)
        seen[name] = (docs, out)
        if name != "source_mixing":
            assert out.columns == list(corpus_pipeline.COLUMNS)
        docs = out
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    before, after = seen["quality_classifier"]
    kept = {r["doc_id"] for r in quality.score(before.select(*corpus_pipeline.COLUMNS), quality.fit(before, spark.read.parquet(f"{sf}/labels.parquet"))).filter("quality_score >= 0.7").collect()}
    assert ids(after) == kept
    before, after = seen["ngram_jaccard_join"]
    same = brute_similar({r["doc_id"]: r["text"] for r in before.collect()})
    assert ids(after) == {k for k, (_, c) in same.items() if k == c}
    before, after = seen["benchmark_decontamination"]
    assert ids(after) == {r["doc_id"] for r in decontam.decontaminate(before, spark.read.parquet(f"{sf}/benchmark.parquet")).filter("not contaminated").collect()}
    before, after = seen["pii"]
    assert ids(after) == ids(before) and not [r for r in after.filter("text rlike '[A-Za-z0-9]@[A-Za-z0-9]+[.][a-z]+'").collect()]
    before, after = seen["source_mixing"]
    assert {(r["doc_id"], r["taken"]) for r in after.collect()} == {(r["doc_id"], r["taken"]) for r in mixing.mix_documents(before).filter("epochs > 0").collect()}


def test_nulls_and_empty_input(spark):
    sf = "/root/testdata/sf0.001"
    for rows in ([], [(1, None, None, None, None), (None, "some words here", "en", None, 3), (2, "", "en", "s", 0)]):
        docs = spark.createDataFrame(rows, KIND)
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, sf).count() <= len(rows), name
    assert jaccard_join.WIDTH == 5

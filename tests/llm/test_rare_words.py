"""Words beyond those that every task holds split names just the same."""

import random

from helixtab.llm import url_filter as U


def test_the_number_of_words_held_changes_nothing(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefg", k=rng.randrange(1, 8))) for _ in range(120)] + ["grün", "größe"]
    texts = [" ".join(rng.choices(words, weights=[1 + k % 17 for k in range(len(words))], k=200)) for _ in range(12)]
    urls = [f"http://{rng.choice(words)}{rng.choice(words)}.{rng.choice(('bad.com', 'good.com', 'x.org'))}/{rng.choice(words)}{rng.choice(words).upper()}/7{rng.choice(words)}" for _ in range(90)]
    urls += [None, "", "no", "http://" + "".join(rng.choices(words, k=40)) + ".com/", *["http://hot" + words[3] + words[5] + ".org/" + words[7]] * 40]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string").repartition(3)
    corpus = spark.createDataFrame([(t,) for t in texts], "text string")
    rules = (("block", "bad.com", "/"), ("allow", "good.com", "/"))
    run = lambda n: {r["page_id"]: (r["verdict"], round(r["block_score"], 9)) for r in U.judge(pages, corpus, rules, n).collect()}
    whole = run(1000)
    assert len(whole) == len(urls) and run(20) == whole and run(0) == whole


def test_rare_words_split_a_name(spark):
    """`zebra` and `lion` occur once among many words; without them the name is one run. A name that frequent words split alike isn't told."""
    from helixtab.llm.common import Scratch

    corpus = spark.createDataFrame([("garden tools " * 50 + "zebra lion",)], "text string")
    pages = spark.createDataFrame([(1, "zebralion.com", "/gardentools/zebra")], "rid long, host string, path string")
    model = spark.sparkContext.broadcast(({"garden": 50, "tools": 50}, 102))
    assert U.Segmenter(*model.value).split("zebralion") == ("zebralion",)
    splits = U.rare_splits(pages, U.word_counts(corpus), model, Scratch(spark))
    assert {r["name"]: tuple(r["split"]) for r in splits.collect()} == {"zebralion": ("zebra", "lion")}
    assert [U._told(r["told"]) for r in U.with_splits(pages, splits).collect()] == [{"zebralion": ("zebra", "lion")}]


def test_tokens_of_names():
    s = U.Segmenter({"ab": 5, "c": 1})
    assert U.names("a-b.c", "/X_y/12") == (["a", "b", "c"], ["x", "y", "12"])
    assert U.tokens("ab.com", "/12/ab", s, {"com": ("c", "om")}) == ["h:ab", "h:c", "h:om", "p:#2", "p:ab"]

"""URL filter: host and path rules first, then a naive Bayes verdict over segmented tokens.

Host labels and path tokens of any length may be concatenated words; a unigram Viterbi search splits them by word probabilities counted over
a whole corpus. The segmented host words and path tokens are features of a multinomial naive Bayes model, hashed to FEATURES
buckets so that the model has a fixed size; it learns from the urls that a rule decides.

The most frequent words are known to every task. The others, any number of them, meet the substrings of the urls' distinct names in a join; a name that a rare word splits otherwise brings its split to the
urls that have it. So splits are those of all words of the corpus, whatever the number that is held.

Null urls and urls without `://` have empty host and path; they get the verdict of the prior. Rows with equal ids are rows of
their own; an empty table gives an empty result; without urls that a rule decides, every other verdict is allow. Extra columns are
ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lower_ascii, most_frequent, only

#: (verdict, host, path): fixed by the contract of the query.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
FEATURES = 1 << 16
#: Most frequent words that every task holds, bits of the filter of the others (a collision costs a row of the join, never a result), and tasks that a common name is dealt to.
VOCABULARY, FILTER, SALTS = 1 << 17, 1 << 23, 8
#: Cost of a letter in a run that is no word.
LETTER = 2.3


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, null if none does."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def word_counts(texts: DataFrame) -> DataFrame:
    """(w, n) of the words of all texts(text), written. Words are runs of letters in lower case."""
    words = texts.select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+")).alias("w")).filter("w != ''")
    return Scratch(texts.sparkSession).write(words.groupBy("w").agg(F.count("*").alias("n")), "words")


class Segmenter:
    """Unigram Viterbi: the split of a name whose words have the highest product of probabilities. A run of letters that is no word has
    a probability by its length, however long it is. Of equal splits the one with the longer last word is taken, and a word before a run."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        self.total = total or sum(counts.values()) or 1
        self.cost = {w: self.cost_of(w, n) for w, n in counts.items()}
        self.lengths = sorted({len(w) for w in counts}, reverse=True)
        self.unknown = math.log(self.total) + math.log(10)
        self.split = lru_cache(1 << 16)(self.split_with)

    def cost_of(self, w: str, n: int) -> float:
        # a single letter is hardly ever a word of its own in a name
        return -math.log(n / self.total) + (8.0 if len(w) == 1 else 0.0)

    def split_with(self, name: str, more: tuple[tuple[str, int], ...] = ()) -> tuple[str, ...]:
        """The split, with further words and their counts."""
        rare = {w: self.cost_of(w, n) for w, n in more}
        lengths = sorted({*self.lengths, *map(len, rare)}, reverse=True) if rare else self.lengths
        best, back = [0.0], [0]
        run, begun = math.inf, 0  # cost of the best split that ends in a run, and where the run begins
        for end in range(1, len(name) + 1):
            if best[-1] + self.unknown < run:
                run, begun = best[-1] + self.unknown, end - 1
            run += LETTER
            least, start = math.inf, 0
            for n in lengths:
                if n <= end:
                    word = name[end - n : end]
                    cost = best[end - n] + (self.cost.get(word) or rare.get(word, math.inf))
                    if cost < least:
                        least, start = cost, end - n
            if run < least:
                least, start = run, begun
            best.append(least)
            back.append(start)
        out, end = [], len(name)
        while end:
            out.append(name[back[end] : end])
            end = back[end]
        return tuple(reversed(out))


def names(host: str, path: str) -> tuple[list[str], list[str]]:
    """Parts of a host and of a path that may be words run together; parts of digits come too."""
    return [x for x in re.split(r"[^a-z0-9\u0080-\U0010ffff]+", host) if x], [x for x in re.split(r"[\W_]+", path.lower()) if x]


def tokens(host: str, path: str, segmenter: Segmenter, told: dict[str, tuple[str, ...]] = {}) -> list[str]:  # noqa: B006
    """Words of a url; told: splits of names that rare words split otherwise."""
    split = lambda x: told.get(x) or segmenter.split(x)
    labels, parts = names(host, path)
    out = ["h:" + w for x in labels for w in split(x)]
    for x in parts:
        out += [f"p:#{len(x)}"] if x.isdigit() else ["p:" + w for w in split(x)]
    return out


def bucket(token: str) -> int:
    return zlib.crc32(token.encode()) & (FEATURES - 1)


def rare_splits(rows: DataFrame, counts: DataFrame, model, scratch: Scratch) -> DataFrame:
    """rows(host, path), counts(w, n), model: a broadcast (frequent words, total of all) -> (name, split) of the distinct names that rare words split otherwise than frequent ones alone."""
    frequent = model.value[0]
    rare = counts.filter(F.col("n") < min(frequent.values())) if frequent else counts
    lengths = sorted(r["n"] for r in rare.select(F.length("w").alias("n")).distinct().collect())
    at = F.crc32(F.col("w").cast("binary")).bitwiseAND(F.lit(FILTER - 1))
    bits = np.zeros(FILTER // 64, np.uint64)
    marks = rare.select(at.alias("b")).groupBy(F.expr("shiftright(b, 6)").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("bits"))
    for r in marks.collect():  # FILTER / 64 rows at most
        bits[r["w"]] = r["bits"] % (1 << 64)
    seen = rows.sparkSession.sparkContext.broadcast((lengths, bits))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = {x for h, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for part in names(h, p) for x in part if not x.isdigit()}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(own), pa.string())], ["name"])

    def substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (lengths, bits) = model.value[0], seen.value
        out: list[tuple[str, str]] = []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in (0, 1)], ["name", "w"])

        for b in batches:
            for name in b.column(0).to_pylist():
                parts = {name[k : k + n] for n in lengths if n <= len(name) for k in range(len(name) - n + 1)}
                for w in parts:
                    c = zlib.crc32(w.encode()) & (FILTER - 1)
                    if int(bits[c >> 6]) >> (c & 63) & 1 and w not in known:
                        out.append((name, w))
                if len(out) > 50_000:
                    yield made()
                    out = []
        yield made()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(*model.value)
        for b in batches:
            done = [(name, segmenter.split_with(name, tuple((x["w"], x["n"]) for x in more))) for name, more in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            done = [x for x in done if x[1] != segmenter.split_with(x[0])]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([list(x[1]) for x in done], pa.list_(pa.string()))], ["name", "split"])

    own = rows.select("host", "path").mapInArrow(distinct, "name string").distinct()
    found = own.mapInArrow(substrings, "name string, w string").join(rare, "w").groupBy("name").agg(F.collect_list(F.struct("w", "n")).alias("more"))
    return scratch.write(found.mapInArrow(split, "name string, split array<string>"), "splits")


def with_splits(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Adds `told`, the splits of the names that a row has, to rows(rid, host, path, ...). A name of many rows is dealt to SALTS tasks."""

    def uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(rid, x) for rid, h, p in zip(*(c.to_pylist() for c in b.columns), strict=True) for x in {x for part in names(h, p) for x in part if not x.isdigit()}]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], ["_rid", "name"])

    salted = splits.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    used = rows.select("rid", "host", "path").mapInArrow(uses, "_rid bigint, name string").withColumn("_salt", F.pmod("_rid", F.lit(SALTS)).cast("int"))
    told = used.join(salted, ["name", "_salt"]).groupBy("_rid").agg(F.collect_list(F.struct("name", "split")).alias("told"))
    return rows.join(told, F.col("rid") == F.col("_rid"), "left").drop("_rid")


def _told(rows: list | None) -> dict[str, tuple[str, ...]]:
    return {x["name"]: tuple(x["split"]) for x in rows or ()}


def judge(pages: DataFrame, corpus: DataFrame, rules=RULES, vocabulary: int = VOCABULARY) -> DataFrame:
    """pages(page_id, url) -> page_id, host, path, rule, verdict, block_score. corpus(text) gives the words, of which the `vocabulary` most frequent are held by every task."""
    spark, scratch = pages.sparkSession, Scratch(pages.sparkSession)
    rows = only(pages, page_id="bigint", url="string")
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    counts = word_counts(corpus)
    told = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("words")).first()
    words = spark.sparkContext.broadcast(({r["w"]: r["n"] for r in most_frequent(counts, vocabulary).collect()}, told["n"]))
    ruled = ruled.withColumn("told", F.lit(None).cast("array<struct<name:string,split:array<string>>>"))
    if told["words"] > len(words.value[0]):
        ruled = scratch.write(ruled.drop("told").withColumn("rid", F.monotonically_increasing_id()), "urls")
        ruled = scratch.write(with_splits(ruled, rare_splits(ruled, counts, words, scratch)), "told")
    scratch.drop(counts)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(*words.value)
        for b in batches:
            counts = np.zeros((2, FEATURES), np.int64)
            docs = np.zeros(2, np.int64)
            for host, path, blocked, more in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                docs[blocked] += 1
                for t in tokens(host, path, segmenter, _told(more)):
                    counts[int(blocked), bucket(t)] += 1
            kind, at = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[kind, 0, 1], pa.int32()), pa.array(np.r_[at, -1, -1], pa.int32()), pa.array(np.r_[counts[kind, at], docs], pa.int64())], ["kind", "bucket", "n"])

    learn = ruled.filter("r is not null").select("host", "path", F.col("r.verdict").eqNullSafe("block").cast("int").alias("blocked"), "told")
    counted = learn.mapInArrow(features, "kind int, bucket int, n bigint").groupBy("kind", "bucket").agg(F.sum("n").alias("n")).collect()
    table, docs = np.ones((2, FEATURES)), np.ones(2)
    for r in counted:
        if r["bucket"] < 0:
            docs[r["kind"]] += r["n"]
        else:
            table[r["kind"], r["bucket"]] += r["n"]
    weights = np.log(table / table.sum(1, keepdims=True))
    model = spark.sparkContext.broadcast(((weights[1] - weights[0]).astype(np.float64), float(np.log(docs[1] / docs[0])) if counted else -1.0))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(*words.value)
        weight, prior = model.value
        for b in batches:
            odds = [prior + float(sum(weight[bucket(t)] for t in tokens(h, p, segmenter, _told(more)))) for h, p, more in zip(*(b.column(k).to_pylist() for k in (1, 2, 5)), strict=True)]
            scores = 1 / (1 + np.exp(-np.clip(np.array(odds, float), -500, 500)))
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(scores, pa.float64())], ["page_id", "host", "path", "rule", "ruled", "block_score"])

    scored = ruled.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("ruled"), "told").mapInArrow(score, "page_id bigint, host string, path string, rule string, ruled string, block_score double")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("block_score") > 0.5, "block").otherwise("allow")).alias("verdict"), "block_score")

"""Overlap joins between candidate calls and features, and the measures derived from them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["sample_id", "chrom"]
#: Least group of lengths, as a power of two; widths of bins in lengths of their group; comparisons held at once.
LEAST, STRETCH, CELLS = 10, 16, 1 << 18


def _level(start, end):
    """The group of an interval: the power of two that its length doesn't exceed."""
    return F.greatest(F.lit(LEAST), F.ceil(F.log2(F.greatest(F.lit(1), F.col(end) - F.col(start)))).cast("int"))


def reciprocal_overlap(calls: DataFrame, features: DataFrame, r: float, keys: list[str] = KEYS) -> DataFrame:
    """(call_id, feature_no): for each call the first feature, by start and then order (feature_no), on the same chromosome that it overlaps by at least r of either length.
    Calls without a match are left out; with r = 0 the first feature on the chromosome matches.

    Two intervals that overlap by a share r > 0 of both have lengths within a factor 1 / r, so features are grouped by the power of two of their length, calls go to every group a partner can
    be in, and long and short ones never meet. Within a group, bins are STRETCH lengths wide: a call is in that of its start, a feature in those where such calls can start. In a bin each call
    looks through the features by start until one matches, so no pair is shuffled or sorted, however densely they lie; a call of a group has one row at most."""
    c = calls.select(*keys, F.col("call_id"), F.col("start").cast("bigint").alias("cs"), F.col("end").cast("bigint").alias("ce"))
    f = features.select(*keys, F.col("feature_no"), F.col("start").cast("bigint").alias("fs"), F.col("end").cast("bigint").alias("fe"))
    if r <= 0:
        first = f.groupBy(*keys).agg(F.min_by("feature_no", F.struct("fs", "feature_no")).alias("feature_no"))
        return c.join(first, keys).select("call_id", "feature_no")
    spread = math.ceil(math.log2(1 / r)) + 1
    width = F.pow(F.lit(2.0), F.col("level")) * STRETCH
    bin_of = lambda at: F.floor(at / width).cast("bigint")
    known = [F.col(k).isNotNull() for k in keys]
    c, f = c.filter("ce > cs"), f.filter("fe > fs")
    for k in known:
        c, f = c.filter(k), f.filter(k)
    reach = F.ceil((F.col("fe") - F.col("fs")) / F.lit(float(r))).cast("bigint") + 1
    f = f.withColumn("level", _level("fs", "fe")).withColumn("bin", F.explode(F.sequence(bin_of(F.col("fs") - reach), bin_of(F.col("fe")))))
    c = c.withColumn("_l", _level("cs", "ce")).withColumn("level", F.explode(F.sequence(F.greatest(F.lit(LEAST), F.col("_l") - spread), F.col("_l") + spread))).withColumn("bin", bin_of(F.col("cs")))
    by, types = [*keys, "level", "bin"], {**dict(c.dtypes), **dict(f.dtypes)}
    found = c.groupBy(*by).cogroup(f.groupBy(*by)).applyInArrow(lambda a, b: _first(a, b, r), f"call_id {types['call_id']}, fs bigint, feature_no {types['feature_no']}")
    return found.groupBy("call_id").agg(F.min_by("feature_no", F.struct("fs", "feature_no")).alias("feature_no"))


def _first(calls: pa.Table, features: pa.Table, r: float) -> pa.Table:
    """call_id, fs, feature_no of calls(call_id, cs, ce) that overlap a feature(feature_no, fs, fe) by r of either: that with the least (fs, feature_no). Each looks at the features by start
    from the first that can match, in steps that double, and stops at a match."""
    if calls.num_rows and features.num_rows:
        features = features.take(pc.sort_indices(features, [("fs", "ascending"), ("feature_no", "ascending")], null_placement="at_start"))
    fs, fe = (features[k].to_numpy() for k in ("fs", "fe"))
    cs, ce = (calls[k].to_numpy() for k in ("cs", "ce"))
    length = ce - cs
    # the shared part is at least r of the call, and the feature at most 1 / r of it; a place more on either side for rounding
    at = np.searchsorted(fs, np.floor(cs - length * (1 / r - 1)).astype(np.int64) - 1)
    end = np.searchsorted(fs, np.minimum(ce, np.ceil(ce - length * r).astype(np.int64) + 1), "right")
    match, left, step = np.full(len(cs), -1), np.flatnonzero(at < end), 4
    while len(left):
        rest = []
        for k in range(0, len(left), max(1, CELLS // step)):
            own = left[k : k + max(1, CELLS // step)]
            place = at[own, None] + np.arange(step)
            inside = place < end[own, None]
            place = np.minimum(place, len(fs) - 1)
            shared = np.minimum(ce[own, None], fe[place]) - np.maximum(cs[own, None], fs[place])
            hit = inside & (shared > 0) & (shared / length[own, None] >= r) & (shared / (fe[place] - fs[place]) >= r)
            some = hit.any(1)
            match[own[some]] = place[some, hit[some].argmax(1)]
            at[own] += step
            rest.append(own[~some & (at[own] < end[own])])
        left, step = np.concatenate(rest), min(2 * step, 256)
    got = np.flatnonzero(match >= 0)
    told = features.take(pa.array(match[got]))
    return pa.table({"call_id": calls["call_id"].take(pa.array(got)), "fs": told["fs"], "feature_no": told["feature_no"]})


def overlap_summary(calls: DataFrame, features: DataFrame, matches: DataFrame, by: list[str]) -> DataFrame:
    """Per group: matched calls, distinct matched features, calls alone, features alone. calls(by, call_id), features(by, feature_no)."""
    c = calls.select(*by, "call_id").join(matches, "call_id", "left").groupBy(*by).agg(F.count("feature_no").alias("matched_calls"), F.count(F.when(F.col("feature_no").isNull(), 1)).alias("calls_only"))
    hit = matches.select("feature_no").distinct().withColumn("_hit", F.lit(1))
    f = features.select(*by, "feature_no").join(hit, "feature_no", "left").groupBy(*by).agg(F.count("_hit").alias("matched_features"), F.count(F.when(F.col("_hit").isNull(), 1)).alias("features_only"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return c.join(f, by, "full").select(*by, *map(zero, ("matched_calls", "matched_features", "calls_only", "features_only")))


def overlap_detail(calls: DataFrame, features: DataFrame, matches: DataFrame, mode: str) -> DataFrame:
    """overlapping: features with the list of their calls in order; unique-input: calls without a match; unique-bed: features without."""
    if mode == "overlapping":
        return matches.groupBy("feature_no").agg(F.sort_array(F.collect_list("call_id")).alias("call_ids"))
    if mode == "unique-input":
        return calls.join(matches.select("call_id"), "call_id", "left_anti")
    if mode == "unique-bed":
        return features.join(matches.select("feature_no").distinct(), "feature_no", "left_anti")
    raise ValueError(f"unknown mode {mode!r}")


def detection_metrics(summary: DataFrame) -> DataFrame:
    """From overlap_summary: TP are matched features, FP calls alone, FN features alone; sensitivity (= detection rate), precision and false discovery rate, 0 where undefined."""
    tp, fp, fn = F.col("matched_features"), F.col("calls_only"), F.col("features_only")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return summary.withColumns({"sensitivity": ratio(tp, tp + fn), "precision": ratio(tp, tp + fp), "fdr": ratio(fp, tp + fp)})


def replicate_summary(metrics: DataFrame, by: str = "caller", names: tuple[str, ...] = ("sensitivity", "precision", "fdr")) -> DataFrame:
    """Mean and sample standard deviation over replicates, one row per caller and metric."""
    long = metrics.unpivot([by], list(names), "metric", "value")
    return long.groupBy(by, "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def apportion(groups: DataFrame, n: int, weight: str = "weight", method: str = "largest", by: list[str] | None = None) -> DataFrame:
    """Adds `allotted`: n split over the rows of `groups` (a small table: one row a group) in proportion to the weight.
    largest: floors, then one each by largest remainder (ties in order of `rank`). min1: rounded half to even, at least 1 for a positive weight, drift given or taken
    one by one in order of `rank`, again from the first row."""
    by = by or []
    everything, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("rank")
    total = F.sum(weight).over(everything)
    exact = F.when(total > 0, F.lit(float(n)) * F.col(weight) / total).otherwise(F.lit(0.0))
    if method == "largest":
        g = groups.withColumn("_e", exact).withColumn("_f", F.floor("_e").cast("bigint"))
        g = g.withColumns({"_rest": F.lit(n) - F.sum("_f").over(everything), "_place": F.row_number().over(Window.partitionBy(*by).orderBy((F.col("_e") - F.col("_f")).desc(), "rank"))})
        return g.withColumn("allotted", F.col("_f") + F.when(F.col("_place") <= F.col("_rest"), 1).otherwise(0)).drop("_e", "_f", "_rest", "_place")
    g = groups.withColumn("_a", F.bround(exact).cast("bigint")).withColumn("_a", F.when((F.col("_a") == 0) & (F.col(weight) > 0), F.lit(1 if n > 0 else 0)).otherwise(F.col("_a")))
    g = g.withColumns({"_drift": F.sum("_a").over(everything) - F.lit(n), "_k": F.row_number().over(order) - 1, "_n": F.count("*").over(everything)})
    # giving: whole turns, then one each to the first rows
    give = F.when(F.col("_drift") < 0, F.floor(-F.col("_drift") / F.col("_n")) + F.when(F.col("_k") < F.pmod(-F.col("_drift"), F.col("_n")), 1).otherwise(0)).otherwise(0)
    # taking: a turn takes one of each row that has any left; the turns that fit are found per row from the sums of capped amounts
    turns = g.withColumn("_t", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("_a"))))).filter("_drift > 0 and _a > 0")
    turns = turns.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy("_t", "rank"))).filter("_at <= _drift").groupBy(*by, "rank").agg(F.count("*").alias("_took"))
    out = g.join(turns, [*by, "rank"], "left")
    return out.withColumn("allotted", (F.col("_a") + give - F.coalesce("_took", F.lit(0))).cast("bigint")).drop("_a", "_drift", "_k", "_n", "_took")

"""Seeded sampling by hashed or congruential uniforms: the same rows anywhere, in any order, on any number of tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .density import density_at, histogram
from .intervals import last_before, uniform
from ..scratch import written
from .ordering import ROWS, number_rows, part_of, with_range_prefix

#: Rows that are sorted in one task to find the cut of a selection.
CUT = 1 << 16


def nth_least(rows: DataFrame, n: int, cut: int = CUT) -> tuple[float, int] | None:
    """rows(k, t): the n-th pair in order of k, then t; None where there are fewer. Two quantiles of a sketch around the place cut the rows in cells, which are counted exactly; only
    the cell of the place is looked at further, until it is small or all its values are equal, where t goes on. The driver sees five counts a time and no row moves."""
    if n < 1:
        return None
    while True:
        s = rows.agg(F.count("*").alias("c"), *(f(c).alias(f"{name}_{c}") for c in ("k", "t") for name, f in (("lo", F.min), ("hi", F.max)))).first()
        if s["c"] < n:
            return None
        if s["c"] <= cut:
            r = rows.orderBy("k", "t").offset(n - 1).limit(1).first()
            return r["k"], r["t"]
        c = "k" if s["lo_k"] < s["hi_k"] else "t"
        if s[f"lo_{c}"] == s[f"hi_{c}"]:
            return s["lo_k"], s["lo_t"]
        p = n / s["c"]
        a, b = rows.agg(F.percentile_approx(c, [max(0.0, p - 3e-4), min(1.0, p + 3e-4)], 10_000)).first()[0]
        cell = F.when(F.col(c) < a, 0).when(F.col(c) == a, 1).when(F.col(c) < b, 2).when(F.col(c) == b, 3).otherwise(4)
        counts = {r["cell"]: r["n"] for r in rows.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).collect()}
        at = 0
        while n > counts.get(at, 0):
            n -= counts.get(at, 0)
            at += 1
        rows = rows.filter(cell == at)


def among_least(key: str, t: str, cut: tuple[float, int] | None) -> Column:
    """Whether a row is at or before the pair that nth_least() found; all are where there is none."""
    return F.lit(True) if cut is None else (F.col(key) < cut[0]) | ((F.col(key) == cut[0]) & (F.col(t) <= cut[1]))


def weighted_sample(df: DataFrame, n: int, weight: str, seed: int, key: str = "id", group: str | None = None) -> DataFrame:
    """n rows without replacement, each draw in proportion to the weight of what is left: the least exponential keys -ln(u) / weight. With `group`, only the first
    row drawn of each group counts (rows with a null group are free). `key` is a whole number that names the row. The n-th key is found by counting, see nth_least(), and
    the rows up to it stay where they are, so n may be any part of the table."""
    k = df.filter(F.col(weight) > 0).withColumn("_key", -F.log(uniform(F.col(key), seed)) / F.col(weight))
    if group:
        first = k.filter(F.col(group).isNotNull()).groupBy(group).agg(F.min(F.struct("_key", key)).alias("_first"))
        k = k.join(first, group, "left").filter(F.col(group).isNull() | (F.struct("_key", key) == F.col("_first"))).select(*df.columns, "_key")
    if n < 1:
        return k.drop("_key").limit(0)
    cut = nth_least(written(k.select(F.col("_key").alias("k"), F.col(key).cast("bigint").alias("t"))), n)
    return k.filter(among_least("_key", key, cut)).drop("_key")


def take_until_budget(df: DataFrame, length: str, target: int, seed: int, key: str = "id", by: list[str] | None = None, rows: int = ROWS) -> DataFrame:
    """Rows in random order until their lengths reach the target, the crossing row included. Prefix sums run over ranges of bounded rows."""
    u = df.withColumns({"_u": uniform(F.col(key), seed), "_all": F.lit(0)})
    out = with_range_prefix(u, by or ["_all"], ["_u", key], F.col(length).cast("bigint"), "_before", rows=rows)
    return out.filter(F.coalesce("_before", F.lit(0)) < target).select(*df.columns)


def draw_categories(weights: DataFrame, n: int, seed: int, rows: int = ROWS) -> DataFrame:
    """n draws with replacement: weights(category, weight), any number of them -> (draw, category). A draw takes the last category whose cumulative share begins at or before its uniform."""
    w = with_range_prefix(weights.filter("weight > 0").withColumn("_all", F.lit(0)), ["_all"], ["category"], F.col("weight"), "_from", total="_total", rows=rows)
    low = F.coalesce("_from", F.lit(0.0))
    w = w.select("_all", (low / F.col("_total")).alias("_at"), ((low + F.col("weight")) / F.col("_total")).alias("_hi"), "category")
    draws = weights.sparkSession.range(n).select(F.lit(0).alias("_all"), uniform(F.col("id"), seed).alias("_at"), F.col("id").alias("draw"))
    hit = last_before(draws, w, ["_all"], ["draw"], rows).filter(F.col("_at") < F.col("_mark._hi"))
    return hit.select("draw", "_mark.category")


def event_counts(weights: DataFrame, n: int) -> DataFrame:
    """Events per category: shares of n rounded half to even, what is missing given to the heaviest category."""
    everything = Window.partitionBy()
    w = weights.withColumn("_share", F.col("weight") / F.sum("weight").over(everything)).withColumn("events", F.bround(F.col("_share") * n).cast("bigint"))
    w = w.withColumns({"_miss": F.lit(n) - F.sum("events").over(everything), "_top": F.row_number().over(Window.orderBy(F.desc("weight"), "category"))})
    return w.select("category", "weight", (F.col("events") + F.when((F.col("_top") == 1) & (F.col("_miss") > 0), F.col("_miss")).otherwise(0)).alias("events"))


def pick_members(draws: DataFrame, library: DataFrame, seed: int) -> DataFrame:
    """A member of the drawn category for each draw, or of the whole library where the category has none. draws(draw, category), library(member, category).
    Members are whole numbers; they are numbered per category and over all, in parts of their range; a draw's uniform picks the number."""
    lib = number_rows(library.withColumn("_one", F.lit(0)), ["_one"], [part_of("member")], ["member"], "_g")
    lib = number_rows(lib, ["category"], [part_of("member")], ["member"], "_k")
    sizes = library.groupBy("category").agg(F.count("*").alias("_n"))
    total = library.agg(F.count("*").alias("_all"))
    d = draws.withColumn("_u", uniform(F.col("draw"), seed)).join(sizes, "category", "left").join(F.broadcast(total))
    own = d.filter("_n is not null").withColumn("_k", F.floor(F.col("_u") * F.col("_n")).cast("bigint")).join(lib.select("category", "_k", "member"), ["category", "_k"])
    other = d.filter("_n is null").withColumn("_g", F.floor(F.col("_u") * F.col("_all")).cast("bigint")).join(lib.select("_g", "member"), "_g")
    return own.select("draw", "category", "member").unionByName(other.select("draw", "category", "member"))


def importance(df: DataFrame, guide: DataFrame, value: str) -> DataFrame:
    """Adds `importance`: density of the guide's values over that of the own values, at each row's value. Both densities are taken at distinct values."""
    one = lambda d: d.withColumn("_all", F.lit(0))
    own, other = (written(histogram(one(d), value, ["_all"])) for d in (df, guide))  # read several times: tables, not plans
    at = own.select("_all", F.col("x").alias("at"))
    w = density_at(at, own, ["_all"]).withColumnRenamed("density", "_own").join(density_at(at, other, ["_all"]).withColumnRenamed("density", "_guide"), ["_all", "at"])
    w = w.select(F.col("at").alias("_at"), (F.col("_guide") / (F.col("_own") + 1e-8)).alias("importance"))
    return df.join(w, F.col(value).cast("double") == F.col("_at")).drop("_at")


def resample_to_guide(df: DataFrame, guide: DataFrame, value: str, seed: int, key: str = "id", mode: str = "match") -> DataFrame:
    """Adds `copies`. match: n rows in all, each floor(n w / sum w) times, what is left drawn without replacement by the fractional parts. duplicate: max(1, w / mean w rounded
    half to even), all rows stay."""
    w = importance(df, guide, value)
    told = w.agg(F.count("*").alias("_n"), F.sum("importance").alias("_sum"))
    if mode == "duplicate":
        w = w.join(F.broadcast(told))
        return w.withColumn("copies", F.greatest(F.lit(1), F.rint(F.col("importance") / (F.col("_sum") / F.col("_n"))).cast("bigint"))).drop("_n", "_sum")
    rows = written(w.select(F.col(key).alias("_name"), F.col(key).cast("bigint").alias("t"), "importance"))
    told = rows.agg(F.count("*").alias("_n"), F.sum("importance").alias("_sum")).first()
    e = F.col("importance") / F.lit(told["_sum"]) * F.lit(told["_n"])
    part = e - F.floor(e)
    rows = rows.withColumns({"_base": F.floor(e).cast("bigint"), "k": F.when(part > 0, -F.log(uniform(F.col("t"), seed)) / part)})
    left = told["_n"] - (rows.agg(F.sum("_base")).first()[0] or 0) if told["_n"] else 0
    cut = nth_least(rows.filter("k is not null").select("k", "t"), left)
    one = F.when(F.col("k").isNotNull() & among_least("k", "t", cut), 1).otherwise(0) if left > 0 else F.lit(0)
    return df.join(rows.select("_name", "importance", (F.col("_base") + one).alias("copies")), F.col(key) == F.col("_name")).drop("_name")

"""Gaussian kernel densities on histograms: the cost follows distinct values plus points, not rows."""

from __future__ import annotations

import json
import math
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written


def histogram(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by, F.col(value).cast("double").alias("x")).agg(F.count("*").alias("n"))


def bandwidths(hist: DataFrame, by: list[str]) -> DataFrame:
    """Scott's rule per group: n^(-1/5) * std (ddof 1); degenerate: at most one distinct value."""
    n = F.sum("n")
    mean = F.sum(F.col("n") * F.col("x")) / n
    square = F.sum(F.col("n") * F.col("x") * F.col("x"))
    g = hist.groupBy(*by).agg(n.alias("total"), mean.alias("mean"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("distinct"), square.alias("_sq"))
    # second pass for the variance: sums of squares of large values lose digits
    d = hist.join(g.select(*by, "mean"), by).groupBy(*by).agg(F.sum(F.col("n") * F.pow(F.col("x") - F.col("mean"), 2)).alias("_ss"))
    g = g.join(d, by).withColumn("std", F.when(F.col("total") > 1, F.sqrt(F.col("_ss") / (F.col("total") - 1))))
    return g.withColumns({"degenerate": F.col("distinct") <= 1, "bandwidth": F.pow(F.col("total"), F.lit(-0.2)) * F.col("std")}).drop("_sq", "_ss")


#: Bandwidths beyond which a kernel counts as nothing (less than 1e-13 of its peak), and terms of an expansion: the error is below 1e-15 of the peak.
REACH, TERMS = 8, 20


@lru_cache(1)
def _shifts() -> str:
    """As JSON, for each distance of REACH boxes at most between a box of values and one of points: the matrix that takes the moments of the first to the series of the second. Boxes
    are a bandwidth wide, so the matrices are the same for all data: Hermite functions by their recursion."""
    out = []
    for k in range(-REACH, REACH + 1):
        t = k / math.sqrt(2)
        h = [math.exp(-t * t), 2 * t * math.exp(-t * t)]
        for n in range(1, 2 * TERMS):
            h.append(2 * t * h[n] - 2 * n * h[n - 1])
        out.append({"k": k, "m": [[(-1) ** b * h[a + b] / math.factorial(a) / math.factorial(b) for a in range(TERMS)] for b in range(TERMS)]})
    return json.dumps(out)


def density_at(points: DataFrame, hist: DataFrame, by: list[str], widths: DataFrame | None = None) -> DataFrame:
    """points(by, at, ...) -> density of each group's values at each distinct point, null for degenerate groups. A fast Gauss transform: values are summed up as the moments of their box
    (a bandwidth wide), the moments of near boxes as a power series in each box of points, and a point reads the series of its box. The work is linear in values plus points; values and
    points never meet. widths: bandwidths() of the histogram, where they are known already."""
    b = (bandwidths(hist, by) if widths is None else widths).select(*by, "total", "bandwidth", "degenerate")
    scaled = lambda c: F.col(c) / F.nullif(F.col("bandwidth"), F.lit(0.0))
    offset = lambda c: (scaled(c) - F.col("_box") - 0.5) / math.sqrt(2)
    box = lambda c: F.floor(scaled(c)).cast("bigint")
    values = hist.join(b.filter("not degenerate"), by).withColumn("_box", box("x")).withColumn("_t", offset("x"))
    moments = values.groupBy(*by, "_box").agg(*(F.sum(F.col("n") * F.pow("_t", F.lit(k))).alias(f"_{k}") for k in range(TERMS)))
    shift = F.explode(F.from_json(F.lit(_shifts()), "array<struct<k:int,m:array<array<double>>>>")).alias("s")
    near = moments.select(*by, "_box", F.array(*(f"_{k}" for k in range(TERMS))).alias("_m"), shift)
    series = F.transform("s.m", lambda row: F.aggregate(F.zip_with(row, F.col("_m"), lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y))
    near = near.select(*by, (F.col("_box") + F.col("s.k")).alias("_box"), series.alias("_c"))
    near = near.groupBy(*by, "_box").agg(F.array(*(F.sum(F.get("_c", F.lit(k))) for k in range(TERMS))).alias("_c"))
    at = points.distinct().join(b, by).withColumn("_box", box("at")).withColumn("_t", offset("at"))
    # from the highest power down
    total = F.aggregate(F.reverse("_c"), F.lit(0.0), lambda acc, c: acc * F.col("_t") + c)
    density = F.coalesce(F.greatest(total, F.lit(0.0)), F.lit(0.0)) / (F.col("total") * F.col("bandwidth") * math.sqrt(2 * math.pi))
    return at.join(near, [*by, "_box"], "left").select(*points.columns, F.when(~F.col("degenerate"), density).alias("density"))


def kde(df: DataFrame, value: str, by: list[str], points: int = 512, cut: float = 3.0) -> DataFrame:
    """Density of each group on `points` evenly spaced values from its least - cut * bandwidth to its most + cut * bandwidth: by, k, at, density. Degenerate
    groups have one row without a curve."""
    hist = written(histogram(df, value, by))  # read several times: a table, not a plan
    b = written(bandwidths(hist, by))
    step = (F.col("hi") - F.col("lo") + 2 * cut * F.col("bandwidth")) / (points - 1)
    grid = b.filter("not degenerate").select(*by, F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"), (F.col("lo") - cut * F.col("bandwidth")).alias("_lo"), step.alias("_step"))
    grid = grid.select(*by, "k", (F.col("_lo") + F.col("k") * F.col("_step")).alias("at"))
    curve = density_at(grid, hist, by, b)
    none = b.filter("degenerate").select(*by, F.lit(None).cast("int").alias("k"), F.col("lo").alias("at"), F.lit(None).cast("double").alias("density"))
    return curve.select(*by, "k", "at", "density").unionByName(none)

"""Interval algebra: merging, complement, neighbourhoods, weights and point lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import is_gene
from ..scratch import written
from .ordering import ROWS, part_of, with_prefix, with_range_prefix

#: Draws of a group that one row makes.
DRAWS = 4096

KEYS = ["sample_id", "chrom"]


def merge_intervals(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Disjoint intervals that cover the same positions; touching ones are merged. The running maximum of ends and the island numbers are accumulated part by
    part, so a long chromosome isn't one task's work. Of intervals that begin at one position only the longest counts, so a part has as many rows as positions at most."""
    df = df.groupBy(*keys, F.col("start").alias("start")).agg(F.max("end").alias("end"))
    df = with_prefix(df, keys, [part_of("start")], ["start"], F.col("end"), "_reach", F.max)
    df = df.withColumn("_new", F.when(F.col("start") <= F.col("_reach"), 0).otherwise(1))
    df = with_prefix(df, keys, [part_of("start")], ["start"], F.col("_new"), "_before")
    island = F.coalesce("_before", F.lit(0)) + F.col("_new")
    return df.groupBy(*keys, island.alias("_island")).agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def complement_intervals(df: DataFrame, lengths: DataFrame, keys: list[str] = KEYS, merged_before: bool = False) -> DataFrame:
    """Gaps of the merged intervals within [0, length) of each chromosome; lengths(keys, length). merged_before: df is merged already."""
    merged = (df if merged_before else merge_intervals(df, keys)).join(lengths.select(*keys, "length"), keys)
    before = with_prefix(merged, keys, [part_of("start")], ["start"], F.col("end"), "_from", F.max)
    gaps = before.select(*keys, F.least(F.coalesce("_from", F.lit(0)), F.col("length")).alias("start"), F.least("start", "length").alias("end"))
    tails = lengths.select(*keys, "length").join(merged.groupBy(*keys).agg(F.max("end").alias("_last")), keys, "left")
    tails = tails.select(*keys, F.coalesce("_last", F.lit(0)).alias("start"), F.col("length").alias("end"))
    return gaps.unionByName(tails).filter("start < end")


def gene_neighbourhoods(df: DataFrame, buffer: int, lengths: DataFrame | None = None, keys: list[str] = KEYS) -> DataFrame:
    """Merged [max(0, start - buffer), end + buffer) of genes, cut at the chromosome's end if lengths are given."""
    near = df.filter(is_gene(F.col("name"))).select(*keys, F.greatest(F.lit(0), F.col("start") - buffer).alias("start"), (F.col("end") + buffer).alias("end"))
    if lengths is not None:
        near = near.join(lengths.select(*keys, "length"), keys).select(*keys, "start", F.least("end", "length").alias("end"))
    return merge_intervals(near, keys)


def weighted_intervals(df: DataFrame, lengths: DataFrame, buffer: int, bias: float, keys: list[str] = KEYS) -> DataFrame:
    """Each chromosome cut into open intervals (gene neighbourhoods; weight length * bias) and closed ones (the rest; weight length)."""
    near = written(gene_neighbourhoods(df, buffer, lengths, keys))  # read several times: a table, not a plan
    rest = complement_intervals(near, lengths, keys, merged_before=True)
    weigh = lambda d, kind, factor: d.withColumns({"kind": F.lit(kind), "weight": (F.col("end") - F.col("start")) * F.lit(float(factor))})
    return weigh(near, "open", bias).unionByName(weigh(rest, "closed", 1.0))


def points_in_intervals(points: DataFrame, intervals: DataFrame, position: str = "position", closed: bool = True, keys: list[str] = KEYS) -> DataFrame:
    """Adds `inside` to points: whether the position is in one of the disjoint intervals, ends included if closed, else half-open.
    As intervals are disjoint, the last one that begins at or before a point decides: a prefix maximum over both, no range join. Distinct positions are looked up and come back to their
    points, so a part has as many rows as positions at most, however many points lie on one."""
    name = [c for c in points.columns if c not in (*keys, position)]
    p = points.select(*keys, F.col(position).cast("bigint").alias("_at")).distinct().withColumns({"_point": F.lit(1), "_end": F.lit(None).cast("bigint")})
    i = intervals.select(*keys, F.col("start").cast("bigint").alias("_at"), F.lit(0).alias("_point"), F.col("end").cast("bigint").alias("_end"))
    both = p.unionByName(i, allowMissingColumns=True)
    both = with_prefix(both, keys, [part_of("_at")], ["_at", "_point"], F.col("_end"), "_reach", F.max).filter("_point = 1")
    inside = F.col("_at") <= F.col("_reach") if closed else F.col("_at") < F.col("_reach")
    found = both.filter(inside).select(*(F.col(k).alias(f"_{k}") for k in keys), "_at")
    on = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col(position) == F.col("_at")]
    return points.join(found, on, "left").select(*keys, position, *name, F.col("_at").isNotNull().alias("inside"))


def last_before(points: DataFrame, marks: DataFrame, keys: list[str], order: list[str], rows: int = ROWS) -> DataFrame:
    """Adds `_mark` to points(keys, _at, order): the columns of the last mark(keys, _at, ...) at or before it, null where there is none. Both are one table in ranges of bounded rows
    over which the greatest mark is carried, so neither many marks nor many points at one place meet each other."""
    held = [c for c in marks.columns if c not in keys]
    m = marks.select(*keys, "_at", F.lit(0).alias("_point"), F.struct("_at", *(c for c in held if c != "_at")).alias("_value"))
    both = points.withColumn("_point", F.lit(1)).unionByName(m, allowMissingColumns=True)
    return with_range_prefix(both, keys, ["_at", "_point", *order], F.col("_value"), "_mark", F.max, rows=rows).filter("_point = 1").drop("_point", "_value")


def sample_positions(intervals: DataFrame, n: int, seed: int, keys: list[str] = ["sample_id"], rows: int = ROWS) -> DataFrame:  # noqa: B006
    """n positions per group, drawn with replacement over weighted intervals (chrom, start, end, weight): an interval by its weight, a position in it evenly.
    Draws are integers from a linear congruence of their number, so that they are the same anywhere; a draw takes the last interval whose cumulative share begins at or before its uniform. Adds
    draw, position."""
    intervals = written(intervals.select(*keys, "chrom", "start", "end", "weight"))  # read several times: a table, not a plan
    edges = with_prefix(intervals, keys, [F.col("chrom"), part_of("start")], ["start"], F.col("weight"), "_from", total="_total").filter("weight > 0")
    low = F.coalesce("_from", F.lit(0.0))
    edges = edges.select(*keys, (low / F.col("_total")).alias("_at"), ((low + F.col("weight")) / F.col("_total")).alias("_hi"), "chrom", "start", "end")
    first = F.col("_first")
    groups = intervals.filter("weight > 0").select(*keys).distinct().withColumn("_first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(0, n - 1)).cast("bigint"), F.lit(DRAWS).cast("bigint"))))
    draws = groups.select(*keys, F.explode(F.sequence(first, F.least(first + DRAWS, F.lit(n)) - 1)).alias("draw")) if n > 0 else groups.select(*keys, first.alias("draw")).limit(0)
    hit = last_before(draws.withColumn("_at", uniform(F.col("draw"), seed)), edges, keys, ["draw"], rows).filter(F.col("_at") < F.col("_mark._hi"))
    v, mark = uniform(F.col("draw"), seed + 1), F.col("_mark")
    return hit.select(*keys, mark["chrom"].alias("chrom"), "draw", (mark["start"] + F.floor(v * (mark["end"] - mark["start"]))).cast("bigint").alias("position"))


def uniform(c, seed: int):
    """In (0, 1) from whole numbers alone, the same in any engine: a multiplicative congruence modulo a prime."""
    x = (c * 48271 + (seed * 69621 + 12345)) % 2147483647
    x = (x * 16807 + 7) % 2147483647
    x = (x * 48271 + 11) % 2147483647
    return (x.cast("double") + 0.5) / 2147483647.0

"""Connected components by alternating large-star and small-star rounds over an edge table (Kiveris et al., 2014).

Every round is two aggregations and two joins on the node; the edge table is cut at each round by a table in shared scratch space. A hub has
its minimum pre-aggregated before the shuffle, and its edges are dealt over SALTS parts. Nothing reaches the driver but
counts and check sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Parts that the edges of a node are dealt over when they meet its minimum.
SALTS = 8


def _dealt(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges(u, v) with m of least(u, m), a hub's edges dealt over SALTS parts."""
    parts = least.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(parts, ["u", "part"])


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _dealt(both.filter("v > u"), least).select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _dealt(down, least).filter("v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """edges(a, b) -> table of (node, component): component is the smallest node reachable. Nodes that are their own component are
    left out. Null ends, loops and repeated edges are ignored."""

    def cut(df: DataFrame) -> tuple[DataFrame, tuple]:
        out = scratch.write(df.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        return out, tuple(out.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 998_244_353)).first())

    now, state = cut(edges)
    for _ in range(rounds):
        if not state[0]:
            break
        nxt, new = cut(_small_star(_large_star(now)))
        scratch.drop(now)
        now, same, state = nxt, new == state, new
        if same:
            break
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    out = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out._scratch_path = now._scratch_path
    return out

"""Ranks, prefix sums and prefix maxima over whole groups without a window that holds a group in one task: a coarse key cuts each
group into parts, the parts' aggregates are accumulated (a table of one row a part), and windows run within a part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

#: Rows of a range that ranges() aims at.
ROWS = 1 << 18
#: Width of a part in positions or lines.
PART = 65_536


def with_prefix(df: DataFrame, by: list[str], coarse: list[Column], fine: list, value: Column, out: str, agg=F.sum, total: str | None = None) -> DataFrame:
    """Adds `out`: agg of `value` over the rows of the group that come before, in the order of the coarse keys and then `fine`; null for the first
    row. With agg=F.max and a struct that begins with the order, this is the row before. total: a column with agg of the whole group."""
    keys = [f"_k{i}" for i in range(len(coarse))]
    df = df.withColumns({k: c for k, c in zip(keys, coarse, strict=True)} | {"_v": value})
    parts = df.groupBy(*by, *keys).agg(agg("_v").alias("_s"))
    w = Window.partitionBy(*by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*(F.col(c).alias(f"_b_{c}") for c in (*by, *keys)), agg("_s").over(w).alias("_first"), *([agg("_s").over(Window.partitionBy(*by)).alias(total)] if total else []))
    on = [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in (*by, *keys)]
    inner = Window.partitionBy(*by, *keys).orderBy(*fine).rowsBetween(Window.unboundedPreceding, -1)
    own = agg("_v").over(inner)
    if agg is F.sum:
        both = F.when(F.col("_first").isNull(), own).otherwise(F.col("_first") + F.coalesce(own, F.lit(0)))
    else:
        both = F.coalesce(F.greatest("_first", own) if agg is F.max and "struct" not in parts.schema["_first"].dataType.typeName() else own, F.col("_first"))
    return df.join(parts, on).withColumn(out, both).drop("_v", "_first", *keys, *(f"_b_{c}" for c in (*by, *keys)))


def number_rows(df: DataFrame, by: list[str], coarse: list[Column], fine: list, out: str = "line_no") -> DataFrame:
    """Adds the 0-based position of each row in its group."""
    return with_prefix(df, by, coarse, fine, F.lit(1).cast("bigint"), out).withColumn(out, F.coalesce(out, F.lit(0)).cast("bigint"))


def part_of(position: str | Column) -> Column:
    c = F.col(position) if isinstance(position, str) else position
    return F.floor(c / PART).cast("bigint")


def ranges(df: DataFrame, order: list[str], rows: int = ROWS, stored: bool = False) -> DataFrame:
    """The rows in ranges of `order` whose edges Spark samples, about `rows` rows each however the values lie: adds `_part`, which ascends with the order, and `_row`, the place within the
    part. `order` should tell rows apart (a key last), so that many rows at one position are split too; rows equal in all of it go to one part. The table is written to scratch space,
    as another run of the plan may sample other edges. stored: df is a table, not a plan, and needs no copy before it is counted, sampled and dealt."""
    df = df if stored else written(df)
    n = max(1, -(-df.count() // rows))
    dealt = df.repartitionByRange(n, *order) if n > 1 else df.coalesce(1)
    out = written(dealt.sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    return out.withColumns({"_part": F.shiftright("_id", 33), "_row": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id")


def number_ranges(ranged: DataFrame, by: list[str], out: str = "line_no", total: str | None = None) -> DataFrame:
    """Adds the 0-based position of each row of ranges() in its group, whose columns are the first of the order; total: the rows of the group. A table of one row a part and group is
    joined; no row moves for a window."""
    parts = ranged.groupBy(*by, "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    w = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = [F.sum("_n").over(Window.partitionBy(*by)).alias(total)] if total else []
    parts = parts.select(*(F.col(c).alias(f"_b_{c}") for c in (*by, "_part")), (F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_first")).alias("_shift"), *whole)
    on = [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in (*by, "_part")]
    return ranged.join(parts, on).withColumn(out, F.col("_row") + F.col("_shift")).drop("_shift", *(f"_b_{c}" for c in (*by, "_part")))


def with_range_prefix(df: DataFrame, by: list[str], order: list[str], value: Column, out: str, agg=F.sum, total: str | None = None, rows: int = ROWS) -> DataFrame:
    """with_prefix() over parts of bounded rows, see ranges(), for positions of which nothing is known."""
    ranged = ranges(df, [*by, *order], rows)
    return with_prefix(ranged, by, [F.col("_part")], ["_row"], value, out, agg, total).drop("_part", "_row")

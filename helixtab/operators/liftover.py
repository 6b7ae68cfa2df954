"""Coordinates after deletions and insertions: in batches on original coordinates, and insertions one after another on the coordinates that those before have left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .ordering import number_ranges, part_of, ranges, with_prefix

KEYS = ["sample_id", "chrom"]


def _shift(rows: DataFrame, events: DataFrame, at: str, size: str, before_first: bool, keys: list[str], out: str) -> DataFrame:
    """Adds `out`: sum of event sizes at positions below rows' `at` (or at it, unless before_first). A prefix sum over the distinct positions of rows and events together, which comes back to
    the rows, so that a part has as many rows as positions at most, however many rows begin at one."""
    r = rows.select(*keys, F.col(at).cast("bigint").alias("_at")).distinct().withColumns({"_o": F.lit(0 if before_first else 1), "_n": F.lit(0).cast("bigint")})
    e = events.groupBy(*keys, F.col("position").cast("bigint").alias("_at")).agg(F.sum(F.col(size).cast("bigint")).alias("_n")).withColumn("_o", F.lit(1 if before_first else 0))
    both = with_prefix(r.unionByName(e), keys, [part_of("_at")], ["_at", "_o"], F.col("_n"), "_sum")
    told = both.filter(F.col("_o") == (0 if before_first else 1)).select(*(F.col(k).alias(f"_{k}") for k in keys), "_at", "_sum").filter("_sum != 0")
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col(at).cast("bigint") == F.col("_at")]
    return rows.join(told, on, "left").select(*rows.columns, F.coalesce("_sum", F.lit(0)).cast("bigint").alias(out))


def lift_over(features: DataFrame, events: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Rows moved left by the lengths of deletions (position, length) that begin before their start; adds `shift`. Start and end move together."""
    out = _shift(features, events, "start", "length", True, keys, "shift")
    return out.withColumns({"start": F.col("start") - F.col("shift"), "end": F.col("end") - F.col("shift")})


def apply_insertions(features: DataFrame, events: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Features after a batch of insertions (position, length, name) given on original coordinates. Features at or after a point move right; one that spans points is
    cut at each of them, and every piece's name gets `;CUT_BY:` and the name of the insertions that cut it, in order of position. Adds `piece`.
    Positions are distinct per chromosome."""
    points = events.groupBy(*keys, F.col("position").cast("bigint").alias("position")).agg(F.sum("length").cast("bigint").alias("length"), F.sort_array(F.collect_list("name")).alias("by"))
    whole = _with_points(features, points, keys)
    # a point of several insertions cuts as often
    cuts = F.flatten(F.transform("_cuts", lambda c: F.transform(c["by"], lambda by: F.struct(c["position"].alias("position"), c["_sum"].alias("_sum"), by.alias("by")))))
    whole = whole.withColumn("_cuts", cuts)
    named = F.concat(F.col("name"), F.array_join(F.transform("_cuts", lambda c: F.concat(F.lit(";CUT_BY:"), c["by"])), ""))
    held = [c for c in features.columns if c not in (*keys, "start", "end", "name")]
    cut = whole.select(*keys, *held, named.alias("name"), F.explode(_pieces(lambda k: k.alias("piece"))).alias("_q"))
    return cut.select(*keys, *held, "name", "_q.piece", (F.col("_q.start") + F.col("_q.shift")).alias("start"), (F.col("_q.end") + F.col("_q.shift")).alias("end"), "_q.shift")


#: Least width of a bin, as a power of two.
LEAST = 10


def _with_points(rows: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """Adds to rows(keys, start, end, ...) `_cuts`, the points(keys, position, length, ...) strictly inside, in order, each with `_sum`, the lengths up to it, its own included; and `_move`, the
    lengths of points up to the start. Positions are distinct per keys. A row is in one bin, at a width near its own length, and a bin has the points of two widths as an array: rows
    are shuffled once, and neither pairs nor pieces are."""
    e = points.withColumn("position", F.col("position").cast("bigint"))
    e = with_prefix(e, keys, [part_of("position")], ["position"], F.col("length"), "_sum").withColumn("_sum", F.coalesce("_sum", F.lit(0)) + F.col("length"))
    size = F.pow(F.lit(2.0), F.col("_level")).cast("bigint")
    level = F.greatest(F.lit(LEAST), F.ceil(F.log2(F.greatest(F.lit(1), F.col("end") - F.col("start")) + 1))).cast("int")
    rows = rows.withColumn("_level", level).withColumn("_bin", F.floor(F.col("start") / size).cast("bigint"))
    at = [*keys, "_level", "_bin"]
    bins = rows.select(*at).distinct()
    carried = _shift(bins.withColumn("_low", F.col("_bin") * size), points, "_low", "length", True, keys, "_carry").drop("_low")
    near = e.join(F.broadcast(bins.select("_level").distinct()))
    own = F.floor(F.col("position") / size).cast("bigint")
    near = near.withColumn("_bin", F.explode(F.array(own - 1, own)))
    held = [c for c in points.columns if c not in (*keys, "position")]
    near = near.groupBy(*at).agg(F.sort_array(F.collect_list(F.struct("position", "_sum", *held))).alias("_points"))
    both = carried.join(near, at, "left").select(*(F.col(c).alias(f"_b{c}") for c in at), "_carry", "_points")
    out = rows.join(both, [F.col(c).eqNullSafe(F.col(f"_b{c}")) for c in at], "left").drop(*(f"_b{c}" for c in at), "_level", "_bin")
    none = F.array().cast(both.schema["_points"].dataType)
    out = out.withColumn("_points", F.coalesce("_points", none))
    before = F.filter("_points", lambda c: c["position"] <= F.col("start"))
    inside = F.filter("_points", lambda c: (c["position"] > F.col("start")) & (c["position"] < F.col("end")))
    return out.withColumns({"_move": F.coalesce(F.try_element_at(before, F.lit(-1))["_sum"], "_carry", F.lit(0)).cast("bigint"), "_cuts": inside}).drop("_points", "_carry")


def _pieces(*more) -> Column:
    """Of a row of _with_points(), an array of its pieces: what `more` gives for the number of each, start and end as they were, and shift."""
    point = lambda k, last: F.when(k == F.size("_cuts"), F.col(last).cast("bigint")).otherwise(F.get("_cuts", k)["position"])
    return F.transform(F.sequence(F.lit(0), F.size("_cuts")), lambda k: F.struct(
        *(m(k) for m in more), F.when(k == 0, F.col("start").cast("bigint")).otherwise(F.get("_cuts", k - 1)["position"]).alias("start"), point(k, "end").alias("end"),
        F.when(k == 0, F.col("_move")).otherwise(F.get("_cuts", k - 1)["_sum"]).alias("shift"),
    ))


def inserted_features(features: DataFrame, events: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The insertions themselves as features on the new coordinates; the name gets `;NESTED_IN:` and the name of each feature that it was put into, in order of line."""
    width = 4096
    f = features.select(*keys, "line_no", F.col("name").alias("_host"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.explode(F.sequence(F.floor(F.col("start") / width).cast("bigint"), F.floor(F.col("end") / width).cast("bigint"))).alias("_bin"))
    e = events.withColumn("_bin", F.floor(F.col("position") / width).cast("bigint"))
    hosts = e.join(f, [*keys, "_bin"]).filter("position > _s and position < _e").groupBy(*keys, "position").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "_host"))), lambda h: F.concat(F.lit(";NESTED_IN:"), h["_host"])), "").alias("_in"))
    out = _shift(events.join(hosts, [*keys, "position"], "left"), events, "position", "length", True, keys, "shift")
    return out.select(*keys, (F.col("position") + F.col("shift")).alias("start"), (F.col("position") + F.col("shift") + F.col("length")).alias("end"), F.concat("name", F.coalesce("_in", F.lit(""))).alias("name"))


def _cut(rows: DataFrame, gaps: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows(keys, row, start, end, tags, ...) after gaps(keys, position, length, seq, by) on the same coordinates: rows at or after a gap move, rows that a gap lies within are cut. Adds to
    the tags (seq, by) of a piece those gaps that cut the row while it still held the piece: looking outwards from it, those earlier than all nearer ones. Also the pairs (keys, row, seq)."""
    whole = _with_points(rows, gaps, keys)

    def earlier(outwards: Column) -> Column:
        tag = lambda c: F.struct(c["seq"].alias("seq"), c["by"].alias("by"))
        none = F.array().cast("array<struct<seq:bigint,by:string>>")
        return F.aggregate(outwards, none, lambda acc, c: F.when((F.size(acc) == 0) | (c["seq"] < F.element_at(acc, -1)["seq"]), F.array_append(acc, tag(c))).otherwise(acc))

    def tags(k: Column) -> Column:
        left, right = F.reverse(F.slice("_cuts", F.lit(1), k)), F.slice("_cuts", k + 1, F.size("_cuts"))
        return F.concat("tags", F.sort_array(F.concat(earlier(left), earlier(right)))).alias("tags")

    held = [c for c in rows.columns if c not in (*keys, "start", "end", "tags")]
    pieces = whole.select(*keys, *held, F.explode(_pieces(tags)).alias("_q"))
    moved = pieces.select(*keys, *held, (F.col("_q.start") + F.col("_q.shift")).alias("start"), (F.col("_q.end") + F.col("_q.shift")).alias("end"), "_q.tags")
    return moved, whole.select(*keys, "row", F.explode("_cuts").alias("_c")).select(*keys, "row", F.col("_c.seq").alias("seq"))


def _gaps(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Inserted segments(keys, row, start, end, by) as gaps on the coordinates before: (keys, position, length, seq, by), of segments at one place the earliest, which is the one that cuts."""
    size = F.col("end") - F.col("start")
    placed = with_prefix(segments, keys, [part_of("start")], ["start"], size, "_before")
    placed = placed.withColumn("position", F.col("start") - F.coalesce("_before", F.lit(0)))
    return placed.groupBy(*keys, "position").agg(F.sum(size).alias("length"), F.min("row").alias("seq"), F.min_by("by", "row").alias("by"))


def insert_in_order(features: DataFrame, events: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """features(keys, line_no, name, start, end) and insertions events(keys, seq, position, length, name), each given on the coordinates that those with a smaller seq have left: all as if applied one after
    another. Returns keys, line_no or seq, name, start, end: pieces of features, whose names have `;CUT_BY:` and the name of each insertion that cut them, in order of time; and of the
    inserted ones, whose names first have `;NESTED_IN:` and the name of each feature or insertion that they went into, insertions first, then features by line. Names in marks are those given.

    A run of insertions is a set of disjoint segments on the coordinates after it, and with their lengths taken off, a set of gaps on those before. Two runs compose: the segments of the first are cut
    and moved by the gaps of the second. So runs of one, two, four ... insertions are built, all of a level in one pass, and the features are cut once by the gaps of the whole run: as many passes as the
    logarithm of the insertions of a chromosome, and no order of time within them."""
    ev = ranges(events.select(*keys, "seq", F.col("position").cast("bigint").alias("position"), F.col("length").cast("bigint").alias("length"), "name"), [*keys, "seq"])
    ev = written(number_ranges(ev, keys, "row").drop("_part", "_row").filter("length > 0"))
    none = F.array().cast("array<struct<seq:bigint,by:string>>")
    segments = ev.select(*keys, "row", F.col("row").alias("node"), F.col("name").alias("by"), F.col("position").alias("start"), (F.col("position") + F.col("length")).alias("end"), none.alias("tags"))
    segments = written(segments)
    most, into = segments.agg(F.max("node")).first()[0] or 0, []
    while most > 0:
        pair = [*keys, "_pair"]
        both = segments.withColumn("_pair", F.floor(F.col("node") / 2).cast("bigint"))
        right = both.filter("node % 2 = 1")
        left, hits = _cut(both.filter("node % 2 = 0"), _gaps(right, pair), pair)
        into.append(written(hits.select(*keys, F.col("row").alias("host"), "seq")))
        segments = written(left.unionByName(right).withColumn("node", F.col("_pair")).drop("_pair"))
        most //= 2
    f = features.select(*keys, F.col("line_no").alias("row"), F.col("name").alias("by"), "start", "end", none.alias("tags"))
    cut, hits = _cut(f, _gaps(segments, keys), keys)
    names = ev.select(*keys, F.col("row").alias("host"), F.col("name").alias("_host"))
    hosts = hits.select(*keys, F.col("row").alias("host"), "seq").join(f.select(*keys, F.col("row").alias("host"), F.col("by").alias("_host")), [*keys, "host"]).select(*keys, "seq", F.lit(1).alias("_kind"), "host", "_host")
    for table in into:
        hosts = hosts.unionByName(table.join(names, [*keys, "host"]).select(*keys, "seq", F.lit(0).alias("_kind"), "host", "_host"))
    mark = lambda c, text, field: F.array_join(F.transform(c, lambda x: F.concat(F.lit(text), x[field])), "")
    hosts = hosts.groupBy(*keys, F.col("seq").alias("row")).agg(F.sort_array(F.collect_set(F.struct("_kind", "host", "_host"))).alias("_in"))
    new = segments.join(hosts, [*keys, "row"], "left").join(ev.select(*keys, "row", F.col("seq").alias("_seq")), [*keys, "row"])
    new = new.select(*keys, F.lit(None).cast("bigint").alias("line_no"), F.col("_seq").alias("seq"), F.concat("by", F.coalesce(mark("_in", ";NESTED_IN:", "_host"), F.lit("")), mark("tags", ";CUT_BY:", "by")).alias("name"), "start", "end")
    old = cut.select(*keys, F.col("row").alias("line_no"), F.lit(None).cast("bigint").alias("seq"), F.concat("by", mark("tags", ";CUT_BY:", "by")).alias("name"), "start", "end")
    return old.unionByName(new)

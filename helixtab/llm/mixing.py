"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a target in words: its share of all words by weight, at most `max_epochs` times its own size, the excess
reshared by weight. A target is met by complete epochs of the source first; the rest is a weighted sample without
replacement: documents in ascending order of the exponential key -ln(u) / quality, u drawn from a hash of seed and id, up
to the remaining budget.

The order within a source is never one task's work: keys fall in `buckets` fixed ranges, the words of each (source, range)
are summed with partial aggregation, and only the documents of the one range in which a source's budget ends are ordered
row by row, in EDGE_PARTS parts whose sums are accumulated.

Nulls: a null text has size 0, a null source is a source of its own and comes last. A null id has the key of the empty
string. Documents of size 0 take nothing. Repeated rows are documents of their own, told apart in no way: equal (key, id, size) rows are
taken together or in any order with the same result in total. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import with_prefix
from .common import WORD, Scratch

MAX_EPOCHS = 3
WEIGHTS = (5.0, 2.0, 1.0)
SEED = "mix-1"
BUCKETS = 4096
#: Parts of the one range in which a source's budget ends.
EDGE_PARTS = 256
#: Parts that each source's rows are dealt in when they meet its target.
SALTS = 128
#: Signs that prose has few of; their density lowers the quality weight.
SIGNS = "!#$%&*|@{}<>=~^_+/0123456789"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def quality_of(text: Column) -> Column:
    """1 for plain prose, falling with the density of signs and digits, 0.05 at least."""
    n = F.length(text)
    return F.coalesce(F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(4.0) * (n - F.length(F.translate(text, SIGNS, ""))) / F.when(n > 0, n)), F.lit(0.05))


def uniform(key: Column, seed: str = SEED) -> Column:
    """In (0, 1), from 52 bits of a hash of seed and key."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> with weight and target. The level at which capped sources stop is found in closed form: sources in
    ascending order of cap / weight are capped as long as the level left for the others exceeds their own.
    One row a source, so its windows are over a table of sources and not of documents."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.array(*map(F.lit, map(float, weights)))
    s = sources.withColumn("weight", F.element_at(pick, (F.row_number().over(by_name) - 1) % len(weights) + 1)).withColumn("cap", F.col("source_size") * float(max_epochs))
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    s = s.withColumn("open", F.col("level") * F.col("weight") < F.col("cap"))
    level = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(everything)["level"]
    return s.withColumn("target", F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap")))).select("source", "source_size", "weight", "target")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: str = SEED, buckets: int = BUCKETS) -> DataFrame:
    """docs(doc_id, source, size, quality) -> doc_id, source, size, source_size, target, epochs, taken."""
    keyed = docs.select("doc_id", "source", F.coalesce("size", F.lit(0)).cast("bigint").alias("size"), (-F.log(uniform(F.col("doc_id"), seed)) / F.greatest(F.coalesce("quality", F.lit(0.05)), F.lit(1e-6))).alias("key"))
    # 1 - exp(-key) spreads keys of weight 1 evenly and lower weights towards 1; finer ranges near 1 follow from the second term.
    spread = F.greatest(F.lit(0), F.least(F.lit(buckets - 1), F.floor((F.lit(1.0) - F.exp(-F.col("key") / 8.0)) * buckets))).cast("int")
    # a short row a document; three branches read it, and none the texts again
    keyed = Scratch(docs.sparkSession).write(keyed.withColumn("bucket", F.when(F.col("key") > 0, spread).otherwise(0)), "keyed")
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    goal = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint"))
    goal = goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = sums.withColumn("words_before", F.coalesce(F.sum("words").over(before), F.lit(0))).join(goal.withColumnRenamed("source", "g"), F.col("source").eqNullSafe(F.col("g"))).drop("g")
    ends = ends.select("source", "bucket", "words", "words_before", "source_size", "target", "epochs", "rest")
    cut = ends.filter((F.col("words_before") < F.col("rest")) & (F.col("words_before") + F.col("words") >= F.col("rest")))
    cut = cut.groupBy("source").agg(F.min("bucket").alias("cut"), F.min_by("words_before", "bucket").alias("words_before")).withColumnRenamed("source", "c")
    plan = goal.join(cut, F.col("source").eqNullSafe(F.col("c")), "left").select(F.col("source").alias("p"), "source_size", "target", "epochs", "rest", "cut", "words_before")
    plan = plan.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    rows = keyed.join(plan, F.col("source").eqNullSafe(F.col("p")) & (F.col("salt") == F.col("part"))).drop("p", "salt", "part")
    edge = rows.filter(F.col("bucket") == F.col("cut"))
    # the range in which the budget ends is cut again, so that no task orders more than a part of it
    part = F.floor((F.lit(1.0) - F.exp(-F.col("key") / 8.0)) * (buckets * EDGE_PARTS)).cast("bigint")
    edge = with_prefix(edge, ["source"], [part], ["key", "doc_id", "size"], F.col("size"), "_sum").withColumn("at", F.col("words_before") + F.coalesce("_sum", F.lit(0))).drop("_sum")
    clear = rows.filter(F.col("cut").isNull() | (F.col("bucket") != F.col("cut"))).withColumn("at", F.when(F.col("bucket") < F.coalesce(F.col("cut"), F.when(F.col("rest") > 0, F.lit(buckets)).otherwise(F.lit(-1))), F.lit(-1.0)))
    extra = F.when(F.col("at") < 0, 1).when(F.col("at") + F.col("size") / 2.0 <= F.col("rest"), 1).otherwise(0)
    both = clear.select("*").unionByName(edge.withColumn("at", F.col("at").cast("double")))
    return both.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") + F.coalesce(extra, F.lit(0))).alias("epochs"), ((F.col("epochs") + F.coalesce(extra, F.lit(0))) * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, **kwargs) -> DataFrame:
    """docs(doc_id, text, source) with the size and the quality weight taken from the whole text."""
    return mix(docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"), quality_of(F.col("text")).alias("quality")), **kwargs)


ORACLE = f"""
with recursive d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
    coalesce(greatest(0.05::double, 1.0::double - 4.0::double * (length(text) - length(regexp_replace(text, '[!#$%&*|@{{}}<>=~^_+/0-9]', '', 'g')))::double / nullif(length(text), 0)::double), 0.05::double) as q,
    ((('0x' || substr(md5('{SEED}:' || coalesce(cast(doc_id as varchar), '')), 1, 13))::bigint)::double + 0.5) / {float(1 << 52)!r}::double as u
  from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as k from d group by source),
w as (select *, case (k - 1) % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end::double as weight, 3.0::double * source_size as cap from s),
f as (
  select 0 as i, 0.0::double as level, null::bigint[] as capped
  union all
  select i + 1, (select (sum(source_size) - coalesce(sum(cap) filter (where list_contains(coalesce(f.capped, []), k)), 0)) / nullif(sum(weight) filter (where not list_contains(coalesce(f.capped, []), k)), 0) from w),
    (select list(k) from w where list_contains(coalesce(f.capped, []), k) or weight * (select (sum(source_size) - coalesce(sum(cap) filter (where list_contains(coalesce(f.capped, []), k)), 0)) / nullif(sum(weight) filter (where not list_contains(coalesce(f.capped, []), k)), 0) from w) >= cap)
  from f where i < 40),
t as (select source, source_size, case when list_contains(coalesce((select capped from f where i = 40), []), k) then cap else weight * (select level from f where i = 40) end as target from w),
e as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from t),
o as (select d.doc_id, d.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size as rest,
    coalesce(sum(d.size) over (partition by d.source order by -ln(d.u) / greatest(d.q, 1e-6::double), d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0) as pos
  from d join e on d.source is not distinct from e.source)
select doc_id, size, source_size, target, ((epochs + case when pos + size / 2.0::double <= rest then 1 else 0 end) * size)::bigint as taken from o
"""

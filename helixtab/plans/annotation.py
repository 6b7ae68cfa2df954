"""Queries of the annotation operators over the views, each with its SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import aggregates as A
from ..operators import classify as C
from ..operators import density, intervals, liftover, overlap, sampling

from .fixtures import features, nested, oracle, view

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Length of each chromosome of the feature views.
CHROM_LENGTH = 1_010_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = oracle(sql)
        return f

    return add


BASE_CATEGORY = """case when fid like 'gene%' then case when has_attr then 'Fragmented gene' else 'Intact gene' end
  when contains(fid, '_SOLO') then 'SoloLTR' when contains(fid, '_FRAG') then 'Fragmented TE'
  when has_attr and contains(split_part(name, ';', 2), 'CUT_BY') then 'Fragmented TE' else 'Intact TE' end"""
PARTS = "select *, split_part(name, ';', 1) as fid, contains(name, ';') as has_attr from features"


def classified(strict: bool = False) -> str:
    """CTEs up to `c` (with category) and `k` (after demotion)."""
    return f"""with p as ({PARTS}), c as (select *, {BASE_CATEGORY} as category from p),
hit as (select distinct a.sample_id, a.line_no from c a join c b on a.sample_id = b.sample_id and a.tsd = b.tsd and a.strand = b.strand and abs(a.line_no - b.line_no) between 1 and 100
  where a.category = 'Intact TE' {"" if strict else "and a.has_attr"} and not b.fid like 'gene%' and (starts_with(a.name, b.name) or starts_with(b.name, a.name))),
k as (select c.* replace (case when hit.line_no is not null then 'Fragmented TE' else category end as category), hit.line_no is not null as demoted from c left join hit using (sample_id, line_no))
"""


TE = "split_part(fid, '#', 2) as rest"
FAMILY = "split_part(split_part(split_part(fid, '#', 2), '/', 2), '~', 1)"
CLASS = "split_part(split_part(fid, '#', 2), '/', 1)"


@query(classified() + """select sample_id, count(*) filter (category = 'Intact gene') as intact_gene, count(*) filter (category = 'Fragmented gene') as fragmented_gene,
  count(*) filter (category = 'Intact TE') as intact_te, count(*) filter (category = 'SoloLTR') as solo_ltr, count(*) filter (category = 'Fragmented TE') as fragmented_te from k group by sample_id""")
def category_counts(spark: SparkSession, d: str) -> DataFrame:
    out = A.category_counts(C.classify(features(spark, d)))
    return out.withColumnsRenamed({"Intact gene": "intact_gene", "Fragmented gene": "fragmented_gene", "Intact TE": "intact_te", "SoloLTR": "solo_ltr", "Fragmented TE": "fragmented_te"})


@query(classified() + f"select sample_id, {CLASS} as class, {FAMILY} as superfamily, count(*) as n from k where category = 'Intact TE' group by all")
def superfamily_counts_intact(spark, d):
    return A.superfamily_counts(C.classify(features(spark, d)), "Intact TE")


@query(classified() + f"select sample_id, {CLASS} as class, {FAMILY} as superfamily, count(*) as n from k where category = 'Fragmented TE' group by all")
def superfamily_counts_frag(spark, d):
    return A.superfamily_counts(C.classify(features(spark, d)), "Fragmented TE")


@query(classified(True) + "select sample_id, count(*) as intact, count(*) filter (contains(name, ';')) as with_attributes from k where category = 'Intact TE' group by sample_id")
def intact_strict(spark, d):
    return C.classify(features(spark, d), frag_first=True, require_attr=False).filter("category = 'Intact TE'").groupBy("sample_id").agg(F.count("*").alias("intact"), F.count_if(F.size("attrs") > 0).alias("with_attributes"))


INTACT_ATTR = f"""with p as ({PARTS}), o as (select *, not (contains(lower(fid), 'gene') or contains(fid, '_FRAG') or contains(fid, '_SOLO')) and not (has_attr and contains(split_part(name, ';', 2), 'CUT_BY')) as ok from p),
hit as (select distinct a.sample_id, a.line_no from o a join o b on a.sample_id = b.sample_id and a.tsd = b.tsd and a.strand = b.strand and abs(a.line_no - b.line_no) between 1 and 100
  where a.ok and a.has_attr and b.has_attr and (starts_with(a.name || ';', b.name || ';') or starts_with(b.name || ';', a.name || ';'))),
i as (select o.*, ok and hit.line_no is null as intact from o left join hit using (sample_id, line_no))
"""


@query(INTACT_ATTR + "select sample_id, count(*) filter (intact) as intact, count(*) as rows from i group by sample_id")
def intact_attr_prefix(spark, d):
    return C.intact_by_attr_prefix(features(spark, d)).groupBy("sample_id").agg(F.count_if("intact").alias("intact"), F.count("*").alias("rows"))


@query(INTACT_ATTR + f", y as (select sample_id, {CLASS} as class, {FAMILY} as superfamily, count(*) as n from i where intact group by all), z as (select * from y) select *, round(n / sum(n) over (partition by sample_id), 9) as share from z")
def intact_distribution(spark, d):
    return C.intact_distribution(features(spark, d)).withColumn("share", F.round("share", 9))


def unnumbered(spark, d) -> DataFrame:
    return view(spark, d, "raw_features").withColumn("sample_id", F.concat(F.lit("gen"), F.col("generation").cast("string")))


def lengths(spark, d) -> DataFrame:
    """(sample_id, genome_length): five chromosomes a generation."""
    return unnumbered(spark, d).groupBy("sample_id").agg((F.count_distinct("chrom") * CHROM_LENGTH).alias("genome_length"))


def chrom_lengths(spark, d) -> DataFrame:
    return unnumbered(spark, d).select("sample_id", "chrom").distinct().withColumn("length", F.lit(CHROM_LENGTH).cast("bigint"))


@query(f"""with p as ({PARTS}), c as (select *, {BASE_CATEGORY} as category, end_pos - start_pos as n from p)
select sample_id, sum(n) filter (category = 'Intact TE')::bigint as intact_te_bp, sum(n) filter (category = 'SoloLTR')::bigint as solo_bp,
 round(sum(n) / (count(distinct chrom) * {CHROM_LENGTH}) * 100, 6) as combined, round(greatest(0, 100 - sum(n) / (count(distinct chrom) * {CHROM_LENGTH}) * 100), 6) as rest from c group by sample_id""")
def feature_fraction(spark, d):
    out = A.feature_fraction(features(spark, d), lengths(spark, d))
    return out.select("sample_id", F.col("Intact TE").alias("intact_te_bp"), F.col("SoloLTR").alias("solo_bp"), F.round("combined %", 6).alias("combined"), F.round("rest %", 6).alias("rest"))


@query(f"""with p as ({PARTS}), s as (select generation, count(*) filter (contains(fid, '_SOLO')) as solo, count(*) filter (not contains(fid, '_SOLO') and {CLASS} = 'LTR') as intact from p where not contains(fid, '_FRAG') group by generation)
select *, round(case when intact > 0 then solo / intact else 0 end, 9) as ratio from s""")
def solo_intact_ratio(spark, d):
    return A.solo_intact_ratio(features(spark, d)).withColumn("ratio", F.round("ratio", 9))


@query(f"""with p as ({PARTS}), g as (select sample_id, fid like 'gene%' as gene, contains(fid, '_FRAG') as frag, end_pos - start_pos as n, chrom from p)
select sample_id, count(*) filter (gene) as gene_count, count(*) filter (not gene) as te_count, count(*) filter (not gene and not frag) as intact_count, count(*) filter (not gene and frag) as frag_count,
  (sum(n) filter (gene))::bigint as gene_bp, (sum(n) filter (not gene))::bigint as te_bp, round(sum(n) filter (not gene) / (count(distinct chrom) * {CHROM_LENGTH}) * 100, 6) as te_percent from g group by sample_id""")
def composition(spark, d):
    return A.composition(features(spark, d), lengths(spark, d)).select("sample_id", "gene_count", "te_count", "intact_count", "frag_count", "gene_bp", "te_bp", F.round("te_percent", 6).alias("te_percent"))


@query(f"""with p as ({PARTS}), k as (select sample_id, end_pos - start_pos as n, contains(fid, '_FRAG') as frag, case when fid like 'gene%' then 'gene' else {CLASS} end as class, case when fid like 'gene%' then 'gene' else {FAMILY} end as superfamily from p)
select sample_id, class, superfamily, grouping_id(sample_id, class, superfamily)::bigint as level, count(*) as features, sum(n)::bigint as bases, count(*) filter (frag) as fragments from k
group by grouping sets ((sample_id, class, superfamily), (sample_id, class), (sample_id), ())""")
def composition_rollup(spark, d):
    return A.composition_rollup(features(spark, d))


@query("""with g as (select distinct event_id // 37 as generation from raw_features), n as (select generation, row_number() over (order by generation) - 1 as pos, count(*) over () as n from g)
select generation from n where pos in (select round_even(i * ((n - 1) / (least(9, n) - 1)), 0)::bigint from (select max(n) as n from n), range(0, 9) t(i) where i < least(9, n))""")
def select_generations(spark, d):
    return A.select_generations(view(spark, d, "raw_features").select((F.expr("event_id div 37")).alias("generation")), 9)


@query("""with s as (select doc_id % 50 as generation, length(seq) as n from seqs) select generation, sum(n)::bigint as genome_length from s group by generation""")
def genome_trajectory(spark, d):
    return A.genome_trajectory(view(spark, d, "seqs").withColumn("generation", F.col("doc_id") % 50))


# intervals

MERGED = """with r as (select *, max(end_pos) over (partition by sample_id, chrom order by start_pos, end_pos, event_id rows between unbounded preceding and 1 preceding) as reach from {src}),
i as (select *, sum(case when start_pos <= reach then 0 else 1 end) over (partition by sample_id, chrom order by start_pos, end_pos, event_id) as island from r),
m as (select sample_id, chrom, min(start_pos) as s, max(end_pos) as e from i group by sample_id, chrom, island)
"""


@query(MERGED.format(src="features") + "select sample_id, chrom, s as start_pos, e as end_pos from m")
def merge_intervals(spark, d):
    return intervals.merge_intervals(features(spark, d)).withColumnsRenamed({"start": "start_pos", "end": "end_pos"})


COMPLEMENT = f"""g as (select sample_id, chrom, least(coalesce(lag(e) over (partition by sample_id, chrom order by s), 0), {CHROM_LENGTH}) as a, least(s, {CHROM_LENGTH}) as b from m
  union all select sample_id, chrom, max(e), {CHROM_LENGTH} from m group by sample_id, chrom)
"""


@query(MERGED.format(src="features") + ", " + COMPLEMENT + "select sample_id, chrom, a as start_pos, b as end_pos from g where a < b")
def complement_intervals(spark, d):
    return intervals.complement_intervals(features(spark, d), chrom_lengths(spark, d)).withColumnsRenamed({"start": "start_pos", "end": "end_pos"})


GENES = f"(select sample_id, chrom, event_id, greatest(0, start_pos - 500) as start_pos, least(end_pos + 500, {CHROM_LENGTH}) as end_pos from features where name like 'gene%')"


@query(MERGED.format(src=GENES) + "select sample_id, chrom, s as start_pos, e as end_pos from m")
def gene_neighbourhoods(spark, d):
    return intervals.gene_neighbourhoods(features(spark, d), 500, chrom_lengths(spark, d)).withColumnsRenamed({"start": "start_pos", "end": "end_pos"})


@query(MERGED.format(src=GENES) + ", " + COMPLEMENT + "select sample_id, chrom, a as start_pos, b as end_pos, 'closed' as kind, (b - a)::double as weight from g where a < b union all select sample_id, chrom, s, e, 'open', (e - s) * 1.5::double from m")
def weighted_intervals(spark, d):
    return intervals.weighted_intervals(features(spark, d), chrom_lengths(spark, d), 500, 1.5).withColumnsRenamed({"start": "start_pos", "end": "end_pos"})


@query(MERGED.format(src=GENES) + "select f.sample_id, f.line_no, (f.start_pos + f.end_pos) // 2 as position, exists (select 1 from m where m.sample_id = f.sample_id and m.chrom = f.chrom and (f.start_pos + f.end_pos) // 2 between m.s and m.e) as inside from features f")
def points_in_intervals(spark, d):
    f = features(spark, d)
    p = f.select("sample_id", "chrom", "line_no", F.expr("(start + end) div 2").alias("position"))
    return intervals.points_in_intervals(p, intervals.gene_neighbourhoods(f, 500, chrom_lengths(spark, d))).select("sample_id", "line_no", "position", "inside")


UNIFORM = lambda c, seed: f"(((((({c} * 48271 + {seed * 69621 + 12345}) % 2147483647) * 16807 + 7) % 2147483647) * 48271 + 11) % 2147483647 + 0.5::double) / 2147483647.0::double"


@query(MERGED.format(src=GENES) + ", " + COMPLEMENT + f""", w as (select sample_id, chrom, a, b, (b - a)::double as weight from g where a < b union all select sample_id, chrom, s, e, (e - s) * 1.5::double from m),
c as (select *, coalesce(sum(weight) over (partition by sample_id order by chrom, a rows between unbounded preceding and 1 preceding), 0) as f, sum(weight) over (partition by sample_id) as t from w),
x as (select range as draw, {UNIFORM("range", 7)} as u, {UNIFORM("range", 8)} as v from range(500))
select sample_id, chrom, draw, (a + floor(v * (b - a)))::bigint as position from x join c on u >= f / t and u < (f + weight) / t""")
def sample_positions(spark, d):
    w = intervals.weighted_intervals(features(spark, d), chrom_lengths(spark, d), 500, 1.5)
    return intervals.sample_positions(w, 500, 7)


GREEDY = """with recursive p as (select *, split_part(name, ';', 1) as fid from nested),
w as (select *, lag(fid) over x as pf, lead(fid) over x as nf, lag(strand) over x as ps, lead(strand) over x as ns, lag(tsd) over x as pt, lead(tsd) over x as nt from p window x as (partition by sample_id order by line_no)),
cand as (select sample_id, line_no, pf like 'gene%' as gene from w where split_part(name, ';', 2) like 'NESTED!_IN:%' escape '!' and pf = nf and ps = ns and pt = nt),
o as (select *, row_number() over (partition by sample_id order by line_no) as k from cand),
g as (select sample_id, k, line_no as last, true as taken, gene from o where k = 1
  union all select o.sample_id, o.k, case when o.line_no - g.last >= 3 then o.line_no else g.last end, o.line_no - g.last >= 3, o.gene from g join o on o.sample_id = g.sample_id and o.k = g.k + 1),
t as (select sample_id, last as mid, gene from g where taken),
s as (select t.sample_id, mid + x as line_no, mid, case when gene then case x when -1 then 'CUT_PAIR_GENE_1' when 0 then 'NEST_TE_IN_GENE' else 'CUT_PAIR_GENE_2' end else case x when -1 then 'CUT_PAIR_TE_1' when 0 then 'NEST_TE_IN_TE' else 'CUT_PAIR_TE_2' end end as sub from t, (values (-1), (0), (1)) v(x)),
n as (select p.*, s.mid as nest_group, coalesce(s.sub, case when fid like 'gene%' then 'NON_NEST_GROUP_GENES' else 'NON_NEST_GROUP_TE' end) as subtype from p left join s using (sample_id, line_no))
"""


@query(GREEDY + "select sample_id, line_no, coalesce(nest_group, -1) as nest_group, subtype from n")
def nest_groups(spark, d):
    return C.nest_groups(nested(spark, d)).select("sample_id", "line_no", F.coalesce("nest_group", F.lit(-1)).alias("nest_group"), "subtype")


@query("""with g as (select distinct sample_id, split_part(name, ';', 1) as gene from nested where name like 'gene%;%'), w as (select *, case when try_cast(substr(gene, 5) as bigint) % 3 = 0 then 2.5::double else 1.0::double end as w from g)
select sample_id, count(*) as genes, sum(w) as weight from w group by sample_id""")
def disrupted_genes(spark, d):
    f = nested(spark, d)
    genes = f.filter(F.startswith("name", F.lit("gene"))).select(N.feature_id(F.col("name")).alias("gene")).distinct().filter(F.substr("gene", F.lit(5)).cast("bigint") % 3 == 0).withColumn("weight", F.lit(2.5))
    return C.disrupted_gene_weight(f, genes)


@query("""with p as (select *, split_part(name, ';', 1) as fid from nested),
w as (select *, coalesce(fid like 'gene%' and fid = lag(fid) over x and strand = lag(strand) over x and tsd = lag(tsd) over x, false) as same from p window x as (partition by sample_id, chrom order by start_pos, line_no)),
i as (select *, sum(case when same then 0 else 1 end) over (partition by sample_id, chrom order by start_pos, line_no) as run from w)
select sample_id, chrom, min(start_pos) as start_pos, arg_max(end_pos, start_pos) as end_pos, case when count(*) > 1 then any_value(fid) else any_value(name) end as name, count(*) as rows from i group by sample_id, chrom, run""")
def consolidate_adjacent(spark, d):
    return C.consolidate_adjacent(nested(spark, d)).select("sample_id", "chrom", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "name", "rows")


@query(GREEDY + """, e as (select *, contains(name, ';') as has_attr from n where subtype in ('NON_NEST_GROUP_TE', 'CUT_PAIR_TE_1', 'CUT_PAIR_TE_2', 'NEST_TE_IN_TE', 'NEST_TE_IN_GENE')),
m as (select *, subtype in ('NEST_TE_IN_TE', 'NON_NEST_GROUP_TE') and contains(fid, 'LTRlen') and not contains(fid, '_SOLO') and not contains(fid, '_FRAG') and not (has_attr and contains(split_part(name, ';', 2), 'CUT_BY')) as may from e),
h as (select distinct a.sample_id, a.line_no from m a join n b on a.sample_id = b.sample_id and a.tsd = b.tsd and a.strand = b.strand and abs(a.line_no - b.line_no) between 1 and 100 where a.may and a.has_attr and (starts_with(a.name, b.name) or starts_with(b.name, a.name)))
select m.sample_id, m.line_no, m.subtype, may and h.line_no is null as partial_ok from m left join h using (sample_id, line_no)""")
def excision_candidates(spark, d):
    return C.excision_candidates(C.nest_groups(nested(spark, d))).select("sample_id", "line_no", "subtype", "partial_ok")


def _weighted(spark, d):
    c = C.excision_candidates(C.nest_groups(nested(spark, d)))
    return A.candidate_weights(c.withColumns({"inside": F.col("line_no") % 2 == 0, "gene_weight": F.when(F.col("line_no") % 5 == 0, 2.0)}), 3.0, ["sample_id"], 1.7, 0.01, 10.0)


WEIGHTED = GREEDY + """, e as (select *, (end_pos - start_pos) as n0 from n where subtype in ('NON_NEST_GROUP_TE', 'CUT_PAIR_TE_1', 'CUT_PAIR_TE_2', 'NEST_TE_IN_TE', 'NEST_TE_IN_GENE')),
l as (select sample_id, quantile_cont(n0, 0.95) as l95 from e group by sample_id),
y as (select e.*, l95, exp(-3.0::double * (1 - least(n0, l95) / l95)) * case when line_no % 2 = 0 then 1.7::double else 1 end * case when subtype = 'NEST_TE_IN_GENE' then 1 + 0.01::double * case when line_no % 5 = 0 then 2.0::double else 1.0::double end * 10 else 1 end as weight from e join l using (sample_id))
"""


@query(WEIGHTED + "select sample_id, line_no, round(weight, 9) as weight from y")
def candidate_weights(spark, d):
    return _weighted(spark, d).select("sample_id", "line_no", F.round("weight", 9).alias("weight"))


@query("select sample_id, round(quantile_cont((end_pos - start_pos)::double, 0.95), 6) as l95 from features group by sample_id")
def length_p95(spark, d):
    return A.length_p95(features(spark, d), ["sample_id"]).withColumn("l95", F.round("l95", 6))


@query(WEIGHTED + f""", k as (select *, -ln({UNIFORM("event_id", 11)}) / weight as key from y), f as (select *, row_number() over (partition by coalesce(subtype || cast(event_id // 5 as varchar), '') order by key, event_id) as place from k)
select event_id from f where subtype not like 'CUT%' or place = 1 order by key, event_id limit 200""")
def weighted_sample(spark, d):
    w = _weighted(spark, d).withColumn("pair", F.when(F.startswith("subtype", F.lit("CUT")), F.concat("subtype", F.expr("event_id div 5").cast("string"))))
    return sampling.weighted_sample(w, 200, "weight", 11, "event_id", "pair").select("event_id")


@query("""select f.sample_id, f.event_id, f.start_pos - coalesce(sum(e.end_pos - e.start_pos), 0)::bigint as start_pos, f.end_pos - coalesce(sum(e.end_pos - e.start_pos), 0)::bigint as end_pos
from features f left join features e on e.sample_id = f.sample_id and e.chrom = f.chrom and e.event_id % 10 = 3 and e.start_pos < f.start_pos group by f.sample_id, f.event_id, f.start_pos, f.end_pos""")
def lift_over(spark, d):
    f = features(spark, d)
    events = f.filter("event_id % 10 = 3").select("sample_id", "chrom", F.col("start").alias("position"), (F.col("end") - F.col("start")).alias("length"))
    return liftover.lift_over(f.select("sample_id", "chrom", "event_id", "start", "end"), events).select("sample_id", "event_id", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"))


INSERTED = """with ev as (select sample_id, chrom, start_pos + 50 as position, min(100 + event_id % 400) as len, min('NEW' || cast(event_id % 23 as varchar)) as nm from features where event_id % 40 = 3 group by sample_id, chrom, start_pos),
sp as (select f.sample_id, f.line_no, list(ev.position order by ev.position) as ps, string_agg(';CUT_BY:' || ev.nm, '' order by ev.position) as tag from features f join ev on ev.sample_id = f.sample_id and ev.chrom = f.chrom and ev.position > f.start_pos and ev.position < f.end_pos group by all),
pc as (select f.sample_id, f.chrom, f.line_no, f.name || coalesce(tag, '') as name, unnest(range(0, len(coalesce(ps, [])) + 1)) as piece, list_concat(list_concat([f.start_pos], coalesce(ps, [])), [f.end_pos]) as pts from features f left join sp using (sample_id, line_no)),
q as (select *, pts[piece + 1] as s, pts[piece + 2] as e from pc)
"""


def _insertions(spark, d):
    f = features(spark, d)
    ev = f.filter("event_id % 40 = 3").groupBy("sample_id", "chrom", (F.col("start") + 50).alias("position")).agg(F.min(100 + F.col("event_id") % 400).alias("length"), F.min(F.concat(F.lit("NEW"), (F.col("event_id") % 23).cast("string"))).alias("name"))
    return f, ev


@query(INSERTED + "select q.sample_id, q.line_no, q.piece::bigint as piece, q.name, s + coalesce(sum(ev.len), 0)::bigint as start_pos, e + coalesce(sum(ev.len), 0)::bigint as end_pos from q left join ev on ev.sample_id = q.sample_id and ev.chrom = q.chrom and ev.position <= q.s group by q.sample_id, q.line_no, q.piece, q.name, s, e")
def apply_insertions(spark, d):
    f, ev = _insertions(spark, d)
    out = liftover.apply_insertions(f.select("sample_id", "chrom", "line_no", "name", "start", "end"), ev)
    return out.select("sample_id", "line_no", F.col("piece").cast("bigint").alias("piece"), "name", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"))


@query(INSERTED + """, h as (select ev.sample_id, ev.chrom, ev.position, string_agg(';NESTED_IN:' || f.name, '' order by f.line_no) as tag from ev join features f on ev.sample_id = f.sample_id and ev.chrom = f.chrom and ev.position > f.start_pos and ev.position < f.end_pos group by all)
select ev.sample_id, ev.chrom, ev.position + coalesce(sum(b.len), 0)::bigint as start_pos, ev.nm || coalesce(h.tag, '') as name from ev left join h using (sample_id, chrom, position) left join ev b on b.sample_id = ev.sample_id and b.chrom = ev.chrom and b.position < ev.position group by ev.sample_id, ev.chrom, ev.position, ev.nm, h.tag""")
def inserted_features(spark, d):
    f, ev = _insertions(spark, d)
    return liftover.inserted_features(f.select("sample_id", "chrom", "line_no", "name", "start", "end"), ev).select("sample_id", "chrom", F.col("start").alias("start_pos"), "name")


#: Insertions on moving coordinates, one step of the recursion each: rows are features and insertions, which wait until their turn.
IN_ORDER = """with recursive ev as (select sample_id, chrom, event_id as seq, (start_pos * 7) % 1500000 as position, 100 + event_id % 400 as len, 'NEW' || (event_id % 23) as nm,
  row_number() over (partition by sample_id, chrom order by event_id) as k, count(*) over (partition by sample_id, chrom) as m from features where event_id % 40 = 3),
st as (select f.sample_id, f.chrom, 0::bigint as k, line_no, null::bigint as seq, 0::bigint as born, name as given, '' as tags, start_pos as s, end_pos as e from features f
    union all select sample_id, chrom, 0, null, seq, k, nm, '', 0, 0 from ev
  union all select st.sample_id, st.chrom, st.k + 1, line_no, st.seq, born, given, case when born < st.k + 1 and s < position and e > position then tags || ';CUT_BY:' || nm else tags end,
    case when born > st.k + 1 then 0 when born = st.k + 1 then position when e <= position then s when s >= position then s + len when side = 0 then s else position + len end,
    case when born > st.k + 1 then 0 when born = st.k + 1 then position + len when e <= position then e when s >= position then e + len when side = 0 then position else e + len end
    from st join ev on ev.sample_id = st.sample_id and ev.chrom = st.chrom and ev.k = st.k + 1, (values (0), (1)) v(side) where side = 0 or (born < st.k + 1 and s < position and e > position)),
h as (select ev.sample_id, ev.chrom, ev.seq, string_agg(';NESTED_IN:' || given, '' order by case when st.seq is null then 1 else 0 end, st.line_no, st.seq) as host
  from ev join st on st.sample_id = ev.sample_id and st.chrom = ev.chrom and st.k = ev.k - 1 and st.born < ev.k and s < position and e > position group by all),
z as (select sample_id, chrom, max(k) as m from ev group by all)
select st.sample_id, st.chrom, line_no, st.seq, given || coalesce(host, '') || tags as name, s as start_pos, e as end_pos from st left join z using (sample_id, chrom) left join h on h.sample_id = st.sample_id and h.chrom = st.chrom and h.seq = st.seq
where st.k = coalesce(m, 0)"""


@query(IN_ORDER)
def insert_in_order(spark, d):
    f = features(spark, d)
    ev = f.filter("event_id % 40 = 3").select("sample_id", "chrom", F.col("event_id").alias("seq"), (F.col("start") * 7 % 1_500_000).alias("position"), (100 + F.col("event_id") % 400).alias("length"), F.concat(F.lit("NEW"), (F.col("event_id") % 23).cast("string")).alias("name"))
    out = liftover.insert_in_order(f.select("sample_id", "chrom", "line_no", "name", "start", "end"), ev)
    return out.withColumnsRenamed({"start": "start_pos", "end": "end_pos"})


# overlap

MATCH = """with o as (select c.call_id, f.line_no, f.event_id, f.start_pos as fs, least(c.end_pos, f.end_pos) - greatest(c.start_pos, f.start_pos) as sh, c.end_pos - c.start_pos as cl, f.end_pos - f.start_pos as fl
  from calls c join features f on c.generation = f.generation and c.chrom = f.chrom and c.start_pos < f.end_pos and f.start_pos < c.end_pos),
m as (select call_id, arg_min(event_id, (fs, line_no)) as feature_no from o where sh > 0 and sh / cl >= {r} and sh / fl >= {r} group by call_id)
"""


def _overlap(spark, d, r):
    f = features(spark, d).withColumn("feature_no", F.col("line_no") * 1_000_000_000 + F.col("event_id"))
    c = view(spark, d, "calls").withColumn("sample_id", F.concat(F.lit("gen"), F.col("generation").cast("string"))).withColumnsRenamed({"start_pos": "start", "end_pos": "end"})
    return c, f, overlap.reciprocal_overlap(c, f, r)


@query(MATCH.format(r="0.9::double") + "select call_id, feature_no from m")
def reciprocal_overlap(spark, d):
    return _overlap(spark, d, 0.9)[2].select("call_id", (F.col("feature_no") % 1_000_000_000).alias("feature_no"))


@query("with m as (select call_id, (select arg_min(event_id, (start_pos, line_no)) from features f where f.generation = c.generation and f.chrom = c.chrom) as feature_no from calls c) select * from m where feature_no is not null")
def reciprocal_overlap_any(spark, d):
    return _overlap(spark, d, 0.0)[2].select("call_id", (F.col("feature_no") % 1_000_000_000).alias("feature_no"))


SUMMARY = MATCH.format(r="0.5::double") + """, c as (select generation, count(m.call_id) as matched_calls, count(*) - count(m.call_id) as calls_only from calls left join m using (call_id) group by generation),
f as (select generation, count(x.feature_no) as matched_features, count(*) - count(x.feature_no) as features_only from features left join (select distinct feature_no from m) x on x.feature_no = event_id group by generation),
s as (select 'gen' || generation as sample_id, matched_calls, matched_features, calls_only, features_only from c join f using (generation))
"""


@query(SUMMARY + "select * from s")
def overlap_summary(spark, d):
    c, f, m = _overlap(spark, d, 0.5)
    return overlap.overlap_summary(c, f, m, ["sample_id"])


@query(MATCH.format(r="0.5::double") + "select feature_no, count(*) as n, min(call_id) as first_call, max(call_id) as last_call from m group by feature_no")
def overlap_detail(spark, d):
    c, f, m = _overlap(spark, d, 0.5)
    out = overlap.overlap_detail(c, f, m, "overlapping")
    return out.select((F.col("feature_no") % 1_000_000_000).alias("feature_no"), F.size("call_ids").cast("bigint").alias("n"), F.get("call_ids", F.lit(0)).alias("first_call"), F.element_at("call_ids", -1).alias("last_call"))


@query(MATCH.format(r="0.5::double") + "select 'call' as side, call_id as id from calls where call_id not in (select call_id from m) union all select 'feature', event_id from features where event_id not in (select feature_no from m)")
def overlap_unique(spark, d):
    c, f, m = _overlap(spark, d, 0.5)
    a = overlap.overlap_detail(c, f, m, "unique-input").select(F.lit("call").alias("side"), F.col("call_id").alias("id"))
    return a.unionByName(overlap.overlap_detail(c, f, m, "unique-bed").select(F.lit("feature").alias("side"), F.col("event_id").alias("id")))


@query(SUMMARY + "select sample_id, round(matched_features / (matched_features + features_only), 9) as sensitivity, round(matched_features / (matched_features + calls_only), 9) as precision, round(calls_only / (matched_features + calls_only), 9) as fdr from s")
def detection_metrics(spark, d):
    c, f, m = _overlap(spark, d, 0.5)
    out = overlap.detection_metrics(overlap.overlap_summary(c, f, m, ["sample_id"]))
    return out.select("sample_id", *(F.round(k, 9).alias(k) for k in ("sensitivity", "precision", "fdr")))


PER_CALLER = MATCH.format(r="0.9::double") + """, c as (select caller, generation, count(m.call_id) as tp0, count(*) - count(m.call_id) as fp, count(distinct m.feature_no) as tp from calls left join m using (call_id) group by all),
z as (select caller, generation, tp, fp, (select count(*) from features f where f.generation = c.generation) - tp as fn from c),
v as (select caller, tp / (tp + fn) as sensitivity, tp / (tp + fp) as precision, fp / (tp + fp) as fdr from z)
"""


@query(PER_CALLER + "select caller, metric, round(avg(value), 9) as mean, round(stddev_samp(value), 9) as std from (unpivot v on sensitivity, precision, fdr into name metric value value) group by all")
def replicate_summary(spark, d):
    c, f, m = _overlap(spark, d, 0.9)
    by = ["caller", "sample_id"]
    own = c.join(m, "call_id", "left").groupBy(*by).agg(F.count_distinct("feature_no").alias("matched_features"), F.count(F.when(F.col("feature_no").isNull(), 1)).alias("calls_only"))
    n = f.groupBy("sample_id").agg(F.count("*").alias("_n"))
    s = own.join(n, "sample_id").withColumn("features_only", F.col("_n") - F.col("matched_features"))
    return overlap.replicate_summary(overlap.detection_metrics(s)).select("caller", "metric", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


@query("""with g as (select sample_id, chrom, count(*) as w from features group by all), r as (select *, row_number() over (order by sample_id, chrom) as rank, 777 * w::double / sum(w) over () as e from g), f as (select *, floor(e)::bigint as fl from r)
select sample_id, chrom, fl + case when row_number() over (order by e - fl desc, rank) <= 777 - sum(fl) over () then 1 else 0 end as allotted from f""")
def apportion(spark, d):
    from pyspark.sql import Window

    g = features(spark, d).groupBy("sample_id", "chrom").agg(F.count("*").alias("weight")).withColumn("rank", F.row_number().over(Window.orderBy("sample_id", "chrom")))
    return overlap.apportion(g, 777).select("sample_id", "chrom", "allotted")


@query("""with recursive g as (select chrom || sample_id as c, count(*) as w from features group by all), r as (select *, row_number() over (order by c) - 1 as k, count(*) over () as n, 13 * w::double / sum(w) over () as e from g),
a as (select *, case when round_even(e, 0) = 0 then 1 else round_even(e, 0)::bigint end as q from r),
s as (select 0 as i, list(q order by k) as l, (sum(q) - 13)::bigint as drift from a
  union all select i + 1, case when drift > 0 and l[i % len(l) + 1] > 0 then list_transform(l, lambda x, j: case when j = i % len(l) + 1 then x - 1 else x end) when drift < 0 then list_transform(l, lambda x, j: case when j = i % len(l) + 1 then x + 1 else x end) else l end,
    case when drift > 0 and l[i % len(l) + 1] > 0 then drift - 1 when drift < 0 then drift + 1 else drift end from s where drift <> 0),
z as (select arg_max(l, i) as l from s)
select c, l[k + 1] as allotted from a, z""")
def apportion_min1(spark, d):
    from pyspark.sql import Window

    g = features(spark, d).groupBy(F.concat("chrom", "sample_id").alias("c")).agg(F.count("*").alias("weight")).withColumn("rank", F.row_number().over(Window.orderBy("c")))
    return overlap.apportion(g, 13, method="min1").select("c", "allotted")


# density and sampling

DENS = """with h as (select header_class as g, n::double as x, count(*) as c from (select split_part(split_part(header, '#', 2), '/', 1) as header_class, length(seq) as n from seqs) group by all),
b as (select g, sum(c) as t, sum(c * x) / sum(c) as m, min(x) as lo, max(x) as hi from h group by g),
v as (select g, sum(c * (x - m) * (x - m)) as ss from b join h using (g) group by g),
s as (select b.*, pow(t, -0.2) * sqrt(ss / (t - 1)) as bw from b join v using (g)),
p as (select g, lo - 3 * bw + range * (hi - lo + 6 * bw) / 511 as y, range as k from s, range(512))
"""


@query(DENS + "select p.g as class, p.k::int as k, round(p.y, 5) as at_len, round(sum(c * exp(-0.5 * ((p.y - x) / bw) * ((p.y - x) / bw)) / (bw * sqrt(2 * pi()))) / any_value(t), 9) as density from p join h on p.g = h.g join s on p.g = s.g group by p.g, p.k, p.y")
def kde_grid(spark, d):
    s = view(spark, d, "seqs").select(N.te_info(F.col("header"))["class"].alias("class"), F.length("seq").alias("n"))
    return density.kde(s, "n", ["class"]).select("class", "k", F.round("at", 5).alias("at_len"), F.round("density", 9).alias("density"))


IMPORTANCE = """with l as (select doc_id, length(seq)::double as x from seqs where doc_id % 2 = 0), gl as (select length(seq)::double as x from seqs where doc_id % 2 = 1),
h as (select x, count(*) as c from l group by x), gh as (select x, count(*) as c from gl group by x),
s as (select sum(c) as t, pow(sum(c), -0.2) * (select stddev_samp(x) from l) as bw from h), gs as (select sum(c) as t, pow(sum(c), -0.2) * (select stddev_samp(x) from gl) as bw from gh),
o as (select a.x, sum(h.c * exp(-0.5 * pow((a.x - h.x) / bw, 2)) / (bw * sqrt(2 * pi()))) / any_value(t) as f from h a, h, s group by a.x),
q as (select a.x, sum(g.c * exp(-0.5 * pow((a.x - g.x) / bw, 2)) / (bw * sqrt(2 * pi()))) / any_value(t) as f from h a, gh g, gs group by a.x),
w as (select doc_id, q.f / (o.f + 1e-8) as w from l join o using (x) join q using (x)), t as (select *, count(*) over () as n, sum(w) over () as sw from w)
"""


@query(IMPORTANCE + "select doc_id, greatest(1, round_even(w / (sw / n), 0))::bigint as copies from t")
def resample_duplicate(spark, d):
    s = view(spark, d, "seqs").select("doc_id", F.length("seq").alias("n"))
    return sampling.resample_to_guide(s.filter("doc_id % 2 = 0"), s.filter("doc_id % 2 = 1"), "n", 5, "doc_id", "duplicate").select("doc_id", "copies")


@query(IMPORTANCE + f""", e as (select *, w / sw * n as e, floor(w / sw * n)::bigint as base from t), k as (select *, row_number() over (order by case when e - base > 0 then -ln({UNIFORM("doc_id", 5)}) / (e - base) else 1e300 end, doc_id) as place, n - sum(base) over () as rest from e)
select doc_id, base + case when place <= rest then 1 else 0 end as copies from k""")
def resample_to_guide(spark, d):
    s = view(spark, d, "seqs").select("doc_id", F.length("seq").alias("n"))
    return sampling.resample_to_guide(s.filter("doc_id % 2 = 0"), s.filter("doc_id % 2 = 1"), "n", 5, "doc_id").select("doc_id", "copies")


@query(f"""with u as (select doc_id, length(seq) as n, {UNIFORM("doc_id", 21)} as u from seqs), b as (select *, coalesce(sum(n) over (order by u, doc_id rows between unbounded preceding and 1 preceding), 0) as before from u)
select doc_id from b where before < (select sum(n) / 3 from u)""")
def take_until_budget(spark, d):
    s = view(spark, d, "seqs").select("doc_id", F.length("seq").alias("n"))
    target = s.agg(F.sum("n")).first()[0] / 3
    return sampling.take_until_budget(s, "n", target, 21, "doc_id").select("doc_id")


@query(f"""with w as (select chrom || sample_id as category, count(*)::double as weight from features group by all), c as (select *, coalesce(sum(weight) over (order by category rows between unbounded preceding and 1 preceding), 0) as f, sum(weight) over () as t from w),
x as (select range as draw, {UNIFORM("range", 3)} as u from range(2000)) select draw, category from x join c on u >= f / t and u < (f + weight) / t""")
def draw_categories(spark, d):
    w = features(spark, d).groupBy(F.concat("chrom", "sample_id").alias("category")).agg(F.count("*").cast("double").alias("weight"))
    return sampling.draw_categories(w, 2000, 3)


@query("""with w as (select name[1:6] as category, count(*)::double as weight from features group by all), s as (select *, round_even(weight / sum(weight) over () * 1000, 0)::bigint as e, row_number() over (order by weight desc, category) as k from w)
select category, (e + case when k = 1 then greatest(0, 1000 - sum(e) over ()) else 0 end)::bigint as events from s""")
def event_counts(spark, d):
    w = features(spark, d).groupBy(F.substring("name", 1, 6).alias("category")).agg(F.count("*").cast("double").alias("weight"))
    return sampling.event_counts(w, 1000).select("category", F.col("events").cast("double").cast("bigint").alias("events"))


@query(f"""with lib as (select event_id as member, 'c' || cast(user_id % 11 as varchar) as category from events), l as (select *, row_number() over (partition by category order by member) - 1 as k, row_number() over (order by member) - 1 as g, count(*) over (partition by category) as n, count(*) over () as a from lib),
x as (select doc_id as draw, 'c' || cast(doc_id % 13 as varchar) as category, {UNIFORM("doc_id", 9)} as u from documents)
select draw, x.category, l.member from x join l on l.category = x.category and l.k = floor(u * n) union all select draw, x.category, l.member from x join l on l.g = floor(u * a) where x.category not in (select category from lib)""")
def pick_members(spark, d):
    lib = view(spark, d, "events").select(F.col("event_id").alias("member"), F.concat(F.lit("c"), (F.col("user_id") % 11).cast("string")).alias("category"))
    draws = view(spark, d, "documents").select(F.col("doc_id").alias("draw"), F.concat(F.lit("c"), (F.col("doc_id") % 13).cast("string")).alias("category"))
    return sampling.pick_members(draws, lib, 9)


@query("select sample_id, line_no, event_id from features")
def file_order(spark, d):
    return features(spark, d).select("sample_id", "line_no", "event_id")



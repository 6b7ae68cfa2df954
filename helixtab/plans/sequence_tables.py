"""Queries of sequence, alignment, log and report operators over the views, each with its SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import aggregates as A
from ..operators import alignments as L
from ..operators import reports as R
from ..operators import sequences as S
from .annotation import QUERIES, query
from .fixtures import features, view

__all__ = ["QUERIES"]


def seqs(spark, d) -> DataFrame:
    return view(spark, d, "seqs").withColumn("line_no", F.col("doc_id"))


REVCOMP = "reverse(translate({c}, 'ACGTacgt', 'TGCAtgca'))"


@query(f"select doc_id, md5({REVCOMP.format(c='seq')}) as rc from seqs")
def reverse_complement(spark, d):
    return seqs(spark, d).select("doc_id", F.md5(S.revcomp(F.col("seq"))).alias("rc"))


@query(f"""select s.doc_id, s.site_no, md5(case when s.strand = '-' then {REVCOMP.format(c="substr(q.seq, (s.start_pos + 1)::bigint, (s.end_pos - s.start_pos)::bigint)")} else substr(q.seq, (s.start_pos + 1)::bigint, (s.end_pos - s.start_pos)::bigint) end) as bases
from sites s join seqs q using (doc_id)""")
def extract_sequences(spark, d):
    """Tiles of 64 bases, so that sites cross them."""
    tiled = S.tiles(seqs(spark, d).withColumn("sample_id", F.lit("s")).withColumn("chrom", F.col("doc_id")), 64)
    sites = view(spark, d, "sites").select(F.lit("s").alias("sample_id"), F.col("doc_id").alias("chrom"), F.col("site_no").alias("line_no"), F.col("start_pos").alias("start"), F.col("end_pos").alias("end"), "strand")
    # a site that begins behind the sequence's end has no tile there: the tile table is asked for the first tile too
    out = S.extract_sequences(sites, tiled, 64)
    missing = sites.join(out.select("sample_id", "chrom", "line_no"), ["sample_id", "chrom", "line_no"], "left_anti").withColumn("seq", F.lit(""))
    both = out.select("chrom", "line_no", "seq").unionByName(missing.select("chrom", "line_no", "seq"))
    return both.select(F.col("chrom").alias("doc_id"), F.col("line_no").alias("site_no"), F.md5("seq").alias("bases"))


@query("""with t as (select *, split_part(header, '~LTRlen:', 2)::int as n from seqs where contains(header, 'LTRlen')), r as (select doc_id, case when length(seq) >= 2 * n then substr(seq, 1, length(seq) - n) || substr(seq, 1, n) else seq end as s, length(seq) >= 2 * n as repaired from t
 union all select doc_id, seq, false from seqs where not contains(header, 'LTRlen')) select doc_id, md5(s) as bases, repaired from r""")
def repair_ltr_ends(spark, d):
    return S.repair_ltr_ends(seqs(spark, d)).select("doc_id", F.md5("seq").alias("bases"), "repaired")


@query("select doc_id % 7 as part, sum(length(seq))::bigint as genome_length from seqs group by all")
def genome_length(spark, d):
    return S.genome_length(seqs(spark, d).withColumn("part", F.col("doc_id") % 7), ["part"])


@query("select split_part(split_part(header, '#', 2), '~', 1) as category, count(*) as n, sum(length(seq))::bigint as bases, max(length(seq))::int as longest from seqs group by all")
def length_by_superfamily(spark, d):
    return S.length_by_superfamily(seqs(spark, d)).groupBy("category").agg(F.count("*").alias("n"), F.sum("seq_len").alias("bases"), F.max("seq_len").alias("longest"))


@query("select doc_id, header || case when row_number() over (partition by header order by doc_id) > 1 then '_' || (row_number() over (partition by header order by doc_id) - 1) else '' end as unique_name from seqs")
def uniquify_names(spark, d):
    return S.uniquify_names(seqs(spark, d)).select("doc_id", "unique_name")


@query("select header, md5(seq) as bases, min(doc_id) as line_no from seqs group by header, seq")
def dedupe_sequences(spark, d):
    return S.dedupe_sequences(seqs(spark, d)).select("header", F.md5("seq").alias("bases"), "line_no")


@query("select header, regexp_extract(header, 'LTRlen\\s*:\\s*(\\d+)', 1)::int as ltr_len, count(*) as n from seqs where regexp_matches(header, 'LTRlen\\s*:\\s*\\d+') group by all")
def ltr_domains(spark, d):
    return N.ltr_domains(seqs(spark, d)).groupBy("header", "ltr_len").agg(F.count("*").alias("n"))


@query("select doc_id, case when doc_id % 5 = 0 then split_part(header, '#', 1) || '#Unknown/Unknown' else split_part(header, '#', 1) || '#' || split_part(split_part(header, '#', 2), '/', 1) || '/' || split_part(header, '/', 2) end as header from seqs")
def normalize_headers(spark, d):
    s = seqs(spark, d).withColumn("header", F.when(F.col("doc_id") % 5 == 0, F.substring_index("header", "#", 1)).otherwise(F.concat("header", F.lit(" description of it"))))
    return N.normalize_headers(s).select("doc_id", "header")


@query("""select doc_id, case doc_id % 4 when 0 then 'ltr' when 1 then 'internal' else 'unknown' end as part, 'TE' || (doc_id % 37) as base from seqs""")
def part_types(spark, d):
    return N.with_part_type(seqs(spark, d)).select("doc_id", "part", "base")


DOMAIN = "(select header, min(length(seq)) as n from seqs where doc_id % 3 = 0 group by header)"


@query(f"select doc_id, s.header || coalesce('~LTRlen:' || d.n, '') as header from seqs s left join {DOMAIN} d on s.header = d.header")
def append_ltr(spark, d):
    s = seqs(spark, d)
    dom = s.filter("doc_id % 3 = 0").groupBy("header").agg(F.min(F.length("seq")).alias("ltr_len"))
    return S.append_ltr(s, dom).select("doc_id", "header")


#: Eight documents a base, so that groups stay small as the table grows, and every document is stitched or passed on.
STITCH = """with p as (select doc_id, regexp_replace(header, '^TE[0-9]+', 'TE' || (doc_id // 8)) as header, seq, 'TE' || (doc_id // 8) as base, doc_id % 4 as t from seqs),
n as (select base, count(*) filter (t = 0) as l, count(*) filter (t = 1) as i from p where t < 2 group by base),
a as (select *, row_number() over (partition by base, t order by doc_id) as k from p where t < 2),
s as (select i.doc_id as line_no, i.base || case when n.l * n.i = 1 then '' else '_' || ((i.k - 1) * n.l + l.k) end || '#LTR/Gypsy' as header, md5(l.seq || i.seq || l.seq) as bases, true as stitched from a i join a l on i.base = l.base and i.t = 1 and l.t = 0 join n on n.base = i.base),
r as (select doc_id, header, md5(seq), false from p left join n using (base) where t >= 2 or coalesce(n.l, 0) = 0 or coalesce(n.i, 0) = 0)
select * from s union all select * from r"""


@query(STITCH)
def stitch_parts(spark, d):
    s = seqs(spark, d).withColumn("header", F.regexp_replace("header", F.lit("^TE[0-9]+"), F.concat(F.lit("TE"), F.expr("doc_id div 8").cast("string"))))
    return S.stitch_parts(s).select("line_no", "header", F.md5("seq").alias("bases"), "stitched")


@query("""with p as (select sample_id, line_no, split_part(split_part(split_part(name, ';', 1), '#', 2), '/', 1) as c, split_part(split_part(split_part(split_part(name, ';', 1), '#', 2), '/', 2), '~', 1) as s, tsd from features where name not like 'gene%'),
r as (select *, case when c = 'DNA' then 0 when c = 'MITE' then 5 else 5 end as lo, case when c = 'DNA' then 0 when c = 'MITE' then 8 when c = 'LINE' then 20 else 5 end as hi from p)
select sample_id, line_no, lo::int as tsd_min, hi::int as tsd_max, case when tsd = 'NA' then 0 else length(tsd) end between lo and hi as tsd_ok from r""")
def tsd_rules(spark, d):
    f = N.with_te_info(N.with_name_parts(features(spark, d).filter(~F.startswith("name", F.lit("gene")))))
    f = f.withColumn("superfamily", F.regexp_replace("superfamily", "_SOLO$", ""))
    return S.with_tsd_rule(f).select("sample_id", "line_no", "tsd_min", "tsd_max", "tsd_ok")


# alignments

KEPT = """with h as (select *, row_number() over () as rid from hsps where aln_len >= 100 and (sstart < 100 or slen - send < 100) and (qseqid <> sseqid or (nident <> qlen and ((sstart < 20 and qlen - qend < 20) or (qstart < 20 and slen - send < 20))))),
l as (select *, regexp_replace(btop, '[0-9]', '', 'g') as s from h), o as (select *, length(s) % 2 <> 0 as odd, regexp_extract_all(s, '..') as ps from l),
c as (select *, case when odd then 0 else len(list_filter(ps, lambda p: p in ('AG', 'GA', 'CT', 'TC'))) end as ts, case when odd then 0 else len(list_filter(ps, lambda p: p in ('AC', 'CA', 'AT', 'TA', 'GC', 'CG', 'GT', 'TG'))) end as tv,
  case when odd then 0 else len(list_filter(ps, lambda p: contains(p, '-'))) end as ind from o)
"""


@query("""with h as (select * from hsps where aln_len >= 100 and (sstart < 100 or slen - send < 100) and (qseqid <> sseqid or (nident <> qlen and ((sstart < 20 and qlen - qend < 20) or (qstart < 20 and slen - send < 20))))) select qseqid, count(*) as n, sum(aln_len)::bigint as aligned from h group by qseqid""")
def filter_hsps(spark, d):
    return L.filter_hsps(view(spark, d, "hsps")).groupBy("qseqid").agg(F.count("*").alias("n"), F.sum("aln_len").alias("aligned"))


@query(KEPT + "select ts::bigint as transitions, tv::bigint as transversions, ind::bigint as indels, odd, count(*) as n from c group by all")
def btop_counts(spark, d):
    c = L.btop_counts(L.filter_hsps(view(spark, d, "hsps")))
    return c.groupBy(*(F.col(k).cast("bigint").alias(k) for k in ("transitions", "transversions", "indels")), "odd").agg(F.count("*").alias("n"))


@query(KEPT + """, t as (select *, ts + tv + nident as tot, (ts + tv) / (ts + tv + nident) as raw, ts / (ts + tv + nident) as p, tv / (ts + tv + nident) as q from c),
x as (select *, case when raw < 0.66 then -0.75 * ln(1 - 4 * raw / 3) else raw end as jc, case when 1 - 2 * p - q > 0 and 1 - 2 * q > 0 then -0.5 * ln((1 - 2 * p - q) * sqrt(1 - 2 * q)) else raw end as k2 from t)
select qseqid, round(sum(case when odd then 0 else raw end) / count(*), 9) as raw_d, round(sum(case when odd then 0 else jc end) / count(*), 9) as jc69_d, round(sum(case when odd then 0 else k2 end) / count(*), 9) as k2p_d,
 round(sum(case when odd then 0 else tot end) / count(*), 6) as tot_len, sum(ts)::bigint as transitions, sum(tv)::bigint as transversions, count(*) as hits from x group by qseqid""")
def element_divergence(spark, d):
    e = L.element_divergence(view(spark, d, "hsps"), 3e-8)
    return e.select("qseqid", *(F.round(k, 9).alias(k) for k in ("raw_d", "jc69_d", "k2p_d")), F.round("tot_len", 6).alias("tot_len"), *(F.col(k).cast("bigint").alias(k) for k in ("transitions", "transversions")), "hits")


@query("""with e as (select chrom, unnest([{'k': 'I', 'p': aln_start + l_partkey + 1, 's': l_linenumber::bigint}, {'k': 'D', 'p': aln_start + l_partkey + 1 + regexp_extract(cigar, '([0-9]+)=', 1)::bigint, 's': regexp_extract(cigar, '([0-9]+)D', 1)::bigint}]) as e from paf)
select chrom, e.k as kind, count(*) as n, sum(e.p)::bigint as positions, sum(e.s)::bigint as sizes from e group by all""")
def indel_events(spark, d):
    return L.indel_events(view(spark, d, "paf")).groupBy("chrom", "kind").agg(F.count("*").alias("n"), F.sum("position").alias("positions"), F.sum("size").alias("sizes"))


@query("""with c as (select sample_id, chrom, max(end_pos) as length from features group by all), i as (select *, row_number() over (partition by sample_id order by chrom) as idx from c)
select sample_id, chrom, length, coalesce(sum(length + 1000000) over (partition by sample_id order by idx rows between unbounded preceding and 1 preceding), 0)::bigint as "offset" from i""")
def chrom_offsets(spark, d):
    from pyspark.sql import Window

    f = features(spark, d).groupBy("sample_id", "chrom").agg(F.max("end").alias("length")).withColumn("idx", F.row_number().over(Window.partitionBy("sample_id").orderBy("chrom")))
    return L.chrom_offsets(f, by=["sample_id"]).select("sample_id", "chrom", "length", "offset")


@query("""with l as (select doc_id, 'TE_0' || (doc_id % 20) as name, split_part(split_part(header, '#', 2), '/', 1) as class, length(seq) as n, (doc_id % 30) / 100.0::double as p from seqs)
select doc_id, name, class from l where not (n < 80 or (n < 100 and p > 0.1) or (starts_with(name, 'TE_00') and p > 0.1) or p > 0.25 or class = 'MITE')""")
def library_qc(spark, d):
    lib = seqs(spark, d).select("doc_id", F.concat(F.lit("TE_0"), (F.col("doc_id") % 20).cast("string")).alias("name"), N.te_info(F.col("header"))["class"].alias("class"), F.length("seq").alias("length"), ((F.col("doc_id") % 30) / 100.0).alias("p"))
    return L.library_qc(lib, "^MITE$").select("doc_id", "name", "class")


def _divergence(spark, d):
    e = L.element_divergence(view(spark, d, "hsps"), 3e-8)
    return e.withColumn("generation", F.regexp_extract("qseqid", r"TE(\d+)#", 1).cast("bigint") % 10 * 1000)


@query(KEPT + """, t as (select qseqid, regexp_extract(qseqid, 'TE(\\d+)#', 1)::bigint % 10 * 1000 as generation, sum(case when odd then 0 else (ts + tv) / (ts + tv + nident) end) / count(*) as d from c group by qseqid)
select generation, count(*) as n, round(avg(d), 9) as mean, round((select max(d) * 1.1 from t), 9) as x_limit from t group by generation""")
def divergence_by_generation(spark, d):
    g = L.divergence_by_generation(_divergence(spark, d), "raw")
    return g.groupBy("generation").agg(F.count("*").alias("n"), F.round(F.avg("distance"), 9).alias("mean"), F.round(F.max("x_limit"), 9).alias("x_limit"))


@query(KEPT + """, t as (select qseqid, sum(case when odd then 0 else (ts + tv) / (ts + tv + nident) end) / count(*) as d from c group by qseqid) select qseqid, round(1 - (1 - d), 9) as divergence from t where d between 0 and 1""")
def select_divergence(spark, d):
    e = L.element_divergence(view(spark, d, "hsps"), 3e-8).select("qseqid", (1 - F.col("raw_d")).alias("Identity"), F.col("k2p_d").alias("K2P_d"))
    return L.select_divergence(e, use_identity=True).select("qseqid", F.round("divergence", 9).alias("divergence"))


# logs and reports

SESSIONS = """with e as (select line_no, value, case when value like 'Total TE%' then 1 else 0 end as o, regexp_extract(value, 'gen(\\d+)_', 1) as g from log_lines),
s as (select *, sum(o) over (order by line_no) as session from e), c as (select session, min(line_no) as fin from s where value like 'Updated FASTA%' and session > 0 group by session),
i as (select s.* from s join c using (session) where line_no <= fin),
r as (select session, max(try_cast(nullif(g, '') as bigint)) as generation, max(try_cast(nullif(regexp_extract(value, 'performed: (\\d+)', 1), '') as bigint)) as inserts, max(try_cast(nullif(regexp_extract(value, '\\(Nested: (\\d+)', 1), '') as bigint)) as nested, max(try_cast(nullif(regexp_extract(value, 'Non-nested: (\\d+)', 1), '') as bigint)) as nonnested,
  arg_max(try_cast(nullif(regexp_extract(value, 'excisions: (\\d+)', 1), '') as bigint), line_no) filter (value like 'Calculated%') as deletions_calc, coalesce(sum(try_cast(nullif(regexp_extract(value, 'Selected (\\d+)', 1), '') as bigint)), 0)::bigint as deletions_actual from i group by session),
z as (select * from r where deletions_calc is not null)
"""


@query(SESSIONS + "select generation, inserts, nested, nonnested, deletions_calc, deletions_actual from z")
def log_sessions(spark, d):
    return R.log_sessions(view(spark, d, "log_lines")).select("generation", "inserts", "nested", "nonnested", "deletions_calc", "deletions_actual")


@query(SESSIONS + """, g as (select doc_id * 10 as generation, length(seq) as n from seqs) select z.generation - z.generation % 10 as generation, inserts, deletions_actual as deletions, case when n > 0 then inserts / n end as insertion_rate, case when n > 0 then deletions_actual / n end as deletion_rate from z left join g on z.generation - z.generation % 10 = g.generation""")
def indel_rates(spark, d):
    r = R.log_sessions(view(spark, d, "log_lines")).select((F.col("generation") - F.col("generation") % 10).alias("generation"), "inserts", F.col("deletions_actual").alias("deletions"))
    return A.indel_rates(r, seqs(spark, d).select((F.col("doc_id") * 10).alias("generation"), F.length("seq").alias("genome_length")))


@query(SESSIONS + """, w as (select generation / 1e6 as generation_m, deletions_calc / 1e3 as "Calculated deletions", deletions_actual / 1e3 as "Actual deletions", nested / 1e3 as "Nest TE insertions", nonnested / 1e3 as "Non-nest TE insertions" from z)
select generation_m, type, count_k from (unpivot w on "Calculated deletions", "Actual deletions", "Nest TE insertions", "Non-nest TE insertions" into name type value count_k)""")
def report_long(spark, d):
    return R.report_long(R.log_sessions(view(spark, d, "log_lines")))


@query("""with r as (select user_id % 20 as series, event_id % 50 * 1000 as generation, round(sum(value), 6) as per_site from events group by all) select series, generation, round(sum(per_site) over (partition by series), 4) as accumulated from r""")
def accumulated_mutations(spark, d):
    r = view(spark, d, "events").groupBy((F.col("user_id") % 20).alias("series"), (F.col("event_id") % 50 * 1000).alias("generation")).agg(F.round(F.sum("value"), 6).alias("per_site"))
    return A.accumulated_mutations(r).select("series", "generation", F.round("accumulated", 4).alias("accumulated"))


@query("""with r as (select doc_id, length(seq) + 1000 as genome_size, doc_id % 97 as mutations, doc_id % 7 as recurrent from seqs)
select doc_id, round(mutations / genome_size, 9) as per_site, round((mutations - recurrent) / genome_size, 9) as unique_per_site, round(genome_size * (1 - exp(-mutations / genome_size)), 6) as expected_unique from r""")
def mutation_summary(spark, d):
    r = seqs(spark, d).select("doc_id", (F.length("seq") + 1000).alias("genome_size"), (F.col("doc_id") % 97).alias("mutations"), (F.col("doc_id") % 7).alias("recurrent"))
    return A.mutation_summary(r).select("doc_id", F.round("per_site", 9).alias("per_site"), F.round("unique_per_site", 9).alias("unique_per_site"), F.round("expected_unique", 6).alias("expected_unique"))


KINDS = ["click", "purchase", "signup", "view"]


@query("select user_id % 15 as sample, count(*) filter (event_type = 'click') as click, count(*) filter (event_type = 'purchase') as purchase, count(*) filter (event_type = 'signup') as signup, count(*) filter (event_type = 'view') as view, count(*) filter (event_type in ('click', 'purchase', 'signup', 'view')) as total from events group by all")
def sample_category_matrix(spark, d):
    e = view(spark, d, "events").groupBy((F.col("user_id") % 15).alias("sample"), F.col("event_type").alias("category")).agg(F.count("*").alias("n"))
    return A.sample_category_matrix(e, KINDS)


def _wide(spark, d):
    e = view(spark, d, "events").groupBy(F.col("event_type").alias("category")).agg(*(F.count_if(F.col("user_id") % 3 == k).alias(f"gen{1000 * k}_final_Count") for k in (2, 0, 1)))
    return R.stats_long(e, ["category"])


@query("select event_type as category, user_id % 3 * 1000 as generation, count(*) as n from events group by all")
def category_lines(spark, d):
    return R.category_lines(_wide(spark, d))


@query("select event_type as category, count(*) filter (user_id % 3 = 0) as \"0\", count(*) filter (user_id % 3 = 1) as \"1000\", count(*) filter (user_id % 3 = 2) as \"2000\" from events group by all")
def stats_matrix(spark, d):
    return R.stats_matrix(_wide(spark, d), [1000, 0, 2000], "category")

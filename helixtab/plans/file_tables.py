"""Queries of file readers and writers: text made from the views is written to a folder of scratch space, read back, and compared with SQL over the views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import sql
from ..operators import aggregates as A
from ..operators import classify as C
from ..operators import reports as R
from ..scratch import new_folder
from ..sources import sinks as K
from ..sources import text_files as T
from ..streaming import incremental
from .annotation import CLASS, FAMILY, QUERIES, classified, query
from .fixtures import features, view
from .sequence_tables import SESSIONS

__all__ = ["QUERIES"]


def put(spark: SparkSession, df: DataFrame, sample: str, order: str, value: str) -> str:
    """A folder with the lines `value`, an expression, of each sample in order."""
    path = new_folder(spark)
    K.write_lines(df.selectExpr(f"{sample} as sample_id", f"{order} as line_no", f"{value} as value"), path, ["line_no"])
    return path


BED = "sample_id, generation, line_no, chrom, start_pos, end_pos, name, tsd, strand"


def _bed(df: DataFrame, *more: str) -> DataFrame:
    return df.withColumnsRenamed({"start": "start_pos", "end": "end_pos"}).select(*BED.split(", "), *more)


@query(f"select {BED} from features")
def read_bed6(spark, d):
    K.write_features(features(spark, d), path := new_folder(spark))
    return _bed(T.read_features(spark, path))


@query(f"select {BED}, case when event_id % 2 = 0 then 'tag' || (event_id % 7) end as tag from features")
def read_bed7(spark, d):
    f = features(spark, d).withColumn("tag", F.expr("case when event_id % 2 = 0 then concat('tag', event_id % 7) end"))
    K.write_features(f, path := new_folder(spark), tag=True)
    return _bed(T.read_features(spark, path), "tag")


@query("""select sample_id, row_number() over (partition by sample_id order by f.line_no) - 1 as line_no, chrom, start_pos, end_pos, name, 'NA' as tsd, '+' as strand
from features f where event_id % 10 not in (3, 4)""")
def read_bed4(spark, d):
    """Comment lines and lines with too few fields between the others."""
    value = "case event_id % 10 when 3 then '# comment' when 4 then concat_ws('\\t', chrom, start, end) else concat_ws('\\t', chrom, start, end, name) end"
    out = T.read_features(spark, put(spark, features(spark, d), "sample_id", "line_no", value), cols=4)
    return _bed(out).drop("generation")


@query("select sample_id, count(*) as n, sum(start_pos)::bigint as starts, max(line_no) as last_line from features group by sample_id")
def read_gzip(spark, d):
    K.write_features(features(spark, d), path := new_folder(spark), compression="gzip")
    return T.read_features(spark, path).groupBy("sample_id").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.max("line_no").alias("last_line"))


@query("select 's' || (doc_id % 3) as sample_id, row_number() over (partition by doc_id % 3 order by doc_id) - 1 as record_no, header, md5(seq) as bases from seqs")
def read_fasta(spark, d):
    s = view(spark, d, "seqs").select(F.expr("concat('s', doc_id % 3)").alias("sample_id"), F.col("doc_id").alias("record_no"), "header", "seq")
    K.write_sequences(s, path := new_folder(spark))
    return T.read_sequences(spark, path).select("sample_id", "record_no", "header", F.md5("seq").alias("bases"))


@query("select sample_id, line_no, chrom, 'repeat_region' as type, start_pos + 1 as start_pos, end_pos, strand, 'TE' || event_id as id, split_part(name, ';', 1) as label from features")
def read_gff(spark, d):
    value = "concat_ws('\\t', chrom, 'sim', 'repeat_region', start + 1, end, '.', strand, '.', concat('ID=TE', event_id, ';Label=', substring_index(name, ';', 1)))"
    g = T.read_gff(spark, put(spark, features(spark, d), "sample_id", "line_no", value))
    return g.select("sample_id", "line_no", "chrom", "type", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "strand", F.col("attrs")["ID"].alias("id"), F.col("attrs")["Label"].alias("label"))


@query("""with k as (select *, event_id % 4 as k, 'F' || (event_id % 7) as fam, 'H' || (event_id % 5) || '_TE00' || (event_id % 3) || '_a' as hid from features),
h as (select sample_id, 'TE00' || (event_id % 3) as no, arg_max(hid || '#DNA/hAT', line_no) as host from k where k = 2 group by all)
select k.sample_id, k.line_no, k.chrom, k.start_pos, k.end_pos, case k when 2 then 'H' || (event_id % 5) when 0 then 'E' || (event_id % 11) else fam end || case when event_id % 3 = 0 then '' else '_FRAG' end
  || case k when 2 then '#DNA/hAT' else '#LTR/Gypsy' end || case when k = 1 then ';CUT_BY:C9' else '' end || coalesce(';NESTED_IN:' || h.host, '') as name,
  case when event_id % 2 = 0 then 'ACG' when event_id % 6 = 1 then 'TT' else 'NA' end as tsd, k.strand
from k left join h on k.k = 3 and k.sample_id = h.sample_id and h.no = 'TE00' || (event_id % 4)""")
def gff_features(spark, d):
    """Hosts are named by their number; that of TE003 is never given."""
    attrs = """concat(case event_id % 4 when 0 then concat('ID=E', event_id % 11, '#LTR/Gypsy') when 2 then concat('ID=H', event_id % 5, '_TE00', event_id % 3, '_a') else concat('Name=F', event_id % 7, '_x;ID=G', event_id) end,
      ';Classification=', case event_id % 4 when 2 then 'DNA/hAT' else 'LTR/Gypsy' end, ';Integrity=', case when event_id % 3 = 0 then '1.0' else '0.5' end, case event_id % 4 when 1 then ';Cut_by=C9_TE005_z' when 3 then concat(';Nest_in=TE00', event_id % 4) else '' end,
      ';TSD_5=', case when event_id % 2 = 0 then 'ACG' else 'None' end, ';TSD_3=', case when event_id % 6 = 1 then 'TT' else 'None' end)"""
    path = put(spark, features(spark, d), "sample_id", "line_no", f"concat_ws('\\t', chrom, 'sim', 'te', start, end, '.', strand, '.', {attrs})")
    out = T.gff_to_features(T.read_gff(spark, path))
    return out.select("sample_id", "line_no", "chrom", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "name", "tsd", "strand")


@query("select caller as sample_id, row_number() over (partition by caller order by call_id) - 1 as idx, chrom, start_pos, end_pos from calls")
def read_calls(spark, d):
    """One caller writes `chrom:start..end`, the others twelve columns, some of them with the ends the other way round."""
    value = """case when caller = 'caller0' then concat(chrom, ':', start_pos, '..', end_pos, '\\tpass') when call_id % 2 = 0 then concat_ws('\\t', end_pos, start_pos, 3, 4, 5, 6, 7, 8, 9, 10, 11, chrom)
      else concat_ws('\\t', start_pos, end_pos, 3, 4, 5, 6, 7, 8, 9, 10, 11, chrom) end"""
    c = T.read_calls(spark, put(spark, view(spark, d, "calls"), "caller", "call_id", value))
    return c.select("sample_id", "idx", "chrom", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"))


@query("""select 'p' || (l_linenumber % 3) as sample_id, anchor, case anchor when 'query' then chrom else 't' || (l_partkey % 4) end as chrom, count(*) as n, sum(case anchor when 'query' then aln_start else l_partkey + 7 end)::bigint as starts, sum(length(cigar))::bigint as cigars
from paf, (values ('query'), ('target')) a(anchor) group by all""")
def read_paf(spark, d):
    value = "concat_ws('\\t', chrom, 1000, aln_start, 0, '+', concat('t', l_partkey % 4), 5, l_partkey + 7, 9, 10, 11, 60, 'NM:i:1', concat('cg:Z:', cigar))"
    path = put(spark, view(spark, d, "paf"), "concat('p', l_linenumber % 3)", "l_orderkey", value)
    out = T.read_paf(spark, path, "both")
    return out.groupBy("sample_id", "anchor", "chrom").agg(F.count("*").alias("n"), F.sum("aln_start").alias("starts"), F.sum(F.length("cigar")).alias("cigars"))


@query("select sample_id, row_number() over (partition by sample_id order by chrom) - 1 as idx, chrom, max(end_pos) as length from features group by sample_id, chrom")
def read_fai(spark, d):
    c = features(spark, d).groupBy("sample_id", "chrom").agg(F.max("end").alias("length"))
    return T.read_fai(spark, put(spark, c, "sample_id", "chrom", "concat_ws('\\t', chrom, length, 7, 60, 61)")).select("sample_id", "idx", "chrom", "length")


@query(f"""with w as (select sample_id, {CLASS} as class, {FAMILY} as superfamily, count(*) as n from (select *, split_part(name, ';', 1) as fid from features where not contains(name, 'gene') and not contains(name, '_SOLO')) group by all)
select sample_id, class, superfamily, round(n / sum(n) over (partition by sample_id), 9) as intact, round(1.0::double / count(*) over (partition by sample_id), 9) as fragment from w""")
def read_weights(spark, d):
    f = N.with_te_info(N.with_name_parts(features(spark, d).filter(~F.contains("name", F.lit("gene")) & ~F.contains("name", F.lit("_SOLO")))))
    w = f.groupBy("sample_id", "class", "superfamily").agg(F.count("*").alias("n"))
    out = T.read_weights(spark, put(spark, w, "sample_id", "concat(class, superfamily)", "concat_ws(' ', class, superfamily, n, 0)"))
    return out.select("sample_id", "class", "superfamily", F.round("intact", 9).alias("intact"), F.round("fragment", 9).alias("fragment"))


@query("""select 'd' || (doc_id % 2) as sample_id, 'LTR' || doc_id as element, case when doc_id % 9 = 0 then null else (doc_id % 100) / 1000.0::double end as k2p, case when doc_id % 2 = 0 then 0.5::double else null end as identity from seqs""")
def read_divergence(spark, d):
    """A table with a header of its own, and one without, which has the usual twelve columns. A header goes first in its file."""
    k2p = "case when doc_id % 9 = 0 then 'NA' else cast(doc_id % 100 / 1000 as string) end"
    s = view(spark, d, "seqs").selectExpr("concat('d', doc_id % 2) as sample_id", "doc_id as line_no", f"case when doc_id % 2 = 0 then concat_ws('\\t', concat('LTR', doc_id), {k2p}, '0.5') else concat_ws('\\t', concat('LTR', doc_id), 1, 2, 3, 4, 5, 6, 7, 8, 9, {k2p}, 11) end as value")
    head = spark.range(1).selectExpr("'d0' as sample_id", "-1L as line_no", "concat_ws('\\t', '#LTR_RT_name', 'K2P_d', 'Identity') as value")
    K.write_lines(s.unionByName(head), path := new_folder(spark), ["line_no"])
    out = T.read_divergence(spark, path)
    return out.select("sample_id", "element", F.try_element_at("values", F.lit("k2p_d")).alias("k2p"), F.try_element_at("values", F.lit("identity")).alias("identity"))


@query("select 'h' || (slen % 4) as sample_id, count(*) as n, sum(nident)::bigint as same, sum(length(btop))::bigint as btops, count(distinct qseqid) as elements, sum(sstart + send + slen + qstart + qend + qlen + aln_len)::bigint as places from hsps group by all")
def read_hsps(spark, d):
    h = T.read_hsps(spark, put(spark, view(spark, d, "hsps"), "concat('h', slen % 4)", "slen", f"concat_ws('\\t', {', '.join(T.HSP)})"))
    places = sum((F.col(c) for c in ("send", "slen", "qstart", "qend", "qlen", "aln_len")), F.col("sstart"))
    return h.groupBy("sample_id").agg(F.count("*").alias("n"), F.sum("nident").alias("same"), F.sum(F.length("btop")).alias("btops"), F.countDistinct("qseqid").alias("elements"), F.sum(places).alias("places"))


@query(SESSIONS + "select generation, inserts, nested, nonnested, deletions_calc, deletions_actual from z")
def read_log(spark, d):
    log = T.read_log(spark, put(spark, view(spark, d, "log_lines"), "source", "line_no", "value"))
    return R.log_sessions(log).select("generation", "inserts", "nested", "nonnested", "deletions_calc", "deletions_actual")


@query("select 'r' || (user_id % 3) as sample_id, event_id * 10 as generation, event_id % 9 + event_id % 5 as inserts, event_id % 9 as nested, event_id % 5 as nonnested, user_id as deletions_calc, user_id % 10 as deletions_actual from events")
def read_report(spark, d):
    value = "concat_ws('\\t', event_id * 10, concat(event_id % 9 + event_id % 5, '(', event_id % 9, '/', event_id % 5, ')'), user_id, user_id % 10)"
    lines = view(spark, d, "events").selectExpr("concat('r', user_id % 3) as sample_id", "event_id as line_no", f"{value} as value")
    head = spark.range(3).selectExpr("concat('r', id) as sample_id", "-1L as line_no", "'Generation\\tTE inserts(nest/nonnest)\\tCalculated deletions\\tActual deletions' as value")
    K.write_lines(lines.unionByName(head), path := new_folder(spark), ["line_no"])
    return T.read_report(spark, path).drop("line_no")


@query("select 'gen' || (doc_id % 20) as sample_id, doc_id % 20 as generation, sum(length(seq))::double as genome_size, count(*)::double as mutations, count(*) filter (doc_id % 3 = 0)::double as recurrent, round(count(*) / 1000.0::double, 6) as per_site from seqs group by all")
def read_mutation_reports(spark, d):
    """Two spellings of the rate's name."""
    s = view(spark, d, "seqs").groupBy((F.col("doc_id") % 20).alias("g")).agg(F.sum(F.length("seq")).alias("size"), F.count("*").alias("n"), F.count_if(F.col("doc_id") % 3 == 0).alias("again"))
    value = "concat('Genome size: ', size, '\\nTotal mutations: ', n, '\\nRecurrent mutations: ', again, case when g % 2 = 0 then '\\nMutions / site: ' else '\\nMutations / site: ' end, n / 1000)"
    out = T.read_mutation_reports(spark, put(spark, s, "concat('gen', g)", "g", value))
    return out.select("sample_id", "generation", "genome_size", "mutations", "recurrent", F.round("per_site", 6).alias("per_site"))


@query("select sample_id, chrom as sample, case strand when '+' then 'forward' else 'backward' end as category, count(*) as n from features group by all")
def read_stat_blocks(spark, d):
    f = features(spark, d).groupBy("sample_id", "chrom").agg(F.count_if(F.col("strand") == "+").alias("f"), F.count_if(F.col("strand") != "+").alias("b"))
    lines = f.select("sample_id", F.posexplode(F.array(F.concat(F.lit("SAMPLE: "), "chrom"), F.concat(F.lit("forward: "), F.col("f").cast("string")), F.concat(F.lit("backward: "), F.col("b").cast("string")))).alias("k", "value"), "chrom")
    K.write_lines(lines, path := new_folder(spark), ["chrom", "k"])
    return T.read_stat_blocks(spark, path)


@query("select event_type as category, 'gen' || (user_id % 3 * 1000) || '_final_Count' as file, user_id % 3 * 1000 as generation, count(*) as n from events group by all")
def read_wide_stats(spark, d):
    e = view(spark, d, "events").groupBy(F.col("event_type").alias("category"), F.expr("concat('gen', user_id % 3 * 1000, '_final')").alias("file")).agg(F.count("*").alias("n"))
    K.write_wide_stats(e, path := new_folder(spark), ["category"], [f"gen{1000 * k}_final" for k in range(3)])
    return T.read_wide_stats(spark, path, ["category"])


@query("select cast(event_id as varchar) as event_id, printf('%.3f', value / 7.0::double) as share, cast(cast(floor(value) as bigint) as varchar) as units from events")
def write_table(spark, d):
    e = view(spark, d, "events").select("event_id", (F.col("value") / 7.0).alias("share"), F.col("value").alias("units"))
    K.write_tsv(e, path := new_folder(spark), decimals={"share": 3}, whole=("units",))
    return spark.read.csv(path, sep="\t", header=True)


@query("""with n as (select *, split_part(name, ';', 1) as fid from features) select sample_id, line_no,
  case when contains(name, '#') then split_part(name, '#', 1) || '_FRAG' || substr(name, instr(name, '#')) else name || '_FRAG' end as frag, fid || '_SOLO' || substr(name, length(fid) + 1) as solo from n""")
def rewrite_tags(spark, d):
    return features(spark, d).select("sample_id", "line_no", N.add_frag_tag(F.col("name")).alias("frag"), N.add_solo_tag(F.col("name")).alias("solo"))


@query("select event_id, regexp_replace(regexp_replace(printf('%.1e', (event_id % 1000 + 1) / 7.3::double), 'e([+-])0*(\\d)', 'e\\1\\2'), 'e\\+', 'e') as rate from events")
def scientific_format(spark, d):
    return view(spark, d, "events").select("event_id", N.fmt_sci((F.col("event_id") % 1000 + 1) / 7.3).alias("rate"))


@query("""with n as (select event_id, case event_id % 5 when 0 then 'burnin.bed' when 1 then 'gen' || event_id || '_final.bed' when 2 then 'gen' || event_id || '_x.bed' when 3 then 'Generation ' || event_id else 'other' end as file from events)
select event_id, case when event_id % 5 = 0 then 0 when event_id % 5 in (1, 2) then event_id end as loose, case when event_id % 5 = 0 then 0 when event_id % 5 = 1 then event_id end as exact, case when event_id % 5 = 3 then event_id end as title,
  row_number() over (order by case when event_id % 5 = 0 then 0 when event_id % 5 in (1, 2) then event_id end nulls last, event_id) - 1 as place from n""")
def generation_labels(spark, d):
    """Styles of generation labels, and the place of each file by generation, those without one last."""
    from ..operators.ordering import number_rows, part_of

    name = F.expr("case event_id % 5 when 0 then 'burnin.bed' when 1 then concat('gen', event_id, '_final.bed') when 2 then concat('gen', event_id, '_x.bed') when 3 then concat('Generation ', event_id) else 'other' end")
    e = view(spark, d, "events").select("event_id", *(N.generation_of(name, s).alias(s) for s in ("loose", "exact", "title")))
    e = R.order_generations(e.withColumn("generation", F.col("loose"))).withColumn("_one", F.lit(0))
    far = F.coalesce("loose", F.lit((1 << 62) - 1))
    return number_rows(e.withColumn("_far", far), ["_one"], [part_of(far)], ["_far", "event_id"], "place").select("event_id", "loose", "exact", "title", "place")


@query(classified() + f"""select 'class' as mode, count(*) as n, sum(event_id)::bigint as ids from k where category = 'Intact TE' and {CLASS} = 'LTR'
 union all select 'header', count(*), sum(doc_id)::bigint from seqs where contains(header, 'LTR')
 union all select 'length', count(*), sum(doc_id)::bigint from seqs where split_part(split_part(header, '#', 2), '/', 1) <> 'LTR' or contains(header, '~LTRlen:')""")
def filter_ltr(spark, d):
    s = view(spark, d, "seqs").withColumn("feature_id", F.col("header"))
    parts = [N.filter_ltr(s, m).select(F.lit(m).alias("mode"), F.col("doc_id").alias("id")) for m in ("header", "length")]
    parts.append(N.filter_ltr(C.classify(features(spark, d)), "class").select(F.lit("class").alias("mode"), F.col("event_id").alias("id")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("mode").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query(classified() + f"""select {CLASS} as class, {FAMILY} as superfamily, count(*) filter (sample_id = 'gen0') as gen0, count(*) filter (sample_id = 'gen1000') as gen1000, count(*) filter (sample_id = 'gen2000') as gen2000, count(*) filter (sample_id = 'gen3000') as gen3000
from k where category = 'Intact TE' group by all""")
def superfamily_matrix(spark, d):
    return A.superfamily_matrix(A.superfamily_counts(C.classify(features(spark, d)), "Intact TE"), [f"gen{1000 * k}" for k in range(4)])


@query(classified() + "select sample_id, category, count(*) as n, sum(end_pos - start_pos)::bigint as bases from k group by all")
def streaming_statistics(spark, d):
    """Files of the features, several a sample, arrive in a folder and are counted one a batch by a streaming query, which ends when all are read."""
    root = new_folder(spark)
    K.write_features(features(spark, d), f"{root}/in", ranges=3)
    incremental.statistics(spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint", files_per_batch=1).awaitTermination()
    return spark.read.parquet(f"{root}/out/categories").select(F.col("sample_id").cast("string").alias("sample_id"), "category", "n", "bases")


@query("""with s as (select 's' || (doc_id % 3) as sample_id, row_number() over (partition by doc_id % 3 order by doc_id) - 1 as record_no, header, seq from seqs)
select sample_id, record_no, header as chrom, t.k as tile_no, substr(seq, t.k * 100 + 1, 100) as bases from s, lateral (select unnest(range(0, greatest(1, (length(seq) + 99) // 100))) as k) t""")
def read_tiles(spark, d):
    """Records read by line, in tiles of 100 bases."""
    s = view(spark, d, "seqs").select(F.expr("concat('s', doc_id % 3)").alias("sample_id"), F.col("doc_id").alias("record_no"), "header", "seq")
    K.write_sequences(s, path := new_folder(spark))
    return T.read_tiles(spark, path, 100).select("sample_id", "record_no", "chrom", "tile_no", "bases")


@query(classified() + """select sample_id, count(*) filter (category = 'Intact gene') as intact_gene, count(*) filter (category = 'Fragmented gene') as fragmented_gene,
  count(*) filter (category = 'Intact TE') as intact_te, count(*) filter (category = 'SoloLTR') as solo_ltr, count(*) filter (category = 'Fragmented TE') as fragmented_te from k group by sample_id""")
def sql_category_counts(spark, d):
    """Category counts in SQL alone, over a view of files and a table function."""
    K.write_features(features(spark, d), path := new_folder(spark))
    sql.register(spark)
    sql.views(spark, features=path)
    return spark.sql("""SELECT sample_id, count_if(category = 'Intact gene') AS intact_gene, count_if(category = 'Fragmented gene') AS fragmented_gene, count_if(category = 'Intact TE') AS intact_te,
      count_if(category = 'SoloLTR') AS solo_ltr, count_if(category = 'Fragmented TE') AS fragmented_te FROM classified_features(false, true, 100) GROUP BY sample_id""")


@query(f"""with n as (select *, split_part(name, ';', 1) as fid from features where not starts_with(name, 'gene')) select sample_id, {CLASS} as class, {FAMILY} as superfamily, count(*) as n, min(fid || '_SOLO' || substr(name, length(fid) + 1)) as least_solo,
  min(split_part(name, '#', 1) || '_FRAG' || substr(name, instr(name, '#'))) as least_frag, regexp_replace(regexp_replace(printf('%.1e', count(*) / 7.3::double), 'e([+-])0*(\\d)', 'e\\1\\2'), 'e\\+', 'e') as rate,
  max(case when {CLASS} = 'LTR' then try_cast(nullif(regexp_extract(fid, '~LTRlen:(.*)$', 1), '') as int) end) as longest, min(reverse(translate(tsd, 'ACGTacgt', 'TGCAtgca'))) as least_rc from n group by all""")
def sql_name_functions(spark, d):
    """The functions over names in one SQL statement."""
    sql.register(spark)
    return spark.sql("""SELECT sample_id, te_class(feature_id(name)) AS class, te_superfamily(feature_id(name)) AS superfamily, count(*) AS n, min(add_solo_tag(name)) AS least_solo, min(add_frag_tag(name)) AS least_frag,
      fmt_sci(count(*) / 7.3D) AS rate, max(te_ltr_len(feature_id(name))) AS longest, min(revcomp(tsd)) AS least_rc FROM {features} WHERE NOT is_gene(name) GROUP BY sample_id, te_class(feature_id(name)), te_superfamily(feature_id(name))""", features=features(spark, d))

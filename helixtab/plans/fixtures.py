"""Annotation-shaped views over the given tables, as SQL that Spark and DuckDB read alike.

`{name}` stands for a base table or an earlier view; `{G}` and `{div}` for what the dialects write differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.ordering import number_rows, part_of

VIEWS = {
    "raw_features": """
select event_id, 1000*(event_id % 4) as generation,
  concat('chr', cast(1 + (event_id*31 + user_id) % 5 as varchar(4))) as chrom,
  (event_id*7919) % 1000003 as start_pos,
  (event_id*7919) % 1000003 + 100 + (event_id*104729) % 2000 as end_pos,
  case
    when k < 4  then concat('gene', cast(event_id as varchar(12)))
    when k = 4  then concat('gene', cast(event_id as varchar(12)), ';CUT_BY:', fid)
    when k < 7  then concat(fid, '_SOLO')
    when k < 9  then concat('TE', cast(event_id % 23 as varchar(4)), '_FRAG#', cls)
    when k < 11 then concat(fid, ';CUT_BY:TE9#LTR/Copia~LTRlen:200')
    when k < 13 then concat(fid, ';NESTED_IN:', concat('gene', cast(event_id % 5 as varchar(4))))
    else fid end as name,
  case when cls = 'DNA/Helitron' or k < 5 then 'NA' when event_id % 3 = 0 then 'ACGTA' when event_id % 3 = 1 then 'TTGCA' else 'GGCCA' end as tsd,
  case when event_id % 7 < 4 then '+' else '-' end as strand
from (select *, (event_id*13 + user_id) % 20 as k,
   case user_id % 6 when 0 then 'LTR/Gypsy' when 1 then 'LTR/Copia' when 2 then 'LTR/unknown' when 3 then 'DNA/Helitron' when 4 then 'MITE/DTA' else 'LINE/unknown' end as cls,
   case when user_id % 6 < 3 then concat('TE', cast(event_id % 23 as varchar(4)), '#', case user_id % 6 when 0 then 'LTR/Gypsy' when 1 then 'LTR/Copia' else 'LTR/unknown' end, '~LTRlen:', cast(100 + event_id % 23 as varchar(4)))
        else concat('TE', cast(event_id % 23 as varchar(4)), '#', case user_id % 6 when 3 then 'DNA/Helitron' when 4 then 'MITE/DTA' else 'LINE/unknown' end) end as fid
  from {events}) e
""",
    "raw_nested": """
select event_id, 1000 * (event_id {div} 2500) as generation, concat('chr', cast(1 + b % 5 as varchar(3))) as chrom, event_id * 1000 as start_pos, event_id * 1000 + 1000 as end_pos,
  case when q % 2 = 1 then concat('TE', cast(event_id % 23 as varchar(4)), '#LTR/Gypsy~LTRlen:100;NESTED_IN:', host) else concat(host, ';CUT_BY:TE', cast((event_id + 1) % 23 as varchar(4)), '#LTR/Gypsy') end as name,
  case when b % 2 = 0 then 'NA' else 'ACGTA' end as tsd,
  case when b % 3 = 2 and q = 0 then '-' else '+' end as strand
 from (select event_id, event_id {div} 5 as b, event_id % 5 as q,
   case when (event_id {div} 5) % 3 = 1 and event_id % 5 = 4 then concat('gene', cast(event_id as varchar(9)))
        when (event_id {div} 5) % 2 = 0 then concat('gene', cast(event_id {div} 5 as varchar(9))) else concat('TE', cast((event_id {div} 5) % 17 as varchar(4)), '#DNA/hAT') end as host from {events}) e
""",
    "calls": """
select event_id as call_id, generation, chrom, concat('caller', cast(event_id % 3 as varchar(2))) as caller,
  case when event_id % 10 = 9 then start_pos + 1000003 else greatest(0, start_pos + (event_id % 50) - 25) end as start_pos,
  case when event_id % 10 = 9 then end_pos + 1000003 else end_pos + (event_id % 37) - 18 end as end_pos
 from {raw_features} where event_id % 10 <> 4
""",
    "seqs": """
select doc_id, concat('TE', cast(doc_id % 37 as varchar(6)), case doc_id % 4 when 0 then '_LTR' when 1 then '_I' else '' end, '#', case when doc_id % 4 < 2 then 'LTR/Gypsy' when doc_id % 4 = 2 then concat('LTR/Copia~LTRlen:', cast(20 + doc_id % 30 as varchar(4))) else 'MITE/DTA' end) as header,
  regexp_replace(upper(text), '[^ACGT]', ''{G}) as seq from {documents}
""",
    "sites": """
select d.doc_id, s.i as site_no, (d.doc_id * 13 + s.i * 40) % 150 as start_pos, (d.doc_id * 13 + s.i * 40) % 150 + 20 + (d.doc_id % 60) as end_pos, case when (d.doc_id + s.i) % 2 = 0 then '+' else '-' end as strand
 from {documents} d join (select 0 as i union all select 1 union all select 2) s on s.i < 3
""",
    "hsps": """
select concat('TE', cast(l_partkey as varchar(8)), '#LTR/Gypsy') as qseqid, concat('TE', cast(l_partkey as varchar(8)), '#LTR/Gypsy') as sseqid,
  1 + l_orderkey % 40 as sstart, 1 + l_orderkey % 40 + 100 + cast(l_quantity as bigint) as send, 2000 + l_partkey as slen,
  2000 + l_partkey - 150 - cast(l_quantity as bigint) as qstart, 2000 + l_partkey - l_suppkey % 40 as qend, 2000 + l_partkey as qlen,
  70 + 2 * cast(l_quantity as bigint) as aln_len, 60 + 2 * cast(l_quantity as bigint) - l_linenumber as nident,
  concat(cast(cast(l_quantity as bigint) as varchar(6)), case when l_returnflag = 'A' then 'AG' when l_returnflag = 'N' then 'CA' else 'T-' end,
    cast(10 + l_linenumber as varchar(6)), case when l_suppkey % 3 = 0 then 'CT' when l_suppkey % 3 = 1 then 'GC' else 'TA' end,
    cast(l_suppkey as varchar(6)), case when l_suppkey % 17 = 0 then 'A' else 'GA' end, '5') as btop from {lineitem}
""",
    "paf": """
select l_orderkey, l_linenumber, l_partkey, concat('chr', cast(1 + l_suppkey % 5 as varchar(3))) as chrom, l_partkey * 100 as aln_start,
  concat(cast(l_partkey + 1 as varchar(8)), 'M', cast(l_linenumber as varchar(3)), 'I', cast(l_suppkey + 1 as varchar(5)), '=', cast(cast(l_quantity as bigint) as varchar(5)), 'D12X3M') as cigar from {lineitem}
""",
    "log_lines": """
select 'run' as source, event_id as line_no, case event_type
   when 'signup' then concat('Total TE insertions performed: ', cast(user_id + event_id % 7 as varchar(9)), ' (Nested: ', cast(event_id % 7 as varchar(3)), ', Non-nested: ', cast(user_id as varchar(9)), ')')
   when 'view' then concat('Calculated number of TE excisions: ', cast(event_id % 50 as varchar(4)))
   when 'click' then concat('Selected ', cast(event_id % 9 as varchar(3)), ' removal events.')
   when 'purchase' then concat('Updated FASTA written to gen', cast(event_id as varchar(9)), '_final.fasta')
   else 'Insertion on chr1' end as value from {events}
""",
}
BASE = ("events", "documents", "lineitem")
#: Numbered feature tables, in DuckDB; Spark numbers them in two levels.
NUMBERED = {
    "features": "select concat('gen', cast(generation as varchar(12))) as sample_id, *, row_number() over (partition by generation order by chrom, start_pos, event_id) - 1 as line_no from raw_features",
    "nested": "select concat('gen', cast(generation as varchar(12))) as sample_id, *, row_number() over (partition by generation order by event_id) - 1 as line_no from raw_nested",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    needs = [n for n in (*BASE, *VIEWS) if f"{{{n}}}" in sql]
    return spark.sql(sql.replace("{G}", "").replace("{div}", "div"), **{n: view(spark, sf_dir, n) for n in needs})


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, generation, line_no, chrom, start, end, name, tsd, strand, event_id."""
    df = view(spark, sf_dir, "raw_features")
    from pyspark.sql import functions as F

    df = df.withColumn("sample_id", F.concat(F.lit("gen"), F.col("generation").cast("string")))
    df = number_rows(df, ["sample_id"], [F.col("chrom"), part_of("start_pos")], ["start_pos", "event_id"])
    return df.withColumnsRenamed({"start_pos": "start", "end_pos": "end"})


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    df = view(spark, sf_dir, "raw_nested").withColumn("sample_id", F.concat(F.lit("gen"), F.col("generation").cast("string")))
    df = number_rows(df, ["sample_id"], [part_of("event_id")], ["event_id"])
    return df.withColumnsRenamed({"start_pos": "start", "end_pos": "end"})


def oracle(body: str) -> str:
    """DuckDB query with the views that it needs in front."""
    parts: dict[str, str] = {}

    def need(name: str) -> None:
        sql = NUMBERED.get(name) or VIEWS[name].replace("{G}", ", 'g'").replace("{div}", "//")
        for n in (*VIEWS, *NUMBERED):
            if n != name and (f"{{{n}}}" in sql or f"from {n}" in sql) and n not in parts:
                need(n)
        for n in (*BASE, *VIEWS):
            sql = sql.replace(f"{{{n}}}", n)
        parts[name] = sql

    import re

    for n in (*VIEWS, *NUMBERED):
        if re.search(rf"\b{n}\b", body) and n not in parts:
            need(n)
    views = ",\n".join(f"{n} as materialized ({sql})" for n, sql in parts.items())
    body = body.strip()
    if not parts:
        return body
    if body.lower().startswith("with recursive "):
        return f"with recursive {views},\n{body[15:]}"
    return f"with {views},\n{body[5:]}" if body.lower().startswith("with ") else f"with {views}\n{body}"

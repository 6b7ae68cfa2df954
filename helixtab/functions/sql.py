"""SQL access: functions over names, headers and sequences as SQL functions of the session, readers as views, and classified features as table functions over them.

    register(spark)
    views(spark, features="annotations/", sequences="genomes/")
    spark.sql("select sample_id, category, count(*) from classified_features(false, true, 100) group by all")

All bodies are SQL over built-in functions, so Catalyst sees through them; nothing runs in Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import text_files as T

#: Scalar functions: name -> (parameters, type, body).
FUNCTIONS = {
    "feature_id": ("name STRING", "STRING", "substring_index(name, ';', 1)"),
    "name_attributes": ("name STRING", "ARRAY<STRING>", "slice(split(name, ';'), 2, greatest(0, size(split(name, ';')) - 1))"),
    "is_gene": ("name STRING", "BOOLEAN", "startswith(name, 'gene')"),
    "te_name": ("id STRING", "STRING", "CASE WHEN regexp_like(id, '(?s)#.*/') THEN substring_index(id, '#', 1) END"),
    "te_class": ("id STRING", "STRING", "CASE WHEN regexp_like(id, '(?s)#.*/') THEN substring_index(substr(id, instr(id, '#') + 1), '/', 1) END"),
    "te_superfamily": ("id STRING", "STRING", "CASE WHEN regexp_like(id, '(?s)#.*/') THEN regexp_extract(id, '(?s)#[^/]*/([^~]*)', 1) END"),
    "te_ltr_len": ("id STRING", "INT", "CASE WHEN te_class(id) = 'LTR' THEN try_cast(nullif(regexp_extract(id, '(?s)#LTR/[^~]*~LTRlen:(.*)$', 1), '') AS INT) END"),
    "te_info": ("id STRING", "STRUCT<te_name STRING, class STRING, superfamily STRING, ltr_len INT>", "named_struct('te_name', te_name(id), 'class', te_class(id), 'superfamily', te_superfamily(id), 'ltr_len', te_ltr_len(id))"),
    "te_info_pattern": ("id STRING", "STRUCT<class STRING, superfamily STRING>", "named_struct('class', coalesce(nullif(regexp_extract(id, '#([^/]+)/([^~;]+)', 1), ''), 'unknown'), 'superfamily', coalesce(nullif(regexp_extract(id, '#([^/]+)/([^~;]+)', 2), ''), 'unknown'))"),
    "add_frag_tag": ("name STRING", "STRING", "CASE WHEN instr(name, '#') > 0 THEN concat(substring_index(name, '#', 1), '_FRAG', substr(name, instr(name, '#'))) ELSE concat(name, '_FRAG') END"),
    "add_solo_tag": ("name STRING", "STRING", "concat(feature_id(name), '_SOLO', substr(name, length(feature_id(name)) + 1))"),
    "fmt_sci": ("x DOUBLE", "STRING", r"regexp_replace(regexp_replace(format_string('%.1e', x), 'e([+-])0*([0-9])', 'e$1$2'), 'e[+]', 'e')"),
    "revcomp": ("s STRING", "STRING", "reverse(translate(s, 'ACGTacgt', 'TGCAtgca'))"),
    "base_category": (
        "name STRING, frag_first BOOLEAN", "STRING",
        """CASE WHEN is_gene(name) THEN CASE WHEN instr(name, ';') > 0 THEN 'Fragmented gene' ELSE 'Intact gene' END
          WHEN frag_first AND contains(feature_id(name), '_FRAG') THEN 'Fragmented TE' WHEN contains(feature_id(name), '_SOLO') THEN 'SoloLTR' WHEN contains(feature_id(name), '_FRAG') THEN 'Fragmented TE'
          WHEN contains(coalesce(get(name_attributes(name), 0), ''), 'CUT_BY') THEN 'Fragmented TE' ELSE 'Intact TE' END"""),
    "tile_of": ("position BIGINT, size INT", "BIGINT", "floor(position / size)"),
}
#: Table functions over the view `features`: name -> (parameters, columns, body). Lines are cut in buckets of radius + 1, which are part of the join's key.
TABLES = {
    "demoted_features": (
        "require_attr BOOLEAN, radius INT, frag_first BOOLEAN", "sample_id STRING, line_no BIGINT",
        """WITH f AS (SELECT sample_id, line_no, name, tsd, strand, line_no DIV (radius + 1) AS bucket FROM features),
          a AS (SELECT *, explode(array(bucket - 1, bucket, bucket + 1)) AS near FROM f WHERE base_category(name, frag_first) = 'Intact TE' AND (NOT require_attr OR instr(name, ';') > 0))
        SELECT DISTINCT a.sample_id, a.line_no FROM a JOIN f b ON a.sample_id = b.sample_id AND a.near = b.bucket AND a.tsd = b.tsd AND a.strand = b.strand
        WHERE NOT is_gene(b.name) AND abs(a.line_no - b.line_no) BETWEEN 1 AND radius AND (startswith(a.name, b.name) OR startswith(b.name, a.name))"""),
    "classified_features": (
        "frag_first BOOLEAN, require_attr BOOLEAN, radius INT", "sample_id STRING, line_no BIGINT, chrom STRING, start BIGINT, `end` BIGINT, name STRING, tsd STRING, strand STRING, feature_id STRING, category STRING, demoted BOOLEAN",
        """SELECT f.sample_id, f.line_no, f.chrom, f.start, f.`end`, f.name, f.tsd, f.strand, feature_id(f.name), CASE WHEN h.line_no IS NOT NULL THEN 'Fragmented TE' ELSE base_category(f.name, frag_first) END, h.line_no IS NOT NULL
        FROM features f LEFT JOIN demoted_features(require_attr, radius, frag_first) h ON f.sample_id = h.sample_id AND f.line_no = h.line_no"""),
}
READERS = {
    "features": T.read_features, "sequences": T.read_sequences, "gff": T.read_gff, "calls": T.read_calls, "paf": T.read_paf, "fai": T.read_fai, "weights": T.read_weights, "divergence": T.read_divergence,
    "hsps": T.read_hsps, "log_lines": T.read_log, "reports": T.read_report, "mutation_reports": T.read_mutation_reports, "stat_blocks": T.read_stat_blocks,
}


def register(spark: SparkSession) -> None:
    """The scalar functions, for this session."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")


def views(spark: SparkSession, **sources: str | DataFrame) -> None:
    """A view a source, by the reader's name: a path that the reader reads, or a DataFrame. With `features`, the table functions over them too."""
    for name, source in sources.items():
        if name not in READERS:
            raise ValueError(f"no reader for {name!r}; there are {', '.join(READERS)}")
        (READERS[name](spark, source) if isinstance(source, str) else source).createOrReplaceTempView(name)
    if "features" in sources:
        for name, (parameters, columns, body) in TABLES.items():
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN {body}")

"""Classification of features by name and neighbourhood."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import is_gene, te_info_pattern, with_name_parts
from ..functions.arrays import running
from ..scratch import written
from .ordering import part_of, with_prefix

CATEGORIES = ("Intact gene", "Fragmented gene", "Intact TE", "SoloLTR", "Fragmented TE")
RADIUS = 100
#: Lines of a part in which nest groups are taken one after another, and parts that are composed at once.
NEST_LINES = NEST_PARTS = 4096


def classify_base(df: DataFrame, frag_first: bool = False) -> DataFrame:
    """Adds `category` from the name alone. Features marked both _SOLO and _FRAG are solo, or fragments if frag_first. CUT_BY is looked for in the
    first attribute."""
    df = with_name_parts(df)
    solo, frag = (F.contains("feature_id", F.lit("_SOLO")), "SoloLTR"), (F.contains("feature_id", F.lit("_FRAG")), "Fragmented TE")
    one, two = (frag, solo) if frag_first else (solo, frag)
    gene = is_gene(F.col("feature_id"))
    cut = F.when(F.size("attrs") > 0, F.contains(F.get("attrs", F.lit(0)), F.lit("CUT_BY"))).otherwise(False)
    return df.withColumn("category", F.when(gene & (F.size("attrs") == 0), "Intact gene").when(gene, "Fragmented gene").when(*one).when(*two).when(cut, "Fragmented TE").otherwise("Intact TE"))


def _neighbours(left: DataFrame, right: DataFrame, same, radius: int) -> DataFrame:
    """(sample_id, line_no) of left rows with a right row within `radius` lines of the same sample with equal TSD and strand for which `same`
    holds. Lines are cut into buckets of radius + 1 and the bucket is part of the join key, so that no key holds more rows of a sample than that
    on either side, however frequent a TSD is."""
    width = radius + 1
    bucket = F.expr(f"line_no div {width}")
    a = left.select("sample_id", "line_no", "tsd", "strand", F.col("name").alias("l_name"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    b = right.select("sample_id", F.col("line_no").alias("r_line"), "tsd", "strand", F.col("name").alias("r_name"), bucket.alias("bucket"))
    near = a.join(b, ["sample_id", "bucket", "tsd", "strand"]).filter(F.abs(F.col("line_no") - F.col("r_line")).between(1, radius) & same(F.col("l_name"), F.col("r_name")))
    return near.select("sample_id", "line_no").distinct()


def demote_by_neighbours(df: DataFrame, radius: int = RADIUS, require_attr: bool = True) -> DataFrame:
    """Intact TEs become fragmented when a row that isn't a gene, within `radius` rows of the sample, has equal TSD and strand and one name is a prefix of
    the other. Needs sample_id and line_no; with require_attr only rows with attributes can be demoted. Adds `demoted`."""
    open_ = df.filter((F.col("category") == "Intact TE") & ((F.size("attrs") > 0) if require_attr else F.lit(True)))
    hits = _neighbours(open_, df.filter(~is_gene(F.col("feature_id"))), lambda a, b: F.startswith(a, b) | F.startswith(b, a), radius)
    out = df.join(hits.withColumn("demoted", F.lit(True)), ["sample_id", "line_no"], "left").withColumn("demoted", F.coalesce("demoted", F.lit(False)))
    return out.withColumn("category", F.when(F.col("demoted"), "Fragmented TE").otherwise(F.col("category")))


def classify(df: DataFrame, frag_first: bool = False, require_attr: bool = True, radius: int = RADIUS) -> DataFrame:
    return demote_by_neighbours(classify_base(df, frag_first), radius, require_attr)


def intact_by_attr_prefix(df: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Adds `intact`: the variant used for rates. Not intact are names with `gene` anywhere, _FRAG, _SOLO, CUT_BY in the second part, and names with attributes
    of which the parts are a prefix of a neighbour's parts or the other way round (genes are neighbours too)."""
    df = with_name_parts(df)
    start = ~(F.contains(F.lower("feature_id"), F.lit("gene")) | F.contains("feature_id", F.lit("_FRAG")) | F.contains("feature_id", F.lit("_SOLO")))
    start &= ~F.when(F.size("attrs") > 0, F.contains(F.get("attrs", F.lit(0)), F.lit("CUT_BY"))).otherwise(False)
    df = df.withColumn("_open", start)
    with_attrs = df.filter(F.size("attrs") > 0)

    def prefix(a, b):  # parts a are a prefix of parts b, which is a prefix of the text up to a `;` or the end
        return F.startswith(F.concat(b, F.lit(";")), F.concat(a, F.lit(";")))

    hits = _neighbours(with_attrs.filter("_open"), with_attrs, lambda a, b: prefix(a, b) | prefix(b, a), radius)
    out = df.join(hits.withColumn("_hit", F.lit(True)), ["sample_id", "line_no"], "left")
    return out.withColumn("intact", F.col("_open") & F.col("_hit").isNull()).drop("_open", "_hit")


def intact_distribution(df: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Intact TEs per sample, class and superfamily, with their share of the sample."""
    kinds = intact_by_attr_prefix(df, radius).filter("intact").withColumn("_te", te_info_pattern(F.col("feature_id")))
    counts = kinds.groupBy("sample_id", F.col("_te.class").alias("class"), F.col("_te.superfamily").alias("superfamily")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("sample_id")))


def _candidates(df: DataFrame, width: int) -> DataFrame:
    """(sample_id, part, cands): lines that may be the middle of a group, in order, and whether genes flank them. Each part of the lines also sees the last row before it and the first after it."""
    line, nested = F.col("line_no"), F.when(F.size("attrs") > 0, F.startswith(F.get("attrs", F.lit(0)), F.lit("NESTED_IN:"))).otherwise(False)
    part = lambda c: F.floor(c / width).cast("bigint")
    rows = df.select("sample_id", "line_no", "feature_id", "strand", "tsd", nested.alias("_nested"))
    seen = rows.withColumn("part", F.explode(F.array_distinct(F.array(part(line), part(line - 1), part(line + 1)))))
    w = Window.partitionBy("sample_id", "part").orderBy("line_no")
    same = F.col("_nested")
    for c in ("feature_id", "strand", "tsd"):
        same &= F.lag(c).over(w) == F.lead(c).over(w)
    seen = seen.withColumns({"_cand": same, "gene": is_gene(F.lag("feature_id").over(w))}).filter(F.col("_cand") & (F.col("part") == part(line)))
    return seen.groupBy("sample_id", "part").agg(F.sort_array(F.collect_list(F.struct(F.col("line_no").alias("line"), "gene"))).alias("cands"))


def _after(last: Column, x: Column) -> Column:
    """The line taken last after candidate x."""
    return F.when(x["line"] - last >= 3, x["line"]).otherwise(last)


def _compose(a: Column, b: Column) -> Column:
    """The table of b after that of a; a table is the distance, 1, 2 or 3 (and more), that each distance becomes."""
    return F.transform(a, lambda d: F.element_at(b, d))


def _entering(parts: DataFrame, width: int) -> DataFrame:
    """parts(sample_id, part, f) -> (sample_id, part, d): the distance with which the scan comes to each part. Tables of parts are composed to those of `width` parts, which are scanned
    first, and so on; what is scanned is bounded everywhere."""
    groups = parts.groupBy("sample_id", F.floor(F.col("part") / width).cast("bigint").alias("_g")).agg(F.sort_array(F.collect_list(F.struct("part", "f"))).alias("ps"))
    identity = F.array(F.lit(1), F.lit(2), F.lit(3))
    if (parts.agg(F.max("part")).first()[0] or 0) >= width:
        whole = written(groups.select("sample_id", F.col("_g").alias("part"), F.aggregate("ps", identity, lambda acc, p: _compose(acc, p["f"])).alias("f")))
        groups = groups.join(_entering(whole, width).withColumnRenamed("part", "_g"), ["sample_id", "_g"])
    else:
        groups = groups.withColumn("d", F.lit(3))
    ds = running(F.col("ps"), F.col("d"), lambda d, p: F.element_at(p["f"], d))
    return groups.select("sample_id", F.explode(F.zip_with("ps", F.slice(ds, 1, F.size("ps")), lambda p, d: F.struct(p["part"].alias("part"), d.alias("d")))).alias("x")).select("sample_id", "x.*")


def nest_groups(df: DataFrame, lines: int = NEST_LINES, parts_at_once: int = NEST_PARTS) -> DataFrame:
    """Adds `subtype` and `nest_group` (line number of the middle row). A row whose first attribute begins NESTED_IN: between two rows with equal feature id,
    strand and TSD makes a group of three; groups are taken from left to right and a row serves in one group only.

    Taking is an automaton over the candidates whose state is the distance since the last one taken: 1, 2 or more. What a part of the lines does to it is a table of three; tables compose,
    so the state at every part's beginning is a scan over parts, and each part is then gone through on its own. A run of candidates may be as long as the file."""
    df = with_name_parts(df)
    begin = F.col("part") * lines
    cands = written(_candidates(df, lines))
    last = [F.aggregate("cands", begin - d, _after) for d in (1, 2, 3)]
    out = [F.least(F.lit(3), begin + lines - x).cast("int") for x in last]
    # a part without candidates leaves any distance at 3: what comes before a gap doesn't matter
    near = F.coalesce(F.lag("part").over(Window.partitionBy("sample_id").orderBy("part")) == F.col("part") - 1, F.lit(False))
    tables = written(cands.select("sample_id", "part", F.when(near, F.array(*out)).otherwise(F.array(out[2], out[2], out[2])).alias("f")))
    came = cands.join(_entering(tables, parts_at_once), ["sample_id", "part"])
    # a part behind a gap is entered from afar
    came = came.join(tables.select("sample_id", (F.col("part") + 1).alias("part"), F.lit(True).alias("_near")), ["sample_id", "part"], "left").withColumn("d", F.when(F.col("_near"), F.col("d")).otherwise(3))
    lasts = running(F.col("cands"), begin - F.col("d"), _after)
    taken = F.filter(F.zip_with("cands", F.slice(lasts, 2, F.size("cands")), lambda c, x: F.struct(c["line"].alias("line"), c["gene"].alias("gene"), (x == c["line"]).alias("taken"))), lambda z: z["taken"])
    picked = came.select("sample_id", F.explode(taken).alias("g")).select("sample_id", F.col("g.line").alias("nest_group"), F.col("g.gene").alias("_g"))
    parts = picked.select("sample_id", "nest_group", "_g", F.posexplode(F.array(*(F.col("nest_group") + d for d in (-1, 0, 1)))).alias("_part", "line_no"))
    names = F.when(F.col("_g"), F.array(*map(F.lit, ("CUT_PAIR_GENE_1", "NEST_TE_IN_GENE", "CUT_PAIR_GENE_2")))).otherwise(F.array(*map(F.lit, ("CUT_PAIR_TE_1", "NEST_TE_IN_TE", "CUT_PAIR_TE_2"))))
    parts = parts.select("sample_id", "line_no", "nest_group", F.get(names, F.col("_part")).alias("_sub"))
    out = df.join(parts, ["sample_id", "line_no"], "left")
    alone = F.when(is_gene(F.col("feature_id")), "NON_NEST_GROUP_GENES").otherwise("NON_NEST_GROUP_TE")
    return out.withColumn("subtype", F.coalesce("_sub", alone)).drop("_sub")


def disrupted_gene_weight(df: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Per sample: distinct genes with attributes and the sum of their weights (gene, weight; 1 where a gene has none)."""
    genes = with_name_parts(df).filter(is_gene(F.col("feature_id")) & (F.size("attrs") > 0)).select("sample_id", "feature_id").distinct()
    if weights is not None:
        genes = genes.join(weights.select(F.col("gene").alias("feature_id"), "weight"), "feature_id", "left")
    else:
        genes = genes.withColumn("weight", F.lit(None).cast("double"))
    return genes.groupBy("sample_id").agg(F.count("*").alias("genes"), F.sum(F.coalesce("weight", F.lit(1.0))).alias("weight"))


def consolidate_adjacent(df: DataFrame) -> DataFrame:
    """Runs of adjacent genes with equal feature id, strand and TSD, in order of start on a chromosome, become one feature: start of the first, end of the last,
    attributes dropped. Other rows stay."""
    df = with_name_parts(df)
    by, coarse, fine = ["sample_id", "chrom"], [part_of("start")], ["start", "line_no"]
    row = F.struct("start", "line_no", "feature_id", "strand", "tsd")
    df = with_prefix(df, by, coarse, fine, row, "_before", F.max)
    same = is_gene(F.col("feature_id"))
    for c in ("feature_id", "strand", "tsd"):
        same &= F.col(c) == F.col(f"_before.{c}")
    df = with_prefix(df.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)), by, coarse, fine, F.col("_new"), "_sum")
    df = df.withColumn("_run", F.coalesce("_sum", F.lit(0)) + F.col("_new"))
    by = df.groupBy("sample_id", "chrom", "_run").agg(
        F.min_by("start", F.struct("start", "line_no")).alias("start"), F.max_by("end", F.struct("start", "line_no")).alias("end"), F.count("*").alias("rows"),
        F.min_by("name", F.struct("start", "line_no")).alias("_name"), F.first("feature_id").alias("_id"), F.first("tsd").alias("tsd"), F.first("strand").alias("strand"), F.min("line_no").alias("line_no"))
    return by.withColumn("name", F.when(F.col("rows") > 1, F.col("_id")).otherwise(F.col("_name"))).select("sample_id", "chrom", "start", "end", "name", "tsd", "strand", "line_no", "rows")


ELIGIBLE = ("NON_NEST_GROUP_TE", "CUT_PAIR_TE_1", "CUT_PAIR_TE_2", "NEST_TE_IN_TE", "NEST_TE_IN_GENE")


def excision_candidates(df: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Rows of nest_groups() that may be removed, with `partial_ok`: an intact LTR element (LTRlen, neither _SOLO nor _FRAG, not cut, and without a neighbour
    of the same name if it has attributes) of which a solo LTR may stay."""
    full = df.filter(F.col("subtype").isin(*ELIGIBLE))
    cut = F.when(F.size("attrs") > 0, F.contains(F.get("attrs", F.lit(0)), F.lit("CUT_BY"))).otherwise(False)
    may = F.col("subtype").isin("NEST_TE_IN_TE", "NON_NEST_GROUP_TE") & F.contains("feature_id", F.lit("LTRlen")) & ~F.contains("feature_id", F.lit("_SOLO")) & ~F.contains("feature_id", F.lit("_FRAG")) & ~cut
    full = full.withColumn("_may", may)
    hits = _neighbours(full.filter("_may").filter(F.size("attrs") > 0), df, lambda a, b: F.startswith(a, b) | F.startswith(b, a), radius)
    out = full.join(hits.withColumn("_hit", F.lit(True)), ["sample_id", "line_no"], "left")
    return out.withColumn("partial_ok", F.col("_may") & F.col("_hit").isNull()).drop("_may", "_hit")

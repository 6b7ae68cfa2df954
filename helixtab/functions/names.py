"""Column expressions for feature names `name#class/superfamily~LTRlen:n[_SOLO];ATTR:..;ATTR:..` and library headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feature_id(name: Column) -> Column:
    """First part of the name, before `;`."""
    return F.substring_index(name, ";", 1)


def attributes(name: Column) -> Column:
    """Parts after the first `;`."""
    parts = F.split(name, ";")
    return F.slice(parts, 2, F.greatest(F.lit(0), F.size(parts) - 1))


def with_name_parts(df: DataFrame) -> DataFrame:
    """Adds feature_id and attrs."""
    return df.withColumns({"feature_id": feature_id(F.col("name")), "attrs": attributes(F.col("name"))})


def _after(c: Column, mark: str) -> Column:
    """What follows the first mark, null without one."""
    at = F.instr(c, mark)
    return F.when(at > 0, F.substr(c, at + 1))


def te_info(c: Column) -> Column:
    """struct<te_name,class,superfamily,ltr_len>; all null unless there is a `#` and a `/` after it. The superfamily ends at `~`. ltr_len only for
    class LTR, when the text right after the first `~` is `LTRlen:` and a whole number."""
    rest = _after(c, "#")
    klass, tail = F.substring_index(rest, "/", 1), _after(rest, "/")
    after = _after(tail, "~")
    length = F.when((klass == "LTR") & F.startswith(after, F.lit("LTRlen:")), F.substr(after, F.lit(8)).try_cast("int"))
    known = tail.isNotNull()
    return F.struct(
        F.when(known, F.substring_index(c, "#", 1)).alias("te_name"), F.when(known, klass).alias("class"),
        F.when(known, F.substring_index(tail, "~", 1)).alias("superfamily"), length.alias("ltr_len"))


def te_info_pattern(c: Column, stop: str = "~;") -> Column:
    """struct<class,superfamily> by pattern, `unknown` where it doesn't fit; the superfamily stops at any of `stop`."""
    pattern = rf"#([^/]+)/([^{stop}]+)"
    get = lambda k: F.coalesce(F.nullif(F.regexp_extract(c, pattern, k), F.lit("")), F.lit("unknown"))
    return F.struct(get(1).alias("class"), get(2).alias("superfamily"))


def with_te_info(df: DataFrame, style: str = "split", ltr: bool = False, stop: str = "~;") -> DataFrame:
    """Adds te_name, class and superfamily from feature_id (ltr: ltr_len too); style `pattern`: class and superfamily by pattern."""
    if style == "pattern":
        return df.withColumn("_te", te_info_pattern(F.col("feature_id"), stop)).withColumns({k: F.col(f"_te.{k}") for k in ("class", "superfamily")}).drop("_te")
    keys = ("te_name", "class", "superfamily", "ltr_len")[: 4 if ltr else 3]
    return df.withColumn("_te", te_info(F.col("feature_id"))).withColumns({k: F.col(f"_te.{k}") for k in keys}).drop("_te")


def is_gene(c: Column) -> Column:
    return F.startswith(c, F.lit("gene"))


def ltr_domains(seqs: DataFrame) -> DataFrame:
    """(header, ltr_len) of headers with `LTRlen : n` anywhere, the leftmost; others are dropped."""
    n = F.regexp_extract("header", r"LTRlen\s*:\s*(\d+)", 1)
    return seqs.filter(n != "").select("header", n.cast("int").alias("ltr_len"))


def filter_ltr(df: DataFrame, mode: str = "header") -> DataFrame:
    """LTR elements alone. header: `LTR` anywhere in the header; class: category Intact TE and class LTR by name; length: everything but
    elements of class LTR without an LTR length."""
    if mode == "header":
        return df.filter(F.contains("header", F.lit("LTR")))
    te = te_info(F.col("feature_id"))
    ltr = F.coalesce(te["class"] == "LTR", F.lit(False))
    if mode == "class":
        return df.filter((F.col("category") == "Intact TE") & ltr)
    if mode == "length":
        return df.filter(~ltr | te["ltr_len"].isNotNull())
    raise ValueError(f"unknown mode {mode!r}")


def normalize_headers(seqs: DataFrame) -> DataFrame:
    """header := name#class/superfamily; blank parts are `Unknown`, the superfamily ends at white space."""
    h, blank = F.col("header"), lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("Unknown"))
    rest = _after(h, "#")
    family = F.element_at(F.split(F.trim(F.coalesce(_after(rest, "/"), F.lit(""))), r"\s+"), 1)
    return seqs.withColumn("header", F.concat(blank(F.substring_index(h, "#", 1)), F.lit("#"), blank(F.coalesce(F.substring_index(rest, "/", 1), F.lit(""))), F.lit("/"), blank(family)))


def with_header_id(seqs: DataFrame) -> DataFrame:
    """Adds tok, name, class, superfamily of the first token of a header; missing parts are null."""
    out = seqs.withColumn("tok", F.element_at(F.split(F.trim("header"), r"\s+"), 1)).withColumn("_rest", _after(F.col("tok"), "#"))
    return out.withColumns({"name": F.substring_index("tok", "#", 1), "class": F.substring_index("_rest", "/", 1), "superfamily": _after(F.col("_rest"), "/")}).drop("_rest")


def with_part_type(seqs: DataFrame, simple: bool = False) -> DataFrame:
    """Adds with_header_id()'s columns, part and base. part is ltr (the name holds LTR), internal (INT, _I or an I inside a word) or unknown; base is the name without the first
    such mark, repeated underscores squeezed and outer ones trimmed. simple: the first LTR or I in the name, which goes."""
    out = with_header_id(seqs)
    n = F.col("name")
    if simple:
        out = out.withColumn("_mark", F.nullif(F.regexp_extract(n, "^.*?(LTR|I)", 1), F.lit("")))
        out = out.withColumn("_at", F.when(F.col("_mark").isNotNull(), F.regexp_instr(n, F.lit("LTR|I"))))
    else:
        out = out.withColumn("_inner", F.regexp_instr(n, F.lit(r"(?<=\w)I(?=\w)")))
        out = out.withColumn("_mark", F.when(F.contains(n, F.lit("LTR")), "LTR").when(F.contains(n, F.lit("INT")), "INT").when(F.contains(n, F.lit("_I")), "_I").when(F.col("_inner") > 0, "I"))
        out = out.withColumn("_at", F.when(F.col("_mark") == "I", F.col("_inner")).otherwise(F.instr(n, F.col("_mark")))).drop("_inner")
    without = F.concat(F.substr(n, F.lit(1), F.col("_at") - 1), F.substr(n, F.col("_at") + F.length("_mark")))
    if not simple:
        without = F.regexp_replace(F.regexp_replace(without, "__+", "_"), "^_+|_+$", "")
    out = out.withColumn("base", F.when(F.col("_mark").isNotNull(), without).otherwise(n))
    return out.withColumn("part", F.when(F.col("_mark") == "LTR", "ltr").when(F.col("_mark").isNotNull(), "internal").otherwise("unknown")).drop("_mark", "_at")


def add_frag_tag(name: Column) -> Column:
    """`_FRAG` before the first `#`, or at the end without one."""
    at = F.instr(name, "#")
    return F.when(at > 0, F.concat(F.substr(name, F.lit(1), at - 1), F.lit("_FRAG"), F.substr(name, at))).otherwise(F.concat(name, F.lit("_FRAG")))


def add_solo_tag(name: Column) -> Column:
    """`_SOLO` at the end of the feature id; attributes stay."""
    return F.concat(feature_id(name), F.lit("_SOLO"), F.substr(name, F.length(feature_id(name)) + 1))


def generation_of(c: Column, style: str = "loose") -> Column:
    """Generation from a file name. loose: burnin is 0, else the number in `gen<n>_`; exact: `burnin.bed` or `gen<n>_final`, else null;
    title: `Generation <n>`."""
    if style == "title":
        return F.regexp_extract(c, r"Generation\s+(\d+)", 1).try_cast("bigint")
    if style == "exact":
        return F.when(c.rlike(r"(^|/)burnin\.bed$"), F.lit(0).cast("bigint")).otherwise(F.regexp_extract(c, r"gen(\d+)_final", 1).try_cast("bigint"))
    return F.when(F.contains(F.lower(c), F.lit("burnin")), F.lit(0).cast("bigint")).otherwise(F.regexp_extract(c, r"gen(\d+)_", 1).try_cast("bigint"))


def fmt_sci(c: Column) -> Column:
    """Shortest scientific form with one decimal: 0.045 is 4.5e-2."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.1e", c), r"e([+-])0*(\d)", "e$1$2"), r"e\+", "e")

"""Sequences: reverse complement, tiles and extraction, LTR end repair, lengths, renaming, stitching and header joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import te_info, with_part_type
from .ordering import number_rows, part_of

TILE = 65_536


def revcomp(c: Column) -> Column:
    """Reverse complement; case is kept, other letters stay."""
    return F.reverse(F.translate(c, "ACGTacgt", "TGCAtgca"))


def repair_ltr_ends(seqs: DataFrame) -> DataFrame:
    """For class LTR with a positive LTR length that fits twice: the 3' end becomes a copy of the 5' end. Adds `repaired`."""
    te = te_info(F.col("header"))
    n, size = te["ltr_len"], F.length("seq")
    fits = F.coalesce((te["class"] == "LTR") & (n > 0) & (size >= 2 * n), F.lit(False))
    return seqs.withColumn("repaired", fits).withColumn("seq", F.when(F.col("repaired"), F.concat(F.substr("seq", F.lit(1), size - n), F.substr("seq", F.lit(1), n))).otherwise(F.col("seq")))


def genome_length(seqs: DataFrame, by: list[str]) -> DataFrame:
    return seqs.groupBy(*by).agg(F.sum(F.length("seq")).alias("genome_length"))


def tiled_length(tiled: DataFrame, by: list[str]) -> DataFrame:
    """genome_length() of tiles."""
    return tiled.groupBy(*by).agg(F.sum(F.length("bases")).alias("genome_length"))


def length_by_superfamily(seqs: DataFrame) -> DataFrame:
    """Adds seq_len and category, `class/superfamily` or Unknown."""
    te = te_info(F.col("header"))
    return seqs.withColumns({"seq_len": F.length("seq"), "category": F.coalesce(F.concat_ws("/", te["class"], F.when(te["class"].isNotNull(), te["superfamily"])), F.lit("Unknown"))}).withColumn("category", F.when(te["class"].isNull(), "Unknown").otherwise(F.col("category")))


def uniquify_names(seqs: DataFrame, order: str = "line_no") -> DataFrame:
    """Adds unique_name: the k-th repeat of a name, in file order, gets `_k`; the first stays. `order` names a row. Names are numbered without their sequences, in parts of the
    order, and come back by it, so a common name is no task's work."""
    k = number_rows(seqs.select("header", order), ["header"], [part_of(order)], [order], "_k").select(F.col(order).alias("_o"), "_k")
    out = seqs.join(k, F.col(order) == F.col("_o")).drop("_o")
    return out.withColumn("unique_name", F.when(F.col("_k") > 0, F.concat_ws("_", "header", F.col("_k").cast("string"))).otherwise(F.col("header"))).drop("_k")


def dedupe_sequences(seqs: DataFrame) -> DataFrame:
    """One row of each header and sequence, the first in file order. Sequences are told by a SHA-256 of theirs, so that short rows are shuffled; those of the first rows alone follow."""
    first = seqs.select("header", F.unhex(F.sha2("seq", 256)).alias("_h"), "line_no").groupBy("header", "_h").agg(F.min("line_no").alias("line_no"))
    return seqs.select("header", "seq", "line_no").join(first.select("header", "line_no"), ["header", "line_no"], "left_semi").dropDuplicates(["header", "line_no"])


def tiles(seqs: DataFrame, size: int = TILE, keys: tuple[str, ...] = ("sample_id", "chrom")) -> DataFrame:
    """Chromosomes as tiles (keys, tile_no, bases), so that none is a task's working set afterwards."""
    n = F.greatest(F.lit(1), F.ceil(F.length("seq") / size)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(k.cast("bigint").alias("tile_no"), F.substr(F.col("seq"), k * size + 1, F.lit(size)).alias("bases")))
    return seqs.select(*keys, F.explode(parts).alias("t")).select(*keys, "t.*")


def extract_sequences(features: DataFrame, tiled: DataFrame, size: int = TILE, stranded: bool = True, keys: tuple[str, ...] = ("sample_id", "chrom"), row: tuple[str, ...] = ("line_no",)) -> DataFrame:
    """Bases [start, end) of features from tiles of that size, cut at the chromosome's end; minus-strand ones reverse-complemented if stranded. Features on chromosomes
    without a sequence are left out. keys + row name a feature."""
    held = [c for c in features.columns if c not in (*keys, *row)]
    f = features.withColumn("_tile", F.explode(F.sequence(F.floor(F.col("start") / size).cast("bigint"), F.floor(F.greatest(F.col("start"), F.col("end") - 1) / size).cast("bigint"))))
    t = tiled.withColumnRenamed("tile_no", "_tile")
    low, high = F.greatest(F.lit(0), F.col("start") - F.col("_tile") * size), F.least(F.lit(size), F.col("end") - F.col("_tile") * size)
    part = F.struct("_tile", F.substr(F.col("bases"), (low + 1).cast("int"), F.greatest(F.lit(0), high - low).cast("int")).alias("b"))
    out = f.join(t, [*keys, "_tile"]).groupBy(*keys, *row, *held).agg(F.sort_array(F.collect_list(part)).alias("_parts"))
    out = out.withColumn("seq", F.array_join(F.transform("_parts", lambda p: p["b"]), "")).drop("_parts")
    return out.withColumn("seq", F.when(F.col("strand") == "-", revcomp(F.col("seq"))).otherwise(F.col("seq"))) if stranded else out


def append_ltr(seqs: DataFrame, domains: DataFrame, div_type: str | None = None, exclude_no_hits: bool = False) -> DataFrame:
    """Headers with `~LTRlen:n` (and `~LTRdiv:x`) from domains(header, ltr_len[, divergence]), joined on the original header."""
    tail = F.concat(F.lit("~LTRlen:"), F.col("ltr_len").cast("string"), *([F.lit("~LTRdiv:"), F.col(div_type).cast("string")] if div_type else []))
    d = domains.select(F.col("header").alias("_h"), tail.alias("_tail"))
    out = seqs.join(d, F.col("header") == F.col("_h"), "inner" if exclude_no_hits else "left")
    return out.withColumn("header", F.concat("header", F.coalesce("_tail", F.lit("")))).drop("_h", "_tail")


def stitch_parts(seqs: DataFrame, drop_unmatched_internal: bool = False, simple: bool = False) -> DataFrame:
    """seqs(line_no, header, seq): internal and LTR parts of class LTR with equal base, class and superfamily are joined as LTR + internal + LTR, every internal with
    every LTR, numbered internal by internal when there is more than one pair; parts without a partner and everything else pass through (unmatched internals are dropped on
    demand). A missing superfamily prints as None. Parts are numbered without their sequences; line_no names a row."""
    typed = with_part_type(seqs, simple)
    key = ["base", "class", "family"]
    typed = typed.withColumn("family", F.coalesce("superfamily", F.lit("None")))
    parts = typed.filter((F.col("class") == "LTR") & F.col("part").isin("ltr", "internal"))
    place = number_rows(parts.select(*key, "part", "line_no"), [*key, "part"], [part_of("line_no")], ["line_no"], "_k").select(F.col("line_no").alias("_o"), (F.col("_k") + 1).alias("_place"))
    parts = parts.join(place, F.col("line_no") == F.col("_o")).drop("_o")
    n = parts.groupBy(*key).agg(F.count(F.when(F.col("part") == "ltr", 1)).alias("_ltrs"), F.count(F.when(F.col("part") == "internal", 1)).alias("_ints"))
    paired = n.filter("_ltrs > 0 and _ints > 0")
    ltr = parts.filter("part = 'ltr'").select(*key, F.col("seq").alias("_l"), F.col("_place").alias("_lp"))
    internal = parts.filter("part = 'internal'").select(*key, "line_no", F.col("seq").alias("_i"), F.col("_place").alias("_ip"))
    joined = internal.join(paired, key).join(ltr, key)
    number = (F.col("_ip") - 1) * F.col("_ltrs") + F.col("_lp")
    name = F.when(F.col("_ltrs") * F.col("_ints") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", number.cast("string")))
    stitched = joined.select("line_no", F.concat(name, F.lit("#"), F.col("class"), F.lit("/"), F.col("family")).alias("header"), F.concat("_l", "_i", "_l").alias("seq"), F.lit(True).alias("stitched"))
    rest = typed.join(paired.select(*key, F.lit(1).alias("_paired")), key, "left")
    used = (F.col("class") == "LTR") & F.col("part").isin("ltr", "internal") & F.col("_paired").isNotNull()
    keep = ~F.coalesce(used, F.lit(False))
    if drop_unmatched_internal:
        keep &= ~F.coalesce((F.col("class") == "LTR") & (F.col("part") == "internal"), F.lit(False))
    return stitched.unionByName(rest.filter(keep).select("line_no", "header", "seq", F.lit(False).alias("stitched")))


#: TSD lengths by lower-case class and superfamily (class, superfamily, least, most); others have 5.
TSD_RULES = (
    ("dna", "cacta", 2, 4), ("dna", "dta", 5, 8), ("dna", "dtc", 2, 4), ("dna", "dth", 2, 10), ("dna", "dtm", 8, 9), ("dna", "dtt", 2, 10),
    ("dna", "harbinger", 3, 3), ("dna", "hat", 5, 8), ("dna", "helitron", 0, 0), ("dna", "mariner", 2, 2), ("dna", "mudr", 8, 9), ("dna", "mutator", 8, 9), ("dna", "tc1_mariner", 2, 10), ("dna", "unknown", 2, 10),
    ("dnaauto", "cacta", 2, 4), ("dnaauto", "cactg", 2, 4), ("dnaauto", "hat", 5, 8), ("dnaauto", "helitron", 0, 0), ("dnaauto", "mle", 2, 10), ("dnaauto", "mudr", 8, 9), ("dnaauto", "mule", 8, 9), ("dnaauto", "pile", 2, 10), ("dnaauto", "pole", 2, 10),
    ("dnanona", "cacta", 2, 4), ("dnanona", "cactg", 2, 4), ("dnanona", "hat", 5, 8), ("dnanona", "helitron", 0, 0), ("dnanona", "mle", 2, 10), ("dnanona", "mule", 8, 9), ("dnanona", "muletir", 8, 9), ("dnanona", "pile", 2, 10), ("dnanona", "pole", 2, 10), ("dnanona", "tourist", 2, 10), ("dnanona", "unknown", 2, 10),
    ("line", "l1", 5, 20), ("line", "rte", 5, 20), ("line", "unknown", 5, 20),
    ("ltr", "copia", 5, 5), ("ltr", "crm", 5, 5), ("ltr", "gypsy", 5, 5), ("ltr", "solo", 5, 5), ("ltr", "trim", 5, 5), ("ltr", "ty3", 5, 5), ("ltr", "unknown", 5, 5),
    ("mite", "dta", 5, 8), ("mite", "dtc", 2, 4), ("mite", "dth", 2, 10), ("mite", "dtm", 8, 9), ("mite", "dtt", 2, 10), ("mite", "stow", 2, 10), ("mite", "tourist", 2, 10),
    ("sine", "trna", 5, 20), ("sine", "unknown", 5, 20),
)
#: Of these only the least and the most are lengths, none between.
TSD_EITHER = (("dna", "unknown"), ("dnaauto", "pile"), ("dnaauto", "pole"), ("dnanona", "pile"), ("dnanona", "pole"), ("dnanona", "unknown"))


def with_tsd_rule(df: DataFrame) -> DataFrame:
    """Adds tsd_min, tsd_max for (class, superfamily), 5 and 5 by default, and tsd_ok: whether the TSD's length (NA: 0) is in range, or one of the two where there are only two."""
    rules = df.sparkSession.createDataFrame([(*r, r[:2] in TSD_EITHER) for r in TSD_RULES], "_c string, _s string, tsd_min int, tsd_max int, _two boolean")
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    out = df.join(F.broadcast(rules), (low(F.col("class")) == F.col("_c")) & (low(F.col("superfamily")) == F.col("_s")), "left").drop("_c", "_s")
    out = out.withColumns({"tsd_min": F.coalesce("tsd_min", F.lit(5)), "tsd_max": F.coalesce("tsd_max", F.lit(5))})
    size = F.when(F.col("tsd") == "NA", 0).otherwise(F.length("tsd"))
    inside = F.when(F.coalesce("_two", F.lit(False)), (size == F.col("tsd_min")) | (size == F.col("tsd_max"))).otherwise(size.between(F.col("tsd_min"), F.col("tsd_max")))
    return out.withColumn("tsd_ok", inside).drop("_two")

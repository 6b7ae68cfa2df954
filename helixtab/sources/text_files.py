"""Readers of annotation, sequence, alignment and report files: a directory of files is one table, keyed by sample_id (the file's name without its
ending). Gzipped files are read by their ending. Every reader has a fixed schema; what differs between files is told from each file's own lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.names import generation_of


def sample_of(file_name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(file_name, r"\.(gz|bz2)$", ""), r"\.[^.]+$", "")


def _raw(spark: SparkSession, path, style: str, **options) -> DataFrame:
    """value, sample_id, generation, file_name, _file and _block of each line. Folders `sample_id=x`, as the writers make them, name the sample; else the file does."""
    raw = spark.read.options(**options).text(path)
    name, meta = F.col("_metadata.file_name"), {"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start")}
    if "sample_id" in raw.columns:
        raw = raw.select("value", F.col("sample_id").cast("string").alias("sample_id"), name.alias("file_name"), *(c.alias(k) for k, c in meta.items()))
        return raw.withColumns({"generation": generation_of(F.concat("sample_id", F.lit("_")), style), "_whole": F.col("sample_id")})
    raw = raw.select("value", sample_of(name).alias("sample_id"), name.alias("file_name"), *(c.alias(k) for k, c in meta.items()))
    return raw.withColumns({"generation": generation_of(F.col("file_name"), style), "_whole": F.col("_file")})


def _numbered(raw: DataFrame, out: str) -> DataFrame:
    """Adds the number of each row in its file, or in the files of its folder, in order. A task gives rows of a split ids in a row, so the number is the distance from the split's first
    plus the rows of the splits before: a table of one row a split, which is broadcast, and no shuffle of the lines."""
    raw = raw.withColumn("_id", F.monotonically_increasing_id())
    splits = raw.groupBy("_whole", "_file", "_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_start"))
    before = F.sum("_n").over(Window.partitionBy("_whole").orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select(F.col("_file").alias("_f2"), F.col("_block").alias("_b2"), (F.coalesce(before, F.lit(0)) - F.col("_start")).alias("_shift"))
    out_ = raw.join(F.broadcast(splits), (F.col("_file") == F.col("_f2")) & (F.col("_block") == F.col("_b2")))
    return out_.withColumn(out, F.col("_id") + F.col("_shift")).drop("_f2", "_b2", "_shift", "_id", "_whole", "_file", "_block")


def read_lines(spark: SparkSession, path, style: str = "loose") -> DataFrame:
    """sample_id, generation, file_name, line_no, value of each line. path may be such a table itself, as read_block_gzip() gives."""
    if isinstance(path, DataFrame):
        return path
    return _numbered(_raw(spark, path, style), "line_no").select("sample_id", "generation", "file_name", "line_no", "value")


#: What each member of a block-gzipped file begins with, up to its size.
MEMBER = bytes((31, 139, 8, 4, 0, 0, 0, 0, 0, 255, 6, 0, 66, 67, 2, 0))


def read_block_gzip(spark: SparkSession, path, style: str = "loose") -> DataFrame:
    """read_lines() of block-gzipped text, in as many tasks as the file has splits: the fixed beginning of a gzip member is the separator by which Spark cuts the raw bytes, each split
    inflates the members that begin in it, and only the lines at its ends meet those of its neighbours. Names must not end in .gz, which Spark would inflate whole; a member that is cut
    short or doesn't match its checksum is an error."""
    raw = _raw(spark, path, style, lineSep=MEMBER.decode("latin-1"), encoding="ISO-8859-1").select("_whole", "sample_id", "generation", "file_name", "_file", "_block", F.col("value").cast("binary").alias("value"))
    kinds = "_whole string, sample_id string, generation bigint, file_name string, _file string, _block bigint"
    lines = raw.mapInArrow(_inflated, f"{kinds}, _line bigint, _end boolean, value string")
    splits = lines.groupBy("_file", "_block").agg(F.max("_line").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select(F.col("_file").alias("_f2"), F.col("_block").alias("_b2"), before.alias("_shift"), F.sum("_n").over(Window.partitionBy("_file")).alias("_total"))
    lines = lines.join(F.broadcast(splits), (F.col("_file") == F.col("_f2")) & (F.col("_block") == F.col("_b2"))).withColumn("line_no", F.col("_line") + F.col("_shift"))
    group = ["_whole", "sample_id", "generation", "file_name", "_file", "line_no", "_total"]
    ends = lines.filter("_end").groupBy(*group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_block", "_line", "value"))), lambda x: x["value"]), "").alias("value"))
    ends = ends.filter("not (line_no = _total and value = '')")
    # lines of a folder's files run on
    files = ends.groupBy("_whole", "_file").agg((F.max("_total") + F.max((F.col("line_no") == F.col("_total")).cast("bigint"))).alias("_n"))
    files = files.select(F.col("_file").alias("_f2"), F.coalesce(F.sum("_n").over(Window.partitionBy("_whole").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    both = lines.filter("not _end").select(*group, "value").unionByName(ends).join(F.broadcast(files), F.col("_file") == F.col("_f2"))
    return both.select("sample_id", "generation", "file_name", (F.col("line_no") + F.col("_before")).alias("line_no"), F.regexp_replace("value", r"\r$", "").alias("value"))


def _inflated(batches):
    """Members of splits in order -> lines with their number in the split; _end: the first and the last, which may go on in another split."""
    import zlib

    import pyarrow as pa

    names = ["_whole", "sample_id", "generation", "file_name", "_file", "_block", "_line", "_end", "value"]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
    split, line, rest = None, 0, b""

    def made(first: int, texts: list[bytes], ends: list[bool]) -> pa.RecordBatch:
        columns = [[v] * len(texts) for v in split] + [list(range(first, first + len(texts))), ends, [t.decode("utf-8", "replace") for t in texts]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    for batch in batches:
        for *own, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != split:
                if split:
                    yield made(line, [rest], [True])
                split, line, rest = own, 0, b""
            if not piece:
                continue
            size = int.from_bytes(piece[:2], "little") + 1
            if size != len(piece) + len(MEMBER):
                raise ValueError(f"{own[4]}: a member of {size} bytes has {len(piece) + len(MEMBER)}")
            data = zlib.decompress(piece[2:-8], -15)
            if zlib.crc32(data) != int.from_bytes(piece[-8:-4], "little"):
                raise ValueError(f"{own[4]}: a member doesn't match its checksum")
            *texts, rest = (rest + data).split(b"\n")
            if texts:
                yield made(line, texts, [line + k == 0 for k in range(len(texts))])
                line += len(texts)
    if split:
        yield made(line, [rest], [True])


def _content(lines: DataFrame) -> DataFrame:
    """Lines that are neither blank nor comments, trimmed."""
    return lines.withColumn("value", F.regexp_replace("value", r"^\s+|\s+$", "")).filter((F.col("value") != "") & ~F.startswith("value", F.lit("#")))


def _renumber(df: DataFrame) -> DataFrame:
    """line_no counts kept rows."""
    from ..operators.ordering import number_rows, part_of

    return number_rows(df.withColumnRenamed("line_no", "_line"), ["sample_id"], [part_of("_line")], ["_line"]).drop("_line")


def read_features(spark: SparkSession, path, cols: int = 6, strict: bool = False, style: str = "loose") -> DataFrame:
    """BED with 6 columns and an optional tag, or 4 (chrom, start, end, gene: TSD NA, strand +). Rows with fewer fields are dropped, or an error if strict."""
    rows = _content(read_lines(spark, path, style)).withColumn("_f", F.split("value", "\t"))
    short = F.size("_f") < cols
    if strict:
        rows = rows.withColumn("_f", F.when(short, F.raise_error(F.concat(F.lit("too few fields: "), F.col("value")))).otherwise(F.col("_f")))
    rows = _renumber(rows.filter(~short))
    at = lambda k: F.get("_f", F.lit(k))
    tsd, strand = (at(4), at(5)) if cols >= 6 else (F.lit("NA"), F.lit("+"))
    return rows.select("sample_id", "generation", "line_no", at(0).alias("chrom"), at(1).try_cast("bigint").alias("start"), at(2).try_cast("bigint").alias("end"), at(3).alias("name"), tsd.alias("tsd"), strand.alias("strand"), (at(6) if cols >= 6 else F.lit(None).cast("string")).alias("tag"))


def read_sequences(spark: SparkSession, path, header: str = "token", upper: bool = False) -> DataFrame:
    """FASTA: sample_id, record_no, header (first token, or the full line), description, seq. One record must fit in a row."""
    raw = _raw(spark, path, "loose", lineSep="\n>")
    raw = _numbered(raw.withColumn("value", F.regexp_replace("value", "^>", "")).filter(F.trim("value") != ""), "record_no")
    line = F.regexp_replace(F.substring_index("value", "\n", 1), r"\r$", "")
    body = F.when(F.instr("value", "\n") > 0, F.substr("value", F.instr("value", "\n") + 1)).otherwise("")
    seq = F.regexp_replace(body, r"\s", "")
    out = raw.select("sample_id", "generation", "record_no", line.alias("description"), (F.upper(seq) if upper else seq).alias("seq"))
    out = out.withColumn("header", F.element_at(F.split(F.trim("description"), r"\s+"), 1) if header == "token" else F.col("description"))
    return out.select("sample_id", "generation", F.col("record_no").cast("bigint").alias("record_no"), "header", "description", "seq")


def read_tiles(spark: SparkSession, path, size: int = 65_536, header: str = "token", upper: bool = False) -> DataFrame:
    """FASTA straight to tiles of `size` bases: sample_id, generation, record_no, chrom (first token of the header, or the full line), description, tile_no, bases. Files are read by line and
    cut anywhere; where a line lies in its record follows from the bases of the splits before (a table of one row a split), so a record of any length is never whole anywhere. A line
    must fit in a row. Lines before a file's first header belong to none; a record without bases has one empty tile."""
    raw = _raw(spark, path, "loose").select("_whole", "sample_id", "generation", "_file", "_block", "value")
    runs = raw.mapInArrow(_runs, "_whole string, sample_id string, generation bigint, _file string, _block bigint, _seg bigint, _off bigint, _n bigint, description string, bases string")
    segs = runs.groupBy("_whole", "_file", "_block", "_seg").agg(F.sum("_n").alias("_n"))
    splits = segs.groupBy("_whole", "_file", "_block").agg(F.max("_seg").alias("_heads"), F.sum("_n").alias("_all"), F.max_by("_n", "_seg").alias("_tail"))
    w = Window.partitionBy("_whole").orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_from", F.coalesce(F.sum("_all").over(w), F.lit(0)))
    # where the record that a split begins within began, in bases of the whole
    begun = F.max(F.when(F.col("_heads") > 0, F.col("_from") + F.col("_all") - F.col("_tail"))).over(w)
    splits = splits.select(F.col("_file").alias("_f2"), F.col("_block").alias("_b2"), F.coalesce(F.sum("_heads").over(w), F.lit(0)).alias("_before"), (F.col("_from") - begun).alias("_carry"))
    placed = runs.join(F.broadcast(splits), (F.col("_file") == F.col("_f2")) & (F.col("_block") == F.col("_b2")))
    placed = placed.withColumns({"record_no": F.col("_before") + F.col("_seg") - 1, "_at": F.col("_off") + F.when(F.col("_seg") == 0, F.col("_carry")).otherwise(0)}).filter("record_no >= 0")
    heads = placed.filter("description is not null").select("sample_id", "generation", "record_no", "description")
    heads = heads.withColumn("chrom", F.element_at(F.split(F.trim("description"), r"\s+"), 1) if header == "token" else F.col("description"))
    first, last = F.floor(F.col("_at") / size).cast("bigint"), F.floor((F.col("_at") + F.col("_n") - 1) / size).cast("bigint")
    cut = placed.filter("_n > 0").select("sample_id", "record_no", "_at", "bases", F.explode(F.sequence(first, last)).alias("tile_no"))
    low = F.greatest(F.lit(0), F.col("tile_no") * size - F.col("_at"))
    high = (F.col("tile_no") + 1) * size - F.col("_at")
    piece = F.struct((F.col("_at") + low).alias("at"), F.substr("bases", (low + 1).cast("int"), (high - low).cast("int")).alias("b"))
    tiled = cut.groupBy("sample_id", "record_no", "tile_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda p: p["b"]), "").alias("bases"))
    out = heads.join(tiled, ["sample_id", "record_no"], "left")
    bases = F.coalesce("bases", F.lit(""))
    return out.select("sample_id", "generation", "record_no", "chrom", "description", F.coalesce("tile_no", F.lit(0)).cast("bigint").alias("tile_no"), (F.upper(bases) if upper else bases).alias("bases"))


def _runs(batches):
    """Lines of splits in order -> runs of bases and headers: the segment (0 before the split's first header), the place of a run in its segment, its length."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    keys, seg, off = None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        value = batch.column(5)
        head = np.asarray(pc.starts_with(value, ">").to_numpy(zero_copy_only=False), bool)
        bases = pc.replace_substring_regex(value, r"\s+", "")
        at = [batch.column(k).to_pylist() for k in (3, 4)]
        new = [k for k in range(batch.num_rows) if k == 0 or head[k] or head[k - 1] or at[0][k] != at[0][k - 1] or at[1][k] != at[1][k - 1]]
        out = {name: [] for name in ("_seg", "_off", "_n", "description", "bases")}
        for begin, end in zip(new, [*new[1:], batch.num_rows], strict=True):
            if keys != (at[0][begin], at[1][begin]):
                keys, seg, off = (at[0][begin], at[1][begin]), 0, 0
            if head[begin]:
                seg, off, text, line = seg + 1, 0, "", value[begin].as_py()[1:].rstrip("\r")
            else:
                text, line = "".join(bases.slice(begin, end - begin).to_pylist()), None
            for name, x in zip(out, (seg, off, len(text), line, text), strict=True):
                out[name].append(x)
            off += len(text)
        rows = batch.take(pa.array(new))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([*rows.columns[:5], *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], [*rows.schema.names[:5], *out])


def attribute_map(c: Column) -> Column:
    """`k=v` or `k:v` pairs between semicolons; of a repeated key the last counts."""
    pairs = F.filter(F.split(c, ";"), lambda p: F.contains(p, F.lit("=")) | F.contains(p, F.lit(":")))
    sep = lambda p: F.when(F.contains(p, F.lit("=")), F.instr(p, "=")).otherwise(F.instr(p, ":"))
    entries = F.transform(pairs, lambda p: F.struct(F.trim(F.substr(p, F.lit(1), sep(p) - 1)).alias("k"), F.substr(p, sep(p) + 1).alias("v")))

    def last(entries: Column, keys: Column) -> Column:
        values = F.transform(entries, lambda e: e["v"])
        again = F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["k"] == k), -1)["v"])
        return F.map_from_arrays(keys, F.when(F.size(keys) == F.size(entries), values).otherwise(again))

    return let(entries, lambda es: let(F.array_distinct(F.transform(es, lambda e: e["k"])), lambda keys: last(es, keys)))


def read_gff(spark: SparkSession, path) -> DataFrame:
    """GFF3 rows of nine columns with attrs as a map; coordinates as they are."""
    rows = _content(read_lines(spark, path)).withColumn("_f", F.split("value", "\t")).filter(F.size("_f") >= 9)
    at = lambda k: F.get("_f", F.lit(k))
    return rows.select("sample_id", "line_no", at(0).alias("chrom"), at(1).alias("source"), at(2).alias("type"), at(3).try_cast("bigint").alias("start"), at(4).try_cast("bigint").alias("end"), at(6).alias("strand"), attribute_map(at(8)).alias("attrs"))


def gff_to_features(gff: DataFrame) -> DataFrame:
    """GFF rows as features: base name (Name up to `_`, else ID up to `#`), _FRAG unless Integrity is 1.0, classification, CUT_BY, NESTED_IN of the host's name by its number (the last
    row of a number counts; a host not known adds nothing), TSD_5, else TSD_3, else NA. Rows with neither Name nor ID are dropped; coordinates are copied."""
    g = F.col("attrs")
    base = F.coalesce(F.substring_index(g["Name"], "_", 1), F.substring_index(id_parts(g["ID"])[0], "#", 1))
    rows = gff.withColumn("_base", base).filter("_base is not null")
    hosts = gff.filter(g["ID"].isNotNull()).select("sample_id", "line_no", id_parts(g["ID"])[1].alias("_no"), F.concat(F.coalesce(F.substring_index(g["Name"], "_", 1), F.substring_index(g["ID"], "#", 1)), F.lit("#"), F.coalesce(g["Classification"], F.lit(""))).alias("_host"))
    hosts = hosts.filter("_no != ''").groupBy("sample_id", "_no").agg(F.max_by("_host", "line_no").alias("_host"))
    out = rows.withColumn("_no", g["Nest_in"]).join(hosts, ["sample_id", "_no"], "left")
    frag = F.when(F.coalesce(g["Integrity"] == "1.0", F.lit(False)), "").otherwise("_FRAG")
    cut = F.when(g["Cut_by"].isNotNull(), F.concat(F.lit(";CUT_BY:"), id_parts(g["Cut_by"])[0])).otherwise("")
    nest = F.when(F.col("_host").isNotNull(), F.concat(F.lit(";NESTED_IN:"), F.col("_host"))).otherwise("")
    tsd = F.coalesce(F.nullif(g["TSD_5"], F.lit("None")), F.nullif(g["TSD_3"], F.lit("None")), F.lit("NA"))
    return out.select("sample_id", "line_no", "chrom", "start", "end", F.concat("_base", frag, F.lit("#"), F.coalesce(g["Classification"], F.lit("")), cut, nest).alias("name"), tsd.alias("tsd"), "strand", F.lit(None).cast("string").alias("tag"))


def id_parts(c: Column) -> list[Column]:
    """[base, number] of an id `base_TE0012_x`: the number is TE and the digits if they begin with 0, else what follows up to `_`; empty without `_TE`."""
    rest = F.regexp_extract(c, "^.*?_TE(.*)$", 1)
    zero = F.regexp_extract(rest, r"^(0\d+)", 1)
    number = F.concat(F.lit("TE"), F.when(zero != "", zero).otherwise(F.regexp_extract(rest, "^(.*?)(_.*)?$", 1)))
    has = F.contains(c, F.lit("_TE"))
    return [F.when(has, F.substring_index(c, "_TE", 1)).otherwise(c), F.when(has, number).otherwise(F.lit(""))]


def read_calls(spark: SparkSession, path) -> DataFrame:
    """Candidate calls of either layout, told by each file's first line: `chrom:start..end` in column 1, or at least 12 columns with start, end and chrom in 1, 2 and 12. Start and end
    are put in order; rows that don't fit are skipped."""
    rows = _content(read_lines(spark, path))
    first = rows.groupBy("sample_id").agg(F.min_by(F.element_at(F.split("value", r"\s+"), 1), "line_no").rlike(r"^.+:\d+\.\.\d+").alias("_pass"))
    rows = rows.join(F.broadcast(first), "sample_id").withColumn("_f", F.split("value", r"\s+"))
    at = lambda k: F.get("_f", F.lit(k))
    p = r"^(.+):(\d+)\.\.(\d+)"
    chrom = F.when(F.col("_pass"), F.nullif(F.regexp_extract(at(0), p, 1), F.lit(""))).otherwise(at(11))
    a = F.when(F.col("_pass"), F.regexp_extract(at(0), p, 2).try_cast("bigint")).otherwise(at(0).try_cast("bigint"))
    b = F.when(F.col("_pass"), F.regexp_extract(at(0), p, 3).try_cast("bigint")).otherwise(at(1).try_cast("bigint"))
    out = rows.select("sample_id", "line_no", chrom.alias("chrom"), a.alias("_a"), b.alias("_b"), F.col("value").alias("raw"))
    return _renumber(out.filter("chrom is not null and _a is not null and _b is not null").select("sample_id", "line_no", "chrom", F.least("_a", "_b").alias("start"), F.greatest("_a", "_b").alias("end"), "raw")).withColumnRenamed("line_no", "idx")


def read_paf(spark: SparkSession, path, anchor: str = "query") -> DataFrame:
    """PAF rows of at least 13 columns with a `cg:Z:` tag: chrom and aln_start of the query or the target, tags, cigar. anchor both: a row for either, told by a last column, from one reading."""
    rows = _content(read_lines(spark, path)).withColumn("_f", F.split("value", "\t")).filter(F.size("_f") >= 13)
    at = lambda k: F.get("_f", F.lit(k))
    ends = {"query": (0, 2), "target": (5, 7)}
    tags = F.slice("_f", 13, F.size("_f"))
    cigar = F.get(F.filter(tags, lambda t: F.startswith(t, F.lit("cg:Z:"))), F.lit(0))
    out = rows.select("sample_id", "line_no", at(4).alias("strand"), tags.alias("tags"), F.substr(cigar, F.lit(6)).alias("cigar"), *(at(k).alias(f"_{name}{i}") for name, ks in ends.items() for i, k in enumerate(ks)))
    place = lambda name: F.struct(F.col(f"_{name}0").alias("chrom"), F.col(f"_{name}1").try_cast("bigint").alias("aln_start"), F.lit(name).alias("anchor"))
    chosen = list(ends) if anchor == "both" else [anchor if anchor == "query" else "target"]
    out = out.filter("cigar is not null").withColumn("_p", F.explode(F.array(*map(place, chosen))) if len(chosen) > 1 else place(chosen[0]))
    out = out.select("sample_id", "line_no", "_p.chrom", "_p.aln_start", "strand", "tags", "cigar", *(["_p.anchor"] if len(chosen) > 1 else []))
    return out.filter("aln_start is not null")


def read_fai(spark: SparkSession, path) -> DataFrame:
    rows = _content(read_lines(spark, path)).withColumn("_f", F.split("value", "\t")).filter(F.size("_f") >= 2)
    return rows.select("sample_id", F.col("line_no").alias("idx"), F.get("_f", F.lit(0)).alias("chrom"), F.get("_f", F.lit(1)).try_cast("bigint").alias("length"))


def read_weights(spark: SparkSession, path) -> DataFrame:
    """Class, superfamily, intact and fragment weights, either normalised to a sum of 1 per file; all zero means uniform."""
    rows = _content(read_lines(spark, path)).withColumn("_f", F.split("value", r"\s+")).filter(F.size("_f") >= 4)
    num = lambda k: F.coalesce(F.get("_f", F.lit(k)).try_cast("double"), F.lit(0.0))
    out = rows.select("sample_id", F.get("_f", F.lit(0)).alias("class"), F.get("_f", F.lit(1)).alias("superfamily"), num(2).alias("intact"), num(3).alias("fragment"))
    w = Window.partitionBy("sample_id")
    share = lambda c: F.when(F.sum(c).over(w) > 0, F.col(c) / F.sum(c).over(w)).otherwise(1.0 / F.count("*").over(w))
    return out.withColumns({"intact": share("intact"), "fragment": share("fragment")})


DIVERGENCE = ("LTR_RT_name", "LTR_LEN", "ALN_LEN", "substitutions", "transitions", "transversions", "raw_d", "raw_T", "JC69_d", "JC69_T", "K2P_d", "K2P_T")


def read_divergence(spark: SparkSession, path) -> DataFrame:
    """Divergence tables as (sample_id, generation, line_no, element, values): values maps lower-case column names to numbers, null where a cell is none. A file's first line is its
    header if its second field is no number (a leading `#` is dropped), else the twelve columns are the usual ones."""
    rows = read_lines(spark, path).filter(F.trim("value") != "")
    first = rows.groupBy("sample_id").agg(F.min_by("value", "line_no").alias("_head"), F.min("line_no").alias("_line"))
    rows = rows.join(F.broadcast(first), "sample_id")
    told = F.get(F.split("_head", "\t"), F.lit(1)).try_cast("double").isNull()
    head = F.when(told, F.split(F.regexp_replace("_head", "^#", ""), "\t")).otherwise(F.array(*map(F.lit, DIVERGENCE)))
    rows = rows.withColumns({"_h": F.transform(head, lambda c: F.lower(F.trim(c))), "_f": F.split("value", "\t")}).filter(~told | (F.col("line_no") > F.col("_line")))
    n = F.least(F.size("_h"), F.size("_f"))
    values = F.map_from_arrays(F.slice("_h", 2, F.greatest(F.lit(0), n - 1)), F.transform(F.slice("_f", 2, F.greatest(F.lit(0), n - 1)), lambda x: x.try_cast("double")))
    return rows.filter(n > 0).select("sample_id", "generation", "line_no", F.get("_f", F.lit(0)).alias("element"), values.alias("values"))


HSP = ("qseqid", "sseqid", "sstart", "send", "slen", "qstart", "qend", "qlen", "aln_len", "nident", "btop")


def read_hsps(spark: SparkSession, path) -> DataFrame:
    rows = read_lines(spark, path).withColumn("_f", F.split("value", "\t")).filter(F.size("_f") >= len(HSP))
    return rows.select("sample_id", "line_no", *(F.get("_f", F.lit(k)).cast("string" if c in ("qseqid", "sseqid", "btop") else "bigint").alias(c) for k, c in enumerate(HSP)))


def read_log(spark: SparkSession, path) -> DataFrame:
    return read_lines(spark, path).select(F.col("sample_id").alias("source"), "line_no", "value")


def read_report(spark: SparkSession, path) -> DataFrame:
    """Pipeline reports: Generation, `n(nest/nonnest)`, calculated and actual deletions; the header line is skipped."""
    rows = _content(read_lines(spark, path)).withColumn("_f", F.split("value", r"\t|\s{2,}|\s(?=\d)")).filter(F.size("_f") >= 4)
    at = lambda k: F.get("_f", F.lit(k))
    cell = lambda k: F.regexp_extract(at(1), r"^(\d+)(?:\((\d+)/(\d+)\))?", k).try_cast("bigint")
    out = rows.select("sample_id", "line_no", at(0).try_cast("bigint").alias("generation"), cell(1).alias("inserts"), cell(2).alias("nested"), cell(3).alias("nonnested"), at(2).try_cast("bigint").alias("deletions_calc"), at(3).try_cast("bigint").alias("deletions_actual"))
    return out.filter("generation is not null")


MUTATION_KEYS = {"genome size": "genome_size", "total mutations": "mutations", "recurrent mutations": "recurrent", "mutions / site": "per_site", "mutations / site": "per_site"}


def read_mutation_reports(spark: SparkSession, path) -> DataFrame:
    """`key: value` reports, one row a file; both spellings of the rate are read."""
    rows = read_lines(spark, path).select("sample_id", "generation", F.lower(F.trim(F.substring_index("value", ":", 1))).alias("_k"), F.regexp_replace(F.regexp_extract("value", r":\s*([-+0-9.,eE]+)", 1), ",", "").try_cast("double").alias("_v"))
    known = F.create_map(*(F.lit(x) for kv in MUTATION_KEYS.items() for x in kv))
    rows = rows.withColumn("_k", known[F.col("_k")]).filter("_k is not null and _v is not null")
    return rows.groupBy("sample_id", "generation").pivot("_k", sorted(set(MUTATION_KEYS.values()))).agg(F.first("_v"))


def read_stat_blocks(spark: SparkSession, path) -> DataFrame:
    """`SAMPLE: n` blocks: (file, sample, category, n) of the `category: count` lines up to the next block."""
    lines = _content(read_lines(spark, path))
    from ..operators.ordering import part_of, with_prefix

    sample = F.when(F.startswith("value", F.lit("SAMPLE:")), F.trim(F.substr("value", F.lit(8))))
    # the last title before a line: of titles by line the greatest
    title = F.when(sample.isNotNull(), F.struct("line_no", sample.alias("s")))
    lines = with_prefix(lines, ["sample_id"], [part_of("line_no")], ["line_no"], title, "_title", F.max).withColumn("sample", F.col("_title.s"))
    n = F.regexp_extract("value", r":\s*(\d+)", 1).try_cast("bigint")
    out = lines.filter(F.col("sample").isNotNull() & ~F.startswith("value", F.lit("SAMPLE:")) & n.isNotNull())
    return out.select("sample_id", "sample", F.trim(F.substring_index("value", ":", 1)).alias("category"), n.alias("n"))


def read_wide_stats(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """A wide statistics table as keys, file, n, generation."""
    from ..operators.reports import stats_long

    return stats_long(spark.read.csv(path, sep="\t", header=True), keys)

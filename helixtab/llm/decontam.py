"""Benchmark decontamination by template canonicalisation, with DataFrame expressions only.

Texts are reduced to templates: numbers, names (capitalised words inside a sentence, whatever white space or quotation marks stand
before them) and units after numbers become typed placeholders, other words are lower-cased without punctuation. Windows of WINDOW
template words of every document are hash-joined with those of the benchmark. Matches of a document and an item on one diagonal
(document position minus item position) form passages, one for each maximal run of adjacent windows; a passage counts if its slots are
consistent: on it each value of the item stands for one value of the document and the other way round, for numbers, names and units
alike. So a question with other numbers or names is caught, and a different table of numbers is not.

* Windows without placeholders are equal word for word and count in any passage.
* Windows with placeholders are joined word for word too. Where one is found that way alone (a name at the start of an item is no
  name inside a sentence), it counts in any passage.
* Windows with more than MOST_SLOTS placeholders say little: word for word they count in any passage; by template their runs count if
  they are consistent and hold LITERALS different plain words at least.
* Items of fewer words than a window count where all their words stand in a row in a document (ITEM_WORDS words at least) or are a whole line or
  sentence of it (fewer words); and by template where they stand in a row in a document with consistent slots, if they hold SHORT_PLAIN different plain words at least: with fewer, any such
  phrase of clean text would be one.

Null texts are empty and match nothing. Rows with a null id are returned with no match; of rows that repeat an id each text is searched
by itself, and all of them have what is found in any. Empty documents or an empty benchmark: no matches. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bitmap, only, with_bit

WINDOW = 8
MOST_SLOTS = 3
#: Different plain words that a run of windows full of placeholders must hold, and words of an item that is found inside a sentence.
LITERALS, ITEM_WORDS = 5, 5
#: Different plain words of a short item that is found by template inside a text.
SHORT_PLAIN = 3
#: The benchmark is broadcast up to this many windows and bytes of text, and joined by shuffle beyond.
BROADCAST_WINDOWS, BROADCAST_BYTES = 500_000, 1 << 25
NAME, NUMBER, UNIT = "\x01", "\x02", "\x03"
#: Units that count as one after a number.
UNITS = "mm cm m km in ft yd mi mg g kg t lb lbs oz ml l s sec min h hr hrs ms day days week weeks month months year years hour hours minute minutes second seconds mph kmh kph hz khz mhz ghz w kw mw v kv a ma j kj cal kcal pa kpa bar k c f usd eur gbp dollar dollars cent cents euro euros pound pounds percent meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet gram grams kilogram kilograms liter liters litre litres ton tons".split()


#: Signs and punctuation: those of ASCII, and ranges of others.
SIGNS = r"[!-/:-@\[-`{-~]+"
OTHER_SIGNS = r"[\u00a1-\u00bf\u00d7\u00f7\u2010-\u2bff\u3001-\u303f\uff01-\uff0f\uff1a-\uff20]+"
BLANKS = " \t\n\x0b\x0c\r"
OPENS = "[\"'(\\[\u201c\u201e\u2018\u201a\u00ab]"
CLOSES = "[\"')\\]\u201d\u2019\u00bb]"
#: Ends of lines and sentences.
ENDS = r"[\r\n]+|[.!?\u2026]+(?=\s|$)"


def marked(text: Column) -> Column:
    """Lower-cased text without punctuation, names marked by \\x01 and numbers by \\x02 at their start; white space stays inside. A column to be named before
    it is used, as are those below: Spark evaluates a named column once."""
    t = F.coalesce(text, F.lit(""))
    own = [F.contains(t, F.lit(c)) for c in (NAME, NUMBER, UNIT)]
    t = F.when(own[0] | own[1] | own[2], F.translate(t, NAME + NUMBER + UNIT, "")).otherwise(t)
    t = F.regexp_replace(t, rf"([ \t-\r]{OPENS}?)(?=\p{{Lu}}\p{{Ll}})(?<=[\p{{L}}\p{{N}},;]{CLOSES}?[ \t-\r]{{1,2}}{OPENS}?)", "$1" + NAME)
    t = F.when(t.rlike("[0-9]"), F.regexp_replace(t, r"(?=\p{Sc}?[0-9])(?<![\p{L}\p{N}\p{Sc}.,:/])", NUMBER)).otherwise(t)
    t = F.regexp_replace(F.lower(t), SIGNS, "")
    t = F.when(F.octet_length(text) > F.length(text), F.regexp_replace(t, OTHER_SIGNS, "")).otherwise(t)
    return F.btrim(t, F.lit(BLANKS))


def template(marked_text: Column) -> Column:
    """Placeholders for marked values; word for word in line with the marked text."""
    t = F.when(F.contains(marked_text, F.lit(NAME)), F.regexp_replace(marked_text, r"\x01[^\s\x01\x02]+", NAME)).otherwise(marked_text)
    units = "|".join(sorted(UNITS, key=lambda u: (-len(u), u)))
    with_numbers = F.regexp_replace(F.regexp_replace(t, r"\x02[0-9]+", NUMBER), rf"(?<=\x02\s?)(?:{units})(?!\S)", UNIT)
    return F.when(F.contains(t, F.lit(NUMBER)), with_numbers).otherwise(t)


def tokens(c: Column) -> Column:
    """Words of a trimmed text."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, "[ \\t-\\r]+", -1))


def with_words(df: DataFrame, values: str, words: str) -> DataFrame:
    """Adds the marked words and the template words of `text`, each step a column of its own."""
    return df.withColumn("_m", marked(F.col("text"))).withColumn("_t", template(F.col("_m"))).withColumns({values: tokens(F.col("_m")), words: tokens(F.col("_t"))}).drop("_m", "_t")


def unmarked(marked_text: Column) -> Column:
    return F.translate(marked_text, NAME + NUMBER, "")


def _window(hashes: Column, i: Column, width: int) -> Column:
    return F.xxhash64(*(F.get(hashes, i + k) for k in range(width)))


def windows(hashes: Column, width: int) -> Column:
    """array<bigint>: hash of each window, in order of position, from a named column of word hashes."""
    n = F.size(hashes)
    return F.when(n >= width, F.transform(F.sequence(F.lit(0), n - width), lambda i: _window(hashes, i, width))).when(n > 0, F.array(F.xxhash64(hashes, F.lit("short")))).otherwise(F.array().cast("array<bigint>"))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def has_slot(word: Column) -> Column:
    return F.contains(word, F.lit(NAME)) | F.contains(word, F.lit(NUMBER)) | F.contains(word, F.lit(UNIT))


def _benchmark(items: DataFrame, width: int, most_slots: int) -> DataFrame:
    """items(item_id, values, words) -> h, item_id, item_pos, kind of each window: plain, few (slots), many, or literal."""
    hashed = items.withColumn("plain", F.transform("values", lambda w: unmarked(w))).withColumns({"wh": word_hashes(F.col("words")), "ph": word_hashes(F.col("plain"))})
    each = F.arrays_zip(windows(F.col("wh"), width).alias("t"), windows(F.col("ph"), width).alias("l"))
    at = hashed.select("item_id", "words", F.posexplode(each).alias("item_pos", "h")).withColumn("own", F.slice("words", F.col("item_pos") + 1, F.lit(width)))
    at = at.select("item_id", "item_pos", "h", F.size(F.filter("own", has_slot)).alias("slots"), F.size(F.array_distinct(F.filter("own", lambda w: ~has_slot(w)))).alias("literals"))
    kind = F.when(F.col("slots") == 0, "plain").when(F.col("slots") <= most_slots, "few").when(F.col("literals") > 1, "many")
    by_template = at.select(F.col("h.t").alias("h"), "item_id", "item_pos", kind.alias("kind")).filter("kind is not null")
    return by_template.unionByName(at.filter("slots > 0").select(F.col("h.l").alias("h"), "item_id", "item_pos", F.lit("literal").alias("kind")))


def _document_windows(rows: DataFrame, width: int) -> DataFrame:
    """rows(doc_id, th, text) -> doc_id, th, pos, h: windows by template, and those with placeholders word for word too. Each step is a
    column of its own, so that nothing is evaluated for each use."""
    own = rows.withColumn("_m", marked(F.col("text"))).withColumn("_t", template(F.col("_m")))
    own = own.select("doc_id", "th", tokens(F.col("_t")).alias("tw"), F.when(has_slot(F.col("_t")), word_hashes(tokens(unmarked(F.col("_m"))))).alias("ph"))
    own = own.select("doc_id", "th", word_hashes(F.col("tw")).alias("wh"), "ph", F.when(F.col("ph").isNotNull(), F.array_compact(F.transform("tw", lambda w, i: F.when(has_slot(w), i)))).alias("places"))
    place = lambda c: F.transform(c, lambda h, i: F.struct(i.alias("pos"), h.alias("h")))
    n = F.size("wh")
    around = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(F.greatest(F.lit(0), p - width + 1), F.least(p, n - width)))))
    literal = F.when(n >= width, F.transform(around, lambda i: F.struct(i.alias("pos"), _window(F.col("ph"), i, width).alias("h")))).otherwise(place(windows(F.col("ph"), width)))
    by_template = place(windows(F.col("wh"), width))
    return own.select("doc_id", "th", F.inline(F.when(F.col("ph").isNull(), by_template).otherwise(F.concat(by_template, literal))))


def _short(rows: DataFrame, items: DataFrame, width: int) -> DataFrame | None:
    """doc_id and item_id where an item of fewer words than a window stands in a document; None if there is no such item."""
    short = items.select("item_id", F.transform("values", lambda w: unmarked(w)).alias("ws")).filter(F.size("ws").between(1, width - 1)).select("item_id", F.size("ws").alias("n"), F.xxhash64("ws").alias("h"))
    lengths = sorted(r["n"] for r in short.select("n").distinct().collect())  # below the width of a window
    if not lengths:
        return None
    words = lambda text: tokens(unmarked(marked(text)))
    named = rows.select("doc_id", words(F.col("text")).alias("ws"), F.transform(F.split(F.coalesce("text", F.lit("")), ENDS, -1), lambda x: words(x)).alias("lines"))
    long = [n for n in lengths if n >= ITEM_WORDS]
    rows_of = lambda n: F.when(F.size("ws") >= n, F.transform(F.sequence(F.lit(1), F.size("ws") - n + 1), lambda i: F.xxhash64(F.slice("ws", i, F.lit(n))))).otherwise(F.array().cast("array<bigint>"))
    each = [rows_of(n) for n in long]
    if len(long) < len(lengths):
        each.append(F.transform(F.filter("lines", lambda x: F.size(x).isin([n for n in lengths if n < ITEM_WORDS])), lambda x: F.xxhash64(x)))
    found = named.select("doc_id", F.explode(F.array_distinct(F.concat(*each))).alias("h")).join(short, "h")
    return found.select("doc_id", "item_id").distinct()


def _short_by_template(rows: DataFrame, items: DataFrame, width: int) -> DataFrame | None:
    """doc_id and item_id where an item of fewer words than a window stands in a document with other values; None if there is no such item. Only windows around placeholders are
    looked up, of the widths that such items have; their words come with them, so no document is read again."""
    plain = F.size(F.array_distinct(F.filter("words", lambda w: ~has_slot(w))))
    short = items.filter(F.size("words").between(1, width - 1) & F.exists("words", has_slot) & (plain >= SHORT_PLAIN)).select("item_id", F.size("words").alias("n"), F.xxhash64("words").alias("h"), "words", F.col("values").alias("b"))
    lengths = sorted(r["n"] for r in short.select("n").distinct().collect())  # below the width of a window
    if not lengths:
        return None
    named = with_words(rows.select("doc_id", "text"), "dv", "dw").filter(F.exists("dw", has_slot)).select("doc_id", "dv", "dw")
    named = named.withColumn("places", F.array_compact(F.transform("dw", lambda w, i: F.when(has_slot(w), i))))

    def around(n: int) -> Column:
        starts = F.array_distinct(F.flatten(F.transform("places", lambda p: F.when(F.size("dw") >= n, F.sequence(F.greatest(F.lit(0), p - n + 1), F.greatest(F.greatest(F.lit(0), p - n + 1), F.least(p, F.size("dw") - n)))).otherwise(F.array().cast("array<int>")))))
        starts = F.filter(starts, lambda i: i + n <= F.size("dw"))
        return F.transform(starts, lambda i: F.struct(F.lit(n).alias("n"), F.xxhash64(F.slice("dw", i + 1, F.lit(n))).alias("h"), F.slice("dv", i + 1, F.lit(n)).alias("d")))

    found = named.select("doc_id", F.inline(F.concat(*map(around, lengths)))).join(short, ["n", "h"])
    pairs = F.array_distinct(F.transform(F.filter(F.arrays_zip("words", "d", "b"), lambda x: has_slot(x["words"])), lambda x: F.struct(x["d"].alias("d"), x["b"].alias("b"))))
    found = found.select("doc_id", "item_id", pairs.alias("slots"))
    one = lambda side: F.size(F.array_distinct(F.transform("slots", lambda s: s[side]))) == F.size("slots")
    return found.filter(one("d") & one("b")).select("doc_id", "item_id").distinct()


def passages(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, most_slots: int = MOST_SLOTS) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> doc_id, item_id, diagonal, first, last, n_windows, slots, consistent."""
    scratch, used = Scratch(docs.sparkSession), []

    def keep(df: DataFrame, name: str) -> DataFrame:
        used.append(scratch.write(df, name))
        return used[-1]

    rows = only(docs, doc_id="bigint", text="string").filter("doc_id is not null").withColumn("th", F.xxhash64("text"))
    given = only(benchmark, item_id="bigint", text="string").filter("item_id is not null")
    items = keep(with_words(given, "values", "words").select("item_id", "values", "words"), "items")
    at = keep(_benchmark(items, width, most_slots), "windows")
    n_bytes = given.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    small = at.count() <= BROADCAST_WINDOWS and n_bytes <= BROADCAST_BYTES
    hits = _document_windows(rows, width).join(F.broadcast(at) if small else at, "h")
    of = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("pos"))).alias(kind)
    found = hits.groupBy("doc_id", "th", "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal")).agg(*map(of, ("plain", "few", "many", "literal")))
    found = keep(found, "hits")  # two kinds of runs are made of them
    # word for word alone, or too full of placeholders to tell by template
    found = found.withColumn("exact", F.array_union("plain", F.array_except("literal", "few")))
    sure = found.withColumn("at", F.sort_array(F.array_union("exact", "few")))
    full = found.filter(F.size(F.array_except("many", "exact")) > 0).withColumn("at", F.sort_array(F.array_union(F.array_union("exact", "few"), "many")))
    begins, ends = F.filter("at", lambda p, i: (i == 0) | (F.get("at", i - 1) != p - 1)), F.filter("at", lambda p, i: (i == F.size("at") - 1) | (F.get("at", i + 1) != p + 1))

    def runs(df: DataFrame, counted: Column, own: Column) -> DataFrame:
        """counted: positions that count where the run is consistent, own: those that count in any."""
        out = df.select("doc_id", "th", "item_id", "diagonal", counted.alias("counted"), own.alias("own"), F.explode(F.arrays_zip(begins.alias("first"), ends.alias("last"))).alias("run"))
        inside = lambda c: F.size(F.filter(c, lambda p: p.between(F.col("run.first"), F.col("run.last"))))
        return out.select("doc_id", "th", "item_id", "diagonal", "run.first", "run.last", inside("counted").alias("n"), inside("own").alias("n_exact"))

    none = F.array().cast("array<int>")
    found = runs(sure, F.col("at"), F.col("exact")).withColumn("full", F.lit(False)).unionByName(runs(full, F.array_except("many", "exact"), none).filter("n > 0").withColumn("full", F.lit(True)))
    found = keep(found, "found")
    # texts of the documents with hits alone are read again, and their words written once: a bitmap of fixed size says which they may be
    wanted = with_bit(rows, "th", bitmap(found, "th")).filter("may")
    wanted = keep(with_words(wanted.select("doc_id", "th", "text"), "dv", "dw").select("doc_id", "th", "dv", "dw"), "wanted").dropDuplicates(["doc_id", "th"])
    both = found.join(wanted, ["doc_id", "th"]).join(F.broadcast(items) if small else items, "item_id")
    span = lambda c, start: F.slice(c, F.greatest(F.lit(1), start + 1), F.col("last") - F.col("first") + width)
    aligned = F.arrays_zip(span(F.col("dv"), F.col("first")).alias("d"), span(F.col("dw"), F.col("first")).alias("dt"), span(F.col("values"), F.col("first") - F.col("diagonal")).alias("b"), span(F.col("words"), F.col("first") - F.col("diagonal")).alias("bt"))
    both = keep(both.select("doc_id", "item_id", "diagonal", "first", "last", "n", "n_exact", "full", aligned.alias("aligned")), "aligned")
    pairs = F.array_distinct(F.transform(F.filter("aligned", lambda x: (x["dt"] == x["bt"]) & has_slot(x["bt"])), lambda x: F.struct(x["d"].alias("d"), x["b"].alias("b"))))
    literals = F.size(F.array_distinct(F.transform(F.filter("aligned", lambda x: (x["dt"] == x["bt"]) & ~has_slot(x["bt"])), lambda x: x["bt"])))
    out = both.withColumns({"slots": pairs, "literals": literals})
    one_to_one = (F.size(F.array_distinct(F.transform("slots", lambda s: s["d"]))) == F.size("slots")) & (F.size(F.array_distinct(F.transform("slots", lambda s: s["b"]))) == F.size("slots"))
    told = one_to_one & (~F.col("full") | (F.col("literals") >= LITERALS))
    out = out.select("doc_id", "item_id", "diagonal", "first", "last", F.when(told, F.col("n")).otherwise(F.col("n_exact")).cast("bigint").alias("n_windows"), "slots", (told | (F.col("n_exact") > 0)).alias("consistent"))
    both_ways = [x for x in (_short(rows, items, width), _short_by_template(rows, items, width)) if x is not None]
    if both_ways:
        zero, short = F.lit(0), both_ways[0]
        for more in both_ways[1:]:
            short = short.unionByName(more).distinct()
        short = short.join(out.filter("consistent").select("doc_id", "item_id"), ["doc_id", "item_id"], "left_anti")
        out = out.unionByName(short.select("doc_id", "item_id", zero.alias("diagonal"), zero.alias("first"), zero.alias("last"), F.lit(1).cast("bigint").alias("n_windows"), F.array().cast("array<struct<d:string,b:string>>").alias("slots"), F.lit(True).alias("consistent")))
    out = scratch.write(out.distinct(), "passages")
    scratch.drop(*used)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, most_slots: int = MOST_SLOTS) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> doc_id, contaminated, n_windows, item_ids; one row per document."""
    found = passages(docs, benchmark, width, most_slots).filter("consistent").groupBy("doc_id").agg(F.sum("n_windows").alias("n"), F.sort_array(F.collect_set("item_id")).alias("items"))
    found = found.withColumnRenamed("doc_id", "d")
    out = only(docs, doc_id="bigint").join(found, F.col("doc_id") == F.col("d"), "left")
    return out.select("doc_id", F.col("d").isNotNull().alias("contaminated"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_windows"), F.coalesce("items", F.array().cast("array<bigint>")).alias("item_ids"))


def contaminated_ids(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, most_slots: int = MOST_SLOTS) -> DataFrame:
    """doc_id of the documents with a consistent passage, each once."""
    return passages(docs, benchmark, width, most_slots).filter("consistent").select("doc_id").distinct()

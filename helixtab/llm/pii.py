"""Personal data by weak supervision, with DataFrame expressions only.

Base patterns (email, ip, card, phone) give spans that always stay. Looser patterns give further candidates (addresses spelt out,
local phone numbers, national ids, account numbers, secrets, titled names). Labelers vote on every candidate: the strict
pattern, a validity check, gazetteers, the words before it and the characters around it, each for, against or abstaining.
Expectation-maximisation over the counts of vote patterns (a table of fixed size: kinds x 3^labelers) estimates how reliable each
labeler is and how likely each pattern of votes is personal data. With these probabilities as soft labels a span classifier is trained,
naive Bayes over the votes and the shape of the span; its verdict decides on the candidates beyond the base spans.

A match and its place come from the same expression: the text is split by the pattern, and lengths of pieces and matches add up.
Offsets are code points, ends exclusive. Null text is empty. Ids are carried as they are; repeated rows are documents of their own. Empty table:
empty result. Extra columns are ignored by find() but for those named in `keep`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import STEP, Scratch, cut, let, pieces_of, running

BASE = ("email", "ip", "card", "phone")
EXTRA = ("contact", "local", "national_id", "account", "secret", "name")
KINDS = BASE + EXTRA
#: Base patterns, fixed by the contract; possessive or anchored where that finds the same matches without
#: recursion or quadratic search.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "contact": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:[\[(]dot[\])]|\.)\x20?[A-Za-z0-9-]{2,}+)++",
    "local": r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])",
    "secret": r"(?i)(?<![a-z])(?:token|api_?key|secret|password|passwd)\x20?[=:]\x20?[\"'][A-Za-z0-9+/=_-]{12,}+[\"']",
    "name": r"(?<!\p{L})(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20\p{Lu}\p{Ll}+(?:\x20\p{Lu}\p{Ll}+)?",
}
#: Gazetteers: fixed values. Words before a span, in English, French, German and Spanish.
DOMAINS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info", "biz", "it", "nl", "ch", "at", "us", "ca")
FOR_WORDS = ("email", "e-mail", "mail", "contact", "write", "call", "phone", "tel", "telephone", "mobile", "fax", "ip", "host", "address", "server", "card", "visa", "credit", "payment", "account", "iban", "ssn", "id", "token", "key", "secret", "password", "name", "signed", "dear", "from", "to", "by",
    "courriel", "adresse", "téléphone", "portable", "carte", "compte", "mot", "clé", "serveur", "appelez", "écrivez", "telefon", "handy", "anschrift", "karte", "konto", "kennwort", "passwort", "schlüssel", "server", "correo", "dirección", "teléfono", "móvil", "tarjeta", "cuenta", "contraseña", "clave", "servidor", "llame", "escriba")
AGAINST_WORDS = ("version", "release", "section", "page", "chapter", "fig", "figure", "table", "isbn", "issn", "doi", "no", "number", "item", "order", "ref", "step", "seite", "kapitel", "abschnitt", "nummer", "chapitre", "numéro", "página", "capítulo", "sección", "número")
LABELERS = ("strict", "valid", "gazetteer", "context", "edges")
#: Most characters before a span in which its context word is looked for.
REACH = 40


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start,end,value,before,after>> of all matches, left to right; before: up to REACH characters from the match before
    on, after: one. All come from the pieces between matches, never from counting through the text, so the time is about linear."""

    def of(s: Column) -> Column:
        pieces, values = s["pieces"], s["values"]
        ends = running(F.zip_with(F.slice(pieces, F.lit(1), F.size(values)), values, lambda p, v: F.length(p) + F.length(v)), F.lit(0), lambda at, n: at + n)

        def one(v: Column, i: Column, e: Column) -> Column:
            piece, following = F.get(pieces, i), F.get(pieces, i + 1)
            before = F.when(F.length(piece) >= REACH, piece).otherwise(F.concat(F.coalesce(F.get(values, i - 1), F.lit("")), piece))
            return F.struct(
                (F.get(e, i) + F.length(piece)).alias("start"), F.get(e, i + 1).alias("end"), v.alias("value"), F.right(before, F.lit(REACH)).alias("before"),
                F.left(F.when(following != "", following).otherwise(F.coalesce(F.get(values, i + 1), F.lit(""))), F.lit(1)).alias("after"))

        return let(ends, lambda e: F.transform(values, lambda v, i: one(v, i, e)))

    return let(F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values")), of)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True if the check digit of a string of digits is right."""
    n = F.length(number)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(number, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.when(n > 0, F.aggregate(each, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0).otherwise(False)


def valid(kind: str, value: Column) -> Column:
    d = digits(value)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int"), F.lit(256)) <= 255))
    if kind == "card":
        return F.length(d).between(16, 19) & luhn(d)
    if kind == "phone":
        return F.length(d).between(8, 15)
    if kind == "local":
        return ~d.rlike(r"^(.)\1*$|^[01]")
    if kind == "national_id":
        return ~d.rlike(r"^(?:000|666|9)|^...00|0000$")
    if kind == "account":
        return F.length(F.replace(value, F.lit(" "), F.lit(""))).between(15, 34)
    if kind == "secret":
        return F.size(F.array_distinct(F.split(F.regexp_extract(value, "[\"'](.*)[\"']", 1), ""))) >= 8
    return F.lit(True)


def gazetteer(kind: str, value: Column) -> Column:
    """1, 0 or -1 from word lists."""
    if kind in ("email", "contact"):
        return F.when(F.lower(F.regexp_extract(value, "([A-Za-z0-9-]+)$", 1)).isin(*DOMAINS), 1).otherwise(0)
    if kind == "ip":
        return F.when(value.rlike(r"^(?:0|127|255)\.|\.0\.0\.0$"), -1).otherwise(0)
    if kind == "card":
        return F.when(value.rlike("^[3456]"), 1).otherwise(0)
    if kind == "local":
        return F.when(digits(value).rlike("^[2-9]..[2-9]"), 1).otherwise(-1)
    return F.lit(0)


def _candidates(text: Column, kind: str) -> Column:
    """array<struct<kind,start,end,base,votes,shape>> of one kind."""
    base = kind in BASE

    def judge(m: Column) -> Column:
        word = F.lower(F.regexp_extract(m["before"], r"([\p{L}-]+)[^\p{L}]{0,3}$", 1))
        left, right = F.right(m["before"], F.lit(1)), m["after"]
        ok = valid(kind, m["value"])
        odd = left.rlike(r"[\p{L}\p{N}_.=/-]") | right.rlike(r"[\p{L}\p{N}_=/-]")
        votes = F.array(
            F.lit(1 if base else 0),
            F.when(ok, 1 if kind not in ("email", "contact", "name") else 0).otherwise(-1),
            gazetteer(kind, m["value"]),
            F.when(word.isin(*FOR_WORDS), 1).when(word.isin(*AGAINST_WORDS), -1).otherwise(0),
            F.when(odd, -1).otherwise(0))
        return F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), (ok & F.lit(base)).alias("base"), votes.cast("array<int>").alias("votes"), F.least(F.lit(9), F.floor(F.log2(m["end"] - m["start"] + 1))).cast("int").alias("shape"))

    return F.transform(matches(text, PATTERNS[kind]), judge)


#: What a text must hold before a pattern is tried: cheap searches that most texts fail.
HOLDS = {
    "email": lambda t: F.contains(t, F.lit("@")), "phone": lambda t: F.contains(t, F.lit("+")), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
    "contact": lambda t: F.contains(t, F.lit("(at)")) | F.contains(t, F.lit("[at]")), "local": lambda t: t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"), "national_id": lambda t: t.rlike("[0-9]-[0-9]{2}-[0-9]"),
    "account": lambda t: t.rlike("[A-Z]{2}[0-9]{2}"), "secret": lambda t: F.contains(t, F.lit('"')) | F.contains(t, F.lit("'")), "name": lambda t: F.contains(t, F.lit("Mr")) | F.contains(t, F.lit("Ms")) | F.contains(t, F.lit("Dr")) | F.contains(t, F.lit("Prof")),
}
SPAN = "array<struct<kind:string,start:int,end:int,base:boolean,votes:array<int>,shape:int>>"


def candidates(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and `found`: candidates of all kinds."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = F.array().cast(SPAN)
    parts = [F.when(HOLDS[k](F.col("_t")), _candidates(F.col("_t"), k)).otherwise(none) for k in KINDS]
    return docs.withColumn("_t", text).select(*(F.col(f"`{c}`") for c in keep), F.concat(*parts).alias("found"))


#: Counts that (vote, truth) start with: a labeler is taken to be better than chance until the data say otherwise.
BELIEF = {(1, 1): 3.0, (0, 1): 2.0, (-1, 1): 0.5, (1, 0): 0.5, (0, 0): 2.0, (-1, 0): 3.0}


def estimate(patterns: dict[tuple[str, tuple[int, ...]], int], rounds: int = 50) -> dict[tuple[str, tuple[int, ...]], float]:
    """Expectation-maximisation over counts of vote patterns: probability that a candidate with these votes is personal data.
    Each labeler has a probability of each vote given the truth; the share of true ones is estimated per kind."""
    post = {}
    for key in patterns:
        total = sum(key[1])
        post[key] = min(0.95, max(0.05, 0.5 + 0.2 * total))
    kinds = {k for k, _ in patterns}
    for _ in range(rounds):
        vote = {(m, v, y): BELIEF[v, y] for m in range(len(LABELERS)) for v in (-1, 0, 1) for y in (0, 1)}
        prior = {k: [1.0, 2.0] for k in kinds}
        for (kind, votes), n in patterns.items():
            p = post[kind, votes]
            prior[kind][0] += n * p
            prior[kind][1] += n
            for m, v in enumerate(votes):
                vote[m, v, 1] += n * p
                vote[m, v, 0] += n * (1 - p)
        sums = {(m, y): sum(vote[m, v, y] for v in (-1, 0, 1)) for m in range(len(LABELERS)) for y in (0, 1)}
        moved = 0.0
        for kind, votes in patterns:
            odds = math.log(prior[kind][0] / max(1e-9, prior[kind][1] - prior[kind][0]))
            for m, v in enumerate(votes):
                # a vote for never counts against, and the other way round
                step = math.log(vote[m, v, 1] / sums[m, 1]) - math.log(vote[m, v, 0] / sums[m, 0])
                odds += max(0.0, step) if v > 0 else min(0.0, step) if v < 0 else 0.0
            new = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
            moved = max(moved, abs(new - post[kind, votes]))
            post[kind, votes] = new
        if moved < 1e-6:
            break
    return post


def _features(kind, votes, shape) -> list[tuple]:
    return [("shape", kind, shape), *((name, votes[m]) for m, name in enumerate(LABELERS))]


def classifier(counts: dict[tuple[str, tuple[int, ...], int], int]) -> dict[tuple[str, tuple[int, ...], int], bool]:
    """Trains the final classifier on soft labels, and its verdict on each (kind, votes, shape) that occurs."""
    patterns: dict[tuple[str, tuple[int, ...]], int] = {}
    for (kind, votes, _), n in counts.items():
        patterns[kind, votes] = patterns.get((kind, votes), 0) + n
    post = estimate(patterns)
    seen = {((name, v), y): b for name in LABELERS for (v, y), b in BELIEF.items()}
    totals, prior = [5.5, 5.5], {}
    for (kind, votes, shape), n in counts.items():
        p = post[kind, votes]
        mine = prior.setdefault(kind, [1.0, 1.0])
        for y, w in ((1, n * p), (0, n * (1 - p))):
            totals[y] += w
            mine[y] += w
            for f in _features(kind, votes, shape):
                seen[f, y] = seen.get((f, y), 0.5) + w
    out = {}
    for key in counts:
        odds = math.log(prior[key[0]][1] / prior[key[0]][0])
        for f in _features(*key):  # a shape is seen within its kind, a vote in all kinds
            norm = prior[key[0]] if f[0] == "shape" else totals
            odds += math.log(seen.get((f, 1), 0.5) / norm[1]) - math.log(seen.get((f, 0), 0.5) / norm[0])
        out[key] = odds > 0
    return out


def _ranges(spans: Column) -> Column:
    """Spans by start in lists of STEP with the range that each list covers, so that most lists are passed over at once."""
    def of(each: Column) -> Column:
        lists = F.transform(F.sequence(F.lit(0), F.floor((F.size(each) - 1) / STEP).cast("int")), lambda k: F.slice(each, k * STEP + 1, F.lit(STEP)))
        return F.when(F.size(each) > 0, F.transform(lists, lambda x: F.struct(F.array_min(F.transform(x, lambda b: b["start"])).alias("lo"), F.array_max(F.transform(x, lambda b: b["end"])).alias("hi"), x.alias("each"))))

    ranges = let(F.sort_array(F.transform(spans, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end")))), of)
    return F.coalesce(ranges, F.array().cast("array<struct<lo:int,hi:int,each:array<struct<start:int,end:int>>>>"))


def find(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs(doc_id, text) -> the kept columns and `spans`, array<struct<kind,start,end,base>> by kind and start."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.write(candidates(docs, keep), "candidates")
    each = found.filter(F.size("found") > 0).select(F.explode("found").alias("f"))
    rows = each.groupBy("f.kind", "f.votes", "f.shape").count().collect()  # at most kinds x 3^5 x 10 rows
    verdict = classifier({(r["kind"], tuple(r["votes"]), r["shape"]): r["count"] for r in rows})
    accepted = sorted(f"{k}/{','.join(map(str, v))}/{s}" for (k, v, s), yes in verdict.items() if yes and k in EXTRA)
    name = lambda f: F.concat_ws("/", f["kind"], F.array_join(f["votes"].cast("array<string>"), ","), f["shape"].cast("string"))
    base = F.filter("found", lambda f: f["base"])
    more = F.filter("found", lambda f: name(f).isin(*accepted)) if accepted else F.array().cast(SPAN)
    clear = F.when(F.size(more) > 0, let(_ranges(base), lambda r: F.filter(more, lambda f: ~F.exists(r, lambda x: (x["lo"] < f["end"]) & (f["start"] < x["hi"]) & F.exists(x["each"], lambda b: (b["start"] < f["end"]) & (f["start"] < b["end"])))))).otherwise(F.array().cast(SPAN))
    slim = lambda c: F.transform(c, lambda f: F.struct(f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end"), f["base"].alias("base")))
    return found.select(*(F.col(f"`{c}`") for c in keep), F.when(F.size("found") > 0, slim(F.concat(base, clear))).otherwise(slim(F.col("found"))).alias("spans"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """The digest columns of op7."""
    out = find(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("bigint").alias(f"n_{kind}")
    return out.select("doc_id", *map(count, BASE), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """Text with each span replaced by its kind in angle brackets; of spans that overlap the first by start stays whole. Time is about linear in text and spans."""
    order = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))

    def of(s: Column) -> Column:
        each, parts, done = s["each"], s["parts"], s["done"]  # done: how far the spans before reach
        shown = F.transform(each, lambda x, i: F.when(x["start"] >= F.get(done, i), F.concat(cut(parts, F.get(done, i), x["start"]), F.lit("<"), F.upper(x["kind"]), F.lit(">"))).otherwise(""))
        return F.concat(F.array_join(shown, ""), cut(parts, F.element_at(done, -1), F.length(text)))

    reach = lambda each: running(F.transform(each, lambda x: x["end"]), F.lit(0), lambda a, e: F.greatest(a, e))
    return F.when(F.size(spans) > 0, let(order, lambda each: let(F.struct(each.alias("each"), pieces_of(text).alias("parts"), reach(each).alias("done")), of))).otherwise(text)

import hashlib
import re

from helixtab.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def good(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in v.split(".")), "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if good(k, m.group())]


CASES = [
    None, "", "a@b.c@d.e x_y@z.com_q@r.org", "1.2.3.4.5 300.1.1.1 007.1.1.1 1.2.3", "4532 0151 1283 0366 1 and 4532015112830366", "+1 (988) 555-2485 +12 345 +1-2",
    "é😀 bosbt.42@mail8.example.com 😀 42.144.35.254", "9" * 30000, "a" * 30000 + "@" + "b.c" * 9000, "1.1" * 5000, "+1" + "-" * 20000,
    'token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae" x', "call 555-867-5309 now", "4111111111111111-1", "x" * 50 + " 4111 1111 1111 1111",
]


def rows(spark, texts):
    return spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id bigint, text string, found string")


def check(frame, texts):
    got = {r["doc_id"]: r for r in pii.digests(frame).collect()}
    assert len(got) == len(texts)
    for k, t in texts.items():
        want = brute(t)
        r = got[k]
        for kind in pii.BASE:
            assert r[f"n_{kind}"] == sum(w[0] == kind for w in want), (k, kind, (t or "")[:80])
        joined = ",".join(f"{a}:{b}:{c}" for a, b, c in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), (k, (t or "")[:80])
        spans = [x for x in r["spans"].split(",") if x]
        assert set(joined.split(",")) - {""} <= set(spans)
        assert spans == sorted(spans, key=lambda x: (pii.KINDS.index(x.split(":")[0]), int(x.split(":")[1])))


def test_edge_cases_equal_brute_force(spark):
    check(rows(spark, CASES), dict(enumerate(CASES)))


def test_table_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(docs, {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()})


def test_empty_table(spark):
    assert pii.digests(rows(spark, [])).count() == 0


def test_added_spans_and_redaction(spark):
    from pyspark.sql import functions as F

    texts = ['mail bob [at] example [dot] com', 'token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae" end', "call 555-867-5309", "plain text", "x@y.com and 10.1.2.3"] * 3
    out = pii.find(rows(spark, texts), keep=("doc_id", "text")).withColumn("red", pii.redact(F.col("text"), F.col("spans"))).orderBy("doc_id").collect()
    assert "<SECRET>" in out[1]["red"] and "1beb" not in out[1]["red"]
    assert out[3]["red"] == "plain text"
    assert out[4]["red"] == "<EMAIL> and <IP>"


def test_em_trusts_agreement():
    post = pii.estimate({("secret", (0, 1, 0, 1, 0)): 90, ("secret", (0, -1, 0, -1, -1)): 60, ("secret", (0, 1, 0, 0, 0)): 10})
    assert post["secret", (0, 1, 0, 1, 0)] > 0.9 > 0.1 > post["secret", (0, -1, 0, -1, -1)]


def test_many_matches_in_one_text(spark):
    """About linear: 60,000 addresses with other spans between them, found and masked."""
    import time

    from pyspark.sql import functions as F

    text = "".join(f"u{k}@mail{k % 7}.example.com é 10.1.{k % 200}.{k % 250} " for k in range(60_000))
    want = brute(text)
    began = time.time()
    frame = rows(spark, [text, "x", None])
    got = {r["doc_id"]: r for r in pii.digests(frame).collect()}
    assert got[0]["n_email"] == got[0]["n_ip"] == 60_000
    assert got[0]["base_sha256"] == hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in want).encode()).hexdigest()
    out = pii.find(frame, keep=("doc_id", "text")).withColumn("red", pii.redact(F.col("text"), F.col("spans"))).filter("doc_id = 0").first()
    assert out["red"] == "<EMAIL> é <IP> " * 60_000
    assert time.time() - began < 120


def test_redaction_equals_plain_python(spark):
    import random

    from pyspark.sql import functions as F

    rnd, cases = random.Random(5), []
    for k in range(60):
        text = "".join(rnd.choice("ab é😀\n") for _ in range(rnd.choice((0, 5, 1023, 1024, 1025, 5000))))
        spans = []
        for _ in range(rnd.choice((0, 1, 3, 200))):
            a = rnd.randint(0, max(0, len(text) - 1))
            spans.append((rnd.choice(("ip", "email")), a, min(len(text), a + rnd.randint(1, 40)), True))
        cases.append((k, text, [s for s in spans if s[1] < s[2]]))

    def plain(text, spans):
        at, out = 0, ""
        for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
            if a >= at:
                out += text[at:a] + f"<{kind.upper()}>"
            at = max(at, b)
        return out + text[at:]

    df = spark.createDataFrame(cases, "k int, text string, spans array<struct<kind:string,start:int,end:int,base:boolean>>")
    for r in df.withColumn("red", pii.redact(F.col("text"), F.col("spans"))).collect():
        kept = {(x["start"], x["end"], x["kind"]) for x in r["spans"]}
        same = len({(a, b) for a, b, _ in kept}) == len(kept)
        if same:  # two kinds on one place: either may be named
            assert r["red"] == plain(r["text"], [(x["kind"], x["start"], x["end"], True) for x in r["spans"]]), r["k"]


def test_candidates_of_any_length(spark):
    """Spelt-out addresses and secrets have no longest form, and what is no match takes no more than linear time."""
    import time

    from pyspark.sql import functions as F

    local, labels, secret = "a" * 70, " (dot) ".join(f"label{k}" for k in range(20)), "Ab0" * 100
    texts = [f"write to {local} (at) {'d' * 90} [dot] com now", f"x.y[at]{labels}", f"token = '{secret}' end", f'password="{secret * 500}"', "a" * 200_000 + " (at", "q (at) " * 20_000, 'secret="' * 20_000, "m [at] n" + " [dot] oo" * 5000]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    began = time.time()
    found = {(r["k"], kind): [m["value"] for m in r[kind]] for r in df.select("k", *(pii.matches(F.col("text"), pii.PATTERNS[kind]).alias(kind) for kind in ("contact", "secret"))).collect() for kind in ("contact", "secret")}
    assert time.time() - began < 60
    assert found[0, "contact"] == [f"{local} (at) {'d' * 90} [dot] com"] and found[1, "contact"] == [texts[1]] and found[2, "secret"] == [f"token = '{secret}'"] and found[3, "secret"] == [texts[3]]
    assert not any(found[k, kind] for k in (4, 5, 6) for kind in ("contact", "secret"))
    # a local part has two letters at least
    assert found[7, "contact"] == []


def test_recall_of_planted_spans(spark):
    """Every kind is found among prose in most of its places."""
    planted = {
        "email": "ann.lee{k}@mail.example.com", "ip": "42.144.{k}.254", "card": "4532015112830366", "phone": "+1 (988) 555-24{k:02d}", "contact": "ann{k} (at) example (dot) com", "local": "(415) 555-26{k:02d}",
        "national_id": "512-34-56{k:02d}", "secret": "token = '1beb58b8af68854f0e01b4ad40cdbb6a{k:02d}'",
    }
    texts = [(kind, f"Some prose stands before it, please write or call {form.format(k=k + 10)} and some stands after it.") for kind, form in planted.items() for k in range(30)]
    got = {r["doc_id"]: r["spans"] for r in pii.digests(rows(spark, [t for _, t in texts])).collect()}
    for kind in planted:
        hits = [f"{kind}:" in got[n] for n, (k, _) in enumerate(texts) if k == kind]
        assert sum(hits) >= 0.9 * len(hits), (kind, sum(hits))

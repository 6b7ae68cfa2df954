"""Edge cases and brute force for the operators without a test module of their own."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixtab.llm import chat, embed_dedup, html_extract, jaccard_join, mixing, quality, queries, url_filter
from helixtab.llm.common import Scratch
from helixtab.llm.components import components


# components


def test_components_of_chains_stars_and_rings(spark):
    edges = [(k, k + 1) for k in range(100, 130)] + [(7, k) for k in range(200, 260)] + [(1, 2), (2, 3), (3, 1), (3, 3), (None, 4)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert got == {**{k: 100 for k in range(101, 131)}, **{k: 7 for k in range(200, 260)}, 2: 1, 3: 1}


# op1


def rule_finder():
    def plain(host, path):
        fits = [(h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits, key=lambda f: len(f[0]), default=(None, None))

    return plain


URLS = [
    None, "", "no scheme", "http://A.Example.COM/en/7x?q#f", "https://example.com/en/8", "http://example.net/de/8", "http://m.example.net/de/9", "http://notexample.com/en/7", "http://x.org/es/", "http://x.org/es", "http://ÀB.org/es/a", "http://a.com",
    "x://y.com/en/://z.net/de/", "http://a.com?x=/en/", "http://" + "ab" * 5000 + ".com/" + "c" * 50000, "http://org/es/", "http://a.b.com/en/7",
]


def test_url_rules_equal_brute_force(spark):
    plain = rule_finder()
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    corpus = spark.createDataFrame([("the cat sat on the mat example",), (None,)], "text string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, corpus).collect()}
    assert len(got) == len(URLS)
    for k, u in enumerate(URLS):
        rest = (u or "").partition("://")[2]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        rule, verdict = plain(host, path)
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule), u
        assert got[k]["verdict"] in ("allow", "block") and (rule is None or got[k]["verdict"] == verdict)
    assert url_filter.judge(pages.limit(0), corpus).count() == 0


def test_segmentation_and_bayes(spark):
    counts = {"cheap": 50, "casino": 40, "garden": 60, "tools": 60, "news": 80, "s": 1}
    split = url_filter.Segmenter(counts).split
    assert split("cheapcasino") == ("cheap", "casino") and split("gardentools") == ("garden", "tools") and split("zqzq") == ("zqzq",)
    rules = (("block", "bad.com", "/"), ("allow", "good.com", "/"))
    rows = [(k, f"http://cheapcasino{k}.bad.com/x") for k in range(20)] + [(100 + k, f"http://gardennews{k}.good.com/y") for k in range(20)] + [(900, "http://casinocheap.org/"), (901, "http://newsgarden.org/")]
    corpus = spark.createDataFrame([(" ".join(w for w, n in counts.items() for _ in range(n)),)], "text string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), corpus, rules).collect()}
    assert got[900] == "block" and got[901] == "allow"


# op2


def brute_links(vectors, t=0.9):
    ids = sorted(vectors)
    ok = {k: v for k, v in vectors.items() if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = {k: set() for k in ids}
    for a in ok:
        for b in ok:
            if a < b and len(ok[a]) == len(ok[b]):
                x, y = np.array(ok[a], float), np.array(ok[b], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= t:
                    links[a].add(b), links[b].add(a)
    comp = {}
    for k in ids:
        if k not in comp:
            todo = [k]
            while todo:
                n = todo.pop()
                if n not in comp:
                    comp[n] = k
                    todo += links[n]
    return {k: (len(links[k]), comp[k]) for k in ids}


def test_embeddings_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((12, 16))
    vectors = {k: (base[k % 12] + (k % 5) * 0.12 * rng.standard_normal(16)).tolist() for k in range(150)}
    vectors |= {200 + k: vectors[3] for k in range(20)} | {300: None, 301: [0.0] * 16, 302: [float("nan")] + [1.0] * 15, 303: [None] + [1.0] * 15, 304: [], 305: [float("inf")] * 16, 306: [1.0, 2.0], 307: (np.array(vectors[5]) * 1e-30).tolist()}
    frame = spark.createDataFrame([(k, v, 0, "e") for k, v in vectors.items()], "vec_id long, embedding array<double>, label int, component_id string")
    want = brute_links({k: v for k, v in vectors.items() if v is None or len(v) != 2} | {306: None})
    monkeypatch.setattr(embed_dedup, "LEAF", 8)
    for interval in (40, 100_000):
        got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(frame, interval=interval).collect()}
        assert {k: (r["n_links"], r["component_id"]) for k, r in got.items()} == want
        assert all(r["kept"] == (k == r["component_id"]) for k, r in got.items())
    assert embed_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_embeddings_of_several_dimensions(spark):
    rng = np.random.default_rng(3)
    vectors = {}
    for dim, n in ((16, 60), (2, 40), (1, 5), (7, 1)):
        base = rng.standard_normal((6, dim))
        vectors |= {1000 * dim + k: (base[k % 6] + 0.1 * (k % 4) * rng.standard_normal(dim)).astype(np.float32).tolist() for k in range(n)}
    want = brute_links(vectors)
    for kind in ("float", "double"):
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicates(spark.createDataFrame(list(vectors.items()), f"vec_id long, embedding array<{kind}>"), interval=16).collect()}
        assert got == want


# op3


def word_sets(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws)} if 0 < len(ws) < 5 else {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)}


def brute_similar(docs):
    sets = {k: word_sets(t) for k, t in docs.items()}
    comp = {k: k for k in docs}

    def find(k):
        while comp[k] != k:
            k = comp[k]
        return k

    for a in docs:
        for b in docs:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return {k: (len(sets[k]), find(k)) for k in docs}


@pytest.mark.parametrize("small", [False, True])
def test_jaccard_equals_brute_force(spark, monkeypatch, small):
    rnd = random.Random(3)
    vocabulary = [f"w{k}" for k in range(300)]
    shared = rnd.choices(vocabulary, k=60)
    docs = {}
    for k in range(60):
        body = rnd.choices(vocabulary, k=rnd.choice((3, 8, 40, 120)))
        docs[10 * k] = " ".join(body + (shared if k % 3 == 0 else []))
        for j in range(k % 4):
            near = list(docs[10 * k].split())
            for _ in range(rnd.randint(0, max(1, len(near) // 25))):
                near[rnd.randrange(len(near))] = rnd.choice(vocabulary)
            docs[10 * k + j + 1] = " ".join(near)
    long = rnd.choices(vocabulary, k=20000)
    docs |= {1000: None, 1001: "", 1002: " \n\t ", 1003: "One two", 1004: "one  TWO", 1005: "é É", 1006: " ".join(long), 1007: " ".join(long[:19000])}
    if small:  # every token a tree of several blocks, every token hot
        for name, value in (("LEAF", 2), ("BLOCK", 4), ("HOT", 3)):
            monkeypatch.setattr(jaccard_join, name, value)
    frame = spark.createDataFrame([(k, t, "x", 1) for k, t in docs.items()], "doc_id long, text string, component_id string, n int").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similar(frame).collect()}
    assert got == brute_similar(docs)


def test_jaccard_of_repeated_null_and_no_rows(spark):
    kind = "doc_id long, text string"
    got = sorted((str(r["doc_id"]), r["component_id"]) for r in jaccard_join.similar(spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (9, "a b c d e f")], kind)).collect())
    assert got == [("5", 5), ("5", 5), ("9", 5), ("None", None)]
    assert jaccard_join.similar(spark.createDataFrame([], kind)).count() == 0


# op5


def test_mix_of_edge_cases(spark):
    rows = [(1, None, "a"), (2, "", None), (3, "one two three", None), (4, "x " * 4000, "b"), (4, "x " * 4000, "b"), (None, "p q", "c"), (7, "$$$ ### 12", "c")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, target string")
    got = mixing.mix_documents(docs).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert abs(sum({(r["source"]): r["target"] for r in got}.values()) - sum(r["size"] for r in got)) < 1e-6
    assert all(r["target"] <= 3 * r["source_size"] + 1e-9 for r in got)
    assert mixing.mix_documents(docs.limit(0)).count() == 0


def test_mix_comes_near_targets_and_again(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = {r["doc_id"]: r for r in mixing.mix_documents(docs).collect()}
    assert {k: r["taken"] for k, r in one.items()} == {r["doc_id"]: r["taken"] for r in mixing.mix_documents(docs.repartition(9)).collect()}
    for s in {r["source"] for r in one.values()}:
        rows = [r for r in one.values() if r["source"] == s]
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= max(r["size"] for r in rows) / 2 + 1


def test_better_documents_are_drawn_sooner(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(10).alias("size"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.2).alias("quality"))
    two = docs.unionByName(spark.range(4000, 8000).select(F.col("id").alias("doc_id"), F.lit("t").alias("source"), F.lit(1).alias("size"), F.lit(1.0).alias("quality")))
    got = mixing.mix(two, weights=(1.0, 9.0), max_epochs=3).filter("source = 's' and taken % 20 = 10 or source = 's' and taken = 0").groupBy(F.col("doc_id") % 2).agg(F.avg("taken").alias("t")).collect()
    t = {r[0]: r["t"] for r in got}
    assert t[0] >= t[1]


# op6


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.classify(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.95 * len(held)


def test_quality_of_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "ab", 5), (4, "x" * 3_000_000, 5), (4, "ab", 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(4, 1), (4, 0), (99, None)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert {r["predicted"] for r in quality.classify(docs, labels.limit(0)).collect()} == {1}
    assert quality.classify(docs.limit(0), labels).count() == 0


# op9


def test_chat_round_trip(spark):
    rnd = random.Random(1)
    bits = ["<|im_start|>", "<|im_end|>", "<|im_start:esc|>", "\\", "\\|", "<", "|", ">", "<|", "user\n", "\n", "hi", "é😀", "", "im_end"]
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None]), rnd.choice([None, "".join(rnd.choices(bits, k=rnd.randint(0, 6)))])) for c in range(300) for t in range(rnd.randint(1, 4))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = chat.with_loss_mask(chat.format_chat(df)).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()
    assert len(out) == 300 and any(r["escaped"] for r in out) and not all(r["escaped"] for r in out)
    for r in out:
        want = [(a or "", b or "") for _, a, b in sorted(((t, a or "", b or "") for c, t, a, b in rows if c == r["conv_id"]))]
        assert [(t["role"], t["text"]) for t in r["parsed"]] == want == [(t["role"], t["text"]) for t in r["turns"]]
        assert r["loss"] == "".join(b for a, b in want if a == "assistant")
    assert chat.format_chat(df.limit(0)).count() == 0


# op10


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("just text", "just text"), ("<p>a&amp;b &lt;c&gt;</p>", "a&b <c>"), ("<article><h1>T</h1><p>one\n two<br>three</p><p><b>x", "T\none two three\nx"),
    ("<body><nav><a>menu</a></nav><div class='ad'>buy</div><article><p>Body text that is long enough.</p><aside>side</aside><form>f</form><p>s</p></article><footer>foot</footer><div id='comments'><p>a reader's long long long comment here</p></div>", "Body text that is long enough.\ns"),
    ("<html><body><div class=sidebar><ul><li><a href=1>l</a></li></ul></div><div id=x><p>Main part with a lot of words in it.</p><p>Second.</p></div><div class='cookie-notice'>We use cookies and so on and so on</div>", "Main part with a lot of words in it.\nSecond."),
    ("<article><p>cut off &amp; here<p>tail <b", "cut off & here\ntail"), ("<script>x</script><style>y</style>", ""), ("<article><!-- c --><p>a</p><noscript>n</noscript>b</article>", "a\nb"),
])
def test_main_text(html, text):
    assert html_extract.main_text(html) == text


@pytest.mark.parametrize("html,text", [
    (f"<body><div><p>{'long text ' * 85}</p></div><div><p>{'more text ' * 15}</p></div></body>", f"{('long text ' * 85).strip()}\n{('more text ' * 15).strip()}"),
    (f"<body><p>one</p><div><p>{'very long ' * 500}</p></div><p>two</p></body>", f"one\n{('very long ' * 500).strip()}\ntwo"),
    ("<main><p>Before it all.</p><article><p>An article with some words.</p></article><p>After.</p></main>", "Before it all.\nAn article with some words.\nAfter."),
    ("<article><p>The first of two.</p></article><article><p>Two.</p></article>", "The first of two.\nTwo."),
])
def test_no_region_is_dropped(html, text):
    assert html_extract.main_text(html) == text


@pytest.mark.parametrize("name", ["content no-sidebar", "has-sidebar", "post tag-news", "page-with-nav", "search-result-body"])
def test_marks_within_other_names(name):
    assert html_extract.main_text(f"<div class='{name}'><p>Some text.</p></div><div><p>{'Other text. ' * 9}</p></div>").startswith("Some text.")


def test_marked_elements_with_content():
    assert html_extract.main_text("<div class=widget><article><p>Some text.</p></article></div>") == "Some text."
    assert html_extract.main_text("<div class=widget><p>Most of the text of the page.</p></div><p>x</p>") == "Most of the text of the page.\nx"


def test_pages_are_articles(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r for r in queries.op10_html_extract(spark, sf).collect()}
    import html as h

    for r in pages.collect():
        body = re.search(r"(?s)<article>(.*?)(?:</article>|\Z)", r["html"])[1]
        body = re.sub(r"<[a-zA-Z/][^<>]*\Z", "", body)
        blocks = [" ".join(h.unescape(re.sub(r"<br\s*/?>", " ", b).replace("<b>", "").replace("</b>", "")).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert got[r["page_id"]]["text"] == "\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


def test_quality_features_equal_plain_python(spark, monkeypatch):
    """Logits recomputed word by word and byte by byte from the fitted weights, with texts longer than a piece."""
    import pyarrow as pa

    from helixtab.llm import textnum

    monkeypatch.setattr(quality, "PIECE", 64)
    texts = ["One two two three", "", "x", "ab " * 100, "é😀 " * 30 + "End", "a b  c\nd"]
    w = np.random.default_rng(4).standard_normal(quality.BUCKETS)
    got = {r["doc_id"]: r["quality_score"] for r in quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), (w, 0.25)).collect()}
    mask, shift = (1 << 64) - 1, 64 - 17

    def plain(text):
        raw, out = text.encode(), []
        at = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
        buf = np.frombuffer(raw, np.uint8)
        h = [int(textnum.spans_hash(buf, np.array([a]), np.array([b]))[0]) for a, b in at]
        out += [x >> shift for x in h]
        for x, y in zip(h[:-1], h[1:], strict=True):
            both = int(textnum.PLACE[2]) if x == y else int(textnum.mix(np.array([(x * int(textnum.PLACE[0]) + y * int(textnum.PLACE[1])) & mask], np.uint64))[0])
            out.append(both >> shift)
        for n in quality.NGRAMS:
            for k in range(len(raw) - n + 1):
                total = sum(int(quality._RAW[raw[k + j]]) * int(textnum.PLACE[n - j]) for j in range(n))
                out.append((total * 0x9E3779B97F4A7C15 & mask) >> shift)
        return out

    for k, t in enumerate(texts):
        f = plain(t)
        z = 0.25 + (w[f].sum() / len(f) if f else 0)
        assert abs(got[k] - 1 / (1 + math.exp(-z))) < 1e-9, t
    both = list(quality.bags(pa.array(texts)))
    for t, (ids, share) in zip(texts, both, strict=True):
        f = plain(t)
        assert sorted(set(f)) == ids.tolist() and all(abs(f.count(i) / len(f) - s) < 1e-6 for i, s in zip(ids.tolist(), share.tolist(), strict=True))


def test_chat_roles_with_line_breaks_and_null_ids(spark):
    rnd = random.Random(8)
    roles = ["us\ner", "\n", "\\n", "\\\n", "\\\\n\n", "<|\n|>", "n", "assistant\n", "assistant", ""]
    rows = [(c, t, rnd.choice(roles), rnd.choice(["hi\nthere", "<|im_end|>", "\\"])) for c in range(200) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat.format_chat(df).collect():
        want = sorted((t, a, b) for c, t, a, b in rows if c == r["conv_id"])
        assert [(x["role"], x["text"]) for x in r["parsed"]] == [(a, b) for _, a, b in want]
    nulls = spark.createDataFrame([(None, 0, "user", "a"), (None, 1, "user", "b"), (-1, 0, "user", "c")], df.schema)
    got = [(r["conv_id"], r["n_turns"]) for r in chat.digests(nulls).collect()]
    assert sorted(got, key=str) == [(-1, 1), (-1, 2), (None, 1), (None, 1)]


def test_chat_digests_equal_sql_and_plain_python(spark):
    import hashlib

    import duckdb
    import pandas as pd

    rows = [(1, k, "assistant" if k % 2 else "us\ner", f"turn {k} é😀" * 3) for k in range(3000)] + [(2, 0, None, None), (3, None, "assistant", "<|im_end|>"), (3, 1, "assistant", "x"), (3, 1, "assistant", "x"), (None, 1, "user", "q")]
    got = {r["conv_id"]: r for r in chat.digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    turns = sorted(((t, a, b) for c, t, a, b in rows if c == 1))
    loss = "".join(b for _, a, b in turns if a == "assistant")
    assert got[1]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    sql = con.execute(chat.ORACLE).fetchall()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert sorted(map(str, sql)) == sorted(str(tuple(r[n] for n in names)) for r in got.values())


def test_segmentation_equals_all_splits():
    rnd = random.Random(2)
    counts = {w: rnd.randint(1, 60) for w in ("a", "b", "ab", "ba", "abc", "cab", "é", "éa", "abcabcabcabcabcabcabcabc")}
    s = url_filter.Segmenter(counts)

    def cost(parts):
        return sum(s.cost[w] if w in s.cost else s.unknown + url_filter.LETTER * len(w) for w in parts)

    def splits(name):
        return [[]] if not name else [[name[:k], *rest] for k in range(1, len(name) + 1) for rest in splits(name[k:])]

    for name in ["", *("".join(rnd.choices("abcé7", k=rnd.randint(1, 10))) for _ in range(200))]:
        got = s.split(name)
        assert "".join(got) == name and abs(cost(got) - min(cost(p) for p in splits(name))) < 1e-9, name
    assert s.split("abcabcabcabcabcabcabcabc" * 40) == ("abcabcabcabcabcabcabcabc",) * 40
    assert url_filter.Segmenter({"ab": 1, "a": 1, "b": 1, "aab": 1}).split("") == () and url_filter.Segmenter({}).split("xyz") == ("xyz",)
    tie = url_filter.Segmenter({"aab": 4, "c": 4, "aa": 4, "bc": 4})
    tie.cost = {"aab": 1.0, "c": 1.0, "aa": 1.0, "bc": 1.0}
    assert tie.split("aabc") == ("aa", "bc")


def test_bayes_scores_equal_plain_counts(spark):
    rnd = random.Random(6)
    rules = (("block", "bad.com", "/"), ("allow", "good.com", "/"))
    names = ["cheapnews", "gardencasino", "newsnewsé", "tools7", "z" * 700]
    rows = [(k, f"http://{rnd.choice(names)}.{rnd.choice(['bad.com', 'good.com', 'else.org'])}/{rnd.choice(names)}/{k}-x_{rnd.choice(names).upper()}") for k in range(120)]
    text = "cheap news garden casino tools é newsé " * 5
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([(text,), ("Casino",)], "text string"), rules).collect()}
    counts = {}
    for w in (text + "casino").split():
        counts[w] = counts.get(w, 0) + 1
    seg = url_filter.Segmenter(counts)

    def features(url):
        host, _, path = url.split("://")[1].partition("/")
        out = ["h:" + w for label in host.split(".") for w in seg.split(label)]
        for part in re.split(r"[\W_]+", path.lower()):
            out += [f"p:#{len(part)}"] if part.isdigit() else ["p:" + w for w in seg.split(part)] if part else []
        return [zlib.crc32(t.encode()) % url_filter.FEATURES for t in out]

    seen, docs = {True: [1.0] * url_filter.FEATURES, False: [1.0] * url_filter.FEATURES}, {True: 1, False: 1}
    for _, u in rows:
        if "else.org" not in u:
            docs["bad.com" in u] += 1
            for f in features(u):
                seen["bad.com" in u][f] += 1
    total = {k: sum(v) for k, v in seen.items()}
    for k, u in rows:
        odds = math.log(docs[True] / docs[False]) + sum(math.log(seen[True][f] / total[True]) - math.log(seen[False][f] / total[False]) for f in features(u))
        assert abs(got[k]["block_score"] - 1 / (1 + math.exp(-odds))) < 1e-9, u


def test_url_filter_without_corpus(spark):
    pages = spark.createDataFrame([(1, "http://abc.org/x"), (2, None)], "page_id long, url string")
    got = url_filter.judge(pages, spark.createDataFrame([], "text string")).collect()
    assert len(got) == 2 and {r["verdict"] for r in got} == {"allow"}


def test_deep_and_long_pages():
    """Time and memory follow the length of a page, not its depth."""
    import time

    began = time.time()
    n = 50_000
    assert html_extract.main_text("<div>" * n + "<p>Deep text.</p>" + "</div>" * n) == "Deep text."
    assert html_extract.main_text("<b>" * n + "Some text." + "</x>" * n) == "Some text."
    assert html_extract.main_text("<p>" + "<i>" * n + "text" + "</p>" * n) == "text"
    assert html_extract.main_text("<div class=ad>" * 2000 + "<article>Inside.</article>" + "</div>" * 2000) == "Inside."
    assert html_extract.main_text("".join(f"<p>line {k}</p>" for k in range(n))).count("\n") == n - 1
    assert time.time() - began < 20


@pytest.mark.parametrize("html,text", [
    ("<div><ul><li><a href=a>Home</a><li><a href=b>News</a><li><a href=c>About us</a></ul></div><div><p>A long enough paragraph of the page's text.</p><p>And one more of the same kind here.</p></div>", "A long enough paragraph of the page's text.\nAnd one more of the same kind here."),
    ("<p>See <a href=x>this</a> and <a href=y>that</a>.</p><p><a href=z>A single link stays.</a></p>", "See this and that.\nA single link stays."),
    ("<article><p>Text.</p><div class='share-price'>It rose.</div><section id='related-work'><p>Others did it.</p></section><ul><li><a>one</a><li><a>two</a><li><a>three</a></ul></article>", "Text.\nIt rose.\nOthers did it.\none\ntwo\nthree"),
    ("<div><p>if 3 &lt; 4 and 5 < 6 then</p><p>x</p></div>", "if 3 < 4 and 5 < 6 then\nx"),
])
def test_menus_without_marks(html, text):
    assert html_extract.main_text(html) == text


def test_quality_weights_have_effect(spark):
    """Half of a source's words are drawn; documents of weight 1 come five times as soon as those of 0.2."""
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit(10).alias("size"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.2).alias("quality"))
    other = spark.range(6000, 12000).select(F.col("id").alias("doc_id"), F.lit("b").alias("source"), F.lit(10).alias("size"), F.lit(1.0).alias("quality"))
    taken = {(r["source"], r["good"]): (r["t"], r["n"]) for r in mixing.mix(rows.unionByName(other), weights=(1.0, 3.0)).groupBy("source", (F.col("doc_id") % 2 == 0).alias("good")).agg(F.sum(F.col("taken") / F.col("size")).alias("t"), F.count("*").alias("n")).collect()}
    good, bad = (taken["a", k][0] / taken["a", k][1] for k in (True, False))
    assert abs(good + bad - 1) < 0.01 and good > bad + 0.35


def test_most_frequent(spark):
    from helixtab.llm.common import most_frequent

    counts = spark.createDataFrame([(k, n) for k, n in enumerate([10**9, 10**6, 70_000, 9, 5, 5, 5, 1, 1])], "k int, n bigint")
    got = {most: sorted(r["k"] for r in most_frequent(counts, most).collect()) for most in (0, 1, 4, 6, 7, 9)}
    assert got == {0: [], 1: [0], 4: [0, 1, 2, 3], 6: [0, 1, 2, 3], 7: list(range(7)), 9: list(range(9))}

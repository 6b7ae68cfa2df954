from helixtab.llm import decontam

ITEM = "In the small harbour town Anna bought 12 apples and 7 pears for her brother before the ferry left at 9 km from shore"


def run(spark, texts, items):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id bigint, text string, item_id string")
    bench = spark.createDataFrame([(k, t, 1) for k, t in enumerate(items)], "item_id bigint, text string, doc_id int")
    return {r["doc_id"]: r for r in decontam.decontaminate(docs, bench).collect()}


def test_reparameterised_and_inconsistent(spark):
    long = "filler words go on and on here " * 50
    texts = [
        ITEM,
        long + ITEM.replace("12", "40").replace("7", "31").replace("Anna", "Petra") + " tail",  # other numbers and names
        long,
        None,
        "",
        ITEM.upper() + "!!",
        "Totally different text about nothing at all that matters to anyone here today",
        ITEM.replace(" apples", " fine apples").replace(" her ", " his "),  # too broken for a window of eight? the rest still matches
    ]
    got = run(spark, texts, [ITEM, None, ""])
    assert [got[k]["contaminated"] for k in range(7)] == [True, True, False, False, False, True, False]
    assert got[1]["item_ids"] == [0]
    assert got[0]["n_windows"] == len(ITEM.split()) - 7 - sum(0 for _ in ())


def test_slot_consistency(spark):
    item = "the price rose from 10 to 20 and then from 20 back to 10 within the same single year of trade"
    good = item.replace("10", "A1").replace("20", "77").replace("A1", "33")
    bad = "the price rose from 10 to 20 and then from 30 back to 10 within the same single year of trade"
    got = run(spark, [good, bad], [item])
    assert got[0]["contaminated"] and not got[1]["contaminated"]


def test_short_item_is_found_as_a_whole_document_only(spark):
    got = run(spark, ["one two three", "one two three four", "zero one two three"], ["One two, three."])
    assert [got[k]["contaminated"] for k in range(3)] == [True, False, False]


def test_empty(spark):
    assert run(spark, [], [ITEM]) == {}
    assert not run(spark, ["some text here"], [])[0]["contaminated"]


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, ITEM), (1, ITEM), (None, ITEM)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(5, ITEM)], "item_id bigint, text string")
    got = [(r["doc_id"], r["contaminated"]) for r in decontam.decontaminate(docs, bench).collect()]
    assert sorted(got, key=str) == [(1, True), (1, True), (None, False)]


def test_table_equals_brute_force(spark, sf):
    """Without slots in the benchmark, a hit is eight words in a row, lower-cased and without punctuation."""
    import re

    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")

    def grams(text):
        ws = [w for w in (re.sub(r"[^\w\s]|_", "", x.lower()) for x in (text or "").split()) if w]
        return {tuple(ws[k : k + 8]) for k in range(len(ws) - 7)}

    items = {r["item_id"]: grams(r["text"]) for r in bench.collect() if not re.search(r"\d|[\w,;] [A-ZÀ-Þ]", r["text"])}
    got = {r["doc_id"]: set(r["item_ids"]) for r in decontam.decontaminate(docs, bench).collect()}
    for r in docs.collect():
        if re.search(r"[\w,;] [A-ZÀ-Þ]", r["text"] or ""):
            continue  # names are placeholders there
        g = grams(r["text"])
        assert {k for k, w in items.items() if w & g} == got[r["doc_id"]] & set(items), r["doc_id"]


def test_one_inconsistent_value_leaves_other_windows(spark):
    plain = "these nine plain words follow without any values inside"
    item = f"from 10 apples to 10 pears it was told {plain}"
    far = f"{plain} then 5 were sold and later on the way home"
    got = run(spark, [item.replace("to 10", "to 11"), far.replace("plain", "simple") + " 7 " + item.replace("to 10", "to 11")], [item])
    assert got[0]["contaminated"] and got[0]["n_windows"] == len(f"pears it was told {plain}".split()) - 7
    assert got[1]["contaminated"]


def test_runs_are_checked_apart(spark):
    item = "we counted 10 birds near the lake before noon and then someone else counted 10 birds near the river after dusk"
    doc = item.replace("counted 10 birds near the lake", "counted 12 birds near the lake").replace("noon and then someone else", "dawn but when somebody new")
    got = run(spark, [doc.replace("counted 10", "counted 15")], [item])
    assert got[0]["contaminated"]


def test_dense_items_are_found_as_copies(spark):
    item = "add 3 and 4 then 5 and 6 then 7 and 8 then 9 and 10"
    short = "3 km 5 kg 7"
    got = run(spark, [f"some text before {item} and after", item.replace("3", "13").replace("5", "15").replace("7", "17").replace("9", "19"), short, "4 km 6 kg 8"], [item, short])
    assert [got[k]["item_ids"] for k in range(4)] == [[0], [], [1], []]


RICH = "At 9 Anna paid 3 euros plus 14 cents to Boris and 5 euros plus 20 cents to Clara for 2 kg of flour"


def test_rich_in_placeholders(spark):
    """More placeholders than a window may have: as a copy, and with other values that are consistent."""
    other = RICH.replace("Anna", "Petra").replace(" 3 ", " 8 ").replace("14", "41").replace("Boris", "Igor")
    mixed = RICH.replace("5 euros", "3 euros")  # two different numbers become one
    got = run(spark, [f"before it {RICH} after it", f"before it {other} after it", mixed, "there were 3 and 14 and 5 and 20 of 9 and 2"], [RICH])
    assert [got[k]["contaminated"] for k in (0, 1, 3)] == [True, True, False]


def test_short_items_inside_texts(spark):
    items = ["What is Rome?", "which river runs through Paris", "two words"]
    texts = ["Some text. What is Rome? More text.", "I ask what is rome now", "tell me which river runs through Paris and why", "first line\nTwo words\nlast line", "not two words here", ""]
    got = run(spark, texts, items)
    assert [got[k]["item_ids"] for k in range(6)] == [[0], [], [1], [2], [], []]


def test_names_after_line_breaks_and_quotes(spark):
    for mark in ("\n", ' "', " (", "  "):
        got = run(spark, [ITEM.replace(" Anna", mark + "Petra")], [ITEM])
        assert got[0]["item_ids"] == [0], repr(mark)
    start = "Lisbon lies on the wide mouth of the old river"
    assert run(spark, [f"they say Lisbon {start[7:]}"], [start])[0]["contaminated"]


def test_repeated_ids_are_searched_apart(spark):
    docs = spark.createDataFrame([(1, ITEM.replace("12", "5")), (1, "padding words come first here " + ITEM.replace("12", "6")), (2, "nothing of it at all in here")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(5, ITEM)], "item_id bigint, text string")
    found = decontam.passages(docs, bench).collect()
    assert {(r["doc_id"], r["diagonal"], r["consistent"]) for r in found} == {(1, 0, True), (1, 5, True)}


def plain_words(text):
    """Marked and template words of a text, by one pass over its words."""
    import re

    text = re.sub("[\x01\x02\x03]", "", text or "")
    words, templates = [], []
    signs = r"[!-/:-@\[-`{-~¡-¿×÷‐-⯿]+"
    for m in re.finditer(r"[^ \t-\r]+", text):
        raw = m[0]
        before = text[: m.start()]
        opened = raw[:1] if raw[:1] in "\"'([“„‘‚«" and len(raw) > 1 else ""
        rest = raw[len(opened) :]
        name = len(rest) > 1 and rest[0].isupper() and rest[1].islower() and re.search(r"[^\W_][\"')\]”’»]?[ \t-\r]{1,2}\Z|[,;][\"')\]”’»]?[ \t-\r]{1,2}\Z", before)
        marked = re.sub(r"(?<![^\W_$€.,:/])(?<![.,:/])(?=[$€]?[0-9])", "\x02", raw) if not name else raw
        word = re.sub(signs, "", marked.lower())
        if not word:
            continue
        words.append(("\x01" if name else "") + word)
        t = "\x01" if name else re.sub(r"\x02[0-9]+", "\x02", word)
        if templates and templates[-1] == "\x02" and t in decontam.UNITS:
            t = "\x03"
        templates.append(t)
    return words, templates


def test_templates_and_slots_equal_plain_python(spark):
    """Sentences from a small grammar with numbers, names and units; windows, runs and slots found by plain loops."""
    import random

    rnd = random.Random(11)
    names, verbs = ["Anna", "Boris", "Clara", "Dmitri"], ["bought", "sold", "carried", "weighed"]

    def sentence():
        return " ".join(f"then {rnd.choice(names)} {rnd.choice(verbs)} {rnd.randint(1, 4)} {rnd.choice(['kg', 'm', 'boxes'])} of {rnd.choice(['flour', 'rope'])} near the {rnd.choice(['old', 'new'])} harbour" for _ in range(rnd.randint(1, 3)))

    items = [sentence() for _ in range(8)]
    texts = [rnd.choice(["", "quite another start of it "]) + sentence() for _ in range(60)]
    width, most = decontam.WINDOW, decontam.MOST_SLOTS
    slot = lambda w: any(c in w for c in "\x01\x02\x03")

    def hit(doc, item):
        (dv, dt), (iv, it) = plain_words(doc), plain_words(item)
        lit = lambda ws: [w.strip("\x01\x02") for w in ws]
        for diagonal in range(-len(it), len(dt)):
            kinds = {}
            for q in range(len(it) - width + 1):
                p = q + diagonal
                if 0 <= p <= len(dt) - width:
                    own, n = it[q : q + width], sum(map(slot, it[q : q + width]))
                    literal = lit(dv[p : p + width]) == lit(iv[q : q + width])
                    template = dt[p : p + width] == own
                    if n == 0 and template or literal and (n > most or not template):
                        return True
                    if template:
                        kinds[p] = n
            for full in (False, True):
                ps = sorted(p for p, n in kinds.items() if full or n <= most)
                run_ = []
                for p in [*ps, None]:
                    if run_ and p != run_[-1] + 1:
                        a, b = run_[0], run_[-1] + width
                        pairs = {(dv[k], iv[k - diagonal]) for k in range(a, b) if slot(it[k - diagonal])}
                        words = {it[k - diagonal] for k in range(a, b) if not slot(it[k - diagonal])}
                        if len({x for x, _ in pairs}) == len(pairs) == len({y for _, y in pairs}) and (len(words) >= decontam.LITERALS or not full or all(kinds[k] <= most for k in run_)):
                            return True
                        run_ = []
                    run_.append(p)
        return False

    got = run(spark, texts, items)
    seen = 0
    for k, t in enumerate(texts):
        want = [i for i, item in enumerate(items) if hit(t, item)]
        seen += bool(want)
        assert got[k]["item_ids"] == want, (t, [items[i] for i in set(want) ^ set(got[k]["item_ids"])])
    assert 5 < seen


def test_short_items_by_template_inside_texts(spark):
    """A re-parameterised question of fewer words than a window is found inside a text, and only with consistent slots and enough plain words."""
    prose = "some words of prose go on here and there without end. "
    items = ["What is 15 times 9?", "Give 3 to 3 people, then 4 more", "pay 5", "Is 20 km more than 20 mi"]
    texts = [
        prose + "Well, what is 21 times 6? " + prose, "What is 21 times 6?", prose + "what is 21 plus 6? " + prose,
        prose + "give 8 to 8 people, then 2 more " + prose, prose + "give 8 to 9 people, then 2 more " + prose, prose + "pay 7 now " + prose,
        prose + "is 7 km more than 7 mi or not " + prose, prose + "is 7 km more than 8 mi or not " + prose, "21 times", "", None, prose + "at the end: what is 7 times 3",
    ]
    got = run(spark, texts, items)
    assert {k: r["item_ids"] for k, r in got.items() if r["contaminated"]} == {0: [0], 1: [0], 3: [1], 6: [3], 11: [0]}

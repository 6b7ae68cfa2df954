import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helixtab.llm import token_align as T

LEFT, RIGHT = T.sides(T.A_FILE, T.B_FILE)
TEXTS = ["Hello wonderful world of tokens", "", "a", "two  spaces and\ttabs\n\nlines", "<|endoftext|> <s> plain text", "日本語テキスト und Größe", "x" * 3000, " leading", "trailing ", "▁mark", "é ﬁ ①²", "Hello wonderful world of tokens"]


def plain(text):
    """Both tokenizers by their own libraries, shared ends by sets."""
    from tokenizers import Tokenizer

    if not hasattr(plain, "a"):
        plain.a = Tokenizer.from_file(T.A_FILE)
        plain.a.encode_special_tokens = True
    if not text:
        return 0, 0, "", []
    a, b, whole = plain.a.encode(" " + text, add_special_tokens=False).ids, RIGHT.encode(text), (" " + text).encode()
    if b"".join(LEFT.table[x] for x in a) != whole or b"".join(RIGHT.table[x] for x in b) != whole:
        return 0, 0, "", []

    def ends(ids, side):
        at, out = 0, []
        for x in ids:
            at += len(side.table[x])
            out.append(at)
        return out

    ea, eb, before, groups, links = ends(a, LEFT), ends(b, RIGHT), 0, [], []
    for end in sorted(set(ea) & set(eb)):
        mine = [[x for x, e in zip(ids, es, strict=True) if before < e <= end] for ids, es in ((a, ea), (b, eb))]
        groups.append("|".join(",".join(map(str, m)) for m in mine))
        links.append((mine[0][-1], mine[1][-1]))
        before = end
    return len(a), len(b), ";".join(groups), links


def expected(rows):
    done = [(k, *plain(t)) for k, t in rows]
    count = Counter(x for r in done for x in r[4])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return sorted((k, a, b, len(links), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), g and hashlib.sha256(g.encode()).hexdigest()) for k, a, b, g, links in done)


def test_windows_equal_plain_alignment():
    aligner = T.Aligner(LEFT, RIGHT)
    for text, (a, b, groups, pairs) in zip(TEXTS, aligner.align(TEXTS), strict=True):
        want = plain(text)
        assert (a, b, groups, [(x >> T.SHIFT, x & (1 << T.SHIFT) - 1) for x in pairs.tolist()]) == want, text
    n = len(aligner.memo)
    aligner.align(TEXTS)
    assert len(aligner.memo) == n > 5


def test_equal_hashes_are_told_apart(monkeypatch):
    """Windows are compared by their ids, not by hashes alone."""
    monkeypatch.setattr(T, "mix", lambda x: x & T.np.uint64(1))
    assert [r[2] for r in T.Aligner(LEFT, RIGHT).align(TEXTS)] == [plain(t)[2] for t in TEXTS]


def test_byte_letters():
    letters = T.byte_letters()
    assert sorted(letters.values()) == list(range(256)) and letters["Ġ"] == 32 and letters["A"] == 65


@pytest.mark.parametrize("frequent", [T.FREQUENT, 5, 0])
def test_table_equals_plain_counts(spark, frequent):
    """Whether counts of pairs are known to every task or meet in a join."""
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(3, None), (None, "Hello again")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_a", F.lit("clash")).repartition(3)
    got = [tuple(r) for r in T.align(docs, frequent=frequent).collect()]
    want = [(None if r[0] == -1 else r[0], *r[1:]) for r in expected([(-1 if k is None else k, t) for k, t in rows])]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in T.align(docs).collect()) == expected(rows)


def test_groups_themselves_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "Hello world")], "doc_id bigint, text string")
    assert T.align(docs, groups=True).first()["groups"] == plain("Hello world")[2]
    assert T.align(docs.limit(0)).count() == 0


def test_missing_file(spark):
    with pytest.raises(FileNotFoundError, match="vocabulary"):
        T.align(spark.createDataFrame([(1, "x")], "doc_id bigint, text string"), "/nowhere.json")


def test_pieces():
    assert [(a, len(p)) for a, p in T._pieces(["x" * T.PIECE, None, "y", "z" * T.PIECE, "w"])] == [(0, 1), (1, 3), (4, 1)]

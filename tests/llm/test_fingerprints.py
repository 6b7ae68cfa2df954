import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixtab.llm import fingerprints as P

WORDS = [f"w{k}" for k in range(400)]


def plain(text):
    """Votes one term and one bit at a time, over hashes of the library."""
    from helixtab.llm.textnum import mix, shingles, spans_hash, words

    buf = np.frombuffer(text.encode(), np.uint8)
    if not len(buf):
        return bytes(P.BITS // 8)
    starts, ends, rows = words(buf, np.array([0, len(buf)]))
    h, votes = spans_hash(buf, starts, ends), [0] * P.BITS
    for width in P.WIDTHS:
        for term in shingles(h, rows, width)[0] if len(h) else []:
            data = b"".join(int(mix(np.array([term + q]))[0]).to_bytes(8, "little") for q in P.QUARTERS)
            for k in range(P.BITS):
                votes[k] += 1 if data[k // 8] >> (7 - k % 8) & 1 else -1
    return np.packbits(np.array(votes) > 0).tobytes()


def test_votes_equal_plain_loops():
    texts = ["", " \n", "one", "one two", "One  two three four", "a b c d e f g a b c d e", " ".join(WORDS), "ä ö ü " * 20]
    with np.errstate(over="ignore"):
        assert [p.tobytes() for p in P.fingerprints(pa.array(texts))] == [plain(t) for t in texts]


def test_pieces_of_a_long_text():
    texts = [" ".join(WORDS[k : k + 90]) for k in range(3)] + ["one two three four", "x" * 100 + " y", "one"]
    whole = P.fingerprints(pa.array(texts))
    for size in (3, 7, 50, 200):
        assert np.array_equal(P.fingerprints(pa.array(texts), size), whole)


def test_likeness_of_copies():
    text = " ".join(WORDS)
    a, b, c = P.fingerprints(pa.array([text, text.replace("w200 ", "other "), " ".join(f"v{k}" for k in range(400))]))
    assert P.distance(a, b) < 30 < 90 < P.distance(a, c)


def rows_of(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("fingerprint", F.lit(1)).repartition(parts)


def check_next(docs, rows):
    rows = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    texts = [t for _, t in rows]
    new = [t[: len(t) - len(t) // 2] + texts[(k + 1) % len(texts)][: len(t) // 2] for k, t in enumerate(texts)]
    own, other = P.fingerprints(pa.array(texts)), P.fingerprints(pa.array(new))
    want = [(k, len(t), hashlib.sha256(e.encode()).hexdigest(), p.tobytes().hex(), q.tobytes().hex(), 1 - P.distance(p, q) / 256, 1 - P.distance(p, own[(n + 1) % len(own)]) / 256) for n, ((k, t), e, p, q) in enumerate(zip(rows, new, own, other, strict=True))]
    got = [tuple(r) for r in P.with_next(docs).select(*P.FIELDS).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_next_document_over_ranges(spark):
    rows = [(3 * k, " ".join(WORDS[k : k + k % 40])) for k in range(60)] + [(-1, None), (None, "null id"), (7, "ünïcode ☃ text")]
    check_next(rows_of(spark, rows), rows)


def test_one_document_repeated_rows_and_none(spark):
    check_next(rows_of(spark, [(1, "abcd")]), [(1, "abcd")])
    check_next(rows_of(spark, [(1, "same")] * 9), [(1, "same")] * 9)
    assert P.fingerprint_documents(rows_of(spark, [(1, "x")]).limit(0)).count() == 0


def flipped(rng, p, n):
    bits = np.unpackbits(np.frombuffer(bytes.fromhex(p), np.uint8))
    bits[rng.choice(P.BITS, n, replace=False)] ^= 1
    return np.packbits(bits).tobytes().hex()


@pytest.mark.parametrize(("radius", "rows"), [(7, 4096), (0, 4096), (3, 5), (12, 50), (30, 7)])
def test_search_equals_brute_force(spark, radius, rows):
    """Also where many fingerprints share a block, in salted parts."""
    rng = np.random.default_rng(radius)
    centres = [rng.bytes(32).hex() for _ in range(6)]
    prints = sorted({flipped(rng, centres[k % 6], int(rng.integers(0, 2 * radius + 2))) for k in range(300)} | {("ab" * 8) + rng.bytes(24).hex() for _ in range(40)})
    table = spark.createDataFrame([(p, 1 + k % 3) for k, p in enumerate(prints)], "fingerprint string, n bigint")
    asks = prints[::7]
    got = {r["fingerprint"]: r["n_near"] for r in P.near(table, spark.createDataFrame([(p,) for p in asks], "fingerprint string"), radius, rows).collect()}
    data = np.array([list(bytes.fromhex(p)) for p in prints], np.uint8)
    want = {p: sum(1 + k % 3 for k in np.flatnonzero(P.distance(np.array(list(bytes.fromhex(p)), np.uint8), data) <= radius).tolist()) for p in asks}
    assert got == want


def test_blocks_cover_the_fingerprint():
    for radius in (0, 3, 7, 12, 63):
        cuts = P.blocks_of(radius)
        assert cuts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(cuts, cuts[1:])) and sum(cuts[-1]) == 64  # noqa: B905
    with pytest.raises(ValueError):
        P.blocks_of(64)


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    check_next(docs, rows)
    out = P.fingerprint_documents(docs).collect()
    by_text = {}
    for r in out:
        by_text.setdefault(dict(rows)[r["doc_id"]], set()).add(r["fingerprint"])
    assert len(out) == len(rows) and all(len(v) == 1 for v in by_text.values()) and sum(r["near_edited"] > r["near_next"] for r in out) > 0.95 * len(out)

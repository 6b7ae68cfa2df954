import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from helixtab.llm import lm_score
from helixtab.llm.textnum import chunks

TEXTS = ["the cat sat on the mat", "The cat\tran. the dog     x", None, "", " \n ", "é" * 50 + " ABC abc", "word " * 5000, "the cat sat on the mat"]


def words(text):
    return [w.lower() if w.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def brute(rows):
    counts, held = Counter(), {k: zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in rows}
    for k, t in rows:
        if not held[k]:
            counts.update([*words(t), None])
    n, v = sum(counts.values()), len(counts)
    return {k: (held[k], len(words(t)) + 1, sum(counts[w] > 0 for w in [*words(t), None]), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*words(t), None])) for k, t in rows}


def check(frame, rows):
    want = brute(rows)
    got = frame.collect()
    assert len(got) == len(rows)
    for r in got:
        held, n, known, total, base = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total), r
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
        assert r["score"] < 0 and math.isfinite(r["score"])


def test_edge_cases_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "HOT", 3)  # so that most words take the join
    rows = [(10 * k, t) for k, t in enumerate(TEXTS)]
    check(lm_score.score(spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id bigint, text string, key int")), rows)


def test_table_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(lm_score.score(docs), [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_empty_table(spark):
    assert lm_score.score(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def encoded(texts):
    table, out = lm_score.Words(lm_score.VOCABULARY), []
    for _, _, buf, offsets in chunks(pa.array(texts, pa.string())):
        _, _, _, ids, bounds = lm_score.subwords(table, buf, offsets)
        out += [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


def test_subwords_are_those_of_each_word():
    encode = lm_score.encoder(lm_score.VOCABULARY)[0].encode_ordinary
    for text, ids in zip(TEXTS, encoded(TEXTS), strict=True):
        assert ids.tolist() == [x for w in words(text) for x in encode(" " + w)] + [lm_score.END]


def test_each_token_is_scored_once_and_causally():
    counts = np.random.default_rng(1).integers(0, 50, lm_score.IDS).astype(float)
    maps = lm_score.classes(counts)
    assert np.allclose(np.bincount(maps["of"], np.exp(maps["within"].astype(float))), 1, atol=1e-3)
    p = lm_score.initial(maps, counts)
    ids = np.random.default_rng(2).integers(0, lm_score.IDS, 100)
    x, score, _ = lm_score.windows(ids, np.array([0, 70, 71, 100]), maps)
    assert sorted(score[score >= 0].tolist()) == list(range(100))
    whole = lm_score.log_probability(p, maps, ids, np.array([0, 100]))[0]
    # naive: one position at a time, over the same windows
    total = 0.0
    for t in range(100):
        k = t // lm_score.STRIDE
        seen = range(max(0, k * lm_score.STRIDE - lm_score.CONTEXT), t + 1)
        row = lambda i: maps["row"][ids[i - 1]] if i else lm_score.INPUTS - 2
        e = np.array([p["E"][row(i)] + p["P"][i - k * lm_score.STRIDE + lm_score.CONTEXT] for i in seen], float)
        a = np.exp((e[-1] @ p["Q"] / 4) @ (e @ p["K"]).T)
        z = (e[-1] + (a / a.sum()) @ (e @ p["V"])) @ p["U"] + p["b"]
        total += z[maps["of"][ids[t]]] - np.log(np.exp(z).sum()) + maps["within"][ids[t]]
    assert abs(whole - total) < 1e-3 * abs(total)


def test_gradients():
    counts = np.ones(lm_score.IDS)
    maps = lm_score.classes(counts)
    p = {k: v.astype(np.float64) for k, v in lm_score.initial(maps, counts).items()}
    ids = np.arange(60) % 37
    x, score, first = lm_score.windows(ids, np.array([0, 60]), maps)
    valid, target = score >= 0, maps["of"][ids][np.maximum(0, score)]
    _, g = lm_score.train_step(p, x, first, target, valid)
    for name in p:
        at = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        step, losses = 1e-3, []
        for sign in (1, -1):
            q = {k: v.copy() for k, v in p.items()}
            q[name][at] += sign * step
            losses.append(lm_score.train_step(q, x, first, target, valid)[0])
        assert abs((losses[0] - losses[1]) / (2 * step) - g[name][at]) < 2e-2 * abs(g[name][at]) + 1e-4, name


def test_training_beats_shares_of_the_corpus(sf):
    import pyarrow.parquet as pq

    parts = encoded(pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist())
    cut = 150
    counts = np.bincount(np.concatenate(parts[:cut]), minlength=lm_score.IDS).astype(float)
    maps = lm_score.classes(counts)
    p, _ = lm_score.train(np.concatenate(parts[:cut]), np.r_[0, np.cumsum([len(x) for x in parts[:cut]])], maps, counts)
    held = parts[cut:]
    got = lm_score.log_probability(p, maps, np.concatenate(held), np.r_[0, np.cumsum([len(x) for x in held])]).sum()
    shares = np.log((counts + 1) / (counts + 1).sum())[np.concatenate(held)].sum()
    assert got > shares


def test_every_training_text_is_learned_from(spark):
    """Other word orders leave all counts as they are; those of the texts beyond the first 1000 by hash must reach the network too."""
    from pyspark.sql import functions as F

    learned = [k for k in range(1600) if zlib.crc32(str(k).encode()) % 7 != 2]
    ids = spark.createDataFrame([(k,) for k in learned], "doc_id bigint")
    late = {r["doc_id"] for r in ids.orderBy(F.xxhash64("doc_id"), "doc_id").collect()[1000:]}
    assert late
    text = lambda k: f"the cat sat on mat number {k} and the dog ran home".split()
    scores = []
    for turned in (set(), late):
        rows = [(k, " ".join(text(k)[::-1] if k in turned else text(k))) for k in range(1600)]
        scores.append({r["doc_id"]: r["score"] for r in lm_score.score(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()})
    same = [k for k in range(1600) if k not in late]
    assert max(abs(scores[0][k] - scores[1][k]) for k in same) > 1e-3


def test_tokens_trained_on_are_all(spark):
    texts = [f"some words of text {k} " * (k % 5) for k in range(300)]
    parts = encoded(texts)
    counts = np.bincount(np.concatenate(parts), minlength=lm_score.IDS).astype(float)
    learn = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert lm_score.fit(learn, lm_score.classes(counts), counts, lm_score.VOCABULARY)[1] == sum(map(len, parts))


def test_missing_vocabulary_is_told_before_any_job(spark):
    import pytest

    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    with pytest.raises(FileNotFoundError, match="spark.helixtab.vocabulary"):
        lm_score.score(docs, vocabulary="/nowhere/ranks.tiktoken")


def test_context_tells_ids_of_a_class_apart():
    """Two ids of one class and of equal shares, each after a word of its own: what the network has seen must decide between them."""
    counts = np.ones(lm_score.IDS)
    counts[:400] = 1000
    of = lm_score.classes(counts)["of"]
    c = np.bincount(of[100:400], minlength=lm_score.CLASSES).argmax()
    x, y = 100 + np.flatnonzero(of[100:400] == c)[:2]
    a, b = 1, 2
    pairs = np.random.default_rng(4).integers(0, 2, 400_000)
    ids = np.stack([np.where(pairs, a, b), np.where(pairs, x, y)], 1).ravel()
    maps = lm_score.classes(counts)
    p, _ = lm_score.train(ids, np.arange(0, len(ids) + 1, 60), maps, counts)
    bounds = np.array([0, 2])
    likes = {(u, v): lm_score.log_probability(p, maps, np.array([u, v]), bounds)[0] for u in (a, b) for v in (x, y)}
    assert (likes[a, x] - likes[a, y]) - (likes[b, x] - likes[b, y]) > 1


def random_tree():
    rng = np.random.default_rng(5)
    counts = np.floor(1e6 / np.arange(1, lm_score.IDS + 1) ** 1.2)
    maps = lm_score.classes(counts)
    p = lm_score.initial(maps, counts)
    return maps, p | {"W": rng.standard_normal(p["W"].shape).astype(np.float32)}, rng


def test_probabilities_of_all_ids_sum_to_one():
    maps, p, rng = random_tree()
    h = np.repeat(rng.standard_normal((1, lm_score.DIM)).astype(np.float32), lm_score.IDS, 0)
    below = lm_score.inner(p, maps, h, np.arange(lm_score.IDS), gradient=False)
    assert np.allclose(np.bincount(maps["of"], np.exp(below)), 1, atol=1e-3)
    assert np.abs(below - maps["within"]).max() > 1


def test_gradients_below_the_root():
    maps, p, rng = random_tree()
    p = {k: v.astype(np.float64) for k, v in p.items()}
    h, ids = rng.standard_normal((300, lm_score.DIM)), rng.integers(0, 3000, 300)
    valid = np.arange(300) % 7 > 0
    out, dh, rows, dw = lm_score.inner(p, maps, h, ids, valid)
    assert not out[~valid].any() and not dh[~valid].any()
    loss = lambda q, g: -lm_score.inner(q, maps, g, ids, valid, gradient=False).sum()
    for _ in range(5):
        d, e = rng.standard_normal(h.shape), {"W": np.zeros_like(p["W"])}
        e["W"][rows] = rng.standard_normal(dw.shape)
        step = 1e-4
        slope = (loss(p | {"W": p["W"] + step * e["W"]}, h + step * d) - loss(p | {"W": p["W"] - step * e["W"]}, h - step * d)) / (2 * step)
        assert abs(slope - ((dh * d).sum() + (dw * e["W"][rows]).sum())) < 1e-2 * max(1, abs(slope))


def test_stored_ids_are_those_of_the_texts(spark):
    docs = spark.createDataFrame([(k, t, False) for k, t in enumerate(TEXTS)], "doc_id bigint, text string, held_out boolean")
    got = {r["doc_id"]: np.frombuffer(r["ids"], np.uint16).tolist() for r in lm_score.encoded(docs, lm_score.VOCABULARY).collect()}
    want = encoded(TEXTS)
    assert got == {k: ids.tolist() for k, ids in enumerate(want)}
    column = pa.array([np.array(x, np.uint16).tobytes() for x in want], pa.binary())
    opens = lm_score.encoder(lm_score.VOCABULARY)[1]
    for sliced in (column, column[2:]):
        for first, end, ids, bounds in lm_score.stored(sliced):
            keys, rows = lm_score.word_keys(ids, opens)
            texts = TEXTS[len(column) - len(sliced) :][first:end]
            each = [w for t in texts for w in words(t)]
            assert np.bincount(rows, minlength=len(texts)).tolist() == [len(words(t)) for t in texts]
            assert len(set(zip(keys.tolist(), each, strict=True))) == len(set(keys.tolist())) == len(set(each))


def test_encoded_texts_are_not_left_in_scratch(spark, monkeypatch, tmp_path):
    import os

    from helixtab.llm import common

    monkeypatch.setattr(common, "scratch_root", lambda spark: f"file://{tmp_path}")
    rows = [(10 * k, t) for k, t in enumerate(TEXTS)]
    check(lm_score.score(spark.createDataFrame(rows, "doc_id bigint, text string")), rows)
    left = [name for _, names, _ in os.walk(tmp_path) for name in names if "-" in name]
    assert any("scored" in name for name in left) and not any("encoded" in name for name in left)


def test_windows_are_those_of_each_text_in_32_bits():
    ids, bounds = np.random.default_rng(6).integers(0, lm_score.IDS, 200), np.array([0, 1, 25, 49, 50, 200])
    x, score, first = lm_score.windows(ids, bounds, lm_score.classes(np.ones(lm_score.IDS)))
    want = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        for k in range(a, b, lm_score.STRIDE):
            see = [ids[t - 1] if t > a else lm_score.INPUTS - 2 for t in range(k - lm_score.CONTEXT, min(k + lm_score.STRIDE, b))]
            want.append((see, [t if t < b else -1 for t in range(k, k + lm_score.STRIDE)], k == a))
    assert len(x) == len(want)
    for got_x, got_score, got_first, (see, scored, opening) in zip(x.tolist(), score.tolist(), first, want, strict=True):
        assert got_x[: len(see)] == see and got_score == scored and got_first == opening
    assert x.dtype == score.dtype == np.int32


def test_met_words_are_kept_in_order(monkeypatch):
    texts = [" ".join(f"w{k * 7919 % 400}x" for k in range(j, j + 60)) for j in range(0, 600, 20)]
    want, encode = [], lm_score.encoder(lm_score.VOCABULARY)[0].encode_ordinary
    for t in texts:
        want.append([x for w in words(t) for x in encode(" " + w)] + [lm_score.END])
    for most in (10**6, 100):  # the second forgets words between texts
        monkeypatch.setattr(lm_score, "CACHE", most)
        table = lm_score.Words(lm_score.VOCABULARY)
        for t, ids in zip(texts, want, strict=True):
            for _, _, buf, offsets in chunks(pa.array([t])):
                assert lm_score.subwords(table, buf, offsets)[3].tolist() == ids
            assert (np.diff(table.known.astype(object)) > 0).all() and len(table.known) == len(table.row)


def test_update_is_adams_step():
    rng = np.random.default_rng(7)
    p, m, s = ({"W": rng.random((9, 3, 2)).astype(np.float32)} for _ in range(3))
    rows, v = np.array([1, 4, 8]), rng.standard_normal((3, 3, 2)).astype(np.float32)
    one, two = m["W"][rows] + 0.1 * (v - m["W"][rows]), s["W"][rows] + 0.02 * (v * v - s["W"][rows])
    rate = 1e-2 * min(1, 30 / 20) / (1 - 0.9**30) * math.sqrt(1 - 0.98**30)
    want = p["W"].copy()
    want[rows] -= rate * one / (np.sqrt(two) + 1e-8)
    lm_score.update(p, {"W": (rows, v.copy())}, m, s, 30, 1e-2)
    assert np.allclose(p["W"], want, atol=1e-6) and np.allclose(m["W"][rows], one, atol=1e-6) and np.allclose(s["W"][rows], two, atol=1e-6)

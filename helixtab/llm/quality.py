"""Quality classifier from supervised subword embeddings (Joulin et al., 2017): vectors of hashed words, word pairs and
character n-grams are averaged per document and a softmax layer gives the class; numpy stochastic gradient descent trains both.

The model is fitted on at most SAMPLE labelled documents (whole texts), chosen by a hash of the id, in one task of fixed size.
Scoring reads every whole text once. Since the score of a document is linear in the average before the softmax, each feature's
vector is reduced to its one logit beforehand, so that scoring adds one number a feature.

Null text is the empty text; it has no features and its score is that of the bias. Rows with a null id count as held out of
training. Repeated rows are scored alike; a document labelled twice is trained on with each label, and of rows that repeat an id the
least text. Without labels every score is 1.
Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import only
from .textnum import PLACE, chunks, mix, spans_hash, words

BUCKETS = 1 << 17
DIM = 8
EPOCHS = 5
RATE = 0.5
NGRAMS = (2, 3, 4)
#: Bytes of text of which features are held at once (a longer text's words are held whole, its n-grams in pieces of this size).
PIECE = 1 << 17
#: Bound on the labelled documents that the model is fitted on.
SAMPLE = 3000
THRESHOLD = 0.7
_RAW = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.uint64)
_SHIFT = np.uint64(64 - 17)


def features(buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket and row of every feature of a chunk, one kind after another: words, pairs of words (a word and itself is one feature whatever
    the word, since repetition tells more than what is repeated), and character n-grams (bytes, case kept). One kind is held at a time."""
    starts, ends, rows = words(buf, offsets)
    if len(starts):
        h, rows = spans_hash(buf, starts, ends), rows.astype(np.int32)
        yield (h >> _SHIFT).astype(np.int32), rows
        pair = rows[1:] == rows[:-1]
        both = np.where(h[1:] == h[:-1], PLACE[2], mix(h[:-1] * PLACE[0] + h[1:] * PLACE[1]))[pair]
        yield (both >> _SHIFT).astype(np.int32), rows[1:][pair]
        del h, both, pair
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    for a in range(0, len(buf), PIECE):
        raw = _RAW[buf[a : a + PIECE + max(NGRAMS) - 1]]  # n-grams that begin in the piece
        for n in NGRAMS:
            m = min(PIECE, len(buf) - a - n + 1)
            if m > 0:
                h = raw[:m] * PLACE[n]
                for j in range(1, n):
                    h += raw[j : m + j] * PLACE[n - j]
                h *= np.uint64(0x9E3779B97F4A7C15)
                h >>= _SHIFT
                inside = owner[a : a + m] == owner[a + n - 1 : a + n - 1 + m]
                yield h[inside].astype(np.int32), owner[a : a + m][inside]


def bags(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct features and their shares for each text."""
    for _, _, buf, offsets in chunks(texts, PIECE):
        rows = len(offsets) - 1
        keys, n = np.empty(0, np.int64), np.empty(0, np.int32)
        for f, r in features(buf, offsets):
            k, c = np.unique(r.astype(np.int64) * BUCKETS + f, return_counts=True)
            keys, n = np.concatenate((keys, k)), np.concatenate((n, c.astype(np.int32)))
        keys, back = np.unique(keys, return_inverse=True)
        n = np.bincount(back, n, minlength=len(keys)) if len(keys) else np.empty(0)
        cuts = np.searchsorted(keys, np.arange(rows + 1, dtype=np.int64) * BUCKETS)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield (keys[a:b] % BUCKETS).astype(np.int32), (n[a:b] / max(1.0, n[a:b].sum())).astype(np.float32)


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 1) -> tuple[np.ndarray, float]:
    """One logit for each bucket (class 1 against 0) and the bias."""
    rng = np.random.Generator(np.random.PCG64(seed))
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim))
    out, bias = np.zeros((dim, 2)), np.zeros(2)
    steps, at = epochs * max(1, len(docs)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(docs)):
            ids, share = docs[k]
            lr = rate * (1 - at / steps)
            at += 1
            hidden = share @ vectors[ids]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = out @ p
            out -= lr * np.outer(hidden, p)
            bias -= 0.1 * lr * p
            if len(ids):  # as is usual for averaged inputs, by the share relative to the largest
                vectors[ids] -= lr * np.outer(share / share.max(), back)
    w = out[:, 1] - out[:, 0]
    return vectors @ w, float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, held_out_of: int = 4, held_out: int = 2) -> tuple[np.ndarray, float] | None:
    """docs(doc_id, text), labels(doc_id, quality) -> (logit of each bucket, bias); None without labels."""
    known = only(labels, doc_id="bigint", quality="int").filter("quality in (0, 1) and doc_id is not null").distinct()
    known = known.filter(F.crc32(F.col("doc_id").cast("string")) % held_out_of != held_out)
    n = known.count()
    if n > 8 * sample:  # the least hashes are below this cut, so that no task sorts the least of every task
        known = known.filter(F.xxhash64("doc_id") < int(-(2.0**63) + 2.0**64 * 4 * sample / n))
    chosen = known.orderBy(F.xxhash64("doc_id"), "quality").limit(sample)
    rows = only(docs, doc_id="bigint", text="string").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = rows.select("text", "quality").repartition(1).sortWithinPartitions(F.xxhash64("text"), "quality")

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, ys = [], []
        for f in frames:
            seen += list(bags(pa.array(f["text"], pa.string(), from_pandas=True)))
            ys.append(f["quality"].to_numpy(np.int64))
        if seen:
            weights, bias = train(seen, np.concatenate(ys))
            yield pd.DataFrame({"weights": [weights.astype(np.float32).tobytes()], "bias": [bias]})

    got = rows.mapInPandas(learn, "weights binary, bias double").collect()
    return (np.frombuffer(got[0]["weights"], np.float32).astype(np.float64), got[0]["bias"]) if got else None


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None) -> DataFrame:
    """docs(doc_id, text, ...) -> the same columns and `quality_score`."""
    weights, bias = model or (np.zeros(BUCKETS), 50.0)
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias))
    names = docs.columns
    k = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b0 = shared.value
        for b in batches:
            z = np.full(len(b), b0)
            for first, end, buf, offsets in chunks(b.column(k), PIECE):
                total, n = np.zeros(end - first), np.zeros(end - first)
                for f, r in features(buf, offsets):
                    n += np.bincount(r, minlength=end - first)
                    total += np.bincount(r, w[f], minlength=end - first)
                z[first:end] += total / np.maximum(1, n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], [*names, "quality_score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, held_out_of: int = 4, held_out: int = 2) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, quality) -> doc_id, held_out, score, predicted."""
    rows = only(docs, doc_id="bigint", text="string")
    scored = score(rows, fit(rows, labels, held_out_of=held_out_of, held_out=held_out)).withColumnRenamed("quality_score", "score")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % held_out_of == held_out, F.lit(True))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

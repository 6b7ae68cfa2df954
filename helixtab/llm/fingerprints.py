"""SimHash fingerprints of documents, and the search of all fingerprints within a Hamming radius.

Terms are the pairs and the five-word runs of a text's words (A-Z taken as a-z; a text with fewer words gives its whole sequence as one). Every occurrence votes on BITS signed bits with the
bits of its term's hash, so a term's weight is how often it occurs, and long texts are counted piece by piece: votes are whole numbers and don't depend on where pieces end. A text
without words has no votes and the fingerprint of zeros.

Search: a fingerprint is cut in radius + 1 blocks; two within the radius agree in one of them at least, so tables of all fingerprints, each permuted so that another block leads, are
joined on the leading block. Equal fingerprints are one row. Rows of a block that many share are dealt to several tasks by salt, and the queries of that block to each of them;
pairs are compared and counted there and never come out. A pair counts at the first block that it agrees in.

Null text is the empty text. Null ids come first in order; repeated rows are documents each, next to each other. The document after the last is the first; one alone is its own next.
Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, only
from .textnum import SPACE, chunks, mix, shingles, spans_hash, words

BITS, WIDTHS = 256, (2, 5)
#: Hamming radius of the search; rows of a block that one task compares.
RADIUS, ROWS = 7, 4096
#: Bytes of a text, and code points of texts, that are worked on at once; terms and texts whose votes are counted at once.
PIECE, TEXTS, TERMS, MANY = 1 << 18, 1 << 20, 1 << 14, 64
#: Of each byte, its bits as votes of one and minus one.
SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64) * 2 - 1
QUARTERS = np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _count(votes: np.ndarray, terms: np.ndarray, rows: np.ndarray) -> None:
    """Adds the votes of terms; rows (of votes) ascend."""
    at = 0
    while at < len(terms):
        end = min(at + TERMS, len(terms), int(np.searchsorted(rows, rows[at] + MANY)))
        low = int(rows[at])
        n = int(rows[end - 1]) - low + 1
        data = np.ascontiguousarray(mix(terms[at:end, None] + QUARTERS)).view(np.uint8)  # a byte of the hash at each of BITS / 8 places
        places = data.shape[1]
        index = (((rows[at:end] - low) * places)[:, None] + np.arange(places)) * 256 + data
        seen = np.bincount(index.ravel(), minlength=n * places * 256).reshape(n, places, 256)
        votes[low : low + n] += (seen @ SIGNS).reshape(n, -1)
        at = end


def _pieces(buf: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The bytes in pieces that end with white space."""
    at = 0
    while at < len(buf):
        end = at + size
        while end < len(buf):  # the next white space, looked for a piece at a time
            gap = np.flatnonzero(SPACE[buf[end : end + size]])
            if len(gap):
                end += int(gap[0])
                break
            end += size
        yield buf[at:end]
        at = end


def fingerprints(texts: pa.Array, size: int = PIECE) -> np.ndarray:
    """A fingerprint a text, as bytes."""
    votes = np.zeros((len(texts), BITS), np.int64)
    for first, end, buf, offsets in chunks(texts, size):
        if end - first > 1:
            starts, ends, rows = words(buf, offsets)
            h = spans_hash(buf, starts, ends)
            for width in WIDTHS:
                _count(votes[first:end], *shingles(h, rows, width))
            continue
        held, whole = np.empty(0, np.uint64), False  # the last words of the piece before
        for piece in _pieces(buf, size):
            starts, ends, _ = words(piece, np.array([0, len(piece)]))
            h = spans_hash(piece, starts, ends)
            if not len(h):
                continue
            for width in WIDTHS:
                mine = np.r_[held[max(0, len(held) - width + 1) :], h]
                if len(mine) >= width:
                    _count(votes[first:end], *shingles(mine, np.zeros(len(mine), np.int64), width))
            whole |= len(held) + len(h) >= max(WIDTHS)
            held = np.r_[held, h][-max(WIDTHS) + 1 :]
        if not whole and len(held):  # fewer words than some width: the sequence as one
            for width in WIDTHS:
                if len(held) < width:
                    _count(votes[first:end], *shingles(held, np.zeros(len(held), np.int64), width))
    return np.packbits(votes > 0, axis=1)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def edited(text: str, after: str) -> str:
    """The text with its last half replaced by as much of the beginning of the next one, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _compared(ids: list, texts: list[str], after: list[str], prints: np.ndarray, next_prints: np.ndarray) -> list[pa.Array]:
    new = [edited(x, y) for x, y in zip(texts, after, strict=True)]
    other = fingerprints(pa.array(new, pa.large_string()))
    likeness = [pa.array(1 - distance(prints, p) / BITS, pa.float64()) for p in (other, next_prints)]
    as_text = [pa.array([p.tobytes().hex() for p in x], pa.string()) for x in (prints, other)]
    return [pa.array(ids, pa.int64()), pa.array([len(x) for x in texts], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in new], pa.string()), *as_text, *likeness]


FIELDS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> the columns FIELDS. Documents are dealt in ranges of doc_id, so that the next one is the next row; the last of a range meets the first of the next in a table
    of one row a range."""
    rows = only(docs, doc_id="bigint", text="string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = ["doc_id", "_tie", "_n"]
    rows = rows.withColumns({"_tie": F.xxhash64("text"), "_n": F.monotonically_increasing_id()})
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, edge, ids, texts, n = TaskContext.get().partitionId(), [], [], [], 0
        prints = np.empty((0, BITS // 8), np.uint8)

        def out(columns: list[pa.Array], part_no: int | None = None, first: str | None = None, text: str | None = None) -> pa.RecordBatch:
            m = len(columns[0])
            more = [pa.array([part_no] * m, pa.int32()), pa.array([first] * m, pa.string()), pa.array([text] * m, pa.string())]
            return pa.RecordBatch.from_arrays([*columns, *more], [*FIELDS, "part", "first", "last"])

        def flush() -> Iterator[pa.RecordBatch]:
            """All rows but the last, whose next one is still to come."""
            nonlocal ids, texts, n, prints
            prints = np.concatenate([prints, fingerprints(pa.array(texts[len(prints) :], pa.large_string()))])
            if len(ids) > 1:
                yield out(_compared(ids[:-1], texts[:-1], texts[1:], prints[:-1], prints[1:]))
            ids, texts, prints, n = ids[-1:], texts[-1:], prints[-1:], 0

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if not edge:
                    edge.append(text)
                ids.append(doc_id)
                texts.append(text)
                n += len(text)
                if n >= TEXTS:
                    yield from flush()
        if ids:
            yield from flush()
            nothing = [pa.array(ids, pa.int64()), *(pa.nulls(1, t) for t in [pa.int64()] + [pa.string()] * 3 + [pa.float64()] * 2)]
            yield out(nothing, part, edge[0], texts[0])

    made = Scratch(docs.sparkSession).write(dealt.mapInArrow(run, SCHEMA + ", part int, first string, last string"), "fingerprints")
    edges = made.filter("part is not null").select("doc_id", "part", "first", "last")
    parts = edges.select("part").withColumn("_one", F.lit(0))  # a number a range
    after = parts.select("part", F.coalesce(F.lead("part").over(Window.partitionBy("_one").orderBy("part")), F.min("part").over(Window.partitionBy("_one"))).alias("after"))
    pairs = edges.select("doc_id", "part", "last").join(after, "part").join(edges.select(F.col("part").alias("after"), F.col("first").alias("next")), "after").select("doc_id", "last", "next")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                doc_id, text, after = (batch.column(c)[k].as_py() for c in range(3))
                prints = fingerprints(pa.array([text, after], pa.large_string()))
                yield pa.RecordBatch.from_arrays(_compared([doc_id], [text], [after], prints[:1], prints[1:]), FIELDS)

    return made.filter("part is null").select(*FIELDS).unionByName(pairs.mapInArrow(meet, SCHEMA))


def blocks_of(radius: int) -> list[tuple[int, int]]:
    """(first hexadecimal digit, digits) of each block; radius + 1 blocks, at most a digit each."""
    digits = BITS // 4
    if not 0 <= radius < digits:
        raise ValueError(f"the radius must be from 0 to {digits - 1}")
    edges = [digits * k // (radius + 1) for k in range(radius + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]  # noqa: B905


def near(table: DataFrame, queries: DataFrame, radius: int = RADIUS, rows: int = ROWS) -> DataFrame:
    """table(fingerprint, n): distinct fingerprints and how many documents have each; queries(fingerprint): distinct ones -> (fingerprint, n_near): documents of the table whose fingerprint
    is within the radius, those of the same fingerprint included."""
    cuts = blocks_of(radius)
    permuted = F.array(*(F.struct(F.lit(k).alias("block"), F.substring("fingerprint", a + 1, n).alias("lead")) for k, (a, n) in enumerate(cuts)))
    tables = table.select("fingerprint", "n", F.explode(permuted).alias("b")).select("fingerprint", "n", "b.*")
    asked = queries.select("fingerprint", F.explode(permuted).alias("b")).select("fingerprint", "b.*")
    keys = asked.select("block", "lead").distinct()
    salts = tables.groupBy("block", "lead").agg(F.ceil(F.count("*") / rows).cast("int").alias("salts")).join(keys, ["block", "lead"])
    own = tables.join(salts, ["block", "lead"]).select("block", "lead", F.pmod(F.xxhash64("fingerprint"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), "fingerprint", "n")
    sent = asked.join(salts, ["block", "lead"]).select("block", "lead", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "fingerprint", F.lit(None).cast("bigint").alias("n"))
    dealt = own.unionByName(sent).repartition("block", "lead", "salt").sortWithinPartitions("block", "lead", "salt", "kind")
    edges = [(a // 2, -(-(a + n) // 2)) for a, n in cuts]

    def agree(a: np.ndarray, b: np.ndarray, block: int) -> np.ndarray:
        """Which pairs agree in an earlier block."""
        out = np.zeros((len(a), len(b)), bool)
        for (digit, size), (low, high) in zip(cuts[:block], edges[:block], strict=True):
            mask = np.full(high - low, 255, np.uint8)
            mask[0] &= 15 if digit % 2 else 255
            mask[-1] &= 240 if (digit + size) % 2 else 255
            out |= ((a[:, None, low:high] ^ b[None, :, low:high]) & mask == 0).all(axis=-1)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asked, found = None, [], []
        part: list[tuple[bytes, int]] = []

        def compare() -> None:
            nonlocal part
            if asked and part:
                a, b, n = np.frombuffer(b"".join(asked), np.uint8).reshape(-1, BITS // 8), np.frombuffer(b"".join(p for p, _ in part), np.uint8).reshape(-1, BITS // 8), np.array([k for _, k in part])
                for at in range(0, len(a), 64):
                    q = a[at : at + 64]
                    hit = (distance(q[:, None], b[None]) <= radius) & ~agree(q, b, key[0])
                    for k in np.flatnonzero(hit.any(axis=1)):
                        found.append((q[k].tobytes().hex(), int(n[hit[k]].sum())))
            part = []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["fingerprint", "n_near"])

        for batch in batches:
            for block, lead, salt, kind, fingerprint, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (block, lead, salt):
                    compare()
                    key, asked = (block, lead, salt), []
                if kind:
                    part.append((bytes.fromhex(fingerprint), n))
                    if len(part) >= 1024:
                        compare()
                else:
                    asked.append(bytes.fromhex(fingerprint))
            if len(found) >= 4096:
                yield made()
                found = []
        compare()
        yield made()

    return dealt.mapInArrow(run, "fingerprint string, n_near bigint").groupBy("fingerprint").agg(F.sum("n_near").alias("n_near"))


def fingerprint_documents(docs: DataFrame, radius: int = RADIUS, every: int = 100) -> DataFrame:
    """with_next(), and n_near of the documents whose id is divisible by `every` (null for the others): how many other documents have a fingerprint within the radius."""
    out = Scratch(docs.sparkSession).write(with_next(docs), "prints")
    table = out.groupBy("fingerprint").agg(F.count("*").alias("n"))
    asks = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    counts = near(table, out.filter(asks).select("fingerprint").distinct(), radius)
    asked = out.filter(asks).join(counts, "fingerprint").select(*FIELDS, (F.col("n_near") - 1).alias("n_near"))
    return out.filter(~asks).withColumn("n_near", F.lit(None).cast("bigint")).unionByName(asked)

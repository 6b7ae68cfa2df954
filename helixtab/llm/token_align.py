"""Alignment of two tokenizers over texts: a byte-level BPE (A) and a sentence-piece BPE (B).

Each text is encoded whole by both. Places where a token of A and one of B end together are shared ends; those at which both tokenizers go on with a token that begins with a
space are anchors, which cut the text into windows of token ids, about one a word. What happens in a window depends on its ids alone, so each distinct window is aligned once a
task and remembered by its id tuples. Groups lie between shared ends; the last tokens of a group are linked. No token is empty, so a text has as many links as groups.

Counts of linked id pairs cover the whole corpus. The FREQUENT most counted pairs (a table of fixed size) are known to every task; the others of a text meet their counts in a
join. The highest count of each id of B is a table of at most as many rows as B has ids.

Texts that are null or empty, or of which either tokenizer's bytes aren't exactly a space and the text, have no tokens: zeros and an empty digest. Repeated rows are aligned each
and all count; null ids stay. Empty table: empty result. Extra columns are ignored. A text of any length is encoded whole, as its tokens may depend on all of it.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, most_frequent, only
from .textnum import mix

#: Vocabulary files, at the same path on the driver and every executor; the session's SETTINGS or align()'s parameters name others.
A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
SETTINGS = ("spark.helixtab.tokenizer.a", "spark.helixtab.tokenizer.b")
#: Pairs of ids are one number: A's id above SHIFT bits of B's.
SHIFT = 15
#: Most counted pairs known to every task.
FREQUENT = 1 << 17
#: Code points of texts that are encoded at once, and distinct windows a task remembers.
PIECE, MEMO = 1 << 19, 400_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others in order from code point 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(2)
def encoder_a(path: str):
    """(encoding, bytes of each id) of a byte-level BPE file, whose ids are in order of merging."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    letters, special = byte_letters(), {t["content"] for t in file["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): k for token, k in file["model"]["vocab"].items() if token not in special}
    table = [b""] * (max(ranks.values()) + 1)
    for token, k in ranks.items():
        table[k] = token
    return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), table


@lru_cache(2)
def encoder_b(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if model.get_piece_size() > 1 << SHIFT:
        raise ValueError(f"{path}: more than {1 << SHIFT} ids")
    pieces = [model.id_to_piece(k) for k in range(model.get_piece_size())]
    return model, [bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]


class Side:
    """A tokenizer's tables: bytes, their number, and whether they begin with a space."""

    def __init__(self, encode, table: list[bytes]):
        self.encode, self.table = encode, table
        self.size = np.array([len(t) for t in table], np.int64)
        self.spaced = np.array([t[:1] == b" " for t in table], bool)

    def exact(self, ids: list[int], text: bytes) -> bool:
        return b"".join(map(self.table.__getitem__, ids)) == text


def sides(path_a: str, path_b: str) -> tuple[Side, Side]:
    for path in (path_a, path_b):
        if not os.path.isfile(path):
            raise FileNotFoundError(f"{path}: the vocabulary must be on the driver and every executor; {' and '.join(SETTINGS)} name the paths")
    a, table_a = encoder_a(path_a)
    b, table_b = encoder_b(path_b)
    return Side(a.encode_ordinary, table_a), Side(lambda text: b.encode(text), table_b)


def groups_of(a: np.ndarray, many_a: np.ndarray, b: np.ndarray, many_b: np.ndarray, left: Side, right: Side) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Groups of each window, as text; the linked pairs of all, and how many each has. A window is the next many_a ids of a and many_b of b, which have equally many bytes. All windows are
    aligned as one: each ends with a shared end."""
    end_a, end_b = np.cumsum(left.size[a]), np.cumsum(right.size[b])
    shared = np.intersect1d(end_a, end_b, assume_unique=True)
    group_a, group_b = np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)
    upto_a, upto_b = np.searchsorted(end_a, shared) + 1, np.searchsorted(end_b, shared) + 1  # tokens up to the end of each group
    # a group's tokens of A, then those of B, each with the mark behind it
    words = np.empty(len(a) + len(b), np.int64)
    words[np.arange(len(a)) + np.r_[0, upto_b][group_a]] = 2 * a + np.isin(np.arange(len(a)), upto_a - 1)
    words[np.arange(len(b)) + upto_a[group_b]] = 2 * len(left.table) + 2 * b + np.isin(np.arange(len(b)), upto_b - 1)
    text = list(map(_marked(len(left.table), len(right.table)).__getitem__, words.tolist()))
    cuts = np.cumsum(many_a + many_b).tolist()
    many = np.diff(np.r_[0, group_a[np.cumsum(many_a) - 1] + 1])
    return ["".join(text[i:j])[:-1] for i, j in zip([0, *cuts], cuts)], a[upto_a - 1] << SHIFT | b[upto_b - 1], many  # noqa: B905


@lru_cache(1)
def _marked(n_a: int, n_b: int) -> list[str]:
    """Ids of A with a comma and with the mark between the sides, then ids of B with a comma and with the mark between groups."""
    return [f"{k}{mark}" for k in range(n_a) for mark in ",|"] + [f"{k}{mark}" for k in range(n_b) for mark in ",;"]


def _ragged(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Slices [first, first + size) of flat, one after another."""
    total = np.cumsum(size)
    return flat[np.arange(total[-1] if len(total) else 0) + np.repeat(first - (total - size), size)]


class Aligner:
    """Aligns texts; remembers windows by their id tuples."""

    def __init__(self, left: Side, right: Side):
        self.left, self.right = left, right
        self.clear()

    def clear(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.texts: list[str] = []
        self.pairs, self.first, self.many = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)  # linked pairs of all windows, and where each window's are

    def numbers(self, a: np.ndarray, first_a: np.ndarray, size_a: np.ndarray, b: np.ndarray, first_b: np.ndarray, size_b: np.ndarray) -> list[int]:
        """The remembered number of each window; new ones are aligned. A window's key is its id tuples as bytes: the number of A's ids, those, and B's."""
        size = 1 + size_a + size_b
        begin = np.cumsum(size) - size
        flat = np.empty(size.sum(), np.int32)
        flat[begin] = size_a
        for ids, first, many, skip in ((a, first_a, size_a, 1), (b, first_b, size_b, 1 + size_a)):
            inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            flat[np.repeat(begin + skip, many) + inside] = ids[np.repeat(first, many) + inside]
        data, edges = flat.tobytes(), (4 * np.r_[begin, len(flat)]).tolist()
        memo, n, out, new = self.memo, len(self.texts), [], []
        for k in range(len(size)):
            key = data[edges[k] : edges[k + 1]]
            found = memo.get(key)
            if found is None:
                found = memo[key] = n + len(new)
                new.append(k)
            out.append(found)
        if new:
            fa, sa, fb, sb = first_a[new], size_a[new], first_b[new], size_b[new]
            texts, pairs, many = groups_of(_ragged(a, fa, sa), sa, _ragged(b, fb, sb), sb, self.left, self.right)
            self.texts += texts
            self.first = np.r_[self.first, len(self.pairs) + np.cumsum(many) - many]
            self.pairs, self.many = np.r_[self.pairs, pairs], np.r_[self.many, many]
        return out

    def tokens(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of both, None where their bytes aren't a space and the text."""
        if not text:
            return None
        whole = b" " + text.encode()
        a = self.left.encode(" " + text)
        if not self.left.exact(a, whole):
            return None
        b = self.right.encode(text)
        return (a, b) if self.right.exact(b, whole) else None

    def align(self, texts: list[str]) -> list[tuple[int, int, str, np.ndarray]]:
        """(tokens of A, of B, groups, linked pairs) of each text."""
        if len(self.memo) > MEMO:
            self.clear()
        found = [self.tokens(t) for t in texts]
        own = [k for k, f in enumerate(found) if f]
        out: list[tuple[int, int, str, np.ndarray]] = [(0, 0, "", np.empty(0, np.int64))] * len(texts)
        if not own:
            return out
        many_a, many_b = np.array([len(found[k][0]) for k in own]), np.array([len(found[k][1]) for k in own])
        a, b = (np.concatenate([np.array(found[k][side], np.int64) for k in own]) for side in (0, 1))
        # ends run through all texts, which have equal bytes on both sides, so a text's end is a shared one
        end_a, end_b = np.cumsum(self.left.size[a]), np.cumsum(self.right.size[b])
        place = np.searchsorted(end_b, end_a)
        ia = np.flatnonzero(end_b[np.minimum(place, len(b) - 1)] == end_a)
        ib = place[ia]
        last_a = np.zeros(len(a), bool)
        last_a[np.cumsum(many_a) - 1] = True
        more_a, more_b = np.minimum(ia + 1, len(a) - 1), np.minimum(ib + 1, len(b) - 1)
        anchor = last_a[ia] | (self.left.spaced[a[more_a]] & self.right.spaced[b[more_b]])
        cut_a, cut_b = ia[anchor] + 1, ib[anchor] + 1
        first_a, first_b = np.r_[0, cut_a[:-1]], np.r_[0, cut_b[:-1]]
        size_a, size_b = cut_a - first_a, cut_b - first_b
        per_text = np.diff(np.r_[0, np.cumsum(last_a[ia[anchor]])])
        windows = self.windows(a, b, first_a, size_a, first_b, size_b)
        upto = np.r_[0, np.flatnonzero(per_text) + 1]
        many = self.many[windows]
        links, upto_link = _ragged(self.pairs, self.first[windows], many), np.r_[0, np.cumsum(many)][upto]
        texts = list(map(self.texts.__getitem__, windows.tolist()))
        for n, k in enumerate(own):
            out[k] = (int(many_a[n]), int(many_b[n]), ";".join(texts[upto[n] : upto[n + 1]]), links[upto_link[n] : upto_link[n + 1]])
        return out

    def windows(self, a: np.ndarray, b: np.ndarray, first_a: np.ndarray, size_a: np.ndarray, first_b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
        """The remembered number of each window: equal ones are looked up once."""
        with np.errstate(over="ignore"):
            h = np.add.reduceat(mix(a.astype(np.uint64) + (np.arange(len(a)) - np.repeat(first_a, size_a)).astype(np.uint64) * np.uint64(1 << 20)), first_a)
            h ^= mix(np.add.reduceat(mix(b.astype(np.uint64) + (np.arange(len(b)) - np.repeat(first_b, size_b) + 1).astype(np.uint64) * np.uint64(1 << 40)), first_b))
        of, kinds = pd.factorize(h)
        at = np.empty(len(kinds), np.int64)
        at[of[::-1]] = np.arange(len(h))[::-1]
        same = at[of]
        equal = np.array_equal(size_a, size_a[same]) and np.array_equal(size_b, size_b[same]) and np.array_equal(a, _ragged(a, first_a[same], size_a)) and np.array_equal(b, _ragged(b, first_b[same], size_b))
        if not equal:  # two windows have one hash: each by its ids
            at, of = np.arange(len(first_a)), np.arange(len(first_a))
        known = np.array(self.numbers(a, first_a[at], size_a[at], b, first_b[at], size_b[at]), np.int64)
        return known[of]


def _pieces(texts: Iterable[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Rows in runs of about PIECE code points."""
    at, n, held = 0, 0, []
    for k, text in enumerate(texts):
        held.append(text or "")
        n += len(held[-1])
        if n >= PIECE:
            yield at, held
            at, n, held = k + 1, 0, []
    if held:
        yield at, held


def aligned(docs: DataFrame, path_a: str, path_b: str, groups: bool = False) -> DataFrame:
    """docs(doc_id, text) -> rid (a number of the row), doc_id, n_a, n_b, n_links, groups_sha256, codes and times: distinct linked pairs and how often; with `groups`, the groups too."""
    fields = "rid bigint, doc_id bigint, n_a bigint, n_b bigint, n_links bigint, groups_sha256 string, codes array<int>, times array<int>" + (", groups string" if groups else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, rid = Aligner(*sides(path_a, path_b)), TaskContext.get().partitionId() << 40
        for batch in batches:
            for at, texts in _pieces(x.as_py() for x in batch.column(1)):
                rows = aligner.align(texts)
                counted = [np.unique(r[3], return_counts=True) for r in rows]
                cuts = pa.array(np.cumsum([0, *(len(c[0]) for c in counted)]), pa.int32())
                lists = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([c[k] for c in counted]), pa.int32())) for k in (0, 1)]
                numbers = [pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)]
                digests = pa.array([hashlib.sha256(r[2].encode()).hexdigest() if r[2] else "" for r in rows], pa.string())
                columns = [pa.array(np.arange(rid, rid + len(rows))), batch.column(0).slice(at, len(rows)), *numbers, pa.array([len(r[3]) for r in rows], pa.int64()), digests, *lists]
                rid += len(rows)
                names = ["rid", "doc_id", "n_a", "n_b", "n_links", "groups_sha256", "codes", "times"]
                if groups:
                    columns, names = [*columns, pa.array([r[2] for r in rows], pa.string())], [*names, "groups"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return only(docs, doc_id="bigint", text="string").mapInArrow(run, fields)


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, groups: bool = False, frequent: int = FREQUENT) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and groups): tokens of both, groups and links of each text; links whose pair has the
    highest count in the corpus that its id of B has, and the sum of the pairs' counts over the links. FileNotFoundError before any job where the driver has no vocabulary."""
    spark = docs.sparkSession
    path_a, path_b = path_a or spark.conf.get(SETTINGS[0], A_FILE), path_b or spark.conf.get(SETTINGS[1], B_FILE)
    ids_b = len(sides(path_a, path_b)[1].table)
    scratch = Scratch(spark)
    rows = scratch.write(aligned(docs, path_a, path_b, groups), "aligned")
    linked = rows.select(F.explode(F.arrays_zip("codes", "times")).alias("l")).groupBy(F.col("l.codes").alias("code")).agg(F.sum("l.times").cast("bigint").alias("n"))
    counts = scratch.write(linked, "pairs")
    best = np.zeros(ids_b, np.int64)
    for r in counts.groupBy(F.col("code").bitwiseAND(F.lit((1 << SHIFT) - 1)).alias("b")).agg(F.max("n").alias("n")).collect():  # a row an id of B
        best[r["b"]] = r["n"]
    known = most_frequent(counts, frequent).toPandas().sort_values("code")
    shared = spark.sparkContext.broadcast((known["code"].to_numpy(np.int64), known["n"].to_numpy(np.int64), best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n, best = shared.value
        top = n == best[codes & ((1 << SHIFT) - 1)]
        for b in batches:
            lists, times = b.column(1), b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            own = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            at = np.minimum(np.searchsorted(codes, own), max(0, len(codes) - 1))
            hit = codes[at] == own if len(codes) else np.zeros(len(own), bool)
            at, w, r = at[hit], times[hit], row[hit]
            sums, bests = np.zeros(len(lists), np.int64), np.zeros(len(lists), np.int64)
            np.add.at(sums, r, w * n[at])
            np.add.at(bests, r, w * top[at])
            cuts = pa.array(np.searchsorted(row[~hit], np.arange(len(lists) + 1)), pa.int32())
            rare = [pa.ListArray.from_arrays(cuts, pa.array(v[~hit], pa.int32())) for v in (own, times)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sums), pa.array(bests), *rare], ["rid", "count_sum", "n_best", "codes", "times"])

    told = scratch.write(rows.select("rid", "codes", "times").mapInArrow(run, "rid bigint, count_sum bigint, n_best bigint, codes array<int>, times array<int>"), "told")
    highest = spark.createDataFrame(list(enumerate(best.tolist())), "b int, most bigint")  # at most as many rows as B has ids
    rare = told.select("rid", F.explode(F.arrays_zip("codes", "times")).alias("l")).select("rid", F.col("l.codes").alias("code"), F.col("l.times").alias("times"))
    rare = rare.join(counts, "code").join(F.broadcast(highest), F.col("code").bitwiseAND(F.lit((1 << SHIFT) - 1)) == F.col("b"))
    rare = rare.groupBy("rid").agg(F.sum(F.col("times") * F.col("n")).alias("_sum"), F.sum(F.when(F.col("n") == F.col("most"), F.col("times")).otherwise(0)).alias("_best"))
    out = rows.drop("codes", "times").join(told.select("rid", "count_sum", "n_best"), "rid").join(rare, "rid", "left")
    more = [F.col("groups")] if groups else []
    return out.select("doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"), "groups_sha256", *more)

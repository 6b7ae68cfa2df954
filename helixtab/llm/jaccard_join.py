"""N-gram Jaccard self-join with signature trees.

Every document is its set of distinct word shingles; sets link at a Jaccard similarity of at least t. The trees of sigtree.py find
the links: their nodes hold OR-combined bitmaps and size ranges, and a dual traversal prunes pairs of nodes by the largest overlap that is possible.

The root level is spread over the cluster by tokens, which bounds the overlap too: in any total order of tokens, two linked sets share
one among the first n - ceil(t n) + 1 of each. The order puts tokens that a fixed-size count sketch found frequent last, then goes by
hash, so a passage that many documents share is rarely a key. Sets of one token whose sizes and places leave room for a link are one tree,
which is traversed twice. First with short signatures, to mark the sets that still have a partner: at most a row a set, however many
partners it has. Then with the shingles of the marked sets alone: what the bitmaps let pass is decided there exactly, sets that are
linked already are skipped, and only edges of a spanning forest come out. So no step writes pairs, and no more rows than it reads.
A pair is looked at where its first common token is, as far as the first EARLY tokens of its sets tell.

A token of more sets than BLOCK, or of very long ones, is cut into blocks by classes of size and by hash. Each block is joined with itself in
the first round; in a second round, which knows the components of the first, blocks of equal or neighbouring classes are
joined with one another, and sets that are one component already are neither marked nor sent.

Sets that are equal are one class from the start, told by a 64-bit hash of the set and its size. Shingles are 64-bit hashes. No link
between different texts is left out: filters only drop pairs that cannot reach t.

Null and empty texts have no shingles and link with nothing. Rows with a null id get a null component and link with nothing; rows that
repeat an id are documents of their own, of which the component has the smallest id. Empty table: empty result. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bitmap, only, with_bit
from .components import components
from .sigtree import LEAF, Signatures, Tree, Union, crossed, dual, signature
from .textnum import chunks, mix, shingles, spans_hash, words

WIDTH = 5
#: Similarity as a fraction of whole numbers: 100 * intersection >= 80 * union.
T_NUM, T_DEN = 80, 100
SKETCH_BITS = 20
#: A token that the sketch counts this often is split over several tasks when its sets are gathered.
HOT = 2000
#: Sets of a token in a block, and shingles of these sets: what a task holds at once is twice that.
BLOCK, BLOCK_SHINGLES = 4096, 1 << 21
#: First tokens of a set that travel with it, to tell whether two sets meet at an earlier token too.
EARLY = 8
#: Bits a shingle of the signatures that are sent, and of those made of the shingles themselves.
SENT_BITS, FULL_BITS = 2, 8
#: Sets that all others of a tree are compared with before it is traversed.
CENTRES = 3
#: Bytes of text that are hashed at once, or one longer text.
PIECE = 1 << 18
#: Tokens of more than a block are broadcast up to this many.
BROADCAST_TOKENS = 100_000


#: First tokens whose rows are made at once.
TOKENS = 1 << 18


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values).view(np.int64) if values else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column as unsigned numbers, and the sizes of the lists."""
    return np.asarray(column.flatten(), np.int64).view(np.uint64), np.asarray(pc.list_value_length(column), np.int64)


def _sets_of(texts: pa.Array, width: int) -> Iterator[tuple[int, int, list[np.ndarray], np.ndarray]]:
    """(first row, end row, sorted distinct shingles of each row, class ids) of each chunk."""
    for first, end, buf, offsets in chunks(texts, PIECE):
        starts, ends, rows = words(buf, offsets)
        h, r = shingles(spans_hash(buf, starts, ends), rows, width)
        cuts = np.searchsorted(r, np.arange(end - first + 1))
        each = [np.unique(h[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        sums = np.array([mix(x).sum(dtype=np.uint64) + np.uint64(len(x)) for x in each], np.uint64)
        yield first, end, each, mix(sums).view(np.int64)


def _sketch(docs: DataFrame, width: int) -> np.ndarray:
    """Counts of shingles by their leading bits, where they stand out in a task; a fixed number of counters, used to order tokens only."""
    size, shift = 1 << SKETCH_BITS, np.uint64(64 - SKETCH_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for b in batches:
            for _, _, buf, offsets in chunks(b.column(0), PIECE):
                starts, ends, rows = words(buf, offsets)
                h, _ = shingles(spans_hash(buf, starts, ends), rows, width)
                counts += np.bincount((h >> shift).astype(np.int64), minlength=size)
        at = np.flatnonzero(counts >= max(6, 6 * counts.mean()))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], ["bucket", "n"])

    out = np.zeros(size, np.int64)
    for r in docs.select("text").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def _sets(width: int, shared, num: int, den: int):
    """Size, class, signature and first tokens of each document's set; tokens that the sketch counts often come last, then by hash."""
    shift = np.uint64(64 - SKETCH_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for b in batches:
            for first, end, each, cid in _sets_of(b.column(1), width):
                firsts = []
                for x in each:
                    w = counts[(x >> shift).astype(np.int64)]
                    keep = len(x) - -(-num * len(x) // den) + 1 if len(x) else 0
                    firsts.append(x[np.argsort(w, kind="stable")[:keep]] if w.any() else x[:keep])
                n = pa.array([len(x) for x in each], pa.int64())
                sigs = [signature(x, SENT_BITS) if len(x) else x for x in each]
                yield pa.RecordBatch.from_arrays([b.column(0)[first:end], n, pa.array(cid), _lists(sigs), _lists(firsts)], ["doc_id", "n", "cid", "sig", "prefix"])

    return run


def _prefixes(shared):
    """A row of each first token; rest: shingles of the set from this one on. A token that the sketch counts often is salted."""
    shift = np.uint64(64 - SKETCH_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for b in batches:
            if not len(b):
                continue
            every = np.r_[0, np.cumsum(np.asarray(pc.list_value_length(b.column(2)), np.int64))]
            at = 0
            while at < len(b):  # sets of TOKENS first tokens together, or one set: a batch of long texts has thousands of times more
                end = max(at + 1, int(np.searchsorted(every, every[at] + TOKENS, side="right")) - 1)
                part, at = b.slice(at, end - at), end
                cid, n = np.asarray(part.column(0)), np.asarray(part.column(1))
                tokens, sizes = _flat(part.column(2))
                own = np.repeat(np.arange(len(part)), sizes)
                pos = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                salts = counts[(tokens >> shift).astype(np.int64)] // HOT
                mixed = mix(cid[own].view(np.uint64))
                salt = np.where(salts > 0, 1 + (mixed % np.maximum(1, salts).astype(np.uint64)).astype(np.int64), 0)
                # size and rest in one number: rows are many and short
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(salt, pa.int32()), pa.array(cid[own]), pa.array((n[own].astype(np.int64) << 32) | (n[own] - pos))], ["token", "salt", "cid", "sizes"])

    return run


def _may(n: np.ndarray, rest: np.ndarray, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sizes leave room for a link; at the first token that two sets share, what is left of either must hold the overlap."""
    return (den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j])) & ((den + num) * np.minimum(rest[i], rest[j]) >= num * (n[i] + n[j]))


def _near(starts: np.ndarray, sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of the same group, of groups of at most `most` rows."""
    starts, sizes = starts[(few := (sizes > 1) & (sizes <= most))], sizes[few]
    rows = np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    end = np.repeat(starts + sizes, sizes)
    parts = [(rows[ok], rows[ok] + d) for d in range(1, most) if (ok := rows + d < end).any()]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 2


def _shared(num: int, den: int):
    """Over rows sorted by (token, salt, cid): each set once a token, where another set has the token too. Of at most LEAF sets only those are
    left whose size and place allow a link with another. No more than LEAF rows are held back, however long a run is."""
    names, kinds = ["token", "cid", "n", "rest"], (pa.int64(), pa.int64(), pa.int32(), pa.int32())

    def settle(t, s, cid, n, rest, begun: bool, goes_on: bool) -> pa.RecordBatch:
        """begun: rows of the first run went before; goes_on: rows of the last run will follow."""
        keep = np.zeros(len(t), bool)
        if len(t):
            starts = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (s[1:] != s[:-1])])
            sizes = np.diff(np.r_[starts, len(t)])
            whole = (sizes > LEAF) | (s[starts] > 0)
            whole[0] |= begun
            whole[-1] |= goes_on
            keep |= np.repeat(whole, sizes)
            i, j = _near(starts[~whole], sizes[~whole], LEAF)
            ok = _may(n, rest, i, j, num, den)
            keep[i[ok]] = keep[j[ok]] = True
        return pa.RecordBatch.from_arrays([pa.array(x[keep], kind) for x, kind in zip((t, cid, n, rest), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, begun, last = None, False, None  # rows of the last run, whether others of it went out, the last row
        for b in batches:
            if not len(b):
                continue
            t, s, cid, sizes = (np.asarray(b.column(k)) for k in range(4))
            fresh = np.r_[last != (t[0], s[0], cid[0]), (t[1:] != t[:-1]) | (s[1:] != s[:-1]) | (cid[1:] != cid[:-1])]
            if begun and last[:2] != (t[0], s[0]):
                begun = False
            last = (t[-1], s[-1], cid[-1])
            rows = [x[fresh] for x in (t, s, cid, sizes >> 32, sizes & 0xFFFFFFFF)]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            t, s = rows[:2]
            if not len(t):
                held = None
                continue
            at = len(t) - int(np.argmax(((t != t[-1]) | (s != s[-1]))[::-1])) if ((t != t[-1]) | (s != s[-1])).any() else 0
            same = at == 0 and begun  # the whole batch goes on with a run of which rows went out
            if same or len(t) - at > LEAF:
                yield settle(*rows, begun, True)
                held, begun = None, True
            else:
                yield settle(*(x[:at] for x in rows), begun, False)
                held, begun = [x[at:] for x in rows], False
        if held is not None:
            yield settle(*held, begun, False)

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: int = 3) -> Iterator[pa.Table]:
    """Tables of whole groups by the first columns: a batch and a group at most."""
    held, key = [], None
    for b in batches:
        if not len(b):
            continue
        k = np.stack([np.asarray(b.column(c)) for c in range(keys)], axis=1)
        new = np.r_[key is None or tuple(k[0]) != key, (k[1:] != k[:-1]).any(1)]
        starts = np.flatnonzero(new)
        if len(starts):
            held.append(b.slice(0, starts[-1]))
            if sum(map(len, held)):
                yield pa.Table.from_batches(held).combine_chunks()
            held = [b.slice(starts[-1])]
        else:
            held.append(b)
        key = tuple(k[-1])
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(t: pa.Table, name: str) -> pa.Array:
    c = t[name]
    return c.chunk(0) if c.num_chunks == 1 else c.combine_chunks()


def _bounds(t: pa.Table, keys: int = 3) -> tuple[np.ndarray, np.ndarray]:
    k = np.stack([np.asarray(_column(t, t.column_names[c])) for c in range(keys)], axis=1)
    starts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(1)])
    return starts, np.diff(np.r_[starts, len(k)])


def _sides(rows: np.ndarray, block: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Rows of the two blocks of a group, the second None where it is one block with itself."""
    return (rows, None) if one[rows[0]] == two[rows[0]] else (rows[block[rows] == one[rows]], rows[block[rows] != one[rows]])


def _leaf(rows: int) -> int:
    """Sets in a leaf: more in large groups, where whole leaves are compared at once."""
    return LEAF if rows <= 32 * LEAF else 4 * LEAF


def _mark(num: int, den: int):
    """Over whole groups (token, one, two): the sets that have a partner which sizes, places and signatures do not rule out."""
    names = ["token", "one", "two", "block", "cid", "comp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            one, two, block, cid, n, rest, comp = (np.asarray(_column(t, c), np.int64) for c in ("one", "two", "block", "cid", "n", "rest", "comp"))
            sigs = Signatures(*_flat(_column(t, "sig")))
            flat, sizes = _flat(_column(t, "early"))
            early, at = np.zeros((len(n), EARLY), np.uint64), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            own = np.repeat(np.arange(len(n)), sizes)
            before = at < (n - rest)[own]  # those that come before the token of the row
            early[own[before], at[before]] = flat[before]
            marked = np.zeros(len(n), bool)

            def judge(i: np.ndarray, j: np.ndarray, one=one, two=two, block=block, n=n, rest=rest, comp=comp, sigs=sigs, early=early, marked=marked) -> None:
                ok = _may(n, rest, i, j, num, den) & (comp[i] != comp[j]) & ((one[i] == two[i]) | (block[i] != block[j]))
                i, j = i[ok], j[ok]
                met = ((early[i][:, :, None] == early[j][:, None, :]) & (early[i] != 0)[:, :, None]).any((1, 2)) if len(i) else np.zeros(0, bool)
                i, j = i[~met], j[~met]
                ok = (den + num) * sigs.most(n, i, j) >= num * (n[i] + n[j])
                marked[i[ok]] = marked[j[ok]] = True

            starts, lengths = _bounds(t)
            i, j = _near(starts, lengths, LEAF)
            for a in range(0, len(i), 1 << 17):
                judge(i[a : a + (1 << 17)], j[a : a + (1 << 17)])
            for start, length in zip(starts[lengths > LEAF].tolist(), lengths[lengths > LEAF].tolist(), strict=True):
                left, right = _sides(np.arange(start, start + length), block, one, two)
                if right is not None and not (len(left) and len(right)):
                    continue
                a = Tree(n, sigs, left, num, den, _leaf(length))
                b = a if right is None else Tree(n, sigs, right, num, den, _leaf(length))
                for x, y in dual(a, b, lambda x, y, marked=marked: bool(marked[x].all() and marked[y].all())):
                    judge(*crossed(x, y))
            yield from t.select(names).filter(pa.array(marked)).to_batches()

    return run


def _decide(num: int, den: int):
    """Over whole groups (token, one, two) of marked sets with their shingles: edges (a, b) of a spanning forest of the links that join
    different components."""

    def group(rows: np.ndarray, one, two, block, cid, n, union: Union, tokens: list[np.ndarray], out: list[tuple[int, int]]) -> None:
        left, right = _sides(rows, block, one, two)
        if right is not None and not (len(left) and len(right)):
            return

        def exact(x: int, ys: np.ndarray) -> None:
            ys = ys[(den * np.minimum(n[ys], n[x]) >= num * np.maximum(n[ys], n[x])) & (union.find(ys) != union.root(x))]
            if not len(ys):
                return
            flat, tx = np.concatenate([tokens[y] for y in ys.tolist()]), tokens[x]
            hit = tx[np.minimum(np.searchsorted(tx, flat), len(tx) - 1)] == flat
            shared = np.add.reduceat(hit, np.cumsum(n[ys]) - n[ys], dtype=np.int64)
            for y in ys[(den + num) * shared >= num * (n[ys] + n[x])].tolist():
                if union.unite(x, y):
                    out.append((int(cid[x]), int(cid[y])))

        if len(rows) <= LEAF:
            for k, x in enumerate(left.tolist()):
                exact(x, left[k + 1 :] if right is None else right)
            return
        each = [signature(tokens[k], FULL_BITS) for k in rows.tolist()]
        sizes = np.zeros(len(n), np.int64)
        sizes[rows] = [len(x) for x in each]
        sigs = Signatures(np.concatenate(each), sizes)
        for x in left[:: -(-len(left) // CENTRES)].tolist():
            exact(x, left if right is None else right)
        a = Tree(n, sigs, left, num, den, _leaf(len(rows)))
        b = a if right is None else Tree(n, sigs, right, num, den, _leaf(len(rows)))

        def joined(x: np.ndarray, y: np.ndarray) -> bool:
            r = union.find(x)
            return bool((r == r[0]).all() and (y is x or (union.find(y) == r[0]).all()))

        for x, y in dual(a, b, joined):
            i, j = crossed(x, y)
            ok = (den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j])) & (union.find(i) != union.find(j))
            i, j = i[ok], j[ok]
            ok = (den + num) * sigs.most(n, i, j) >= num * (n[i] + n[j])
            i, j = i[ok], j[ok]
            for k in np.unique(i).tolist():
                exact(k, j[i == k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            one, two, block, cid, comp = (np.asarray(_column(t, c), np.int64) for c in ("one", "two", "block", "cid", "comp"))
            flat, n = _flat(_column(t, "tokens"))
            tokens = np.split(flat, np.cumsum(n)[:-1])
            out: list[tuple[int, int]] = []
            for start, length in zip(*_bounds(t), strict=True):
                rows = np.arange(start, start + length)
                # the same two sets may be in another group of the batch: each has its own union
                part = slice(start, start + length)
                group(rows - start, one[part], two[part], block[part], cid[part], n[part], Union(comp[part]), tokens[start : start + length], out)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else ([], []))], ["a", "b"])

    return run


def _links(rows: DataFrame, classes: DataFrame, docs: DataFrame, scratch: Scratch, width: int, num: int, den: int) -> DataFrame:
    """rows(token, one, two, block, cid, n, rest, comp) -> edges (a, b) of links between different components."""
    sent = rows.join(classes.select("cid", "sig", "early"), "cid").select("token", "one", "two", "block", "cid", "n", "rest", "comp", "sig", F.slice("early", F.lit(1), (F.col("n") - F.col("rest")).cast("int")).alias("early"))
    marks = sent.repartition("token", "one", "two").sortWithinPartitions("token", "one", "two", "block").mapInArrow(_mark(num, den), "token bigint, one bigint, two bigint, block bigint, cid bigint, comp bigint")
    marks = scratch.write(marks, "marks")
    # a bitmap of fixed size says which documents may be wanted: only these are read as sets again
    reps = marks.select("cid").distinct().join(classes.select("cid", "rep"), "cid").select("rep")
    wanted = with_bit(docs, "doc_id", bitmap(reps, "rep")).filter("may")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, each, cid in _sets_of(b.column(0), width):
                yield pa.RecordBatch.from_arrays([pa.array(cid), _lists(each)], ["cid", "tokens"])

    sets = wanted.select("text").mapInArrow(again, "cid bigint, tokens array<bigint>").groupBy("cid").agg(F.first("tokens").alias("tokens"))
    both = marks.join(sets, "cid").select("token", "one", "two", "block", "cid", "comp", "tokens")
    links = both.repartition("token", "one", "two").sortWithinPartitions("token", "one", "two", "block").mapInArrow(_decide(num, den), "a bigint, b bigint")
    out = scratch.write(links, "links")
    scratch.drop(marks)
    return out


def _blocks(shared: DataFrame, hot: DataFrame, num: int, den: int, small) -> DataFrame:
    """Rows of the tokens hot(token) with their block, for each pair of blocks (one, two) that they are in. Blocks are of one class of sizes: only
    equal and neighbouring classes can link. small: broadcasts tables of the hot tokens where these are few."""
    rows = shared.join(hot, "token").withColumn("s", F.floor(F.log(F.col("n")) / float(np.log(den / num) + 1e-9)).cast("bigint"))
    per = rows.groupBy("token", "s").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("bigint").alias("blocks"))
    beside = lambda d, name: per.select("token", (F.col("s") + d).alias("s"), F.col("blocks").alias(name))
    per = per.join(beside(1, "below"), ["token", "s"], "left").join(beside(-1, "above"), ["token", "s"], "left")
    # one row a hot token and class of sizes: no more than rows / BLOCK tokens
    rows = rows.join(small(per), ["token", "s"]).withColumn("block", F.col("s") * (1 << 20) + F.pmod(F.xxhash64("cid"), F.col("blocks")))
    others = lambda d, n: F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda k: (F.col("s") + d) * (1 << 20) + k)).otherwise(F.array().cast("array<bigint>"))
    every = F.concat(others(-1, F.coalesce("below", F.lit(0))), others(0, F.col("blocks")), others(1, F.coalesce("above", F.lit(0))))
    rows = rows.withColumn("other", F.explode(every))
    return rows.select("token", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "cid", "n", "rest")


def similar(docs: DataFrame, width: int = WIDTH, num: int = T_NUM, den: int = T_DEN) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = only(docs, doc_id="bigint", text="string")
    known_ids = rows.filter("doc_id is not null")
    sketch = spark.sparkContext.broadcast(_sketch(known_ids, width))
    sets = scratch.write(rows.mapInArrow(_sets(width, sketch, num, den), "doc_id bigint, n bigint, cid bigint, sig array<bigint>, prefix array<bigint>"), "sets")
    linkable = sets.filter("n > 0 and doc_id is not null")
    classes = linkable.groupBy("cid").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first(F.slice("prefix", 1, EARLY)).alias("early"))
    classes = scratch.write(classes, "classes")
    prefix = linkable.select("cid", "n", "prefix").mapInArrow(_prefixes(sketch), "token bigint, salt int, cid bigint, sizes bigint")
    shared = prefix.repartition("token", "salt").sortWithinPartitions("token", "salt", "cid").mapInArrow(_shared(num, den), "token bigint, cid bigint, n int, rest int")
    shared = scratch.write(shared, "shared")
    ids = scratch.write(sets.select("doc_id", "n", "cid"), "ids")
    scratch.drop(sets)
    hot = shared.groupBy("token").agg(F.count("*").alias("df"), F.sum("n").alias("sizes")).filter((F.col("df") > BLOCK) | (F.col("sizes") > BLOCK_SHINGLES)).select("token")
    hot = scratch.write(hot, "hot")
    n_hot = hot.count()
    small = lambda df: F.broadcast(df) if n_hot <= BROADCAST_TOKENS else df
    none = F.lit(0).cast("bigint")
    plain = (shared.join(small(hot), "token", "left_anti") if n_hot else shared).select("token", none.alias("one"), none.alias("two"), none.alias("block"), "cid", "n", "rest")
    used = [ids, classes, shared, hot]
    if n_hot:
        few = lambda df: F.broadcast(df) if n_hot <= BROADCAST_TOKENS // 64 else df  # noqa: E731  a token has some 60 classes of sizes at most
        cut = _blocks(shared, small(hot), num, den, few)
        plain = plain.unionByName(cut.filter("one = two"))
    links = _links(plain.withColumn("comp", F.col("cid")), classes, known_ids, scratch, width, num, den)
    used.append(links)
    if n_hot:
        first = components(links, scratch)
        wide = cut.filter("one != two").join(first.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("component", "cid")).drop("component")
        more = _links(wide, classes, known_ids, scratch, width, num, den)
        used += [first, more]
        links = links.unionByName(more)
    comp = components(links, scratch)
    named = classes.select("cid", "rep").join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    of = scratch.write(named.select("cid", "component").join(least, "component").select("cid", "component_id"), "components")
    out = ids.select("doc_id", F.col("n").alias("n_shingles"), "cid").join(of, "cid", "left")
    out = scratch.write(out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component_id")), F.col("doc_id"))).alias("component_id")), "result")
    scratch.drop(*used, comp, of)
    return out


#: Brute force: pairs that share a shingle, found by joining the shingles.
ORACLE = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from w),
f as (select doc_id, s, len(s) as n, md5(array_to_string(list_sort(s), chr(10))) as h from s),
c as (select h, min(doc_id) as rep, any_value(n) as n, any_value(s) as s from f where n > 0 group by h),
x as (select rep, n, unnest(s) as t from c),
p as (select a.rep as a, b.rep as b, a.n as na, b.n as nb, count(*) as k from x a join x b on a.t = b.t and a.rep < b.rep and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by all having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l as (select a, b from p union all select b, a from p),
r as (select a as node, least(a, b) as m from l union select l.b, r.m from r join l on r.node = l.a),
m as (select node, min(m) as m from r group by node)
select f.doc_id, f.n::bigint as n_shingles, coalesce(least(m.m, c.rep), c.rep, f.doc_id) as component_id
from f left join c on f.h = c.h left join m on m.node = c.rep
"""

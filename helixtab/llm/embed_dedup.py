"""Embedding near-duplicates by epsilon grid order join (Boehm et al., 2001) on leading principal dimensions.

Cosine >= t of unit vectors is a distance of at most eps = sqrt(2 - 2t). Vectors are put in epsilon grid order (the
lexicographic order of their cells of width eps on the leading principal dimensions), the order is cut into intervals of INTERVAL
vectors, and pairs of intervals whose bounding boxes are within eps are joined: each pair recursively halves its two sequences and
skips blocks that are provably distant, by the boxes of their coordinates and of the norm left outside the leading dimensions.
What is left is compared in blocks of LEAF x LEAF, with the cosine in double precision deciding.

Equal vectors are one class with a count, so a group of copies costs one comparison; near copies meet in blocks, which emit a
count per vector and a spanning forest, never all pairs.

Vectors of each dimension are joined apart, one dimension after another. Vectors that are null, zero, or hold null or non-finite components, and a
vector that is alone in its dimension, link with nothing: no links, a component of their own. Rows with a null id are returned with a null component and linked
with nothing. Rows that repeat an id are vectors of their own. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, only
from .components import components

LEAD = 6
INTERVAL = 8192
LEAF = 512
#: Slack of single-precision products and coordinates.
SLACK = 1e-4
#: Intervals that one meets in a task, partitions of these tasks at most, and marks of rows of the interval itself.
PARTNERS, MOST_PARTS = 64, 20_000
OWN, WITH_ITSELF = -1, -2


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def principal(vectors: DataFrame, dim: int, lead: int) -> tuple[np.ndarray, int]:
    """Leading principal axes of the unit vectors, from their summed moments (dim * dim numbers a task, summed by Spark)."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim + 1))
        for b in batches:
            x = _unit(_matrix(b.column(0), dim))
            x = np.c_[x, np.ones(len(x))]
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], ["k", "v"])

    sums = vectors.select("embedding").mapInArrow(moments, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((dim + 1) ** 2)
    for r in sums:
        total[r["k"]] = r["v"]
    total = total.reshape(dim + 1, dim + 1)
    n = max(1.0, total[-1, -1])
    mean = total[-1, :-1] / n
    _, axes = np.linalg.eigh(total[:-1, :-1] / n - np.outer(mean, mean))
    return axes[:, ::-1][:, :lead].copy(), int(round(total[-1, -1]))


def _distant(lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray, eps: float) -> bool:
    gap = np.maximum(0, np.maximum(lo2 - hi, lo - hi2))
    return float(gap @ gap) > eps * eps


class Join:
    """Recursive join of two sequences in epsilon grid order; `same` if they are one."""

    def __init__(self, x: np.ndarray, y: np.ndarray, copies: np.ndarray, t: float):
        self.x, self.y, self.copies, self.t = x, y, copies.astype(np.int64), t
        self.x32 = x.astype(np.float32)
        self.eps = float(np.sqrt(max(0.0, 2 - 2 * t))) + SLACK
        self.links = np.zeros(len(x), np.int64)
        self.parent = np.arange(len(x))

    def find(self, i: np.ndarray) -> np.ndarray:
        p = self.parent[i]
        while True:
            q = self.parent[p]
            if (q == p).all():
                return p
            p = q

    def unite(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.find(i), self.find(j)
            open_ = a != b
            if not open_.any():
                break
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))

    def leaf(self, a: slice, b: slice) -> None:
        if not (self.x32[a] @ self.x32[b].T >= self.t - SLACK).any():
            return
        linked = self.x[a] @ self.x[b].T >= self.t
        if a == b:
            np.fill_diagonal(linked, False)
        i, j = np.nonzero(linked)
        if len(i):
            self.links[a] += linked @ self.copies[b]
            if a != b:
                self.links[b] += self.copies[a] @ linked
            self.unite(i + a.start, j + b.start)

    def run(self, a: slice, b: slice) -> None:
        if a != b and _distant(self.y[a].min(0), self.y[a].max(0), self.y[b].min(0), self.y[b].max(0), self.eps):
            return
        n, m = a.stop - a.start, b.stop - b.start
        if n <= LEAF and m <= LEAF:
            self.leaf(a, b)
        elif a == b:
            mid = a.start + n // 2
            left, right = slice(a.start, mid), slice(mid, a.stop)
            for x, y in ((left, left), (left, right), (right, right)):
                self.run(x, y)
        elif n >= m:
            mid = a.start + n // 2
            self.run(slice(a.start, mid), b)
            self.run(slice(mid, a.stop), b)
        else:
            mid = b.start + m // 2
            self.run(a, slice(b.start, mid))
            self.run(a, slice(mid, b.stop))


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple[int, ...], list[pa.RecordBatch]]]:
    """Groups of rows that are equal in the first columns, one at a time."""
    key, held = None, []
    for b in batches:
        g = np.stack([np.asarray(b.column(k), np.int64) for k in range(keys)], axis=1)
        cuts = np.flatnonzero((g[1:] != g[:-1]).any(1)) + 1
        for s, e in zip(np.r_[0, cuts], np.r_[cuts, len(b)], strict=True):
            if e > s:
                now = tuple(g[s].tolist())
                if key is not None and now != key:
                    yield key, held
                    held = []
                key = now
                held.append(b.slice(s, e - s))
    if held:
        yield key, held


def near_duplicates(embeddings: DataFrame, t: float = 0.9, lead: int = LEAD, interval: int = INTERVAL) -> DataFrame:
    """embeddings(vec_id, embedding) -> vec_id, n_links, component_id, kept."""
    scratch = Scratch(embeddings.sparkSession)
    given = embeddings.schema["embedding"].dataType
    single = isinstance(given, T.ArrayType) and isinstance(given.elementType, T.FloatType)  # sent as they are, half as long
    rows = only(embeddings, vec_id="bigint", embedding="array<float>" if single else "array<double>")
    sound = F.col("vec_id").isNotNull() & F.coalesce(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) & F.coalesce(F.exists("embedding", lambda v: v != 0), F.lit(False))
    found = rows.filter(sound).groupBy(F.size("embedding").alias("d")).count().filter("count > 1").collect()  # one row a dimension
    dims = sorted(r["d"] for r in found)
    out = rows.filter(~(sound & F.size("embedding").isin(dims)) if dims else F.lit(True)).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    for dim in dims:
        out = out.unionByName(_of_dimension(rows.filter(sound & (F.size("embedding") == dim)), dim, t, min(lead, dim), interval, scratch))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _of_dimension(good: DataFrame, dim: int, t: float, lead: int, interval: int, scratch: Scratch) -> DataFrame:
    """good(vec_id, embedding) of one dimension -> vec_id, n_links, component_id."""
    spark, kind = good.sparkSession, dict(good.dtypes)["embedding"]
    classes = scratch.write(good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes")
    axes, n = principal(classes, dim, lead)
    eps = float(np.sqrt(max(0.0, 2 - 2 * t))) + SLACK
    where = [f"y{k}" for k in range(lead + 1)]

    def placed(x: np.ndarray) -> np.ndarray:
        """Coordinates of unit vectors: the leading principal ones, and the norm that is left outside."""
        y = x @ axes
        return np.c_[y, np.sqrt(np.maximum(0.0, 1 - (y * y).sum(1)))]

    def order(y: np.ndarray, rep: np.ndarray) -> np.ndarray:
        cells = np.floor(y[:, :lead] / eps)
        return np.lexsort((rep, y[:, 0], *(cells[:, k] for k in range(lead - 1, -1, -1))))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                y = placed(_unit(_matrix(b.column(0), dim)))
                cells = np.floor(y[:, :lead] / eps).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(y[:, k]) for k in range(lead + 1)), *(pa.array(cells[:, k]) for k in range(lead))], ["embedding", "rep", "copies", *where, *(f"c{k}" for k in range(lead))])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = 0, TaskContext.get().partitionId()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(b), part, np.int32)), pa.array(np.arange(at, at + len(b)))], [*b.schema.names, "part", "at"])
            at += len(b)

    shape = f"embedding {kind}, rep bigint, copies bigint, " + ", ".join(f"{y} double" for y in where)
    cells = [f"c{k}" for k in range(lead)]
    ordered = classes.select("embedding", "rep", "copies").mapInArrow(project, shape + "".join(f", {c} int" for c in cells))
    ordered = ordered.repartitionByRange(max(1, -(-n // interval)), *cells, "y0", "rep").sortWithinPartitions(*cells, "y0", "rep").drop(*cells[1:])
    ordered_table = ordered = scratch.write(ordered.mapInArrow(number, f"{shape}, c0 int, part int, at bigint"), "ordered")
    # position in the whole order: rows before the partition (one number a partition) + position within
    ends, offset, starts = ordered.groupBy("part").count().orderBy("part").collect(), 0, []
    for r in ends:
        starts.append((r["part"], offset))
        offset += r["count"]
    place = spark.createDataFrame(starts, "part int, first bigint")
    ordered = ordered.join(F.broadcast(place), "part").withColumn("g", F.floor((F.col("first") + F.col("at")) / interval).cast("bigint")).drop("part", "first")
    boxes = ordered.groupBy("g").agg(F.min("c0").alias("c_lo"), F.max("c0").alias("c_hi"), F.array(*(F.min(y) for y in where)).alias("lo"), F.array(*(F.max(y) for y in where)).alias("hi"))
    a = boxes.select(F.col("g").alias("g1"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"), F.explode(F.sequence("c_lo", "c_hi")).alias("cell"))
    b = boxes.select(F.col("g").alias("g2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.explode(F.sequence(F.col("c_lo") - 1, F.col("c_hi") + 1)).alias("cell"))
    gap = lambda k: F.pow(F.greatest(F.lit(0.0), F.col("lo2")[k] - F.col("hi1")[k], F.col("lo1")[k] - F.col("hi2")[k]), 2)
    pairs = a.join(b, "cell").filter((F.col("g1") <= F.col("g2")) & (sum((gap(k) for k in range(lead + 1)), F.lit(0.0)) <= eps * eps)).select("g1", "g2").distinct()
    # an interval meets up to PARTNERS others in one task, to which it is sent once; of two intervals either is the one in half of the cases
    swap = (F.col("g1") + F.col("g2")) % 2 == 1
    pairs = pairs.select(F.when(swap, F.col("g2")).otherwise(F.col("g1")).alias("own"), F.when(swap, F.col("g1")).otherwise(F.col("g2")).alias("other"))
    pairs = scratch.write(pairs.withColumn("part", F.floor(F.col("other") / PARTNERS)), "pairs")
    data = ordered.select("g", "rep", "copies", "embedding")
    tasks = pairs.select("own", "part").distinct()
    first = data.join(tasks.withColumn("g", F.col("own")), "g").select("own", "part", F.lit(OWN).cast("bigint").alias("other"), "rep", "copies", "embedding")
    others = data.join(pairs.withColumn("g", F.col("other")), "g").select("own", "part", F.when(F.col("own") != F.col("other"), F.col("other")).otherwise(F.lit(WITH_ITSELF)).alias("other"), "rep", "copies", "embedding")
    # an interval with itself needs no second copy of its rows: one row tells that the pair is wanted
    alone = others.filter(F.col("other") == WITH_ITSELF).groupBy("own", "part", "other").agg(F.min("rep").alias("rep")).select("own", "part", "other", "rep", F.lit(0).cast("bigint").alias("copies"), F.array().cast(kind).alias("embedding"))
    sent = first.unionByName(others.filter("other >= 0")).unionByName(alone)
    sent = sent.repartition(max(1, min(MOST_PARTS, tasks.count())), "own", "part").sortWithinPartitions("own", "part", "other")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
            t_ = pa.Table.from_batches(parts).combine_chunks()
            x, rep = _unit(_matrix(t_["embedding"].combine_chunks(), dim)), np.asarray(t_["rep"])
            y = placed(x)
            at = order(y, rep)
            return x[at], y[at], np.asarray(t_["copies"])[at], rep[at]

        def one(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...] | None) -> pa.RecordBatch:
            x, y, copies, rep = left if right is None else (np.concatenate(p) for p in zip(left, right, strict=True))
            n1 = len(left[0])
            join = Join(x, y, copies, t)
            join.run(slice(0, n1), slice(0, n1) if right is None else slice(n1, len(x)))
            hit = np.flatnonzero(join.links)
            return pa.RecordBatch.from_arrays([pa.array(rep[hit]), pa.array(join.links[hit]), pa.array(rep[join.find(hit)])], ["rep", "links", "root"])

        left, wanted = None, None
        for key, parts in _groups(batches, 3):
            if key[2] == WITH_ITSELF:  # comes first
                wanted = key[:2]
            elif key[2] == OWN:
                left = block(parts)
                if wanted == key[:2]:
                    yield one(left, None)
            else:
                yield one(left, block(parts))

    found = scratch.write(sent.mapInArrow(joined, "rep bigint, links bigint, root bigint"), "links")
    comp = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = classes.join(links, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select(F.col("embedding").alias("e"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = scratch.write(good.join(known, F.col("embedding") == F.col("e")).select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id")), "result")
    scratch.drop(classes, ordered_table, pairs, found, comp)
    return out


#: Brute force over all pairs; the links of the components by a recursive query.
ORACLE = """
with recursive e as (
  select vec_id, list_transform(embedding, lambda v: v::double) as x from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda v: v is null or isnan(v) or isinf(v))) = 0 and len(list_filter(embedding, lambda v: v <> 0)) > 0),
u as (select vec_id, x, sqrt(list_dot_product(x, x)) as n from e),
l as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and len(a.x) = len(b.x) and list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.9),
r as (select a as node, least(a, b) as c from l union select l.b, r.c from r join l on r.node = l.a)
select v.vec_id, coalesce((select count(*) from l where l.a = v.vec_id), 0)::bigint as n_links,
  coalesce((select min(c) from r where r.node = v.vec_id), v.vec_id) as component_id,
  coalesce((select min(c) from r where r.node = v.vec_id), v.vec_id) = v.vec_id as kept
from embeddings v
"""

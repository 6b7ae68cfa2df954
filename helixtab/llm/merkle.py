"""A Merkle manifest of a data set with incremental witnesses: a tree of FAN-wide runs per source, and one over the sources' roots.

Leaves arrive in order, block by block (BLOCK leaves, aligned, so a block is a whole subtree). Within a block they are appended one by one: a run of FAN nodes that is full
becomes a node of the level above, and its members' partial witnesses (place, run) are fixed from then on. The blocks' roots are appended in the same way to the next stage,
whose blocks are made by other tasks, and so on until each tree has one node; sources' roots are appended to a last tree. Then witnesses are extended downwards, stage by
stage: a block's witness is a row that is dealt to the task of the block's nodes and comes before them. No proof of a leaf is ever stored; its digests are.

Nodes are rows of a hundred bytes, texts don't move. Blocks are bounded, so no source, however large, is one task's work. Leaves are placed by sampled ranges of
(source, doc_id, leaf).

Null fields are hashed as `-`; a null source is a source, before all others; null ids come first in their source. Equal ids are ordered by leaf; repeated rows are leaves each. Empty
table: no rows, root() is None. Empty and very long texts are hashed like any. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import number_ranges, ranges
from .common import Scratch, lower_ascii, only

#: Nodes of a run, levels of a block, leaves of a block.
FAN, DEPTH = 16, 3
BLOCK = FAN**DEPTH
FIELDS = {"doc_id": "bigint", "source": "string", "lang": "string", "n_chars": "bigint", "text": "string"}


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(**changed: Column) -> Column:
    """Digest of a row, as bytes: each field's length in bytes, a colon and the field, or `-` for null."""

    def part(c: Column) -> Column:
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*(part(changed.get(name, F.col(name)).cast("string")) for name in FIELDS)), 256))


class Open:
    """A block that nodes are appended to; n: nodes of the whole tree on the block's lowest level."""

    def __init__(self, n: int):
        self.levels: list[list[str]] = [[] for _ in range(DEPTH + 1)]
        self.height = 0
        while self.height < DEPTH and n > 1:
            self.height, n = self.height + 1, -(-n // FAN)

    def append(self, node: str, level: int = 0) -> None:
        nodes = self.levels[level]
        nodes.append(node)
        if level < self.height and len(nodes) % FAN == 0:
            self.append(digest("".join(nodes[-FAN:])), level + 1)

    def close(self) -> str:
        """Ends the last runs; the block's root."""
        for level in range(self.height):
            if rest := len(self.levels[level]) % FAN:
                self.append(digest("".join(self.levels[level][-rest:])), level + 1)
        return self.levels[self.height][0]

    def witness(self, at: int) -> list[tuple[int, str]]:
        """(place in the run, run) on each level of the block, from the node up."""
        out = []
        for level in range(self.height):
            begin = at - at % FAN
            out.append((at % FAN, "".join(self.levels[level][begin : begin + FAN])))
            at //= FAN
        return out


def others(witness: list[tuple[int, str]]) -> str:
    return "".join(run[: 64 * k] + run[64 * k + 64 :] for k, run in witness)


def fold(node: str, witness: list[tuple[int, str]]) -> str:
    for k, run in witness:
        node = digest(run[: 64 * k] + node + run[64 * k + 64 :])
    return node


def _write(witness: list[tuple[int, str]]) -> str:
    return ";".join(f"{k}:{run}" for k, run in witness)


def _read(text: str) -> list[tuple[int, str]]:
    return [(int(k), run) for k, run in (x.split(":") for x in text.split(";"))] if text else []


def _dealt(nodes: DataFrame) -> DataFrame:
    """Blocks' rows together and in order."""
    return nodes.withColumn("block", F.expr(f"pos div {BLOCK}")).repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", "pos")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Open, list[dict]]]:
    """Block by block: the row of its witness if there is one, the closed block and its rows."""
    key, above, block, rows = None, {}, None, []
    for batch in batches:
        for r in batch.to_pylist():
            if (r["tree"], r["block"]) != key:
                if block:
                    block.close()
                    yield above, block, rows
                key, above, block, rows = (r["tree"], r["block"]), {}, None, []
            if not r["kind"]:
                above = r
                continue
            block = block or Open(r["n"])
            r["digest"] = r["digest"].hex()
            block.append(r["digest"])
            rows.append(r)
    if block:
        block.close()
        yield above, block, rows


def raised(nodes: DataFrame) -> DataFrame:
    """nodes(tree, pos, n, digest) -> the blocks' roots as nodes of the next stage. A tree of one node stays as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(out, pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())]))

        for _, block, rows in _stream(batches):
            r = rows[0]
            out.append({"tree": r["tree"], "pos": r["block"], "n": -(-r["n"] // BLOCK), "digest": bytes.fromhex(block.levels[block.height][0])})
            if len(out) >= 1024:
                yield made()
                out = []
        yield made()

    dealt = _dealt(nodes.select("tree", "pos", "n", "digest", F.lit(1).alias("kind")))
    return dealt.mapInArrow(run, "tree string, pos bigint, n bigint, digest binary")


def _stages(nodes: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """The stages of the trees, from the nodes up to one node a tree."""
    stages = [nodes]
    while (stages[-1].agg(F.max("n")).first()[0] or 0) > 1:
        stages.append(scratch.write(raised(stages[-1]), "stage"))
    return stages


def extended(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """Witnesses of nodes: those of their blocks, above(tree, pos, upper, sub), with the block's runs before them. (tree, pos, upper, sub)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for up, block, rows in _stream(batches):
            for at in range(0, len(rows), 256):
                part = rows[at : at + 256]
                upper = [";".join(filter(None, (_write(block.witness(at + k)), up["upper"]))) for k in range(len(part))]
                yield pa.RecordBatch.from_arrays([pa.array([r["tree"] for r in part], pa.string()), pa.array([r["pos"] for r in part]), pa.array(upper, pa.string()), pa.array([up["sub"]] * len(part), pa.string())], ["tree", "pos", "upper", "sub"])

    return _dealt(_with_witness(nodes, above)).mapInArrow(run, "tree string, pos bigint, upper string, sub string")


def _with_witness(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """A block's witness as a row of kind 0 at its first place, before its nodes."""
    rows = above.select("tree", (F.col("pos") * BLOCK).alias("pos"), "upper", "sub", F.lit(0).alias("kind"))
    return nodes.withColumn("kind", F.lit(1)).unionByName(rows, allowMissingColumns=True)


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(tree, doc_id, digest, changed): a leaf a document; changed: that of the document as it is found when checked, where `tampered` (a condition) lower-cases its text's A-Z."""
    rows = only(docs, **FIELDS)
    changed = F.when(tampered, leaf(text=lower_ascii(F.col("text")))) if tampered is not None else F.lit(None).cast("binary")
    return rows.select(F.col("source").alias("tree"), "doc_id", leaf().alias("digest"), changed.alias("changed"), F.monotonically_increasing_id().alias("_n"))


def placed(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Leaves as nodes: adds pos and n, in order of doc_id within each source."""
    rows = scratch.write(rows, "leaves")
    out = number_ranges(ranges(rows, ["tree", "doc_id", "digest", "_n"]), ["tree"], "pos", "n")
    return out.select("tree", "pos", "n", "digest", "doc_id", "changed")


def _sources(subroots: DataFrame) -> DataFrame:
    """Roots of sources as nodes of one tree, in order of source; `source` keeps the name."""
    rows = ranges(subroots.select(F.col("tree").alias("source"), "digest"), ["source"])
    rows = number_ranges(rows.withColumn("_one", F.lit(0)), ["_one"], "pos", "n")
    return rows.select(F.lit("").alias("tree"), "pos", "n", "digest", "source")


def root(subroots: DataFrame, scratch: Scratch) -> tuple[str | None, list[DataFrame]]:
    """The root over sources' roots (tree, digest), and the stages."""
    stages = _stages(scratch.write(_sources(subroots), "sources"), scratch)
    top = stages[-1].select("digest").first()
    return top and bytes(top[0]).hex(), stages


def witnesses(stages: list[DataFrame], above: DataFrame) -> DataFrame:
    """Extends the witnesses of the last stage's nodes to those of the first stage's blocks."""
    for nodes in reversed(stages[1:-1]):
        above = extended(nodes.select("tree", "pos", "n", "digest"), above)
    return above


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """docs(doc_id, source, lang, n_chars, text) -> doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: each document's leaf, its source's root and the root of all; the
    digest of its witness (siblings, level by level); the root that the witness gives for the leaf as found, and whether it is the root."""
    scratch = Scratch(docs.sparkSession)
    nodes = scratch.write(placed(leaves(docs, tampered), scratch), "nodes")
    stages = _stages(nodes, scratch)
    top, over = root(stages[-1].select("tree", "digest"), scratch)
    source_nodes = over[0]
    one = over[-1].select("tree", "pos", F.lit("").alias("upper"), F.lit("").alias("sub"))
    blocks = witnesses(over, one)
    own = source_nodes.select("source", "pos", "digest")
    above = extended(source_nodes.select("tree", "pos", "n", "digest"), blocks).select("pos", "upper") if len(over) > 1 else one.select("pos", "upper")
    above = above.join(own, "pos").select(F.col("source").alias("tree"), F.lit(0).cast("bigint").alias("pos"), "upper", F.lower(F.hex("digest")).alias("sub"))
    above = witnesses(stages, scratch.write(above, "witnesses"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for up, block, rows in _stream(batches):
            upper = _read(up["upper"])
            rest, out = others(upper), []
            tops: dict[tuple[int, str], str] = {}
            for at, r in enumerate(rows):
                low = block.witness(at)
                found = r["changed"].hex() if r["changed"] is not None else r["digest"]
                node = fold(found, low)
                if (at // BLOCK, node) not in tops:  # the way from the block's root up is the same for all that fold to it
                    tops[at // BLOCK, node] = fold(node, upper)
                folded = tops[at // BLOCK, node]
                out.append((r["doc_id"], r["digest"], up["sub"], top, digest(others(low) + rest), folded, folded == top))
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return _dealt(_with_witness(nodes, above)).mapInArrow(run, "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def append(state: DataFrame | None, docs: DataFrame) -> DataFrame:
    """A manifest that grows: state(tree, kind, pos, digest) holds the roots of each source's whole blocks (kind 1) and the leaves of its open one (kind 0), None at first. New
    documents come after the old ones of their source, in order of doc_id; only they and the open blocks are hashed."""
    scratch = Scratch(docs.sparkSession)
    new = placed(leaves(docs), scratch).select("tree", "pos", "digest")
    old = None
    if state is not None:
        had = state.groupBy(F.col("tree").alias("_t")).agg(F.sum(F.when(F.col("kind") == 1, BLOCK).otherwise(1)).alias("_had"))
        new = new.join(had, F.col("tree").eqNullSafe(F.col("_t")), "left").select("tree", (F.col("pos") + F.coalesce("_had", F.lit(0))).alias("pos"), "digest")
        new, old = new.unionByName(state.filter("kind = 0").select("tree", "pos", "digest")), state.filter("kind = 1")
    new = scratch.write(new, "open")
    n = new.groupBy(F.col("tree").alias("_t")).agg((F.max("pos") + 1).alias("n"))
    new = new.join(n, F.col("tree").eqNullSafe(F.col("_t"))).drop("_t")
    whole = F.expr(f"pos < n div {BLOCK} * {BLOCK}")
    closed = raised(new.filter(whole)).select("tree", F.lit(1).alias("kind"), "pos", "digest")
    out = new.filter(~whole).select("tree", F.lit(0).alias("kind"), "pos", "digest").unionByName(closed)
    return scratch.write(out if old is None else out.unionByName(old), "state")


def root_of(state: DataFrame) -> str | None:
    """The root of append()'s state."""
    scratch = Scratch(state.sparkSession)
    first = state.groupBy(F.col("tree").alias("_t")).agg(F.sum(F.when(F.col("kind") == 1, BLOCK).otherwise(1)).alias("n"))
    rows = state.join(first, F.col("tree").eqNullSafe(F.col("_t"))).drop("_t")
    blocks = raised(rows.filter("kind = 0")).unionByName(rows.filter("kind = 1").select("tree", "pos", F.ceil(F.col("n") / BLOCK).cast("bigint").alias("n"), "digest"))
    return root(_stages(scratch.write(blocks, "blocks"), scratch)[-1].select("tree", "digest"), scratch)[0]


#: A tree as rows: nodes of every level by recursion, runs by whole-number division; siblings by joins; the way up by recursion over levels.
ORACLE = """with recursive crc as (select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
d as (select *, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(doc_id::varchar) + 1), lambda j: ascii(substr(doc_id::varchar, j, 1)))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 5 = 0 as hit from documents, crc),
e as (select doc_id, source, hit, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as head,
  text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low from d),
f as (select doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf, case when hit then sha256(head || coalesce(strlen(low) || ':' || low, '-')) end as changed from e),
g as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by source) as n, row_number() over () as rid from f),
tree as (select coalesce('s' || source, 'n') as tree, 0 as level, i, leaf as x, n from g
  union all select tree, level + 1, i // 16, sha256(string_agg(x, '' order by i)), (n + 15) // 16 from tree where n > 1 group by tree, level, i // 16, n),
sub as (select tree, x as subroot, level as height, row_number() over (order by tree) - 1 as i, count(*) over () as n from tree where n = 1),
top as (select 0 as level, i, subroot as x, n from sub union all select level + 1, i // 16, sha256(string_agg(x, '' order by i)), (n + 15) // 16 from top where n > 1 group by level, i // 16, n),
r as (select x as root from top where n = 1),
pw(l, p) as (values (0, 1), (1, 16), (2, 256), (3, 4096), (4, 65536), (5, 1048576), (6, 16777216)),
one as (select rid, level, coalesce(string_agg(x, '' order by t.i) filter (t.i < g.i // p), '') as a, coalesce(string_agg(x, '' order by t.i) filter (t.i > g.i // p), '') as b
  from g join tree t on t.tree = coalesce('s' || source, 'n') and t.n > 1 join pw on l = level where t.i // 16 = g.i // p // 16 group by rid, level),
two as (select tree, top.level + height as level, coalesce(string_agg(x, '' order by top.i) filter (top.i < sub.i // p), '') as a, coalesce(string_agg(x, '' order by top.i) filter (top.i > sub.i // p), '') as b
  from sub join pw on true join top on l = top.level and top.n > 1 where top.i // 16 = sub.i // p // 16 group by tree, top.level, height),
w as (select rid, level, a, b from one union all select rid, level, a, b from g join two on tree = coalesce('s' || source, 'n')),
proof as (select rid, sha256(string_agg(a || b, '' order by level)) as p, count(*) as high from w group by rid),
up as (select rid, 0 as level, coalesce(changed, leaf) as x from g union all select up.rid, up.level + 1, sha256(a || x || b) from up join w on w.rid = up.rid and w.level = up.level),
folded as (select rid, arg_max(x, level) as folded_root from up group by rid)
select doc_id, leaf, subroot, root, coalesce(p, sha256('')) as proof_sha256, folded_root, folded_root = root as verified from g join sub on tree = coalesce('s' || source, 'n') cross join r join folded using (rid) left join proof using (rid)"""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from helixtab.llm import merkle as M

FIELDS = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 16]) for k in range(0, len(levels[-1]), 16)])
    return levels


def way(levels, at):
    """(before, after) of a node level by level."""
    out = []
    for level in levels[:-1]:
        begin = at - at % 16
        out.append(("".join(level[begin:at]), "".join(level[at + 1 : begin + 16])))
        at //= 16
    return out


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    for source in by:
        by[source].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf(r) for r in by[s]]) for s in sources}
    over = tree([trees[s][-1][0] for s in sources])
    root, out = over[-1][0], []
    for k, s in enumerate(sources):
        for at, r in enumerate(by[s]):
            steps = way(trees[s], at) + way(over, k)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]) if r[4] is not None and hit else r[4]))
            for a, b in steps:
                node = h(a, node, b)
            out.append((r[0], leaf(r), trees[s][-1][0], root, h(*(a + b for a, b in steps)), node, node == root))
    return out


def check(spark, rows, parts=3):
    docs = spark.createDataFrame(rows, FIELDS).withColumn("leaf", F.lit("clash")).repartition(parts)
    got = [tuple(r) for r in M.manifest(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    want = plain(rows)
    assert sorted(got, key=key) == sorted(want, key=key)
    return got


def test_small_trees_nulls_and_repeats(spark):
    rows = [(k, f"s{k % 3}" if k % 7 else None, "en", k, f"Text {k}") for k in range(60)]
    rows += [(1, None, None, None, None), (None, "s1", "de", 3, "Null id"), (None, "ä", "de", 3, ""), (5, "s2", "x", 1, "Ünïcode"), (5, "s2", "x", 1, "Ünïcode"), (5, "s2", "x", 1, "Other")]
    got = check(spark, rows)
    assert {r[-1] for r in got} == {True, False}


def test_one_document_and_none(spark):
    assert check(spark, [(7, "only", None, 3, "abc")])[0][1:5][0] == leaf((7, "only", None, 3, "abc"))
    assert M.manifest(spark.createDataFrame([], FIELDS)).count() == 0


def test_many_sources(spark):
    check(spark, [(k, f"source {k % 300}", "en", k, "A") for k in range(600)])


def test_a_source_of_several_blocks(spark):
    """More leaves than a block holds: block roots are appended to a next stage and witnesses extended."""
    n = 2 * M.BLOCK + 300
    rows = [(k * 7 % 100_003, "hot" if k < n else f"s{k % 5}", "en", k, f"Text {k}") for k in range(n + 40)]
    check(spark, rows, 5)


def test_growing_in_steps_gives_the_same_root(spark):
    random.seed(3)
    n = M.BLOCK + 700
    rows = [(k, "hot" if k % 9 else f"s{k % 4}", "en", k, f"Text {k}") for k in range(n)]
    root, state = plain(rows)[0][3], None
    for a, b in ((0, 1), (1, 50), (50, M.BLOCK), (M.BLOCK, n)):
        state = M.append(state, spark.createDataFrame(rows[a:b], FIELDS))
        assert M.root_of(state) == plain(rows[:b])[0][3]
    assert M.root_of(state) == root


def test_open_block():
    for n in (1, 2, 15, 16, 17, 255, 256, 257, 4095, 4096):
        nodes = [h(str(k)) for k in range(n)]
        block = M.Open(n)
        for x in nodes:
            block.append(x)
        assert block.close() == tree(nodes)[-1][0]
        assert all(M.fold(nodes[k], block.witness(k)) == block.close() if n < 2 else M.fold(nodes[k], block.witness(k)) == tree(nodes)[-1][0] for k in (0, n // 2, n - 1))


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = [tuple(r) for r in M.manifest(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect()]
    assert sorted(got) == sorted(plain(rows))

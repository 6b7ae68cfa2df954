"""Tables, shared scratch space and membership filters used by the operators of this package."""

from __future__ import annotations

import contextlib
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import STEP, let, running  # noqa: F401
from ..scratch import scratch_root

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, all other letters as they are."""
    return F.translate(c, UPPER, LOWER)


_lock, _held = threading.Lock(), {}


@contextlib.contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """CLEAN is on while any thread of the session is inside, and as it was afterwards."""
    key = id(spark)
    with _lock:
        n, before = _held.get(key) or (0, spark.conf.get(CLEAN, None))
        _held[key] = (n + 1, before)
        if not n:
            spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        with _lock:
            n, before = _held.pop(key)
            if n > 1:
                _held[key] = (n - 1, before)
            elif before is None:
                spark.conf.unset(CLEAN)
            else:
                spark.conf.set(CLEAN, before)


class Scratch:
    """Tables written in the shared folder to cut lineage; drop() deletes those that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.dir, self.n = spark, f"{scratch_root(spark)}/{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.dir}/{self.n:03d}-{name}"
        with _cleaning(self.spark):  # the table replaces its lineage, so its shuffle files can go when it is written
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns alone, so that extra columns with clashing names never meet ours: only(df, doc_id="bigint", text="string")."""
    return df.select(*(F.col(f"`{c}`").cast(kind).alias(c) for c, kind in columns.items()))


#: Code points of the pieces that a text is cut in.
PIECE = 1024
#: Words of the bitmap of a set of ids.
MEMBER_WORDS = 1 << 17


def bitmap(ids: DataFrame, name: str) -> DataFrame:
    """A set of whole numbers as a bitmap of fixed size: w, bits. For may_be_in()."""
    c = f"`{name}`"
    return ids.groupBy(F.expr(f"pmod(shiftright({c}, 6), {MEMBER_WORDS})").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({c}, 64) as int))")).alias("bits"))


def with_bit(df: DataFrame, name: str, member: DataFrame) -> DataFrame:
    """Adds `may`: false only for rows whose id isn't in the set of the bitmap."""
    c = f"`{name}`"
    own = df.withColumn("_w", F.expr(f"pmod(shiftright({c}, 6), {MEMBER_WORDS})")).join(F.broadcast(member.withColumnsRenamed({"w": "_w", "bits": "_bits"})), "_w", "left")
    return own.withColumn("may", F.expr(f"coalesce((shiftright(_bits, cast(pmod({c}, 64) as int)) & 1L) = 1L, false)")).drop("_w", "_bits")


def without(df: DataFrame, name: str, ids: DataFrame) -> DataFrame:
    """Rows whose id isn't among ids (a table with one column, ids not null); rows with a null id stay. Rows that the bitmap rules out don't move; only the others, which are about
    as many as are found, are joined."""
    told = with_bit(df, name, bitmap(ids, ids.columns[0]))
    rest = told.filter("may").drop("may").join(ids.withColumnRenamed(ids.columns[0], "_gone"), F.col(f"`{name}`") == F.col("_gone"), "left_anti")
    return told.filter("not may").drop("may").unionByName(rest)


def pieces_of(text: Column) -> Column:
    """The text in pieces of PIECE code points, for cut()."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(pieces: Column, start: Column, end: Column) -> Column:
    """Code points [start, end) of a text in pieces; a substring of the whole text would count from its beginning each time."""
    at = F.floor(start / PIECE).cast("int")
    part = F.array_join(F.slice(pieces, at + 1, F.greatest(F.lit(1), F.floor((end - 1) / PIECE).cast("int") - at + 1)), "")
    return F.when(end > start, F.substr(part, start - at * PIECE + 1, end - start)).otherwise("")


def most_frequent(counts: DataFrame, most: int, n: str = "n") -> DataFrame:
    """Rows of the largest n, `most` at most. Rows of equal n (beyond 2^16 of equal n within about one per cent) are all in or all out, so the cut is found from a
    histogram of fixed size and no task sorts what every task thinks are the largest. `counts` is read twice: a table, not a plan."""
    size = F.when(F.col(n) < (1 << 16), F.col(n)).otherwise((1 << 16) + F.floor((F.log2(F.col(n)) - 16) * 64)).cast("bigint")
    left = most
    for r in sorted(counts.groupBy(size.alias("size")).agg(F.count("*").alias("c")).collect(), key=lambda r: -r["size"]):
        left -= r["c"]
        if left < 0:
            return counts.filter(size > r["size"])
    return counts

"""Helpers of the training-data operators: shared storage, Arrow plumbing and connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The fold that no learner may see, as the contracts of the learners state it.
HELD_OUT_MOD, HELD_OUT_REST = 3, 1


def held_out(doc_id: str | Column) -> Column:
    """True where crc32 of the id as text leaves 1 modulo 3 (a null id counts as the empty text)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % HELD_OUT_MOD == HELD_OUT_REST


def shared_dir(spark: SparkSession) -> str:
    """A folder all executors share: that of spark.checkpoint.dir, or, where it is unset (tests), one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = getattr(shared_dir, "own", None)
        if root is None:
            root = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="skein-shared-")
    return root.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/skein-{what}-{uuid.uuid4().hex}"


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Have an existing path deleted when the driver's JVM ends."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def materialize(df: DataFrame, what: str = "cut") -> DataFrame:
    """Write df to the shared folder and return a scan of it: lineage ends there, and a lost executor costs nothing.

    The files' path is kept in the attribute shared_path of the result for drop_shared().
    """
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    drop_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def drop_shared(*frames: DataFrame) -> None:
    """Delete what materialize() wrote for these frames, once nothing reads it any more."""
    for df in frames:
        path = getattr(df, "shared_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def map_arrow(df: DataFrame, schema: T.StructType | str, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    return df.mapInArrow(fn, schema)


def trim() -> None:
    """Give freed memory back to the system: workers live on and are handed to other tasks and operators."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps what it likes
        pass


def strings(col: pa.Array) -> list[str]:
    """The texts of an Arrow column; null counts as the empty text."""
    return [x if x is not None else "" for x in col.to_pylist()]


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Forest:
    """Union-find over non-negative integers with the smallest member as root of each tree."""

    __slots__ = ("up",)

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while (p := up.get(x, x)) != r:
            up[x] = r
            x = p
        return r

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.up[b] = a
        self.up.setdefault(a, a)
        return True


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one partition -> as few edges (member, root) with the same components; memory is bounded by FLUSH ids."""
    flush = 2_000_000
    forest = Forest()

    def out() -> pa.RecordBatch:
        up = forest.up
        ids = [x for x in up if forest.find(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([forest.find(x) for x in ids], pa.int64())], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
        if len(forest.up) > flush:
            yield out()
            forest = Forest()
    yield out()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: (node, component), component being the smallest node reachable.

    edges has the long columns a and b (loops allowed, any direction, repeats allowed). Nodes without a link to another
    node are not in the result. Alternates the large-star and small-star steps of Kiveris et al. ("Connected components
    in MapReduce and beyond"), each a groupBy-min with map-side combine and a join that AQE may split; the edge set is
    written to the shared folder after every round, so neither lineage nor driver memory grows. A union-find over each
    partition first contracts what it can see, which bounds the number of rounds in practice to a few.
    """
    e = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    cur = materialize(e.mapInArrow(_stars, "a long, b long").distinct(), "edges")

    def star(df: DataFrame, large: bool) -> DataFrame:
        if large:  # every node's larger neighbours are linked to the smallest of the neighbourhood
            both = df.select("a", "b").union(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:  # every node's smaller neighbours, itself included
            both = df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        # written out, so that both sides of the join are plain exchanges, which AQE can split at a hot root
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m")), "low")
        lows.append(low)
        j = both.join(low, both["a"] == low["k"])
        if large:
            out = j.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = j.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(F.col("k").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    lows: list[DataFrame] = []
    before = mark(cur)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        nxt = materialize(star(star(cur, True), False), "edges")
        after = mark(nxt)
        drop_shared(cur, *lows)
        lows.clear()
        cur = nxt
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected components did not settle")
    out = cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = out.select(F.col("component").alias("node"), "component").distinct()
    return out.unionByName(roots)

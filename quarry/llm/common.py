"""Shared pieces of the training-data operators: scratch tables, word pattern, connected components."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import ship

#: A word is a run of characters other than space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def let(value: Column, f) -> Column:
    """``f`` of a value that is evaluated once for all its uses."""
    return F.element_at(F.transform(F.array(value), f), 1)


#: Items of an array that are folded together; results of folds are joined afterwards, so no array is copied per item.
CHUNK = 256


def folded(items: Column, zero: Column, total, merge, step) -> Column:
    """One result per item of an array, each from a running value before it, in time near linear in the items.

    ``zero`` is the running value at the start, ``total(item)`` what an item adds to it and ``merge(a, b)`` their sum, which has to be
    associative; ``step(running, item)`` is the result.
    """

    def over(chunks: Column) -> Column:
        sums = F.transform(chunks, lambda c: F.aggregate(c, zero, lambda a, x: merge(a, total(x))))
        before = F.aggregate(sums, F.array(zero), lambda acc, t: F.concat(acc, F.array(merge(F.element_at(acc, -1), t))))
        return let(before, lambda starts: F.flatten(F.transform(chunks, lambda c, i: one(c, F.get(starts, i)))))

    def one(chunk: Column, start: Column) -> Column:
        # The running values of a chunk, then its results.
        runs = F.aggregate(chunk, F.array(start), lambda acc, x: F.concat(acc, F.array(merge(F.element_at(acc, -1), total(x)))))
        return let(runs, lambda r: F.transform(chunk, lambda x, i: step(F.get(r, i), x)))

    def chunked(xs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(xs) / CHUNK).cast("int") - 1, F.lit(0))), lambda c: F.slice(xs, c * CHUNK + 1, CHUNK))

    return let(items, lambda xs: let(chunked(xs), over))


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` as one column ``row`` beside computed ones, so that no name of its own can clash."""
    return df.select(F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("row"), *[c.alias(k) for k, c in columns.items()])


def unpacked(columns: list[str], **new: Column) -> list[Column]:
    """The columns of a packed frame, some of them replaced."""
    return [new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in columns]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def tidy(go):
    """``go``, a function of batches for ``mapInArrow``; a Python worker outlives its task, so what the task freed is given back at its end."""

    @functools.wraps(go)
    def run(batches):
        try:
            yield from go(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return run


class Scratch:
    """Tables in the folder that spark.checkpoint.dir names, which driver and executors share.

    The setting is read from the session. Where it is unset a folder of this machine is made and set if Spark runs
    inside one process (as in tests); on a cluster, whose executors could not read it, that is an error.
    ``cut`` writes a frame there and reads it back, so lineage ends at a replicated file and a lost
    executor costs no recomputation of what came before.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        ship(spark)
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            root = f"file://{tempfile.mkdtemp(prefix='quarry-ckpt-')}"
            spark.conf.set("spark.checkpoint.dir", root)
        self.base = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def cut(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n:03d}-{name}"
        df.write.parquet(path)
        # The schema is known, so reading it back lists files and starts no job.
        back = self.spark.read.schema(df.schema).parquet(path)
        back._quarry_path = path
        return back

    def drop(self, df: DataFrame | None) -> None:
        """Delete a table made by ``cut`` that no later frame reads."""
        path = getattr(df, "_quarry_path", None)
        if path:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def blocks(df: DataFrame, keys: list[str], size: str, member: str, block: int) -> DataFrame:
    """Each row once per pair (i, j) of blocks it takes part in; blk is its own block."""
    q = F.greatest(F.lit(1), F.ceil(F.col(size) / block)).cast("int")
    d = df.withColumn("q", q).withColumn("blk", F.pmod(F.xxhash64(member), F.col("q").cast("long")).cast("int"))
    both = F.transform(F.sequence(F.lit(0), F.col("q") - 1), lambda o: F.struct(F.least("blk", o).alias("i"), F.greatest("blk", o).alias("j")))
    return d.withColumn("ij", F.explode(both)).withColumns({"i": F.col("ij.i"), "j": F.col("ij.j")}).drop("ij", "q")


#: A key of more rows than a table's rows over SHARE is hot; there are at most SHARE of them, or SHARE * FEW rows in all.
SHARE, FEW = 2000, 16


def hot_bound(total: int) -> int:
    return max(FEW, total // SHARE)


def many_to_one(big: DataFrame, small: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``big`` joined with ``small``, which has one row a key and in ``n`` the number of the key's rows in ``big``.

    Keys over ``hot_bound`` of the ``total`` rows of ``big`` are at most max(SHARE, total / FEW) <= 2000 rows and are
    broadcast, so their rows stay where they are; only the others meet in a shuffle.
    """
    hot = F.broadcast(small.where(F.col(n) > hot_bound(total)))
    rest = big.join(hot.select(key), key, "left_anti").join(small.where(F.col(n) <= hot_bound(total)), key)
    return big.join(hot, key).unionByName(rest)


def hot_keys(posts: DataFrame, key: str, member: str) -> DataFrame:
    """At most SHARE keys that seem to hold more than 1 / SHARE of the rows (128 at least), counted over an eighth of
    the members. A plan only: what is done with a key must not change its result."""
    part = posts.where(F.pmod(F.xxhash64(member, F.lit(8)), F.lit(8)) == 0)
    counts = part.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > FEW)
    return counts.orderBy(F.col("_n").desc(), key).limit(SHARE).select(key)


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: (node, root), root the smallest node reachable.

    ``edges`` has two columns ``a``, ``b`` of one orderable type; self loops and repeats are fine, null
    ends are dropped. Only nodes of some edge with a != b appear. Alternating large-star and
    small-star steps (Kiveris et al. 2014): each step replaces edges by edges to a local minimum, and
    the number of edges never grows. Minima come from partial aggregation; the minima of hubs are
    broadcast (``many_to_one``), so a hub of any degree never meets in one task. Every round is written to
    the shared folder. Ends when every node hangs directly from its root; raises if that is not reached.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = scratch.cut(e, "edges")
    for _ in range(max_rounds):
        total = e.count()
        # Large star: every neighbour above u goes to the smallest of u and its neighbours.
        both = e.select("u", "v", F.lit(0).alias("above")).union(e.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(1).alias("above")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.sum("above").alias("n")).where("n > 0").select("u", F.least("u", "m").alias("m"), "n")
        up = e.select(F.col("v").alias("u"), F.col("u").alias("w"))  # neighbours w above u
        low = scratch.cut(low, "low")
        large = many_to_one(up, low, "u", "n", total).select(F.col("w").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.cut(large, "large")
        scratch.drop(low)
        # Small star: u and its lower neighbours go to the smallest of them.
        low = scratch.cut(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "low")
        pulled = many_to_one(large, low.where("n > 1"), "u", "n", total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        nxt = scratch.cut(low.select("u", F.col("m").alias("v")).union(pulled).distinct(), "star")
        for done in (e, large, low):
            scratch.drop(done)
        e = nxt
        # Done when each child has one root and no root is a child.
        if e.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
            continue
        roots = e.select("v").distinct()
        if not roots.join(e.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
    raise RuntimeError(f"components: not settled after {max_rounds} rounds")

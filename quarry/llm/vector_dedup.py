"""Embedding near-duplicates through a pivot-permutation index.

Reference points (pivots) are a bounded sample of the vectors; a vector is described by its NEAREST pivots in
order. Each pivot has an inverted list, per label and length, of the vectors it describes. Two vectors of a list are
a candidate pair if they share SHARED pivots or more and their orders agree: the overlaps of their first 1, 2, ..,
NEAREST pivots add up to ORDER or more. Candidates are verified by cosine in double precision. A list over
BLOCK members is divided by a second shared pivot, and where that leaves over BLOCK by a third; what is longer still
(many vectors with three pivots in common) is compared as pairs of blocks, each in a task of its own, so no list is
cut short. A pair belongs to the list of its least shared pivots, so it counts once.

Exact copies are one class with a multiplicity. A list sends out, per member, how many vectors it
links and the least member of its local group, not pairs, so output is linear in the members.

Fit: the pivots are at most MAX_PIVOTS vectors of each of the LENGTHS commonest vector lengths (a power of two near the
square root of the number of classes), from a sample of SAMPLE times as many with the least hashes. A vector of the sample
that is near a chosen pivot is passed over, so a dense group does not fill the pivots with its own members, which would
put its vectors in any order. Vectors of other lengths, or of a length with
fewer than NEAREST different vectors, form one list per label and length that is compared whole. Every vector
is indexed. README gives the recall against brute force.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and vectors
with a null label, link with nothing. Vectors of different lengths do not link. Repeated rows are
copies and link. A null id never names a component unless nothing else can. Extra columns are ignored.
An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, many_to_one

COSINE = 0.98
NEAREST = 6
SHARED = 3
#: Of NEAREST * (NEAREST + 1) / 2, which equal descriptions reach.
ORDER = 6
MAX_PIVOTS = 1024
LENGTHS = 8
SAMPLE = 4
#: Cosine from which on two pivots are too near each other; the next one is tried where that leaves too few.
SPREAD = (0.9, 0.97, 2.0)
BLOCK = 1024


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows over their lengths; scaled by the largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _ragged(a: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return a.offsets.to_numpy(), a.values.to_numpy(zero_copy_only=False).astype(np.float64)


def _spread(sample: np.ndarray, most: int, few: int = 32) -> np.ndarray:
    """At most ``most`` of the sample's vectors, in order, none too near another."""
    out = sample[:0]
    for limit in SPREAD:
        out = np.empty((0, sample.shape[1]))
        for x in sample:
            if len(out) < most and (not len(out) or (out @ x).max() < limit):
                out = np.vstack([out, x])
        if len(out) >= min(few, most):
            break
    return out


def _describe(pivots: dict[int, np.ndarray], nearest: int):
    """(cid, vec) to (cid, sig): the indices of the nearest pivots of the same length, nearest first; empty where there are too few."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if not rb.num_rows:
                continue
            off, val = _ragged(rb.column(1))
            dims = np.diff(off)
            sig: list = [[]] * rb.num_rows
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                p = pivots.get(int(d), ())
                if len(p) < nearest:
                    continue
                for s in range(0, len(at), 4096):
                    rows = at[s : s + 4096]
                    x = _unit(np.stack([val[off[r] : off[r + 1]] for r in rows]))
                    order = np.argsort(-(x @ p.T), axis=1, kind="stable")[:, :nearest]
                    for r, o in zip(rows, order.astype(np.int32).tolist()):
                        sig[r] = o
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(sig, pa.list_(pa.int32()))], names=["cid", "sig"])

    return go


def _local_roots(link: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id of each row's group; ``link`` symmetric."""
    root, seen = ids.copy(), np.zeros(len(ids), bool)
    for s in np.argsort(ids, kind="stable"):
        if seen[s]:
            continue
        front = np.zeros(len(ids), bool)
        front[s] = True
        group = front.copy()
        while front.any():
            front = link[front].any(axis=0) & ~group
            group |= front
        seen |= group
        root[group] = ids[s]
    return root


def _agreeing(sig: np.ndarray, key: list[int], shared: int, order: int) -> np.ndarray:
    """Pairs of rows that are candidates and belong to the list of pivots ``key``; all pairs if there is no key."""
    n, k = sig.shape
    if not key:
        return np.ones((n, n), bool)
    seen, local = np.unique(sig, return_inverse=True)
    local = local.reshape(n, k)
    first, over = np.zeros((n, len(seen)), np.float32), np.zeros((n, n), np.float32)
    rows = np.arange(n)
    for t in range(k):  # the first t + 1 pivots of each
        first[rows, local[:, t]] = 1.0
        both = first @ first.T
        over += both
    low = first[:, : int(np.searchsorted(seen, key[-1])) + 1]
    # All of a list share its key; with no other shared pivot up to the key's last, these are the pair's least.
    return (both >= shared) & (over >= order) & (low @ low.T == len(key))


def _verify(cosine: float, shared: int, order: int):
    """Runs of equal (list, i, j), sorted: gives (cid, root, links) for members with a link."""
    names = ["cid", "root", "links"]

    def one(block, cid, mult, sig, x, key, i, j):
        mine = _agreeing(sig, key, shared, order)
        np.fill_diagonal(mine, False)
        if i != j:
            mine &= block[:, None] != block[None, :]
        if not mine.any():
            return None
        x = _unit(x)
        mine &= x @ x.T >= cosine
        links = mine @ mult
        keep = links > 0
        if not keep.any():
            return None
        return cid[keep], _local_roots(mine[np.ix_(keep, keep)], cid[keep]), links[keep]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # parts of the run that may go on

        def close(parts):
            block, cid, mult, sig, x = (np.concatenate([p[k] for p in parts]) for k in range(1, 6))
            (_, i, j), key = parts[0][0][0].tolist(), parts[0][6]
            return one(block, cid, mult, sig, x.reshape(len(cid), -1), key, i, j) if len(cid) > 1 else None

        for rb in batches:
            if not rb.num_rows:
                continue
            keys = np.stack([rb.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1, 2)], 1)
            block, cid, mult = (rb.column(k).to_numpy(zero_copy_only=False) for k in (3, 4, 5))
            soff, sval = _ragged(rb.column(6))
            off, val = _ragged(rb.column(7))
            edge = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, len(keys)]
            out = []
            for n, (s, e) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())):
                sig = sval[soff[s] : soff[e]].astype(np.int64).reshape(e - s, -1)
                part = (keys[s:e], block[s:e], cid[s:e], mult[s:e], sig, val[off[s] : off[e]], rb.column(8)[s].as_py())
                if n == 0 and held and (held[0][0][0] == keys[0]).all():
                    held.append(part)
                    continue
                if held and (got := close(held)):
                    out.append(got)
                held = [part]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out]), pa.int64()) for k in range(3)], names=names)
        if held and (got := close(held)):
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()) for g in got], names=names)

    return go


def _lists(whole: DataFrame, scratch: Scratch, shared: int, block: int) -> DataFrame:
    """(cid, pivots, list, m): the inverted lists of two members or more that a class takes part in, with their sizes.

    Lists of one pivot first; those over ``block`` are divided by a further pivot, ``shared`` pivots at most. Pivots rise
    within a list's name, so dividing adds a greater one.
    """
    # Without a description: one list.
    start = F.when(F.size("sig") == 0, F.array(F.array().cast("array<int>"))).otherwise(F.transform("sig", lambda p: F.array(p)))
    posts, done = whole.select("cid", "part", "sig", F.explode(start).alias("pivots")), None
    for depth in range(1, shared + 1):
        posts = scratch.cut(posts.withColumn("list", F.xxhash64("part", "pivots")), "posts")
        sizes = scratch.cut(posts.groupBy("list").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "sizes")
        sized = many_to_one(posts, sizes, "list", "m", posts.count())
        last = (F.col("m") <= block) | (F.size("pivots") == 0) | F.lit(depth == shared)
        fit = sized.where(last).select("cid", "pivots", "list", "m")
        done = fit if done is None else done.unionByName(fit)
        if depth == shared or not sizes.where(F.col("m") > block).limit(1).count():
            break
        more = F.filter("sig", lambda p: p > F.element_at("pivots", -1))
        posts = sized.where(~last).select("cid", "part", "sig", F.explode(F.transform(more, lambda p: F.concat("pivots", F.array(p)))).alias("pivots"))
    return done


def near_duplicates(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    cosine: float = COSINE, nearest: int = NEAREST, shared: int = SHARED, order: int = ORDER, max_pivots: int = MAX_PIVOTS, block: int = BLOCK,
) -> DataFrame:
    """One row per row of ``df``: id, n_links, component_id, kept."""
    spark = df.sparkSession
    scratch = Scratch(spark, "vectors")
    v = F.col("vec")
    inf = float("inf")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < inf)) & F.exists(v, lambda c: c != 0)
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), F.col(label_col).alias("label"))
    rows = rows.withColumn("ok", F.coalesce(fine, F.lit(False)) & F.col("label").isNotNull())
    # Copies are told by a hash of 128 bits, so no vector is a shuffle key.
    twin = F.struct("label", F.xxhash64("vec").alias("x"), F.xxhash64("vec", F.lit(1)).alias("y")).alias("twin")
    same = rows.where("ok").groupBy(twin).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.min("vec").alias("vec"))
    # The class number is the place in a written table, so it stays the same for all that read it.
    same = scratch.cut(same.withColumn("cid", F.monotonically_increasing_id()), "classes")
    total = same.count()
    dims = [r[0] for r in same.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.col("c").desc(), "d").limit(LENGTHS).collect()]
    m = min(max_pivots, 1 << max(5, round(np.log2(max(total, 1)) / 2)))
    pivots: dict[int, np.ndarray] = {}
    for d in dims:
        got = same.where(F.size("vec") == d).orderBy(F.xxhash64("vec"), "cid").limit(SAMPLE * m).select("vec").collect()
        pivots[d] = _spread(_unit(np.array([r.vec for r in got], np.float64)), m)
    sigs = same.select("cid", "vec").mapInArrow(_describe(pivots, nearest), "cid long, sig array<int>")
    whole = same.select("cid", "n", "vec", F.xxhash64("twin.label", F.size("vec")).alias("part")).join(sigs, "cid")
    whole = scratch.cut(whole, "described")
    lists = _lists(whole.select("cid", "part", "sig"), scratch, shared, block)
    q = F.ceil(F.col("m") / block).cast("int")
    met = lists.withColumns({"q": q, "blk": F.pmod(F.xxhash64("cid", "list"), q.cast("long")).cast("int")}).select(
        "list", "pivots", "cid", "blk",
        F.explode(F.transform(F.sequence(F.lit(0), F.col("q") - 1), lambda o: F.struct(F.least("blk", o).alias("i"), F.greatest("blk", o).alias("j")))).alias("ij"),
    )
    fed = met.join(whole, "cid").select("list", F.col("ij.i").alias("i"), F.col("ij.j").alias("j"), "blk", "cid", "n", "sig", "vec", "pivots")
    keys = ["list", "i", "j"]
    found = scratch.cut(fed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_verify(cosine, shared, order), "cid long, root long, links long"), "found")
    comp = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")), scratch)
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    told = same.select("twin", "cid", "n", "first").join(links, "cid", "left").join(comp, F.col("cid") == F.col("node"), "left")
    told = scratch.cut(
        told.select("twin", "n", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root")), "told"
    )
    least = scratch.cut(told.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("m")), "least")
    told = scratch.cut(many_to_one(told, least, "root", "m", total).select("twin", "n", "n_links", "component_id"), "components")
    known = rows.where("ok").select("id", twin)
    good = many_to_one(known, told, "twin", "n", known.count()).select("id", "n_links", "component_id")
    lone = rows.where(~F.col("ok")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = good.union(lone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))

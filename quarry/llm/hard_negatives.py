"""Hard negatives through a Voronoi-partitioned, distributed nearest-neighbour join.

Inner products become distances by one more component: with M the greatest norm, a candidate x is (x, sqrt(M^2 - |x|^2)) and an anchor q
is (q, 0), so |q - x|^2 = |q|^2 + M^2 - 2 q.x, and the best scores are the nearest candidates. Pivots (a bounded sample) part this
space into cells; candidates and anchors lie in the cell of their nearest pivot.

Anchors of neighbouring cells form groups of GROUP at most; a cell with more anchors is split. A search takes two joins:

* home: each candidate goes to the group of its own cell. That leaves every anchor with its k best so far, hence with a distance
  beyond which nothing helps it.
* rest: with U the greatest distance of a cell's anchors from their pivot p and [near, far] the distances that can still serve one of them, a candidate
  c is copied to the cell's group only if near - U <= d(c, p) <= far + U (triangle inequality).

Each group joins exactly what it was given: products of whole blocks in numpy, k best kept. Groups with many candidates are split into blocks,
each a task of its own, and the k best of each are merged by anchor; so a hot cell, label or group of copies spreads out.

Positives are searched first (same label), then negatives (another label) with the scores that each positive allows. The result is exact whatever the pivots.

Defined results: rows with a null id, label or vector take no part. Shorter vectors count as filled up with zeros. Repeated rows are rows of their
own: each can be a positive or negative of the other, and a repeated anchor has its results once per row. Inner products have to fit
64 bits, else ValueError. Extra columns are ignored. An empty table, or one without anchors, gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SHARE, Scratch, ship, tidy

MAX_PIVOTS = 1024
#: Anchors of a group, candidates of a block, candidates that are multiplied at once.
GROUP, BLOCK, CHUNK = 1024, 1024, 1024
NONE, ALL = -(1 << 62), 1 << 62


def matrix(a: pa.ListArray, width: int) -> np.ndarray:
    """The lists as rows of int64, filled up with zeros."""
    off, val = a.offsets.to_numpy(), a.values.to_numpy(zero_copy_only=False)
    size = np.diff(off)
    if len(size) and (size == width).all():
        return val[off[0] : off[-1]].reshape(len(size), width).astype(np.int64)
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = val[off[0] : off[-1]]
    return out


class Space:
    """The pivots and what distances in the augmented space take."""

    def __init__(self, pivots: np.ndarray, width: int, top: int, small: bool):
        self.pivots, self.width, self.top, self.small = pivots.astype(float), width, float(top), small
        self.lift = np.sqrt(np.maximum(self.top - (self.pivots**2).sum(axis=1), 0))
        self.slack = 1e-6 * math.sqrt(self.top) + 1e-9

    def from_candidates(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(float)
        lift = np.sqrt(np.maximum(self.top - (x**2).sum(axis=1), 0))
        return np.sqrt(np.maximum(2 * self.top - 2 * (x @ self.pivots.T + lift[:, None] * self.lift), 0))

    def from_anchors(self, q: np.ndarray) -> np.ndarray:
        q = q.astype(float)
        return np.sqrt(np.maximum((q**2).sum(axis=1)[:, None] + self.top - 2 * (q @ self.pivots.T), 0))

    def products(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Exact: below 2^53 doubles are, and beyond that integers."""
        return (a.astype(float) @ b.astype(float).T) if self.small else a @ b.T


def _describe(space: Space):
    """Rows with the cell they lie in as candidates, and as anchors: cell, distance from its pivot, squared norm."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            x, anchor = matrix(rb.column(4), space.width), rb.column(3).to_numpy(zero_copy_only=False).astype(bool)
            cell = space.from_candidates(x).argmin(axis=1).astype(np.int32)
            acell, away, norm = np.full(len(x), -1, np.int32), np.zeros(len(x)), np.zeros(len(x))
            if anchor.any():
                d = space.from_anchors(x[anchor])
                acell[anchor] = d.argmin(axis=1)
                away[anchor] = d.min(axis=1)
                norm[anchor] = (x[anchor].astype(float) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(cell), pa.array(acell), pa.array(away), pa.array(norm)], names=[*rb.schema.names, "cell", "acell", "away", "norm"])

    return go


def grouped_cells(anchors: dict[int, int], pivots: np.ndarray, size: int) -> dict[int, list[int]]:
    """The groups of each cell: one, shared with cells nearby, or several of its own where it has more than ``size`` anchors."""
    out: dict[int, list[int]] = {}
    n = 0
    for c in sorted(c for c in anchors if anchors[c] > size):
        k = -(-anchors[c] // size)
        out[c] = list(range(n, n + k))
        n += k
    left = sorted(c for c in anchors if anchors[c] <= size)
    held, at = 0, left[0] if left else None
    while left:
        left.remove(at)
        if held and held + anchors[at] > size:
            n, held = n + 1, 0
        out[at] = [n]
        held += anchors[at]
        if left:  # on to the nearest cell that has no group yet
            rest = np.array(left)
            at = int(rest[((pivots[rest] - pivots[at]) ** 2).sum(axis=1).argmin()])
    for c in sorted(set(range(len(pivots))) - set(anchors)):  # no anchor lies there: at home with the nearest that have some
        there = sorted(anchors)
        out[c] = out[there[int(((pivots[there] - pivots[c]) ** 2).sum(axis=1).argmin())]]
    return out


class Best:
    """The k best (score, id) of each (anchor, slot), from scores within [lo, hi] of the slot."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, k: int):
        self.least, self.hi, self.k = lo.copy(), hi, k
        none = np.zeros(0, np.int64)
        self.held = [(none, none, none) for _ in range(lo.shape[1])]

    def offer(self, a: np.ndarray, score: np.ndarray, other: np.ndarray) -> None:
        for slot, held in enumerate(self.held):
            fit = (score >= self.least[a, slot]) & (score <= self.hi[a, slot])
            if not fit.any():
                continue
            a2, s2, o2 = (np.concatenate([h, x[fit]]) for h, x in zip(held, (a, score, other)))
            order = np.lexsort((o2, -s2, a2))
            a2, s2, o2 = a2[order], s2[order], o2[order]
            first = np.flatnonzero(np.concatenate([[True], a2[1:] != a2[:-1]]))
            rank = np.arange(len(a2)) - np.repeat(first, np.diff(np.append(first, len(a2))))
            keep = rank < self.k
            self.held[slot] = a2[keep], s2[keep], o2[keep]
            full = rank == self.k - 1
            self.least[a2[full], slot] = s2[full]


def _join(space: Space, k: int, other_label: bool):
    """Sorted (a, g, blk, kind, rid, id, label, vec, lo, hi), anchors before candidates, to (rid, slot, score, other)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, anchors, best = None, [], None

        def close():
            if best is None:
                return
            for slot, (a, s, o) in enumerate(best.held):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(who[0][a]), pa.array(np.full(len(a), slot, np.int32)), pa.array(s), pa.array(o)], names=["rid", "slot", "score", "other"])

        def begin():
            parts = list(zip(*anchors))
            rid, label = (np.concatenate(p) for p in parts[:2])
            slots = max(1, max(len(x) for p in parts[3] for x in p))
            lo, hi = np.full((len(rid), slots), ALL), np.full((len(rid), slots), NONE)
            for into, p in ((lo, parts[3]), (hi, parts[4])):
                for i, x in enumerate(x for y in p for x in y):
                    into[i, : len(x)] = x
            return (rid, label, np.concatenate(parts[2])), Best(lo, hi, k)

        who = None
        for rb in batches:
            keys = np.stack([rb.column(i).to_numpy().astype(np.int64) for i in range(4)], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, z in zip([0, *cuts], [*cuts, rb.num_rows]):
                if a == z:
                    continue
                part, now = rb.slice(a, z - a), tuple(keys[a, :3])
                if now != key:
                    yield from close()
                    key, anchors, best = now, [], None
                rid, ids, label = (part.column(i).to_numpy() for i in (4, 5, 6))
                x = matrix(part.column(7), space.width)
                if not keys[a, 3]:
                    anchors.append((rid, label, x, part.column(8).to_pylist(), part.column(9).to_pylist()))
                    continue
                if not anchors:
                    continue
                if best is None:
                    who, best = begin()
                for c in range(0, len(rid), CHUNK):
                    s = slice(c, c + CHUNK)
                    score = space.products(who[2], x[s])
                    fit = (who[1][:, None] != label[s]) if other_label else (who[1][:, None] == label[s]) & (who[0][:, None] != rid[s])
                    fit &= (score >= best.least.min(axis=1)[:, None]) & (score <= best.hi.max(axis=1)[:, None])
                    at, of = np.nonzero(fit)
                    best.offer(at, score[at, of].astype(np.int64), ids[s][of])
        yield from close()

    return go


def _routes(space: Space, groups: dict[int, list[int]], bounds: dict[int, tuple[float, float]]):
    """Candidates to those groups, their own cell's left out, whose bounds let them serve an anchor."""
    cells = np.array(sorted(bounds), np.int64)
    near, far = (np.array([bounds[c][i] for c in cells.tolist()]) for i in (0, 1))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            d = space.from_candidates(matrix(rb.column(3), space.width))[:, cells]
            fit = (d >= near - space.slack) & (d <= far + space.slack)
            out = []
            for row, own in zip(fit, rb.column(4).to_pylist()):
                out.append(sorted({g for c in cells[row].tolist() for g in groups[c]} - set(groups.get(own, ()))))
            yield pa.RecordBatch.from_arrays([*rb.columns[:4], pa.array(out, pa.list_(pa.int32()))], names=[*rb.schema.names[:4], "groups"])

    return go


class Search:
    """k best of each slot of each anchor, over all rows of a described table."""

    def __init__(self, rows: DataFrame, space: Space, groups: dict[int, list[int]], scratch: Scratch):
        self.rows, self.space, self.groups, self.scratch = rows, space, groups, scratch
        self.n_groups = len({g for gs in groups.values() for g in gs})
        of_cell = [(c, gs) for c, gs in groups.items()]  # a row per pivot at most
        self.of_cell = rows.sparkSession.createDataFrame(of_cell, "cell int, gs array<int>")

    def _local(self, candidates: DataFrame, anchors: DataFrame, k: int, other_label: bool) -> DataFrame:
        """``candidates`` (with ``groups``) and ``anchors`` (with ``g``) joined within groups; positives also within labels."""
        a = F.lit(0).cast("long") if other_label else F.col("label").cast("long")
        c = candidates.select(a.alias("a"), F.explode("groups").alias("g"), "rid", "id", "label", "vec")
        sizes = self.scratch.cut(c.groupBy("a", "g").agg(F.count(F.lit(1)).alias("m")), "sizes")
        most = max(BLOCK, (sizes.agg(F.sum("m")).first()[0] or 0) // SHARE)
        split = F.broadcast(sizes.where(F.col("m") > most).select("a", "g", F.ceil(F.col("m") / most).cast("int").alias("q")))  # SHARE rows at most
        q = F.coalesce("q", F.lit(1))
        none = F.lit(None).cast("array<bigint>")
        c = c.join(split, ["a", "g"], "left").select("a", "g", F.pmod(F.xxhash64("rid"), q.cast("long")).cast("int").alias("blk"), F.lit(1).alias("kind"), "rid", "id", "label", "vec", none.alias("lo"), none.alias("hi"))
        m = anchors.select(a.alias("a"), "g", "rid", "id", "label", "vec", "lo", "hi").join(split, ["a", "g"], "left")
        m = m.select("a", "g", F.explode(F.sequence(F.lit(0), q - 1)).alias("blk"), F.lit(0).alias("kind"), "rid", "id", "label", "vec", "lo", "hi")
        fed = m.unionByName(c).repartition("a", "g", "blk").sortWithinPartitions("a", "g", "blk", "kind")
        return fed.mapInArrow(tidy(_join(self.space, k, other_label)), "rid long, slot int, score long, other long")

    def best(self, anchors: DataFrame, k: int, other_label: bool) -> DataFrame:
        """``anchors``: rows with arrays lo and hi, the scores that each slot takes. Gives rid, slot, rank, score, other."""
        group = F.get("gs", F.pmod(F.xxhash64("rid"), F.size("gs").cast("long")).cast("int"))
        placed = anchors.join(F.broadcast(self.of_cell.withColumnRenamed("cell", "acell")), "acell").withColumn("g", group).drop("gs")
        at_home = self.rows.join(F.broadcast(self.of_cell.withColumnRenamed("gs", "groups")), "cell")
        found = self._local(at_home, placed, k, other_label)
        if self.n_groups > 1:  # else every candidate was at home
            home = self.scratch.cut(found, "home")
            w = Window.partitionBy("rid", "slot").orderBy(F.col("score").desc())
            kth = home.withColumn("n", F.row_number().over(w)).where(F.col("n") == k).groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("kth"))
            raised = F.transform("lo", lambda x, i: F.greatest(x, F.try_element_at("kth", i)))  # a missing one changes nothing
            placed = placed.join(kth, "rid", "left").withColumn("lo", F.coalesce(raised, "lo")).drop("kth")
            placed = self.scratch.cut(placed, "anchors")
            away = lambda s: F.sqrt(F.greatest(F.col("norm") + F.lit(self.space.top) - 2.0 * s.cast("double"), F.lit(0.0)))
            reach = placed.groupBy("acell").agg(
                F.min(away(F.array_max("hi")) - F.col("away")).alias("near"), F.max(away(F.array_min("lo")) + F.col("away")).alias("far")
            )
            bounds = {r["acell"]: (r["near"], r["far"]) for r in reach.collect()}  # a row per pivot at most
            routed = self.rows.select("rid", "id", "label", "vec", "cell").mapInArrow(tidy(_routes(self.space, self.groups, bounds)), "rid long, id long, label long, vec array<bigint>, groups array<int>")
            found = home.unionByName(self._local(routed, placed, k, other_label))
        w = Window.partitionBy("rid", "slot").orderBy(F.col("score").desc(), "other")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("rid", "slot", "rank", "score", "other")


def mine(
    df: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "vector", label_col: str = "label",
    positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, group: int = GROUP, pivots: int | None = None,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vector_col`` holds whole numbers, ``anchor`` says which rows are anchors. For each anchor and each of its ``positives`` best rows of its label,
    the ``negatives`` best rows of other labels with low * positive <= 100 * score <= high * positive.
    """
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "negatives")
    names = "anchor_id, positive_id, rank, negative_id, positive_score, negative_score".split(", ")
    d = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector_col).cast("array<bigint>").alias("vec"))
    d = d.where("id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL")
    rows = scratch.cut(d.select(F.monotonically_increasing_id().alias("rid"), "id", "label", "anchor", "vec"), "rows")
    norm = F.aggregate("vec", F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x.cast("decimal(19,0)") * x.cast("decimal(19,0)")).cast("decimal(38,0)"))
    n, width, top = rows.agg(F.count(F.lit(1)), F.max(F.size("vec")), F.max(norm)).first()
    if not n or rows.where("anchor").isEmpty():
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if int(top) >= 1 << 61:
        raise ValueError("inner products do not fit 64 bits")
    # Pivots: different vectors with the least hashes of their ids, a power of two near the square root of the rows.
    want = pivots or min(MAX_PIVOTS, 1 << max(0, round(math.log2(math.sqrt(n)))))
    some = rows.orderBy(F.xxhash64("id", F.lit(12)), "rid").limit(2 * want).select("vec").collect()
    chosen = list(dict.fromkeys(tuple(r["vec"]) + (0,) * (width - len(r["vec"])) for r in some))[:want]
    space = Space(np.array(chosen, np.int64).reshape(len(chosen), width), width, int(top), int(top) < 1 << 52)
    rows = scratch.cut(
        rows.mapInArrow(tidy(_describe(space)), "rid long, id long, label long, anchor boolean, vec array<bigint>, cell int, acell int, away double, norm double"), "cells"
    )
    anchors = rows.where("anchor")
    per_cell = {r["acell"]: r["count"] for r in anchors.groupBy("acell").count().collect()}  # a row per pivot at most
    search = Search(rows, space, grouped_cells(per_cell, space.pivots, group), scratch)

    one = lambda x: F.array(F.lit(x).cast("long"))
    best = search.best(anchors.withColumns({"lo": one(NONE), "hi": one(ALL)}), positives, False)
    best = scratch.cut(best.select("rid", "rank", F.col("score").alias("ps"), F.col("other").alias("positive_id")), "positives")
    pairs = best.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("rank", "ps"))).alias("p"))  # ``positives`` a row at most
    whole = lambda pct, p, up: (F.ceil if up else F.floor)(F.lit(pct).cast("decimal(5,0)") * p["ps"].cast("decimal(19,0)") / F.lit(100).cast("decimal(3,0)")).cast("long")
    asked = anchors.join(pairs, "rid").withColumns({"lo": F.transform("p", lambda p: whole(low, p, True)), "hi": F.transform("p", lambda p: whole(high, p, False))}).drop("p")
    found = search.best(scratch.cut(asked, "asked"), negatives, True)
    out = found.withColumn("k", F.col("slot") + 1).join(best.select("rid", F.col("rank").alias("k"), "ps", "positive_id"), ["rid", "k"])
    out = out.join(anchors.select("rid", F.col("id").alias("anchor_id")), "rid")
    return out.select("anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), F.col("ps").alias("positive_score"), F.col("score").alias("negative_score")).select(names)

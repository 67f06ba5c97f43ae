"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at RADIUS = 4 or fewer differing bits agree to 2 bits or fewer in one of their two
32-bit halves. Each fingerprint therefore emits, for each half, every variant within half of that
share (one bit: 33 variants), and two fingerprints whose half is within 2 bits share a variant. The
shuffle is on (half, variant); colliding pairs are verified on all 64 bits. Emitting the whole ball of
radius 2 over 64 bits needs 2081 rows a fingerprint instead of 66, and no verification; buckets too
large to compare inside one task go that way, so no bucket is cut short.

Everything runs on distinct fingerprints, so copies cost one row each. A bucket's links are reduced to a
spanning tree before they leave the task: output is linear in the bucket.

``deduplicate`` links texts by the Jaccard similarity of their shingle sets, SIMILARITY or more. Candidates are the groups
whose fingerprints hang together within RADIUS. As fingerprints at 0.8 differ in about ten bits, those that share one of BANDS keys
of ROWS minimum hashes each (a pair at 0.8 does with probability 0.9999, a more similar one almost surely) are candidates too.
All are verified on their whole shingle sets. Equal sets are one class; buckets of the same members are compared once,
buckets over BLOCK members as pairs of blocks in tasks of their own, so no bucket is cut short.

Defined results: a text without words (null, empty, blank) has fingerprint zero and links like any
other. Fewer words than a shingle: the whole sequence is one shingle. Repeated rows stay repeated and
share a component. Rows with a null id keep their fingerprint and take the component of their
group's smallest id (null where it has none). Extra columns are kept by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, blocks, components, hot_keys, many_to_one, packed, ship, tidy, unpacked

RADIUS = 4
#: Buckets up to this many distinct fingerprints are compared inside their task.
DIRECT = 8192
SEED = 42
SIMILARITY = 0.8
BANDS, ROWS = 30, 6
#: Members of a bucket whose shingle sets are compared in one task.
BLOCK = 256
#: Odd multipliers of the minimum hashes and of their keys.
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words, A-Z lower-cased, repeats included."""
    # bytes.lower and bytes.split know ASCII only: A-Z, and space with 09 to 0D.
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return np.empty(0, np.uint64)
    buf = b" ".join(ws)
    if len(ws) <= width:
        return np.array([xxhash.xxh64_intdigest(buf, SEED)], np.uint64)
    size = np.fromiter(map(len, ws), np.int64, len(ws))
    end = np.cumsum(size + 1) - 1
    start = end - size
    digest = xxhash.xxh64_intdigest
    return np.array([digest(buf[s:e], SEED) for s, e in zip(start[: len(ws) - width + 1].tolist(), end[width - 1 :].tolist())], np.uint64)


def simhash(h: np.ndarray) -> int:
    """Bit i is set where it is set in over half of the hashes."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 15):
        part = np.ascontiguousarray(h[k : k + (1 << 15)]).astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text_col: str = "text", width: int = 4, out: str = "fp") -> DataFrame:
    """``df`` with ``out``, the fingerprint as a signed long."""
    ship(df.sparkSession)

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(shingle_hashes(t, width)) for t in texts], np.uint64).view(np.int64))

    return df.withColumn(out, fp(text_col))


def _tree(x: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links inside one bucket; x distinct."""
    out, left = [], x.copy()
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            v = queue.pop()
            near = np.bitwise_count(left ^ v) <= radius
            if near.any():
                got = left[near]
                out += [(v, w) for w in got]
                queue += list(got)
                left = left[~near]
    return out


def _runs(radius: int):
    """Reads (key, fp) sorted by both; gives verified links (a, b, null), and (fp, null, key) for each member of a bucket over DIRECT."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64())])

    def batch(a, b):
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.int64())], schema=schema)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ck, cx, big = None, np.empty(0, np.uint64), False  # the run that may go on in the next batch

        def closed(x: np.ndarray):
            x = x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x
            return _tree(x, radius) if len(x) > 1 else []

        for rb in batches:
            if not rb.num_rows:
                continue
            key = rb.column(0).to_numpy(zero_copy_only=False)
            fp = rb.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            start, stop = np.r_[0, cuts], np.r_[cuts, len(key)]
            links: list[tuple[int, int]] = []
            hot: list[tuple[int, np.ndarray]] = []
            first, last = 0, len(start) - 1
            if ck is not None and key[0] != ck:
                links += [] if big else closed(cx)
                ck, cx, big = None, np.empty(0, np.uint64), False
            if ck is not None:
                part = fp[start[0] : stop[0]]
                if big:
                    hot.append((ck, part))
                else:
                    cx = np.concatenate([cx, part])
                if not big and len(cx) > DIRECT:
                    hot.append((ck, cx))
                    cx, big = np.empty(0, np.uint64), True
                if last > 0:
                    links += [] if big else closed(cx)
                    ck, cx, big = None, np.empty(0, np.uint64), False
                first = 1
            if last >= first:
                s, e = start[first:last], stop[first:last]  # whole runs
                two = e - s == 2
                x, y = fp[s[two]], fp[s[two] + 1]
                near = (np.bitwise_count(x ^ y) <= radius) & (x != y)
                pairs = (x[near].view(np.int64), y[near].view(np.int64))
                if len(pairs[0]):
                    yield batch(*pairs)
                for i, j in zip(s[e - s > 2].tolist(), e[e - s > 2].tolist()):
                    if j - i > DIRECT:
                        hot.append((key[i], fp[i:j]))
                    else:
                        links += closed(fp[i:j])
                ck, cx, big = key[-1], fp[start[last] :].copy(), False
                if len(cx) > DIRECT:
                    hot.append((ck, cx))
                    cx, big = np.empty(0, np.uint64), True
            if links:
                ab = np.array(links, np.uint64).view(np.int64)
                yield batch(ab[:, 0], ab[:, 1])
            if hot:
                a = np.concatenate([x for _, x in hot]).view(np.int64)
                k = np.concatenate([np.full(len(x), k, np.int64) for k, x in hot])
                yield pa.record_batch([pa.array(a), pa.nulls(len(a), pa.int64()), pa.array(k)], schema=schema)
        if ck is not None and not big and (links := closed(cx)):
            ab = np.array(links, np.uint64).view(np.int64)
            yield batch(ab[:, 0], ab[:, 1])

    return go


def _ball(bits: int, reach: int) -> list[int]:
    """Masks of ``bits`` bits with ``reach`` set bits or fewer."""
    out = [0]
    for _ in range(reach):
        out = sorted({m | 1 << i for m in out for i in range(bits)} | {0})
    return [m - (1 << 64) if m >> 63 else m for m in out]


def links(distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (a, b) whose components are those of the graph "RADIUS or fewer differing bits"; ``distinct`` has ``fp``."""
    low = F.lit(0xFFFFFFFF).cast("long")
    ball = F.array(*[F.lit(m).cast("long") for m in _ball(32, RADIUS // 4)])
    halves = F.concat(
        F.transform(ball, lambda m: F.col("fp").bitwiseAND(low).bitwiseXOR(m)),
        F.transform(ball, lambda m: F.shiftrightunsigned("fp", 32).bitwiseXOR(m).bitwiseOR(F.lit(1 << 32).cast("long"))),
    )
    keyed = distinct.select(F.explode(halves).alias("key"), "fp")
    crowded = F.broadcast(scratch.cut(hot_keys(keyed, "key", "fp"), "crowded"))  # SHARE keys at most
    found = scratch.cut(
        keyed.join(crowded, "key", "left_anti").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(tidy(_runs(RADIUS)), "a long, b long, key long"), "links"
    )
    edges = found.where("b is not null").select("a", "b")
    hot = keyed.join(crowded, "key").select("fp").union(found.where("b is null").select(F.col("a").alias("fp"))).distinct()
    if hot.limit(1).count():
        # The whole ball of radius 2: sharing a variant proves RADIUS bits or fewer, so all hang from the least.
        whole = F.array(*[F.lit(m).cast("long") for m in _ball(64, RADIUS // 2)])
        var = hot.select(F.explode(F.transform(whole, lambda m: F.col("fp").bitwiseXOR(m))).alias("v"), "fp")
        var = scratch.cut(var, "variants")
        least = scratch.cut(var.groupBy("v").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1"), "least")
        edges = edges.union(many_to_one(var, least, "v", "n", var.count()).select(F.col("fp").alias("a"), "b").where("a <> b").distinct())
    return edges


def classes(df: DataFrame, scratch: Scratch, id_col: str = "doc_id") -> DataFrame:
    """(fp, n, component_id) of a frame with ``id_col`` and ``fp``: its rows, and the least id reachable."""
    distinct = scratch.cut(df.groupBy("fp").agg(F.min(id_col).alias("first"), F.count(F.lit(1)).alias("n")), "fps")
    comp = components(links(distinct.select("fp"), scratch), scratch)
    placed = distinct.join(comp, distinct["fp"] == comp["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    placed = scratch.cut(placed, "placed")
    least = scratch.cut(placed.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("m")), "least")
    return scratch.cut(many_to_one(placed, least, "root", "m", placed.count()).select("fp", "n", "component_id"), "classes")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp, component_id), one row per row of ``df``."""
    scratch = Scratch(df.sparkSession, "simhash")
    fps = scratch.cut(fingerprints(df.select(id_col, text_col), text_col, width).select(id_col, "fp"), "all")
    return many_to_one(fps, classes(fps, scratch, id_col), "fp", "n", fps.count()).select(id_col, "fp", "component_id")


def hexed(col: str = "fp"):
    return F.lpad(F.lower(F.hex(col)), 16, "0")


def band_keys(x: np.ndarray) -> np.ndarray:
    """The BANDS keys of a set of hashes; an empty set has none."""
    if not len(x):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(x), 4096):
        np.minimum(least, (_ODD[0][:, None] * x[k : k + 4096]).min(axis=1), out=least)
    return (least * _ODD[1]).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64).view(np.int64)


def _sketch(width: int, sets: bool):
    """(id, t, text) to (id, t, h, fp, keys); with ``sets`` (cid, h, text) to (cid, shingle set) where the set's hash is h."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for at in range(0, rb.num_rows, 1024):
                part = rb.slice(at, 1024)
                every = [shingle_hashes(t.as_py(), width) for t in part.column(part.num_columns - 1)]
                xs = [np.unique(x) for x in every]
                digest = [xxhash.xxh3_128_digest(x.tobytes()) for x in xs]
                if sets:
                    keep = [k for k, h in enumerate(part.column(1).to_pylist()) if h == digest[k]]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep, pa.int64())), pa.array([xs[k].tobytes() for k in keep], pa.binary())], names=["cid", "sh"])
                else:
                    keys = pa.array([band_keys(x) for x in xs], pa.list_(pa.int64()))
                    fp = pa.array(np.array([simhash(x) for x in every], np.uint64).view(np.int64))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(digest, pa.binary()), fp, keys], names=["id", "t", "h", "fp", "keys"])

    return go


def _alike(least: float):
    """Runs of equal (key, i, j), sorted: (cid, blk, sh) to links (a, b) of a spanning forest."""

    def one(cid, blk, sets, across):
        size = np.array([len(x) for x in sets])
        out, left = [], np.arange(len(cid))
        while len(left):
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                v = queue.pop()
                fits = np.minimum(size[left], size[v]) >= least * np.maximum(size[left], size[v]) - 1e-9
                if across:
                    fits &= blk[left] != blk[v]
                at = left[fits]
                if not len(at):
                    continue
                x = np.concatenate([sets[w] for w in at])
                hit = sets[v][np.minimum(np.searchsorted(sets[v], x), size[v] - 1)] == x
                both = np.add.reduceat(hit, np.r_[0, np.cumsum(size[at])[:-1]], dtype=np.int64)
                got = at[both >= least * (size[at] + size[v] - both) - 1e-9]
                out += [(cid[v], cid[w]) for w in got]
                queue += got.tolist()
                left = left[~np.isin(left, got)]
        return out

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}

        def close():
            blk = np.array([r[0] for r in held.values()])
            links = one(list(held), blk, [np.frombuffer(r[1], np.uint64) for r in held.values()], key[1] != key[2]) if len(held) > 1 else []
            if links:
                a, b = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for rb in batches:
            for k, i, j, cid, blk, sh in zip(*(c.to_pylist() for c in rb.columns)):
                if (k, i, j) != key:
                    if held:
                        yield from close()
                    key, held = (k, i, j), {}
                held[cid] = (blk, sh)
        if held:
            yield from close()

    return go


def _near_fingerprints(one: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, cid) of (fp, cid): one key for all whose fingerprints hang together by RADIUS."""
    distinct = scratch.cut(one.groupBy("fp").agg(F.count(F.lit(1)).alias("m")), "fps")
    comp = components(links(distinct.select("fp"), scratch), scratch)
    placed = distinct.join(comp, distinct["fp"] == comp["node"], "left").select("fp", "m", F.xxhash64(F.lit("near"), F.coalesce("root", "fp")).alias("key"))
    return many_to_one(one.select("fp", "cid"), scratch.cut(placed, "near"), "fp", "m", one.count()).select("key", "cid")


def _similar(df: DataFrame, id_col: str, text_col: str, width: int, similarity: float) -> DataFrame:
    """(id, t, h, head) per row with an id: the hashes of its text and of its shingle set, and (id, h) of its group's first."""
    scratch = Scratch(df.sparkSession, "similar")
    docs = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    rows = scratch.cut(docs.mapInArrow(tidy(_sketch(width, False)), f"id {kind}, t long, h binary, fp long, keys array<bigint>"), "sketches")
    one = rows.groupBy("h").agg(F.min("id").alias("first"), F.min("fp").alias("fp"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("rows"))
    # The class number is the place in a written table, so it stays the same for all that read it.
    one = scratch.cut(one.withColumn("cid", F.monotonically_increasing_id()), "classes")
    keyed = scratch.cut(_near_fingerprints(one, scratch), "close").unionByName(one.select(F.explode("keys").alias("key"), "cid"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("cid")).alias("who")).where("n > 1")
    buckets = scratch.cut(shared.groupBy("n", "who").agg(F.min("key").alias("key")).select("key", "n"), "buckets")
    members = scratch.cut(many_to_one(keyed, buckets, "key", "n", one.count() * (BANDS + 1)), "members")
    need = members.select("cid").distinct().join(one.select("cid", "h", "first"), "cid")
    # A repeated id may bring other texts along; a set that is not of hash h is left out again.
    texts = docs.join(need.withColumnRenamed("first", "id"), "id").select("cid", "h", "text")
    sets = scratch.cut(texts.mapInArrow(tidy(_sketch(width, True)), "cid long, sh binary"), "sets")
    fed = blocks(members, ["key"], "n", "cid", BLOCK).join(sets, "cid").select("key", "i", "j", "cid", "blk", "sh")
    edges = fed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "cid").mapInArrow(tidy(_alike(similarity)), "a long, b long")
    comp = components(scratch.cut(edges, "edges"), scratch)
    placed = one.join(comp, one["cid"] == comp["node"], "left").select("h", "first", "rows", F.coalesce("root", "cid").alias("root"))
    placed = scratch.cut(placed, "placed")
    least = placed.groupBy("root").agg(F.min(F.struct(F.col("first").alias("id"), "h")).alias("head"), F.count(F.lit(1)).alias("m"))
    told = many_to_one(placed, scratch.cut(least, "least"), "root", "m", placed.count()).select("h", "rows", "head")
    return many_to_one(rows.select("id", "t", "h"), scratch.cut(told, "told"), "h", "rows", rows.count()).select("id", "t", "h", "head")


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """(id, component_id) per row with an id: the least id of the texts linked by shingle similarity."""
    return _similar(df, id_col, text_col, width, similarity).select(F.col("id").alias(id_col), F.col("head.id").alias("component_id"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """The rows of ``df`` that are the first of their group of similar texts by (id, hash of the shingle set).

    Rows with a null id stay. Rows that repeat an id and a shingle set share their fate; rows that repeat an id alone do not.
    """
    own = (F.col("id") == F.col("head.id")) & (F.col("h") == F.col("head.h"))
    lost = _similar(df, id_col, text_col, width, SIMILARITY).where(~own).select(F.col("id").alias("i"), F.col("t").alias("h")).distinct()
    d = packed(df, id=F.col(id_col), t=F.xxhash64(text_col))
    return d.join(lost, (F.col("id") == F.col("i")) & (F.col("t") == F.col("h")), "left_anti").select(unpacked(df.columns))

"""Postings in Arrow batches: texts turned into chunks of postings, chunks into blocks, blocks into hits.

A chunk is what a stretch of rows (BATCH tokens) holds of one term, so a token costs a byte or two on its way and not a row. A block has
up to ``block`` hits. Both keep their hits as variable-length numbers: ``head`` has for each the distance from the rid before (the first: from
``low``), the length of its row and its frequency; ``places`` has the gaps between its positions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Tokens of a stretch of rows that is inverted at once, and bytes of chunks that are made into blocks at once.
BATCH, BYTES = 1 << 21, 1 << 22
CHUNK = "term string, n int, low long, head binary, places binary"


def coded(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Numbers from 0 on, seven bits a byte, as one binary for those from each place in ``first`` to the next."""
    x = values.astype(np.uint64)
    size = np.ones(len(x), np.int64)
    top = int(x.max()) if len(x) else 0
    for k in range(1, 10):
        if top >> 7 * k:
            size += x >= np.uint64(1 << 7 * k)
    start = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    out[start] = (x & np.uint64(127)).astype(np.uint8) | ((size > 1) << 7).astype(np.uint8)
    for k in range(1, int(size.max()) if len(x) else 0):
        on = np.flatnonzero(size > k)
        out[start[on] + k] = ((x[on] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | ((size[on] > k + 1) << 7).astype(np.uint8)
    offsets = np.append(start[first], len(out)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def decoded(column: pa.Array) -> np.ndarray:
    """All numbers of a column of binaries."""
    if not len(column):
        return np.empty(0, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    b = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    end = np.flatnonzero(b < 128)
    start = np.r_[0, end[:-1] + 1] if len(end) else end
    size = end - start + 1
    x = (b[start] & 127).astype(np.int64)
    for k in range(1, int(size.max()) if len(size) else 0):
        on = np.flatnonzero(size > k)
        x[on] |= (b[start[on] + k] & 127).astype(np.int64) << 7 * k
    return x


def _stretches(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of some ``most`` in all, one row at least."""
    start = total = 0
    for k, n in enumerate(size.tolist()):
        if total and total + n > most:
            yield start, k
            start, total = k, 0
        total += n
    if start < len(size):
        yield start, len(size)


def _chunks(code: np.ndarray, row: np.ndarray, pos: np.ndarray, rid: np.ndarray, dl: np.ndarray, names: Callable) -> pa.RecordBatch:
    """Tokens, in order of their row and position, as one chunk a code; rows are in order of their rid."""
    order = np.argsort(code, kind="stable")
    c, r, p = code[order], row[order], pos[order]
    hit = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (r[1:] != r[:-1])])
    gaps = np.diff(p, prepend=0)
    gaps[hit] = p[hit]
    c, r = c[hit], r[hit]
    term = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
    far = np.diff(rid[r], prepend=0)
    far[term] = 0
    head = np.stack([far, dl[r], np.diff(np.append(hit, len(p)))], 1).ravel()
    n = np.diff(np.append(term, len(c))).astype(np.int32)
    return pa.RecordBatch.from_arrays([names(c[term]), pa.array(n), pa.array(rid[r[term]]), coded(head, 3 * term), coded(gaps, hit[term])], names=["term", "n", "low", "head", "places"])


def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, tokens) to chunks."""
    for rb in batches:
        rb = rb.take(pa.array(np.argsort(rb.column(0).to_numpy(), kind="stable")))
        rid, tokens = rb.column(0).to_numpy(), rb.column(1)
        size = tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        for i, j in _stretches(size, BATCH):
            n = size[i:j]
            if not n.sum():
                continue
            d = tokens.slice(i, j - i).flatten().dictionary_encode()
            row = np.repeat(np.arange(j - i), n)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            yield _chunks(d.indices.to_numpy(), row, pos, rid[i:j], n, lambda c, d=d: d.dictionary.take(pa.array(c)).cast(pa.string()))


def trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, text) to chunks of runs of three characters."""
    for rb in batches:
        rb = rb.take(pa.array(np.argsort(rb.column(0).to_numpy(), kind="stable")))
        rid, texts = rb.column(0).to_numpy(), rb.column(1).to_pylist()
        size = np.array([len(t) for t in texts], np.int64)
        for i, j in _stretches(size, BATCH):
            c = np.frombuffer("".join(texts[i:j]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            dl = np.maximum(size[i:j] - 2, 0)
            if not dl.sum():
                continue
            row = np.repeat(np.arange(j - i), dl)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(dl) - dl, dl)
            at = np.repeat(np.cumsum(size[i:j]) - size[i:j], dl) + pos
            some, code = np.unique(c[at] << 42 | c[at + 1] << 21 | c[at + 2], return_inverse=True)
            name = lambda k, some=some: pa.array(["".join(map(chr, (x >> 42, x >> 21 & 0x1FFFFF, x & 0x1FFFFF))) for x in some[k].tolist()], pa.string())
            yield _chunks(code.astype(np.uint16) if len(some) <= 1 << 16 else code, row, pos, rid[i:j], dl, name)


def _hits(rb: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of every hit: its row in the batch, rid, dl, tf."""
    n, low = rb["n"].to_numpy().astype(np.int64), rb["low"].to_numpy()
    far, dl, tf = decoded(rb["head"]).reshape(-1, 3).T
    row = np.repeat(np.arange(len(n)), n)
    far = np.cumsum(far)
    return row, low[row] + far - far[(np.cumsum(n) - n)[row]], dl, tf


def blocks(avg: float, k1: float, b: float, block: int, tiers: int, classes: int) -> Callable:
    """Chunks (bucket, then as CHUNK), sorted by bucket, term and low, to blocks by falling impact in steps; inside a block hits go by rid."""

    def made(rb: pa.RecordBatch, run: np.ndarray) -> pa.RecordBatch:
        row, rid, dl, tf = _hits(rb)
        gaps, at = decoded(rb["places"]), np.cumsum(tf) - tf
        tier = np.floor((1 - tf / (tf + k1 * (1 - b + b * dl / max(avg, 1.0)))) * tiers).astype(np.int64)
        of = run[row]
        order = np.argsort(of * (tiers + 1) + tier, kind="stable")
        new = np.r_[True, np.diff(of[order]) != 0]
        place = np.arange(len(order))
        place -= np.maximum.accumulate(np.where(new, place, 0))
        blk = np.cumsum(place % block == 0)
        order = order[np.lexsort((rid[order], blk))]
        first = np.flatnonzero(np.r_[True, np.diff(blk) != 0])
        row, rid, dl, tf, tier, at = (x[order] for x in (row, rid, dl, tf, tier, at))
        start = np.cumsum(tf) - tf
        gaps = gaps[np.repeat(at - start, tf) + np.arange(len(gaps))]
        far = np.diff(rid, prepend=0)
        far[first] = 0
        last = np.append(first[1:], len(rid)) - 1
        cls = np.minimum(np.frexp(tf)[1] - 1, classes - 1)
        none = np.iinfo(np.int64).max
        tfs = np.stack([np.maximum.reduceat(np.where(cls == k, tf, 0), first) for k in range(classes)], 1)
        dls = np.stack([np.minimum.reduceat(np.where(cls == k, dl, none), first) for k in range(classes)], 1)
        dls[dls == none] = 0
        edges = pa.array(np.arange(len(first) + 1, dtype=np.int32) * classes)
        each = lambda x: pa.ListArray.from_arrays(edges, pa.array(x.ravel().astype(np.int32)))
        i = pa.array(row[first])
        arrays = [
            rb["bucket"].take(i), rb["term"].take(i), pa.array(np.minimum.reduceat(tier, first).astype(np.int32)), pa.array(np.diff(np.append(first, len(rid))).astype(np.int32)),
            pa.array(np.add.reduceat(tf, first)), pa.array(rid[first]), pa.array(rid[last]), each(tfs), each(dls), coded(np.stack([far, dl, tf], 1).ravel(), 3 * first), coded(gaps, start[first]),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=["bucket", "term", "tier", "n", "tokens", "low", "high", "tfs", "dls", "head", "places"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush(whole: bool) -> Iterator[pa.RecordBatch]:
            """All terms but the last, which may go on, unless it is large by itself; blocks of a large term are made of some of its chunks at a time."""
            nonlocal held, size
            rb = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            bucket, term = rb["bucket"].to_numpy(), rb["term"].dictionary_encode().indices.to_numpy()
            run = np.cumsum(np.r_[0, (np.diff(bucket) != 0) | (np.diff(term) != 0)])
            first = int(np.searchsorted(run, run[-1]))
            upto = len(run) if whole or not first else first
            cost = pc.add(pc.binary_length(rb["head"]), pc.binary_length(rb["places"])).to_numpy()
            for i, j in _stretches(cost[:upto], BYTES):
                yield made(rb.slice(i, j - i), run[i:j])
            held, size = ([rb.slice(upto)], int(cost[upto:].sum())) if upto < len(run) else ([], 0)

        for rb in batches:
            if rb.num_rows:
                held.append(rb)
                size += rb.nbytes
            if size > BYTES:
                yield from flush(False)
        if held:
            yield from flush(True)

    return go


def hits(places: bool) -> Callable:
    """Blocks (term, n, low, head, places) to (term, rid, dl, tf), with ``places`` also positions."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for k in range(0, rb.num_rows, 256):
                part = rb.slice(k, 256)
                row, rid, dl, tf = _hits(part)
                arrays = [part["term"].take(pa.array(row)), pa.array(rid), pa.array(dl.astype(np.int32)), pa.array(tf.astype(np.int32))]
                if places:
                    gaps, at = decoded(part["places"]), np.cumsum(tf) - tf
                    sums = np.cumsum(gaps)
                    pos = sums - np.repeat(sums[at] - gaps[at], tf)
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(pos)).astype(np.int32)), pa.array(pos.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(arrays, names=["term", "rid", "dl", "tf", "positions"][: len(arrays)])

    return go


def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (bucket, term, n, low, head, places) to a chunk for each hit."""
    for rb in batches:
        for k in range(0, rb.num_rows, 256):
            part = rb.slice(k, 256)
            row, rid, dl, tf = _hits(part)
            one, i = np.arange(len(row)), pa.array(row)
            head = coded(np.stack([np.zeros(len(row), np.int64), dl, tf], 1).ravel(), 3 * one)
            yield pa.RecordBatch.from_arrays(
                [part["bucket"].take(i), part["term"].take(i), pa.array(np.ones(len(row), np.int32)), pa.array(rid), head, coded(decoded(part["places"]), np.cumsum(tf) - tf)],
                names=["bucket", "term", "n", "low", "head", "places"],
            )

"""Packing documents into token windows by non-negative least squares.

A document of n tokens (its ids, then the end id) fills n // WINDOW windows by itself; only its
remainder, shorter than a window, needs company. The histogram of remainder lengths (WINDOW - 1 counts
at most, whatever the corpus) goes to the driver. There, shallow combinations of two to four lengths
that fill a window exactly are enumerated, and non-negative least squares gives how often each is used. Repeats are rounded
down, then up in order of their fractions as far as the histogram allows, and what is left is solved again, with combinations of its own,
until a round places nothing (three or four rounds). The residual is packed greedily: the longest length takes the fewest others, DEEP
at most, that fill its window exactly, as often as they last. The few lengths without such company are laid end to end
and cut at window ends; the last, partial window is cut at powers of two, which need no padding. So padding is zero.

Which document takes which place follows from its rank among remainders of its length. Ranks come
from counts by (length, hash bucket), so a length that a third of all documents share is ranked in
BUCKETS tasks.

Defined results: null text is empty and has the end id alone. Repeated rows are packed once each, told
apart by a row key, and null ids are carried. An empty table gives no piece. Extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, tidy

WINDOW = 2048
END_ID = 1
BUCKETS = 64
#: Lengths from which combinations of three and of four are drawn: the commonest ones, and one more that completes them.
TRIPLE_LENGTHS, FOUR_LENGTHS = 96, 20
DEEP = 8
SWEEPS = 60
#: Entries of a worker's memory of words and parts of words; later ones are encoded anew each time.
MEMORY = 400_000

#: Printable ASCII but the apostrophe, and Latin letters that are single code points in NFC.
_PLAIN = re.compile(r"[!-&(-~À-ÖØ-öø-ÿ]+")
_PARTS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Ids of a text as little-endian 16-bit bytes, equal to the tokenizer's own, word by word.

    The vocabulary drops white space and no token spans it, so a text's ids are those of its words in
    order. Plain words are split as the tokenizer's own pattern does and go straight to its BPE model;
    words with anything else (apostrophes, other scripts, special tokens) go through all of it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.words: dict[str, bytes] = {"": b""}

    def _part(self, p: str) -> bytes:
        got = self.words.get(p)  # a part by itself is a word with the same ids
        if got is None:
            s = p if p.isascii() else "".join(map(self.letters.__getitem__, p.encode()))
            got = struct.pack(f"<{len(ids)}H", *ids) if (ids := [t.id for t in self.model.tokenize(s)]) else b""
            if len(self.words) < MEMORY and len(p) < 64:
                self.words[p] = got
        return got

    def _word(self, w: str) -> bytes:
        if _PLAIN.fullmatch(w) and "<|" not in w:
            parts = _PARTS.findall(w.lower())
            got = b"".join(map(self._part, parts))
            if len(parts) == 1 and parts[0] == w:
                return got
        else:
            ids = self.whole.encode(w, add_special_tokens=False).ids
            got = struct.pack(f"<{len(ids)}H", *ids)
        if len(self.words) < MEMORY and len(w) < 64:
            self.words[w] = got
        return got

    def __call__(self, text: str | None) -> bytes:
        known, word = self.words.get, self._word
        out = []
        for w in (text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "):
            b = known(w)
            out.append(word(w) if b is None else b)
        return b"".join(out)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder a worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def crc(ids16: bytes) -> int:
    return zlib.crc32(np.frombuffer(ids16, "<u2").astype("<u4").tobytes())


def tokenise(df: DataFrame, vocabulary: str, id_col: str, text_col: str) -> DataFrame:
    """(id, row, n, seq0, crcs, rem, rem_crc, ids): per document its length, the sequence of its first
    whole window and their checksums, and the length, checksum and ids of its remainder."""
    kind = df.schema[id_col].dataType.simpleString()
    last = np.array([END_ID], "<u2").tobytes()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(vocabulary)
        nxt = (TaskContext.get().partitionId() + 1) << 40
        for rb in batches:
            for at in range(0, rb.num_rows, 512):  # bounded output batches
                part = rb.slice(at, 512)
                n, seq0, crcs, rem, rcrc, ids = [], [], [], [], [], []
                for t in part.column(2):
                    b = enc(t.as_py()) + last
                    k = len(b) // 2 // WINDOW
                    n.append(len(b) // 2)
                    seq0.append(nxt)
                    nxt += k
                    crcs.append([crc(b[i * 2 * WINDOW : (i + 1) * 2 * WINDOW]) for i in range(k)])
                    tail = b[k * 2 * WINDOW :]
                    rem.append(len(tail) // 2)
                    rcrc.append(crc(tail))
                    ids.append(tail)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(seq0, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(rem, pa.int32()), pa.array(rcrc, pa.int64()), pa.array(ids, pa.binary())],
                    names=["id", "row", "n", "seq0", "crcs", "rem", "rem_crc", "ids"],
                )

    src = df.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    return src.mapInArrow(tidy(go), f"id {kind}, row long, n long, seq0 long, crcs array<long>, rem int, rem_crc long, ids binary")


def nnls(columns: list[tuple[int, ...]], target: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """min |A x - target| for x >= 0, where column j of A counts the lengths in columns[j]; coordinate descent."""
    x, r = np.zeros(len(columns)), target.astype(float).copy()
    cols = []
    for c in columns:
        at, times = np.unique(np.array(c), return_counts=True)
        cols.append((at.tolist(), times.tolist(), float((times**2).sum())))
    for _ in range(sweeps):
        moved = 0.0
        for j, (at, times, sq) in enumerate(cols):
            new = max(0.0, x[j] + sum(r[a] * k for a, k in zip(at, times)) / sq)
            if (d := new - x[j]) != 0.0:
                x[j] = new
                moved = max(moved, abs(d))
                for a, k in zip(at, times):
                    r[a] -= d * k
        if moved < 0.25:
            break
    return x


def combinations(hist: np.ndarray) -> list[tuple[int, ...]]:
    """Two, three or four present lengths that add up to the window; of three and four all but one are among the commonest."""
    have = np.flatnonzero(hist)
    present = set(have.tolist())
    out = [(a, WINDOW - a) for a in have.tolist() if a <= WINDOW - a and WINDOW - a in present]
    top = sorted(have.tolist(), key=lambda a: (-hist[a], a))
    three, four = top[:TRIPLE_LENGTHS], top[:FOUR_LENGTHS]
    trip = {tuple(sorted((a, b, WINDOW - a - b))) for i, a in enumerate(three) for b in three[i:] if WINDOW - a - b in present}
    quad = {tuple(sorted((a, b, c, WINDOW - a - b - c))) for i, a in enumerate(four) for j, b in enumerate(four[i:], i) for c in four[j:] if WINDOW - a - b - c in present}
    return out + sorted(trip) + sorted(quad)


def company(left: np.ndarray, gap: int, deep: int = DEEP) -> list[int] | None:
    """The fewest present lengths, ``deep`` at most, that add up to ``gap``; longer ones first. None if there are none."""
    have = np.flatnonzero(left[: gap + 1]).tolist()
    fit = (1 << gap + 1) - 1
    sums = [1]  # bit s of sums[d]: d lengths add up to s, each as often as one likes
    while not sums[-1] >> gap & 1:
        if len(sums) > deep or not have:
            return None
        nxt = 0
        for b in have:
            nxt |= sums[-1] << b
        sums.append(nxt & fit)
    spare, out = left.copy(), []
    for d in range(len(sums) - 1, 0, -1):
        b = next((b for b in reversed(have) if b <= gap and spare[b] > 0 and sums[d - 1] >> (gap - b) & 1), None)
        if b is None:
            return None
        spare[b] -= 1
        gap -= b
        out.append(b)
    return out


def plan(hist: np.ndarray) -> dict:
    """Where the remainders go. Lengths 1 .. WINDOW - 1; ``hist[a]`` remainders have length a.

    Gives ``slots``, by length: arrays (first rank, first sequence, offset); a rank takes the last slot at
    or before it. Ranks from ``taken[a]`` on lie on the residual line, from ``line[a]`` tokens on.
    """
    left = hist.astype(np.int64).copy()
    slots: dict[int, list[tuple[int, int, int]]] = {}
    taken = np.zeros(WINDOW, np.int64)
    seq = 0

    def use(lengths, k):
        off = 0
        for a in lengths:
            slots.setdefault(a, []).append((int(taken[a]), seq, off))
            taken[a] += k
            left[a] -= k
            off += a

    while cols := combinations(left):
        x = nnls(cols, left)
        whole = np.floor(x + 1e-9)
        before = seq
        # Whole repeats by size, then one more by fraction, as far as the histogram goes; what is left is solved again.
        for part, most in ((x, whole), (x - whole, np.ceil(x - whole))):
            for j in sorted(range(len(cols)), key=lambda j: (-part[j], cols[j])):
                at, times = np.unique(np.array(cols[j]), return_counts=True)
                k = int(min(most[j], (left[at] // times).min()))
                if k > 0:
                    use(cols[j], k)
                    seq += k
        if seq == before:
            break
    solved = 1 - left.sum() / max(1, hist.sum())

    for a in range(WINDOW - 1, 0, -1):  # the greedy part
        while left[a] > 0:
            left[a] -= 1
            more = company(left, WINDOW - a)
            left[a] += 1
            if more is None:
                break
            at, times = np.unique(np.array([a, *more]), return_counts=True)
            k = int((left[at] // times).min())
            use([a, *more], k)
            seq += k
    line = np.zeros(WINDOW + 1, np.int64)
    np.cumsum(left * np.arange(WINDOW), out=line[1:])
    share = 1 - left.sum() / max(1, hist.sum())
    return {
        "solved": float(solved), "share": float(share),  # of the remainders, whole in a window that they fill with others: by least squares; by these and greedily
        "slots": {a: tuple(np.array(v, np.int64).T) for a, v in slots.items()},
        "taken": taken, "line": line[:-1], "total": int(line[-1]), "first": seq, "residual": left,
    }


def tail_cuts(total: int) -> list[tuple[int, int]]:
    """(start, sequence number) of the pieces of the last partial window of a line: powers of two, largest first."""
    at, out, seq = total - total % WINDOW, [], total // WINDOW
    for b in range(WINDOW.bit_length() - 1, -1, -1):
        if total % WINDOW >> b & 1:
            out.append((at, seq))
            at += 1 << b
            seq += 1
    return out


def pack(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    scratch = Scratch(df.sparkSession, "packing")
    docs = scratch.cut(tokenise(df, vocabulary, id_col, text_col), "tokens")
    # WINDOW - 1 rows at most.
    bucket = F.pmod(F.xxhash64("row"), F.lit(BUCKETS)).cast("int").alias("b")
    short = docs.where("rem > 0").select("row", "rem", bucket)
    counts = scratch.cut(short.groupBy("rem", "b").agg(F.count(F.lit(1)).alias("n")), "counts")
    hist = np.zeros(WINDOW, np.int64)
    for r in counts.groupBy("rem").agg(F.sum("n").alias("n")).collect():
        hist[r["rem"]] = r["n"]
    p = plan(hist)
    before = counts.select(
        "rem", "b", F.coalesce(F.sum("n").over(Window.partitionBy("rem").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    ranked = short.withColumn("k", F.row_number().over(Window.partitionBy("rem", "b").orderBy("row")) - 1).join(before, ["rem", "b"])
    tails = tail_cuts(p["total"])
    tail_at, tail_seq = np.array([t[0] for t in tails], np.int64), np.array([t[1] for t in tails], np.int64)
    whole_end = p["total"] - p["total"] % WINDOW

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A piece's sequence and offset; on the residual line, ``cuts`` are where the remainder is cut."""
        for rb in batches:
            row, rem, rank = (rb.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            seq, off = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
            pos = np.full(len(row), -1, np.int64)
            for a in np.unique(rem):
                m = rem == a
                k = rank[m]
                free = k >= p["taken"][a]
                s, o = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
                if a in p["slots"]:
                    first, base, at = p["slots"][a]
                    i = np.maximum(np.searchsorted(first, k, "right") - 1, 0)
                    s, o = base[i] + k - first[i], at[i]
                q = np.where(free, p["line"][a] + (k - p["taken"][a]) * a, -1)
                seq[m], off[m], pos[m] = s, o, q
            cuts: list[list[int]] = [[] for _ in row]
            on = pos >= 0
            if on.any():
                i = np.searchsorted(tail_at, pos, "right") - 1
                late = on & (pos >= whole_end)
                seq[on] = p["first"] + pos[on] // WINDOW
                off[on] = pos[on] % WINDOW
                if late.any():
                    seq[late] = p["first"] + tail_seq[i[late]]
                    off[late] = pos[late] - tail_at[i[late]]
                for j in np.flatnonzero(on):
                    a, z = int(pos[j]), int(pos[j] + rem[j])
                    inner = [w for w in range(a // WINDOW * WINDOW + WINDOW, min(z, whole_end + 1), WINDOW)] + [int(t) for t in tail_at if t > whole_end]
                    cuts[j] = sorted({c - a for c in inner if a < c < z})
            yield pa.RecordBatch.from_arrays(
                [rb.column(0), pa.array(seq), pa.array(off), pa.array(pos), pa.array(cuts, pa.list_(pa.int64()))], names=["row", "sequence_id", "offset", "pos", "cuts"]
            )

    placed = scratch.cut(
        ranked.select("row", "rem", (F.col("k") + F.col("before")).cast("long").alias("rank")).mapInArrow(
            place, "row long, sequence_id long, offset long, pos long, cuts array<long>"
        ),
        "placed",
    )

    first = p["first"]
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            cols = rb.to_pydict()
            take, out = [], {k: [] for k in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
            for j in range(rb.num_rows):
                rem, n, pos = cols["rem"][j], cols["n"][j], cols["pos"][j]
                edge = [0, *cols["cuts"][j], rem]
                for a, z in zip(edge, edge[1:]):
                    q = pos + a
                    if q >= whole_end:
                        i = int(np.searchsorted(tail_at, q, "right")) - 1
                        s, o = first + int(tail_seq[i]), q - int(tail_at[i])
                    else:
                        s, o = first + q // WINDOW, q % WINDOW
                    take.append(j)
                    for k, v in zip(out, (n - rem + a, z - a, crc(cols["ids"][j][2 * a : 2 * z]), n, s, o)):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays(
                [rb.column(0).take(pa.array(take, pa.int64())), *(pa.array(v, pa.int64()) for v in out.values())], names=["id", *out]
            )

    named = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole = docs.select("id", F.col("n").alias("doc_tokens"), "seq0", F.posexplode("crcs").alias("i", "ids_crc32")).select(
        "id", (F.col("i") * WINDOW).cast("long").alias("start"), F.lit(WINDOW).cast("long").alias("length"), "ids_crc32", "doc_tokens",
        (F.col("seq0") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    uncut = placed.where(F.size("cuts") == 0).select("row", "sequence_id", "offset")
    rest = docs.where("rem > 0").select("row", "id", "n", "rem", "rem_crc").join(uncut, "row").select(
        "id", (F.col("n") - F.col("rem")).alias("start"), F.col("rem").cast("long").alias("length"), F.col("rem_crc").alias("ids_crc32"),
        F.col("n").alias("doc_tokens"), "sequence_id", "offset",
    )
    crossing = placed.where(F.size("cuts") > 0).select("row", "pos", "cuts")
    parts = docs.where("rem > 0").select("row", "id", "n", "rem", "ids").join(crossing, "row").select("id", "n", "rem", "ids", "pos", "cuts").mapInArrow(cut, schema)
    return whole.select(named).union(rest.select(named)).union(parts.select(named)).withColumnRenamed("id", id_col)

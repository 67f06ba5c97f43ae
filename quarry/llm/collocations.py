"""Phrase collocations from word-id suffix arrays, one a shard of text.

A shard is some SHARD words of one language, as ids of its own vocabulary, with 0 between pieces of text. Its suffixes are sorted by
their first words through prefix doubling; neighbours in that order share LCP leading words, and the intervals in which that is n or
more are the different n-grams with their counts. The counts of all shards are merged by (language, phrase).

Rounds go up in length, and each leaves out what cannot reach ``min_count``: a frequent phrase holds only frequent words and frequent
pairs. Tasks test that against bit sets of the frequent ones (2 bits each, MAX_BITS bits at most, so what is broadcast is bounded). A bit
set lets some others through, whose counts are then merged and found small, so results are exact at any size.

A piece of text may be longer than a shard. The next shard then begins with the words before it, and an n-gram belongs to the shard
that holds its last word.

Defined results: a null language is ``und``, a null text is empty; languages without a candidate have no row. Repeated rows count once each.
Extra columns are ignored. An empty table gives no row.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, ship, tidy

#: Words of a shard, and bytes of text that are split at once.
SHARD, SLICE = 1 << 21, 1 << 22
MIN_BITS, MAX_BITS, BITS_EACH = 1 << 16, 1 << 27, 16
BUCKETS = 16
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MARK = b"\xff"  # no byte of UTF-8 text


def _table() -> bytes:
    """A-Z to a-z, ends of pieces to line feeds, tabs to spaces."""
    t = bytearray(range(256))
    for c in range(65, 91):
        t[c] = c + 32
    for c in b".,;:!?\n\x0b\x0c\r":
        t[c] = 10
    t[9] = 32
    return bytes(t)


_TABLE = _table()


def slices(text: bytes, size: int = SLICE) -> Iterator[list[bytes]]:
    """The words of a text and a mark after each piece, in lists of bounded length."""
    text, at = text.translate(_TABLE), 0
    while at < len(text):
        end = at + size
        if end < len(text):
            ends = [i for i in (text.find(b" ", end), text.find(b"\n", end)) if i >= 0]
            end = min(ends) if ends else len(text)
        yield text[at:end].replace(b"\n", b" \xff ").split()
        at = end


class Shard:
    """Words of one language as ids; ``own`` is false for the words that an earlier shard has counted."""

    def __init__(self, carry: Sequence[bytes] = ()):
        self.vocabulary: dict[bytes, int] = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.vocabulary[_MARK]
        self.carried = len(carry)
        self.parts: list[np.ndarray] = []
        self.size, self.tail = 0, []
        self.add(list(carry))

    def add(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.vocabulary.__getitem__, words), np.int32, len(words)))
        self.size += len(words)
        self.tail = (self.tail + words[-3:])[-3:]

    def open_end(self) -> list[bytes]:
        """The last words of a piece that goes on."""
        tail = self.tail
        return tail[len(tail) - tail[::-1].index(_MARK) :] if _MARK in tail else tail

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        w = np.concatenate(self.parts).astype(np.int64)
        own = np.ones(len(w), bool)
        own[: self.carried] = False
        return w, own


def suffix_array(w: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``w`` in the order of their first ``depth`` ids (rounded up to a power of two), by prefix doubling."""
    rank, h = w, 1
    order = np.argsort(rank)
    while h < depth:
        after = np.zeros_like(rank)
        after[:-h] = rank[h:] + 1 if h < len(rank) else 0
        key = rank * (int(after.max(initial=0)) + 1) + after
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty_like(key)
        rank[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
        h *= 2
    return order


def intervals(w: np.ndarray, own: np.ndarray, orders: Sequence[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, places, counts): for each n one place of every different n-gram and its occurrences; 0 ends a piece."""
    deep = max(orders)
    sa = suffix_array(w, deep)
    sa = sa[w[sa] > 0]
    if not len(sa):
        return
    padded, mine = np.concatenate([w, np.zeros(deep, w.dtype)]), np.concatenate([own, np.zeros(deep, bool)])
    # lcp: leading words shared with the suffix before it; room: words up to the end of the piece.
    lcp, room = np.zeros(len(sa), np.int8), np.zeros(len(sa), np.int8)
    same, inside = np.ones(len(sa), bool), np.ones(len(sa), bool)
    same[0] = False
    for k in range(deep):
        word = padded[sa + k]
        inside &= word > 0
        same[1:] &= (word[1:] == word[:-1]) & inside[1:]
        room += inside
        lcp += same
    for n in orders:
        at = np.flatnonzero(room >= n)
        if not len(at):
            continue
        starts = np.flatnonzero(lcp[at] < n)
        counts = np.add.reduceat(mine[sa[at] + n - 1].astype(np.int64), starts)
        places = sa[at[starts]]
        yield n, places[counts > 0], counts[counts > 0]


def _hashes(lang: str, words: Sequence[bytes]) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in words), np.uint64, len(words))


def _joined_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a ^ (a >> np.uint64(29))) * _MIX + b
    return h ^ (h >> np.uint64(32))


def _probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return h % np.uint64(bits), (h * _MIX >> np.uint64(20)) % np.uint64(bits)


def _in(bitset: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether both bits of each hash are set."""
    a, b = _probes(h, len(bitset) * 64)
    one = np.uint64(1)
    return (bitset[a >> np.uint64(6)] >> (a & np.uint64(63)) & bitset[b >> np.uint64(6)] >> (b & np.uint64(63)) & one).astype(bool)


def _bitset(frequent: DataFrame, count: int) -> np.ndarray:
    """Bits of the (lang, phrase) rows; at most MAX_BITS, so that is all that reaches the driver."""
    bits = min(MAX_BITS, max(MIN_BITS, 1 << (count * BITS_EACH).bit_length()))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if not rb.num_rows:
                continue
            hs = []
            for lang, phrase in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
                words = _hashes(lang, phrase.encode().split(b" "))
                h = words[:1]
                for k in range(1, len(words)):
                    h = _joined_hash(h, words[k : k + 1])
                hs.append(h)
            at = np.unique(np.concatenate(_probes(np.concatenate(hs), bits)))
            cell = at >> np.uint64(6)
            first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
            yield pa.RecordBatch.from_arrays([pa.array(cell[first].astype(np.int64)), pa.array(value.view(np.int64))], names=["cell", "value"])

    cells = frequent.select("lang", "phrase").mapInArrow(tidy(go), "cell long, value long").groupBy("cell").agg(F.bit_or("value").alias("value")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[cells.column(0).to_numpy()] = cells.column(1).to_numpy().view(np.uint64)
    return out


def _pruned(lang: str, shard: Shard, words, pairs) -> tuple[np.ndarray, np.ndarray]:
    """The shard's words with a mark wherever no frequent phrase can reach across."""
    w, own = shard.arrays()
    if words is None:
        return w, own
    h = _hashes(lang, list(shard.vocabulary))
    fit = _in(words.value, h)
    fit[0] = False
    w = np.where(fit[w], w, 0)
    linked = np.zeros(len(w) + 1, bool)  # linked[i]: a phrase may hold the words i - 1 and i
    linked[1:-1] = (w[1:] > 0) & (w[:-1] > 0)
    if pairs is not None:
        at = np.flatnonzero(linked)
        linked[at] = _in(pairs.value, _joined_hash(h[w[at - 1]], h[w[at]]))
    # Words with company stay; before each that does not follow from its left one stands a mark.
    keep = np.flatnonzero(linked[:-1] | linked[1:])
    new = ~linked[keep]
    place = np.arange(len(keep)) + np.cumsum(new)
    out, mine = np.zeros(len(keep) + int(new.sum()) + 1, np.int64), np.zeros(len(keep) + int(new.sum()) + 1, bool)
    out[place], mine[place] = w[keep], own[keep]
    return out, mine


def _counts(orders: Sequence[int], words=None, pairs=None, shard_words: int = SHARD):
    """(lang, text) to (lang, phrase, f), the n-grams of each shard."""

    def close(lang: str, shard: Shard) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(list(shard.vocabulary), pa.binary())
        w, own = _pruned(lang, shard, words, pairs)
        for n, places, counts in intervals(w, own, orders):
            for a in range(0, len(places), 1 << 16):
                at = places[a : a + (1 << 16)]
                cols = [vocabulary.take(pa.array(w[at + k])) for k in range(n)]
                phrase = pc.binary_join_element_wise(*cols, b" ") if n > 1 else cols[0]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), phrase.cast(pa.string()), pa.array(counts[a : a + (1 << 16)])], names=["lang", "phrase", "f"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Shard] = {}
        total = 0
        for rb in batches:
            for lang, text in zip(rb.column(0).to_pylist(), rb.column(1).cast(pa.binary())):
                text = text.as_py()
                if not text:
                    continue
                for part in slices(text):
                    if total >= shard_words:  # all close, so that many languages are bounded too
                        carry = held[lang].open_end() if lang in held else []
                        for name in list(held):
                            yield from close(name, held.pop(name))
                        total = 0
                        if carry:
                            held[lang] = Shard(carry)
                    held.setdefault(lang, Shard()) if lang not in held else None
                    held[lang].add(part)
                    total += len(part)
                held[lang].add([_MARK]) if lang in held else None
        for name in list(held):
            yield from close(name, held.pop(name))

    return go


def phrase_counts(df: DataFrame, scratch: Scratch, min_count: int, longest: int, shard_words: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """((lang, n) with all words, (lang, phrase, f) of the phrases of up to ``longest`` words that occur ``min_count`` times)."""
    sc = df.sparkSession.sparkContext

    def merged(*args) -> DataFrame:
        return df.mapInArrow(tidy(_counts(*args, shard_words=shard_words)), "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))

    words = scratch.cut(merged((1,)), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    found = [words.where(F.col("f") >= min_count)]
    sets = [sc.broadcast(_bitset(found[0], found[0].count()))]
    if longest > 1:
        found.append(scratch.cut(merged((2,), sets[0]).where(F.col("f") >= min_count), "pairs"))
    if longest > 2:
        sets.append(sc.broadcast(_bitset(found[1], found[1].count())))
        found.append(scratch.cut(merged(tuple(range(3, longest + 1)), *sets).where(F.col("f") >= min_count), "longer"))
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    return totals, every


def collocations(
    df: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = 30, longest: int = 4, cover: int = 80, top: int = 2000, shard_words: int = SHARD
) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score, words, cut.

    A phrase of a occurrences, cut after some word into parts of l and r, scores floor(2000000 a / (l + r)), at its worst cut (the first
    of equal ones). A phrase whose words a longer one holds, which occurs ``cover`` percent as often or more, is left out.
    """
    ship(df.sparkSession)
    scratch = Scratch(df.sparkSession, "collocations")
    d = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    totals, counted = phrase_counts(d, scratch, min_count, longest, shard_words)
    words = F.split("phrase", " ")
    long = counted.withColumn("w", words).where(F.size("w") > 1)

    def part(start, size):
        return F.array_join(F.slice("w", start, size), " ")

    # Both parts of every cut, looked up among the counted phrases.
    cuts = long.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("cut"))
    sides = F.array(F.struct(F.lit(0).alias("side"), part(F.lit(1), F.col("cut")).alias("p")), F.struct(F.lit(1).alias("side"), part(F.col("cut") + 1, F.size("w") - F.col("cut")).alias("p")))
    asked = cuts.select("lang", "phrase", "a", "cut", F.explode(sides).alias("s")).select("lang", "phrase", "a", "cut", "s.side", F.col("s.p").alias("p"))
    known = counted.select("lang", F.col("phrase").alias("p"), "f")
    pair = lambda k: F.max(F.when(F.col("side") == k, F.col("f")))
    scored = asked.join(known, ["lang", "p"]).groupBy("lang", "phrase", "a", "cut").agg(pair(0).alias("l"), pair(1).alias("r"))
    exact = "CAST(2000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(20, 0)) DIV (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))"
    worst = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr(exact).alias("score"), "cut", "l", "r")).alias("x"))
    worst = worst.select("lang", "phrase", "a", "x.*")
    # The commonest longer phrase that holds a phrase.
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
    inside = long.where(F.size("w") > 2).select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = worst.join(inside, ["lang", "phrase"], "left").where(
        "longer IS NULL OR CAST(100 AS DECIMAL(3, 0)) * CAST(longer AS DECIMAL(20, 0)) < CAST(%d AS DECIMAL(3, 0)) * CAST(a AS DECIMAL(20, 0))" % cover
    )
    # The best of each bucket, then those of a language: ``top`` times BUCKETS rows at most.
    best = F.struct((-F.col("score")).alias("s"), (-F.col("a")).alias("b"), "phrase", "l", "r", "cut")
    kept = kept.select("lang", best.alias("x"), F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS)).alias("bucket"))
    kept = kept.withColumn("k", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy("x"))).where(F.col("k") <= top)
    ranked = kept.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list("x")), 1, top).alias("xs")).join(totals, "lang")
    out = ranked.select("lang", "n", F.posexplode("xs").alias("at", "x"))
    return out.select(
        "lang", (F.col("at") + 1).cast("long").alias("rank"), "x.phrase", (-F.col("x.b")).alias("a"), "x.l", "x.r", "n", (-F.col("x.s")).alias("score"),
        F.size(F.split("x.phrase", " ")).alias("words"), F.col("x.cut").alias("cut"),
    )

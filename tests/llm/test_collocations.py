import random
import re
from collections import Counter

import numpy as np
import pytest

from quarry.llm import collocations as co


def brute(rows, min_count, longest=4, cover=80, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    out = {}
    cands = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= min_count}
    longer = Counter()
    for (lang, w), a in cands.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longer[lang, w[i : i + k]] = max(longer[lang, w[i : i + k]], a)
    for (lang, w), a in cands.items():
        if 100 * longer[lang, w] >= cover * a:
            continue
        score, cut = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        phrase = " ".join(w)
        out.setdefault(lang, []).append((-score, -a, phrase.encode(), f[lang, w[:cut]], f[lang, w[cut:]], len(w), cut))
    return sorted(
        (lang, i, p.decode(), -a, left, right, n[lang], -s, k, cut) for lang, xs in out.items() for i, (s, a, p, left, right, k, cut) in enumerate(sorted(xs)[:top], 1)
    )


def got(df):
    return sorted(map(tuple, df.collect()))


def texts(seed=4, n=300):
    rng = random.Random(seed)
    words = ["the", "The", "new", "york", "é", "日本", "of", "a", "b", "c", "zebra", "x-y", "NEW"] + [f"w{i}" for i in range(200)]
    common = ["new york city hall", "once upon a time", "a b a b a b a b", "日本 é of the"]
    rows = []
    for i in range(n):
        parts = [rng.choice(common) if rng.random() < 0.3 else rng.choice(words[: 13 if rng.random() < 0.5 else None]) for _ in range(rng.randrange(1, 60))]
        rows.append((rng.choice(["en", "de", None]), "".join(p + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", "\x0b"]) for p in parts)))
    return rows


@pytest.mark.parametrize("shard, piece", [(1 << 21, 1 << 22), (50, 40), (1, 1)])
def test_equals_counting(spark, shard, piece, monkeypatch):
    """Whatever the shards: with small ones, pieces of text go on from one to the next."""
    monkeypatch.setattr(co.slices, "__defaults__", (piece,))
    rows = texts(n=300 if shard > 100 else 60)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, f int, phrase string")
    for least in (8, 3):
        assert got(co.collocations(df, min_count=least, shard_words=shard)) == brute(rows, least) != []


def test_top_and_other_lengths(spark):
    rows = texts(9)
    df = spark.createDataFrame(rows, "lang string, text string")
    assert got(co.collocations(df, min_count=4, top=7)) == brute(rows, 4, top=7)
    assert got(co.collocations(df, min_count=4, longest=3, cover=50)) == brute(rows, 4, 3, 50)


def test_odd_rows(spark):
    shape = "lang string, text string"
    assert co.collocations(spark.createDataFrame([], shape)).count() == 0
    assert co.collocations(spark.createDataFrame([("en", None), ("en", ""), (None, " .,\n")], shape)).count() == 0
    rows = [("en", "a b " * 40_000), (None, "a b " * 40_000 + "\x00 \x00"), ("en", "a b"), ("en", "a b")]  # one very long piece, repeated rows
    assert got(co.collocations(spark.createDataFrame(rows, shape), shard_words=1000)) == brute(rows, 30)


def test_large_counts_stay_exact(spark, monkeypatch):
    """Products beyond 64 bits: the counts of a scratch table are scaled up."""
    real = co.phrase_counts

    def scaled(*args, **more):
        totals, every = real(*args, **more)
        return totals, every.selectExpr("lang", "phrase", "f * 90000000000000 AS f")

    monkeypatch.setattr(co, "phrase_counts", scaled)
    rows = texts(9)
    big = {(r[0], r[2]): (r[3], r[4], r[5], r[7]) for r in got(co.collocations(spark.createDataFrame(rows, "lang string, text string"), min_count=4))}
    for lang, _, phrase, a, left, right, _, score, *_ in brute(rows, 4):
        assert big[lang, phrase] == (a * 90000000000000, left * 90000000000000, right * 90000000000000, score)


def test_intervals_of_a_suffix_array():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 4, 500).astype(np.int64)
    found = {(n, tuple(w[p : p + n])): int(c) for n, ps, cs in co.intervals(w, np.ones(500, bool), (1, 2, 3, 4)) for p, c in zip(ps, cs)}
    want = Counter((n, tuple(w[i : i + n])) for n in range(1, 5) for i in range(500 - n + 1) if (w[i : i + n] > 0).all())
    assert found == dict(want)


def test_a_crowded_bit_set_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(co, "MAX_BITS", 64)
    monkeypatch.setattr(co, "MIN_BITS", 64)
    rows = texts(11)
    assert got(co.collocations(spark.createDataFrame(rows, "lang string, text string"), min_count=5)) == brute(rows, 5)

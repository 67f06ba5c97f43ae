import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from quarry.llm import packing, queries


@pytest.fixture(scope="module")
def vocab():
    return queries.vocabulary("word_bpe_49k.json")


def check(rows, texts, vocab):
    """Pieces cover each document's ids once, sequences are gapless and hold at most a window."""
    tk = Tokenizer.from_file(vocab)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for i, text in texts.items():
        ids = tk.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            at += r.length
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : at], "<u4").tobytes())
        assert at == len(ids)
    padding = 0
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW
        padding += 0 if at & (at - 1) == 0 else packing.WINDOW - at
    return padding


def test_query(spark, sf, vocab):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert check(queries.op6_packing(spark, sf).collect(), texts, vocab) == 0


def test_odd_rows(spark, vocab):
    odd = ["", None, "a", "<|endoftext|> it's <|startoftext|>x", "İstanbul ﬁ é   x\x1cy 日本語 ß ÀÉ", "don't 12ab!?", "w " * 6000, "😀".encode("utf-16", "surrogatepass").decode("utf-16")]
    odd += ["x y z"] * 5 + ["abc " * k for k in range(300, 1500, 7)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(odd)], "doc_id long, text string, start int")
    assert check(packing.pack(df, vocab).collect(), dict(enumerate(odd)), vocab) == 0
    assert packing.pack(df.limit(0), vocab).count() == 0
    rep = packing.pack(spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string"), vocab).collect()
    assert len({(r.sequence_id, r.offset) for r in rep}) == len(rep) and sum(r.length for r in rep) == 6


def test_plan_uses_every_rank_once():
    rng = np.random.default_rng(3)
    hist = np.zeros(packing.WINDOW, np.int64)
    hist[1:] = rng.poisson(4, packing.WINDOW - 1)
    hist[700] = 5000
    p = packing.plan(hist)
    for a, (first, base, off) in p["slots"].items():
        assert list(first) == sorted(set(first)) and first[0] == 0
    assert (p["taken"] <= hist).all()
    assert p["total"] == int(((hist - p["taken"]) * np.arange(packing.WINDOW)).sum())
    # Combinations carry most of what pairs and triples can.
    assert p["first"] > 500


def test_least_squares_place_most_of_sparse_lengths():
    """Counts of one or two a length, as long as documents here on average: the solution is nearly all fractions, yet over half find a place."""
    rng = np.random.default_rng(4)
    hist = np.zeros(packing.WINDOW, np.int64)
    np.add.at(hist, np.clip(rng.gamma(2.0, 330.0, 1000).astype(int), 1, packing.WINDOW - 1), 1)
    p = packing.plan(hist)
    assert 0.5 < p["solved"] <= p["share"] and (p["taken"] <= hist).all()
    filled = {}
    for a, (first, base, off) in p["slots"].items():
        ends = [*first[1:], p["taken"][a]]
        for f, b, o, e in zip(first, base, off, ends):
            for k in range(int(e - f)):
                filled.setdefault(int(b) + k, []).append((int(o), a))
    assert len(filled) == p["first"]
    for parts in filled.values():
        at = 0
        for o, a in sorted(parts):
            assert o == at
            at += a
        assert at == packing.WINDOW
    empty = packing.plan(np.zeros(packing.WINDOW, np.int64))
    assert empty["first"] == 0 and empty["solved"] == 1.0


def test_nnls():
    cols = [(1, 3), (2, 2), (1, 1, 2)]
    target = np.array([0.0, 30, 40, 10])
    x = packing.nnls(cols, target, 500)
    A = np.array([[0, 0, 0], [1, 0, 2], [0, 2, 1], [1, 0, 0]], float)
    assert (x >= 0).all()
    g = A.T @ (A @ x - target)
    assert (g > -1).all() and abs((g * x).sum()) < 30

"""Packed postings without Spark: texts to chunks, to blocks and back to hits."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quarry.operators import postings as P


def test_numbers_round_trip():
    x = np.array([0, 1, 127, 128, 16383, 16384, 5 << 33, (1 << 62) - 1, 3], np.int64)
    for first in ([0], [0, 3, 4], list(range(9))):
        c = P.coded(x, np.array(first))
        assert len(c) == len(first) and P.decoded(c).tolist() == x.tolist() and P.decoded(c.slice(len(first) - 1)).tolist() == x[first[-1] :].tolist()


@pytest.mark.parametrize(("batch", "size"), [(1 << 21, 1 << 22), (40, 60)])
@pytest.mark.parametrize("kind", ["words", "trigrams"])
def test_blocks_hold_what_texts_hold(monkeypatch, kind, batch, size):
    """Also where stretches are short and a frequent term is made into blocks in several goes; a chunk costs one row, not one a token."""
    monkeypatch.setattr(P, "BATCH", batch)
    monkeypatch.setattr(P, "BYTES", size)
    rng = random.Random(2)
    rids = rng.sample(range(1 << 36), 300)
    texts = [" ".join(rng.choice(["a", "bb", "the", "é𝄞x", "rare%d" % rng.randrange(99)]) for _ in range(rng.choice([0, 1, 9, 80]))) for _ in rids]
    want = {}
    for rid, t in zip(rids, texts):
        toks = t.split() if kind == "words" else [t[i : i + 3] for i in range(len(t) - 2)]
        for k, w in enumerate(toks):
            want.setdefault((w, rid), (len(toks), []))[1].append(k)
    col = pa.array([t.split() for t in texts], pa.list_(pa.string())) if kind == "words" else pa.array(texts)
    chunks = pa.Table.from_batches(list(getattr(P, kind)(iter([pa.record_batch([pa.array(rids), col], names=["rid", "t"])]))))
    assert sum(chunks["n"].to_pylist()) == len(want)
    if batch > 40:
        assert chunks.num_rows == len({w for w, _ in want})
    chunks = chunks.append_column("bucket", pa.array([len(w) % 3 for w in chunks["term"].to_pylist()], pa.int32())).sort_by([("bucket", "ascending"), ("term", "ascending"), ("low", "ascending")])
    blocks = list(P.blocks(30.0, 1.2, 0.75, 8, 16, 6)(iter(chunks.to_batches(max_chunksize=7))))
    got = {}
    for rb in blocks:
        assert max(rb["n"].to_pylist()) <= 8
        for i, b in enumerate(rb.to_pylist()):
            h = [x for y in P.hits(True)(iter([rb.slice(i, 1)])) for x in y.to_pylist()]
            assert [x["rid"] for x in h] == sorted(x["rid"] for x in h) and b["low"] == h[0]["rid"] and b["high"] == h[-1]["rid"] and b["tokens"] == sum(x["tf"] for x in h)
            for k in range(6):
                cls = [x for x in h if min(x["tf"].bit_length() - 1, 5) == k]
                assert b["tfs"][k] == max([x["tf"] for x in cls], default=0) and b["dls"][k] == min([x["dl"] for x in cls], default=0)
            for x in h:
                assert x["tf"] == len(x["positions"]) and (x["term"], x["rid"]) not in got
                got[x["term"], x["rid"]] = (x["dl"], x["positions"])
    assert got == want
    assert sum(rb.num_rows for rb in P.single(iter(blocks))) == len(want)

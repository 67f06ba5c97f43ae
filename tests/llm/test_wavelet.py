import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import queries
from quarry.llm import wavelet as wl
from quarry.llm.common import Scratch


@pytest.fixture(scope="module")
def vocab():
    return queries.vocabulary("word_bpe_49k.json")


def expected(rows, vocab):
    """(id, start, n, crc) in the order of ids, and all tokens."""
    tk, at, out, every = Tokenizer.from_file(vocab), 0, [], []
    for i, text in rows:
        ids = [*tk.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
        every += ids
    return out, every


def test_query(spark, sf, vocab):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()]
    assert [tuple(r) for r in queries.op13_wavelet(spark, sf).orderBy("doc_id").collect()] == expected(rows, vocab)[0]


@pytest.fixture(scope="module")
def stored(spark, vocab):
    """A few small shards, with a long document, and what they hold."""
    texts = ["", None, "the cat sat on the mat", "<|endoftext|> it's", "日本語 😀 ß", "the " * 3000, *[f"the number {i} of the {i % 7}" for i in range(400)]]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in reversed(rows)], "doc_id long, text string, row int, id string")
    folder = Scratch(spark, "tokens").base
    shards = wl.write(df.repartition(5), folder, vocab, shard_tokens=300)
    return shards, folder, *expected(rows, vocab)


def test_files_hold_every_document(stored):
    shards, folder, docs, tokens = stored
    assert [tuple(r) for r in wl.documents(shards, folder).orderBy("doc_id").collect()] == docs
    m = shards.orderBy("start").collect()
    assert len(m) > 5 and [r["start"] for r in m] == np.cumsum([0, *[r["tokens"] for r in m][:-1]]).tolist() and sum(r["tokens"] for r in m) == len(tokens)
    parts = wl.over_files(shards, folder, lambda w, start: iter([pa.RecordBatch.from_arrays([pa.array([start]), pa.array([w.tokens().tolist()], pa.list_(pa.int32()))], names=["start", "t"])]), "start long, t array<int>")
    assert [t for r in parts.orderBy("start").collect() for t in r["t"]] == tokens


def test_access_count_and_occurrences(stored):
    shards, folder, docs, tokens = stored
    at = [0, 1, 17, len(tokens) // 2, len(tokens) - 1]
    assert {r["position"]: r["token"] for r in wl.tokens_at(shards, folder, at).collect()} == {p: tokens[p] for p in at}
    the = tokens[docs[2][1]]
    assert {r["token"]: r["n"] for r in wl.counts(shards, folder, [the, 2, 49_000]).collect()} == {t: tokens.count(t) for t in (the, 2, 49_000)}
    found = wl.occurrences(shards, folder, the).orderBy("position").collect()
    assert [r["position"] for r in found] == [i for i, t in enumerate(tokens) if t == the]
    starts = {d: a for d, a, *_ in docs}
    assert all(starts[r["doc_id"]] + r["place"] == r["position"] for r in found)


@pytest.mark.parametrize("n", [0, 1, 8, wl.BLOCK, wl.BLOCK + 1, 3 * wl.BLOCK + 77])
@pytest.mark.parametrize("most", [1, 2, 50_000, 1 << 20])
def test_format_round_trip(n, most):
    rng = np.random.default_rng(n + most)
    v = (rng.zipf(1.3, n) % most).astype(np.uint32)
    f = wl.WaveletFile(io.BytesIO(wl.dump(v, np.array([n]), pa.array(["a"]))))
    assert (f.tokens() == v).all() and f.ids.to_pylist() == ["a"] and f.lengths.tolist() == [n]
    for i in rng.integers(0, n, 12) if n else ():
        t, where = int(v[i]), np.flatnonzero(v == v[i])
        assert f.access(int(i)) == t and f.rank(t, int(i)) == (v[:i] == t).sum() and f.count(t) == len(where)
        assert f.select(t, len(where) - 1) == where[-1]
    assert f.count(1 << 25) == 0
    with pytest.raises(IndexError):
        f.access(n)


def test_odd_rows(spark, vocab):
    shape = "doc_id string, text string"
    folder = Scratch(spark, "tokens").base
    assert wl.documents(wl.write(spark.createDataFrame([], shape), folder, vocab), folder, id_type="string").count() == 0
    rows = [("b", "x y"), ("a", "x y"), (None, "z"), ("b", "x y")]
    folder = Scratch(spark, "tokens").base
    got = wl.documents(wl.write(spark.createDataFrame(rows, shape), folder, vocab), folder, id_type="string").orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, "a", "b", "b"] and got[2]["ids_crc32"] == got[3]["ids_crc32"]


def test_a_task_that_runs_twice_leaves_one_file(spark, vocab):
    import pyarrow.fs as pafs

    df = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    folder = Scratch(spark, "tokens").base
    once = [tuple(r) for r in wl.documents(wl.write(df, folder, vocab), folder).orderBy("doc_id").collect()]
    d = df.select(F.col("doc_id").alias("id"), "text").coalesce(1).sortWithinPartitions("id")
    again = d.mapInArrow(wl._shards(folder, vocab, pa.int64(), wl.SHARD_TOKENS, 2), "part long, shard long, file string, documents long, before long, tokens long")
    assert [r["documents"] for r in again.collect()] == [50] and [r["documents"] for r in again.collect()] == [50]
    fs, base = pafs.FileSystem.from_uri(folder)
    names = [f.base_name for f in fs.get_file_info(pafs.FileSelector(base)) if f.is_file]
    assert len(once) == 50 and not [n for n in names if not n.endswith(".qwm")]

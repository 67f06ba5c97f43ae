import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece

from quarry.llm import queries, sp_wfst


@pytest.fixture(scope="module")
def vocab():
    return queries.vocabulary("piece_bpe_32k.model")


def texts():
    rng = random.Random(2)
    out = ["", " ", "  ", " a  b   c ", "a\nb\tc\r\n", "日本é€ ﬁ ʼn \u00a0x", "▁ literal ▁▁ marks", "<s> <0x41> </s>", "\ufeffab", "e\u0301", "😀😀 a", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]
    letters = "abcdehinorst THEé.,-_/0123\n  "
    out += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 120))) for _ in range(300)]
    return out


def test_paths_equal_the_library(vocab):
    m, sp = sp_wfst.Transducer.load(vocab), sentencepiece.SentencePieceProcessor(model_file=vocab)
    for t in texts():
        assert m.encode(t).tolist() == sp.encode(t), t
        assert m.decode(m.encode(t).tolist()) == sp.decode(sp.encode(t))


def test_shortest_path_of_the_whole_composition_is_the_librarys(vocab):
    """Without the shortcuts of ``path``: all arcs and contexts."""
    m, sp = sp_wfst.Transducer.load(vocab), sentencepiece.SentencePieceProcessor(model_file=vocab)
    assert m.kind == "bpe"
    for t in texts()[:200]:
        words = sp_wfst._WORDS.findall(m.normalise(t)) if t else []
        assert [i for w in words for i in m.shortest(w)] == sp.encode(t), t


def test_unigram_paths_equal_all_segmentations():
    rng = random.Random(6)
    for _ in range(30):
        texts_ = {"▁", *"abc"} | {("▁" if rng.random() < 0.3 else "") + "".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(25)}
        pieces = [(s, 300 + k, -rng.random() * 9) for k, s in enumerate(sorted(texts_))]
        m = sp_wfst.Transducer(pieces, {b: b for b in range(256)}, "unigram")
        score = {s: x for s, _, x in pieces}
        name = {s: i for s, i, _ in pieces}

        def best(w):
            """(score, ids) by trying every cut."""
            if not w:
                return 0.0, []
            out = [(score[w[:k]] + best(w[k:])[0], [name[w[:k]], *best(w[k:])[1]]) for k in range(1, len(w) + 1) if w[:k] in score]
            if w[0] not in score:
                rest = best(w[1:])
                out.append((rest[0] - m.unknown, [*w[0].encode(), *rest[1]]))
            return max(out)

        for _ in range(8):
            t = "".join(rng.choice("abcab é") for _ in range(rng.randrange(1, 10)))
            value = lambda ids: sum(-m.unknown / len("é".encode()) if i < 256 else m.score[i] for i in ids)
            want = best(m.normalise(t))[1]
            assert abs(value(m.encode(t).tolist()) - value(want)) < 1e-9, t  # equal sums may have other orders
            assert m.decode(m.encode(t).tolist()) == t


def test_a_literal_mark_comes_back_as_a_space(vocab):
    m = sp_wfst.Transducer.load(vocab)
    assert m.decode(m.encode("a ▁ b").tolist()) == "a   b" and m.decode(m.encode(" a  b ").tolist()) == " a  b "


def test_query_equals_the_library(spark, sf, vocab):
    sp = sentencepiece.SentencePieceProcessor(model_file=vocab)
    got = {r.doc_id: r for r in queries.op8_wfst(spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = sp.encode(d.text)
        r = got[d.doc_id]
        assert r.n_ids == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert r.decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()


def test_operator_and_odd_rows(spark, vocab):
    rows = [(1, None, "x"), (2, "", "y"), (3, "a b", "z"), (3, "a b", "z"), (4, "long " * 40000, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    enc = sp_wfst.encode(df, vocab)
    assert enc.columns == ["doc_id", "text", "ids"]
    back = sp_wfst.decode(enc, vocab, out="back").collect()
    assert sorted((r.doc_id, r.back) for r in back) == sorted((r[0], r[1] or "") for r in rows)
    assert sp_wfst.encode(df.limit(0), vocab).count() == 0
    assert sp_wfst.digest(df.limit(0), vocab).count() == 0

import zlib

import numpy as np

from quarry.llm import pu_classifier as pc, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.op9_pu_quality(spark, sf).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    test = [(rows[x.doc_id].predicted, x.quality) for x in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[x.doc_id].held_out]
    good = [p for p, q in test if q == 1]
    bad = [p for p, q in test if q == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.25


def test_labels_of_held_out_rows_change_nothing(spark):
    docs = spark.createDataFrame([(i, "good words here now " * (i % 7 + 3) if i % 4 else "bad ### $$$ " * 9) for i in range(60)], "doc_id long, text string")
    a = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(60)], "doc_id long, quality int")
    b = spark.createDataFrame([(i, 1 - int(i % 4 > 0) if zlib.crc32(str(i).encode()) % 3 == 1 else int(i % 4 > 0)) for i in range(60)], "doc_id long, quality int")
    one, two = (sorted((r.doc_id, r.score) for r in pc.classify(docs, x).collect()) for x in (a, b))
    assert one == two


def test_risk_never_pays_for_fitting_the_positives():
    g = np.random.default_rng(0)
    good, bad = g.normal(1.5, 1, (900, 4)), g.normal(-1.5, 1, (300, 4))
    m = pc.fit(good[:300], np.vstack([good[300:], bad]), 2 / 3)
    assert (m.score(good) >= 0.5).mean() > 0.9 and (m.score(bad) >= 0.5).mean() < 0.15


def test_odd_rows(spark):
    rows = [(1, None, 9), (2, "", 9), (None, "a b", 9), (3, "w " * 50000, 9), (4, "x y z", 9), (4, "x y z", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(4, 1), (None, 1), (3, None)], "doc_id long, quality int")
    got = {(r.doc_id): (r.score, r.held_out) for r in pc.classify(docs, labels).collect()}
    assert got[1][0] == got[2][0] and got[None][1] is False and len(got) == 5
    assert pc.classify(docs, labels.limit(0)).count() == 6
    assert pc.classify(docs.limit(0), labels).count() == 0


def test_features_equal_plain_python():
    def plain(text):
        ws = text.split()
        if not ws:
            return [0.0] * (pc.MEASURES + pc.BUCKETS)
        count = lambda cs: sum(text.count(c) for c in cs)
        raw = text.encode()
        letters = max(1, sum(chr(b).isalpha() and b < 128 or 0xC3 <= b < 0xCC for b in raw))
        chars, lines, low = sum(map(len, ws)), [x for x in text.split("\n") if x.strip()], text.lower().split()
        out = [np.log(1 + len(ws)), count("#*$%&<>") / len(ws), count("|") / len(ws), count("!") / len(ws), sum(65 <= b < 91 for b in raw) / letters, chars / len(ws),
               1 - len(set(lines)) / len(lines), len(set(low)) / len(low), sum(ws[i] == ws[i + 1] for i in range(len(ws) - 1)) / len(ws), sum(48 <= b < 58 for b in raw) / chars,
               count(".,;:?()'\"-") / chars, sum(len(w) == 1 for w in ws) / len(ws), sum(len(w) > 15 for w in ws) / len(ws), np.log(1 + len(lines))]
        b = [zlib.crc32(w.encode()) % pc.BUCKETS for w in low]
        hist = [0] * pc.BUCKETS
        for k, v in enumerate(b):
            hist[v] += 1
            if k:
                hist[(b[k - 1] * 31 + v * 17 + 7) % pc.BUCKETS] += 1
        return out + [np.sqrt(h / sum(hist)) for h in hist]

    for text in ("", " \n\t", "One word!", "é à Ü ñ one ONE one\n\nsame line\nsame line\n|| ## 12 3.4", "x" * 9000, "a b " * 5000, "日本 語 ﬁ"):
        assert np.allclose(pc.features(text), plain(text)), text[:20]
    assert (pc.features(None) == 0).all()


def test_query_scores_equal_a_model_fitted_outside(spark, sf):
    """Samples, prior, risk and scores again, without Spark but for the hashes that order the samples."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    order = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit(3)).alias("h")).collect()}
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    assert len(good) <= pc.POSITIVES and len(texts) <= pc.UNLABELLED
    ids = sorted(texts, key=lambda i: (order[i], i))
    x = {i: pc.features(texts[i]).astype(np.float32).astype(float) for i in ids}
    pos, unl = np.stack([x[i] for i in ids if i in good]), np.stack([x[i] for i in ids])
    m = pc.fit(pos, unl, pc.estimated_prior(pos, unl))
    got = {r.doc_id: r.score for r in queries.op9_pu_quality(spark, sf).collect()}
    a, b, c, d = (np.asarray(p, float) for p in m.par)
    for i in ids[::7]:
        h = np.tanh(np.clip((x[i] - m.mean) / m.std, -8, 8) @ a + b)
        assert abs(got[i] - 1 / (1 + np.exp(-(h @ c + d[0])))) < 1e-4


def test_gradient_is_the_slope_of_the_risk():
    g = np.random.default_rng(1)
    m = pc.Model(5)
    z, dm = g.normal(size=(7, 5)), g.normal(size=7)
    grads = m.grad(z, np.tanh(z @ m.par[0] + m.par[1]), dm)
    for p, v in zip(m.par, grads):
        for at in list(np.ndindex(p.shape))[:6]:
            old, e = p[at], 1e-6
            value = []
            for s in (e, -e):
                p[at] = old + s
                value.append((dm * (np.tanh(z @ m.par[0] + m.par[1]) @ m.par[2] + m.par[3][0])).sum())
            p[at] = old
            assert abs((value[0] - value[1]) / (2 * e) - v[at]) < 1e-5


def test_prior_without_negatives():
    g = np.random.default_rng(5)
    for share in (0.3, 0.6, 0.9):
        pos = g.normal(1, 1, 3000)
        unl = np.r_[g.normal(1, 1, int(6000 * share)), g.normal(-2, 1, 6000 - int(6000 * share))]
        assert abs(pc.best_bin(pos, unl) - share) < 0.06

import random

import numpy as np
import pytest
import xxhash

from quarry.llm import queries, simhash_dedup as sd


def brute_fp(text, width=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    ws = [w for w in low.split(" ") if w]
    if not ws:
        return 0
    sh = [" ".join(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    x = np.array(fps, np.uint64)
    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= radius) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    best = {}
    for i in range(len(ids)):
        r = find(i)
        best[r] = min(best.get(r, ids[i]), ids[i])
    return [best[find(i)] for i in range(len(ids))]


def test_query_equals_brute_force(spark, sf):
    rows = {r.doc_id: r for r in queries.op7_simhash(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    ids = [d.doc_id for d in docs]
    fps = [brute_fp(d.text) for d in docs]
    comp = brute_components(ids, fps)
    assert len(rows) == len(docs)
    for i, f, c in zip(ids, fps, comp):
        assert rows[i].fingerprint == f"{f:016x}"
        assert rows[i].component_id == c


@pytest.mark.parametrize("direct", [8192, 3])
def test_links_of_planted_fingerprints(spark, monkeypatch, direct):
    """Chains, hubs and lone fingerprints; with small buckets the whole-ball way is taken."""
    monkeypatch.setattr(sd, "DIRECT", direct)
    rng = random.Random(5)
    fps = []
    for _ in range(25):
        at = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 3, 12])):
            fps.append(at)
            for b in rng.sample(range(64), rng.choice([1, 3, 4, 5])):
                at ^= 1 << b
    hub = rng.getrandbits(64)
    fps += [hub ^ (1 << b) for b in range(40)] + [0, (1 << 64) - 1, 1 << 63]
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "doc_id long, fp long")
    got = {r.fp: r.component_id for r in sd.classes(df, sd.Scratch(spark, "t")).collect()}
    want = brute_components(list(range(len(fps))), fps)
    assert [got[f - (1 << 64) if f >> 63 else f] for f in fps] == want


def test_runs_cross_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        fps = [1 << b for b in range(30)]
        df = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "doc_id long, fp long")
        assert {r.component_id for r in sd.classes(df, sd.Scratch(spark, "t")).collect()} == {0}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, " \t\n", "z"), (4, "Aa b", "q"), (5, "aA\tB", "q"), (5, "aA\tB", "q"), (None, "aa b", "q"), (9, "w " * 30000, "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = [(r.doc_id, r.component_id) for r in sd.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (5, 4), (None, 4), (9, 9)], key=str)
    kept = [r.doc_id for r in sd.deduplicate(df).collect()]
    assert sorted(kept, key=str) == [1, 4, 9, None]
    assert sd.deduplicate(df).columns == df.columns
    assert sd.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [256, 3])
def test_deduplicate_links_by_shingle_similarity(spark, monkeypatch, block):
    """Against all pairs by true similarity of five-word shingles, without a radius."""
    monkeypatch.setattr(sd, "BLOCK", block)
    rng = random.Random(8)
    docs, sets = [], []
    for _ in range(30):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([8, 60, 300]))]
        for n in (0, 0, 1, 2, 4, 8):
            ws = list(base)
            for _ in range(n * len(base) // 100 + (n > 0)):
                ws[rng.randrange(len(ws))] = f"x{rng.randrange(10**6)}"
            docs.append((len(docs), " ".join(ws)))
            sets.append({tuple(ws[i : i + 5]) for i in range(len(ws) - 4)})
    root, far = list(range(len(docs))), 0
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both / len(sets[i] | sets[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
                far += (brute_fp(docs[i][1], 5) ^ brute_fp(docs[j][1], 5)).bit_count() > sd.RADIUS
    assert far > 20
    got = {r.doc_id: r.component_id for r in sd.similar_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in docs] == root
    kept = sd.deduplicate(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root))


def test_fingerprints_alone_lead_to_links(spark, monkeypatch):
    """Without a key of minimum hashes the texts within RADIUS bits are candidates still, and are verified."""
    rng = random.Random(3)
    docs = []
    for _ in range(12):
        ws = [f"w{rng.randrange(10**6)}" for _ in range(600)]
        docs += [(len(docs) + k, " ".join(ws[: 600 - k])) for k in range(3)]
    fps = [brute_fp(t, 5) for _, t in docs]
    want = brute_components([i for i, _ in docs], fps)
    assert sum(i != c for (i, _), c in zip(docs, want)) > 15
    cut = sd.Scratch.cut

    def without_keys(self, df, name="t"):
        df = df.withColumn("keys", sd.F.array().cast("array<bigint>")) if name == "sketches" else df
        return cut(self, df, name)

    monkeypatch.setattr(sd.Scratch, "cut", without_keys)
    got = {r.doc_id: r.component_id for r in sd.similar_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in docs] == want

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import hard_negatives as hn
from quarry.llm import queries

SHAPE = "vec_id long, label int, vector array<long>, rid string, score string"


def brute(rows, every, positives=5, negatives=5, low=80, high=100):
    rows = [(i, lab, [int(x) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for n, (i, lab, v) in enumerate(rows):
        if i % every:
            continue
        best = sorted((-dot(v, w), j) for m, (j, other, w) in enumerate(rows) if other == lab and m != n)[:positives]
        for ps, j in best:
            fit = sorted((-dot(v, w), k) for k, other, w in rows if other != lab and low * -ps <= 100 * dot(v, w) <= high * -ps)[:negatives]
            out += [(i, j, r, k, -ps, -ns) for r, (ns, k) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, every, **more):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SHAPE)
    return sorted(map(tuple, hn.mine(df, F.col("vec_id") % every == 0, **more).collect()))


def clustered(seed=5, n=700, dim=6):
    """Clusters of any norm, with a third of the rows equal and many ties."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim)) * rng.integers(5, 60, (12, 1))
    rows = [(i, int(rng.integers(0, 4)), np.floor(centres[rng.integers(0, 12)] + rng.normal(size=dim) * 3).astype(int).tolist()) for i in range(n)]
    same = np.floor(centres[0]).astype(int).tolist()
    return [(i, lab, same if i % 3 == 0 else v) for i, lab, v in rows]


@pytest.mark.parametrize("group", [1024, 9])
def test_equals_all_pairs(spark, group, monkeypatch):
    """With one group, and with many, of which hot cells take several and blocks are split."""
    monkeypatch.setattr(hn, "BLOCK", 100)
    rows = clustered()
    assert mined(spark, rows, 7, group=group) == brute(rows, 7)


def test_bounds_leave_far_groups_out(spark):
    """Two far clusters: a candidate is sent to its own group alone."""
    rng = np.random.default_rng(2)
    rows = [(i, i // 2 % 2, (np.array([1000, 0] if i % 2 else [-1000, 0]) + rng.integers(-5, 6, 2)).tolist()) for i in range(400)]
    space = hn.Space(np.array([[1000, 0], [-1000, 0]]), 2, 1_010_100, True)
    batch = spark.createDataFrame([(i, i, int(lab), v, 0 if v[0] > 0 else 1) for i, lab, v in rows], "rid long, id long, label long, vec array<bigint>, cell int")
    out = batch.mapInArrow(hn._routes(space, {0: [0], 1: [1]}, {0: (0.0, 300.0), 1: (0.0, 300.0)}), "rid long, id long, label long, vec array<bigint>, groups array<int>")
    assert not [r for r in out.collect() if r["groups"]]
    assert mined(spark, rows, 10, group=20) == brute(rows, 10)


def test_odd_rows(spark):
    rows = [(0, 1, [3, 4]), (0, 1, [3, 4]), (1, 1, [3, 4]), (2, 2, [3, 4]), (3, 2, [3]), (4, 2, []), (None, 2, [3, 4]), (5, None, [3, 4]), (6, 2, None), (7, 1, [0, 0]), (-100, 2, [-3, -4]), (9, 2, [3, 4, 0])]
    assert mined(spark, rows, 100) == brute(rows, 100)
    assert mined(spark, [], 100) == []
    assert mined(spark, [(1, 1, [2])], 100) == []
    big = [(0, 1, [1 << 28]), (1, 1, [1 << 28]), (2, 2, [(1 << 28) - 1])]
    assert mined(spark, big, 100) == brute(big, 100) != []
    with pytest.raises(ValueError):
        mined(spark, [(0, 1, [1 << 40]), (1, 1, [1])], 100)


def test_query_on_odd_vectors(spark, sf, tmp_path):
    """Null labels and vectors, and components that are null or no numbers, take no part."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", "embedding")
    odd = spark.createDataFrame([(1000, None, [1.0] * 64), (1001, 1, None), (1002, 1, [None] * 64), (1100, 1, [float("nan")] * 64), (1200, 2, [float("inf")] * 64)], "vec_id long, label int, embedding array<float>")
    e.unionByName(odd.select("vec_id", F.col("label").cast(e.schema["label"].dataType).alias("label"), "embedding")).write.parquet(f"{tmp_path}/embeddings.parquet")
    order = ["anchor_id", "positive_id", "rank"]
    assert queries.op12_hard_negatives(spark, str(tmp_path)).orderBy(order).collect() == queries.op12_hard_negatives(spark, sf).orderBy(order).collect()

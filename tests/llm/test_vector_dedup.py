import numpy as np

from quarry.llm import queries, vector_dedup as vd


def brute(rows, cosine=0.98):
    """(id, n_links, component) per row, by all pairs."""
    n = len(rows)
    root, links = list(range(n)), [0] * n

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def ok(v):
        return v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)

    units = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok(v) and lab is not None else None for _, v, lab in rows]
    for i in range(n):
        for j in range(i + 1, n):
            if units[i] is None or units[j] is None or rows[i][2] != rows[j][2] or len(units[i]) != len(units[j]):
                continue
            if units[i] @ units[j] >= cosine:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    best = {}
    for i in range(n):
        best[find(i)] = min(best.get(find(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], links[i], best[find(i)]) for i in range(n))


def planted(seed=1, dim=24):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(60):
        at = rng.normal(size=dim)
        at /= np.linalg.norm(at)
        for _ in range(int(rng.choice([1, 2, 5, 30]))):
            rows.append([(at + rng.normal(size=dim) * rng.choice([0.0, 0.01, 0.02, 0.05])).tolist(), int(g % 3)])
    return [(i, v, lab) for i, (v, lab) in enumerate(rows)]


def test_equals_brute_force(spark, sf):
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in queries.op5_pivot_index(spark, sf).collect())
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert got == brute(rows)


def test_planted_groups_and_small_blocks(spark):
    """Groups of near and exact copies, compared over blocks of seven members."""
    rows = planted()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = brute(rows)
    for block in (1024, 7):
        got = sorted((r.vec_id, r.n_links, r.component_id) for r in vd.near_duplicates(df, block=block).collect())
        linked = sum(w[1] for w in want)
        assert sum(g[1] for g in got) >= 0.98 * linked
        assert all(g[1] <= w[1] for g, w in zip(got, want))
        if sum(g[1] for g in got) == linked:
            assert got == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1)]
    rows += [(8, [inf, 1.0], 1), (9, [None, 1.0], 1), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1.0, 0.0], 1), (12, [1.0, 0.0], 1), (13, [1e300, 1e-300], 2)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<double>, label int, n_links int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vd.near_duplicates(df).collect())
    lone = [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11)]
    assert got == sorted([(1, 3, 1, True), (2, 3, 1, False), (12, 3, 1, False), (12, 3, 1, False), (3, 1, 3, True), (13, 1, 3, False), *lone])
    assert vd.near_duplicates(df.limit(0)).count() == 0


def test_long_lists_are_divided_by_further_pivots(spark):
    """One dense group beside others: lists of one and two pivots overflow, and blocks of 40 take the rest."""
    rng = np.random.default_rng(5)
    at = rng.normal(size=16)
    rows = [(at + rng.normal(size=16) * 0.05).tolist() for _ in range(400)] + rng.normal(size=(300, 16)).tolist()
    rows = [(i, v, 0) for i, v in enumerate(rows)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = brute(rows)
    for block in (1024, 40):
        got = sorted((r.vec_id, r.n_links, r.component_id) for r in vd.near_duplicates(df, block=block).collect())
        assert sum(g[1] for g in got) >= 0.98 * sum(w[1] for w in want) > 100_000
        assert all(g[1] <= w[1] for g, w in zip(got, want))
        assert [g[2] for g in got] == [w[2] for w in want]


def test_many_vector_lengths(spark):
    rows = [(i, [1.0 + (i % 2) * 1e-9] * (1 + i // 3), 1) for i in range(3030)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {(r.vec_id, r.n_links, r.component_id) for r in vd.near_duplicates(df).collect()} == {(i, 2, i // 3 * 3) for i in range(3030)}

import numpy as np

from storyweft.llm import neighbours

SCHEMA = "item_id string, model_id string, dim int, vector array<double>, key string, vid int"


def brute(rows, k=5, low=0.85):
    out = set()
    for m in {r[1] for r in rows}:
        seen = {}
        for i, model, dim, v, *_ in rows:
            if model == m and v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v) and any(v):
                seen[i] = np.array(v) / np.linalg.norm(v)
        ids = sorted(seen)
        for a in ids:
            best = sorted(((-round(float(seen[a] @ seen[b]), 6), b) for b in ids if b != a))[:k]
            out |= {(m, *sorted((a, b))) for s, b in best if -s >= low}
    return out


def clustered(n, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 8, dim))
    return [(f"i{k:04}", "m" if k % 5 else "n", dim, (centres[rng.integers(len(centres))] + rng.standard_normal(dim) * rng.random() * 0.5).tolist(), "x", 1) for k in range(n)]


def run(spark, rows, **kw):
    return {tuple(r) for r in neighbours.similar_pairs(spark.createDataFrame(rows, SCHEMA), **kw).collect()}


def test_recall(spark):
    rows = clustered(600)
    true, found = brute(rows), run(spark, rows)
    assert len(true & found) >= 0.97 * len(true)
    assert len(found - true) <= 0.03 * len(true)


def test_crowded_buckets_are_split(spark):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(16)
    rows = [(f"d{k:04}", "m", 16, (centre + rng.standard_normal(16) * 0.15).tolist(), "x", 1) for k in range(400)] + clustered(200)
    true, found = brute(rows), run(spark, rows, bucket_limit=30)
    assert len(true & found) >= 0.95 * len(true) and len(found - true) <= 0.05 * len(true)


def test_dirty_rows_and_ties(spark):
    v = [1.0, 2.0, 0.0, 1.0]
    rows = [(f"c{i}", "m", 4, v, "x", 1) for i in range(9)]
    rows += [("c0", "m", 4, v, "y", 2), ("d", "m", 4, [2.0, 4.0, 0.0, 2.0], "x", 1), ("n1", "m", 4, None, "x", 1), ("n2", "m", 4, [0.0] * 4, "x", 1), ("n3", "m", 4, [float("nan"), 1.0, 1.0, 1.0], "x", 1)]
    rows += [("n4", "m", 5, v, "x", 1), ("n5", "m", 4, [1.0, None, 1.0, 1.0], "x", 1), ("other", "k", 4, v, "x", 1), (None, "m", 4, v, "x", 1), ("n6", None, 4, v, "x", 1)]
    assert run(spark, rows) == brute([r for r in rows if r[0] and r[1]])


def test_empty(spark):
    assert run(spark, []) == set()
    assert run(spark, [("a", "m", 2, [1.0, 0.0], "x", 1)]) == set()


def test_probe_order_starts_with_the_closest_border():
    sets = neighbours.probe_order(6, 20)
    assert sets[0] == (0,) and len(set(sets)) == 20
    assert all(11 - x not in s for s in sets for x in s)


def test_one_crowded_group_keeps_its_neighbours(spark):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(32)
    centre /= np.linalg.norm(centre)
    rows = [(f"d{k:04}", "m", 32, (centre + rng.standard_normal(32) * 0.04).tolist(), "x", 1) for k in range(1500)]
    true, found = brute(rows), run(spark, rows, bucket_limit=60)
    assert len(true & found) >= 0.98 * len(true)


def test_crowded_buckets_are_compared_in_full(spark):
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(16)
    centre /= np.linalg.norm(centre)
    tight = [(f"d{k:04}", "m", 16, (centre + rng.standard_normal(16) * 0.002).tolist(), "x", 1) for k in range(700)]
    loose = [(f"e{k:04}", "m", 16, (centre + rng.standard_normal(16) * 0.08).tolist(), "x", 1) for k in range(300)]
    # one direction in different lengths: equal cosines, so the item ids decide
    alike = [(f"f{k:04}", "m", 16, (centre * (k + 1)).tolist(), "x", 1) for k in range(100)]
    rows = tight + loose + alike + clustered(100)
    true = brute(rows)
    inside = {r[0] for r in tight + alike}
    for block_rows in (90, 1000):
        found = run(spark, rows, bucket_limit=60, block_rows=block_rows)
        part = lambda pairs: {p for p in pairs if p[1] in inside and p[2] in inside}
        assert part(found) == part(true)
        assert len(true & found) >= 0.99 * len(true) and len(found - true) <= 0.01 * len(true)


def test_the_best_of_blocks():
    rng = np.random.default_rng(4)
    x = np.round(rng.standard_normal((400, 3)), 1) + 0.05
    x /= np.linalg.norm(x, axis=1)[:, None]
    vid, rank = np.arange(400) + 7, rng.permutation(400)
    best = neighbours._Best(x, vid, 6, 0.9)
    for at in range(0, 400, 150):
        best.add(x[at : at + 150], vid[at : at + 150], rank[at : at + 150])
    got = best.rows().to_pandas()
    true = set()
    for i in range(400):
        order = sorted((-c, rank[j], j) for j, c in enumerate(np.round(x @ x[i], 6)) if j != i and c >= 0.9)[:6]
        true |= {(i + 7, j + 7, -c) for c, _, j in order}
    assert set(got.itertuples(index=False, name=None)) == true

import numpy as np

from latticeworks.llm import ann


def table(spark, vectors):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in vectors], "vec_id long, embedding array<float>, list string, chunk int")


def brute(vectors, every, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in vectors if v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, a in good:
        if q % every == 0:
            scored = sorted((-float(a @ b) / float(np.sqrt(a @ a) * np.sqrt(b @ b)), i) for i, b in good if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_all_lists_probed_is_exact(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=24).tolist()) for i in range(300)]
    vectors += [(300, None), (301, [0.0] * 24), (302, [float("nan")] * 24), (303, [None] + [1.0] * 23), (304, vectors[4][1]), (305, vectors[4][1]), (306, [1.0] * 7)]
    got = {}
    for r in ann.nearest(table(spark, vectors), every=10, k=5, lists=4, probes=4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute(vectors[:-1], 10, 5)
    assert set(got) == set(want)
    for q, rows in got.items():
        rows.sort()
        assert [i for _, i, _ in rows] == [i for i, _ in want[q]]
        assert np.allclose([s for _, _, s in rows], [s for _, s in want[q]], atol=1e-12)


def test_recall_of_probed_lists(spark):
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(8, 32))
    vectors = [(i, (centers[i % 8] + 0.8 * rng.normal(size=32)).tolist()) for i in range(1500)]
    got = {}
    for r in ann.nearest(table(spark, vectors), every=20).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute(vectors, 20, 5)
    assert np.mean([len(got[q] & {i for i, _ in w}) / 5 for q, w in want.items()]) >= 0.9


def test_small_tables(spark):
    assert ann.nearest(table(spark, [])).count() == 0
    assert ann.nearest(table(spark, [(0, [1.0, 2.0])])).count() == 0
    rows = ann.nearest(table(spark, [(0, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0])])).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in rows] == [(1, 2), (2, 3)]


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x, q = ann.unit(rng.normal(size=(2000, 64))), ann.unit(rng.normal(size=(20, 64)))
    c = np.zeros((1, 64))
    turn = ann.rotation(64, 1)
    _, code, length, fit, along = ann.encode(x, c, turn)
    value, error = ann.estimate(q, code, length, fit, along, c[0], turn)
    assert (np.abs(value - q @ x.T) <= error).mean() > 0.97


def test_commonest_dimension_counts(spark):
    """One odd vector that comes first takes no part and hides nothing."""
    rng = np.random.default_rng(5)
    vectors = [(0, [1.0, 2.0, 3.0]), (1, [float("inf"), 1.0])] + [(i, rng.normal(size=2).tolist()) for i in range(2, 200)]
    got = ann.nearest(table(spark, vectors).coalesce(1), every=10).collect()
    want = brute(vectors[2:], 10, 5)
    assert {r["query_id"] for r in got} == set(want) and len(got) == 5 * len(want)


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [0.9, 0.1]), (2, [0.1, 0.9])]
    got = sorted((r["rank"], r["vec_id"], round(r["score"], 3)) for r in ann.nearest(table(spark, rows), k=1).collect())
    assert got == [(1, 1, 0.994), (1, 2, 0.994)]


def test_probes_follow_the_data():
    rng = np.random.default_rng(8)
    for spread, most in ((0.05, 4), (10.0, 40)):
        x = ann.unit(np.repeat(rng.normal(size=(200, 16)), 20, axis=0) + spread * rng.normal(size=(4000, 16)))
        centroids = ann.fit_centroids(x, ann.list_count(len(x)), 7)
        assert 1 <= ann.probes_for(x, centroids, 5) <= most and len(centroids) == 32
    assert ann.list_count(4_000_000) == 1000

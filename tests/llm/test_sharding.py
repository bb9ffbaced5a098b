from collections import Counter

import numpy as np

from latticeworks.llm import sharding


def chi_square(counts, n):
    expected = sum(counts.values()) / n
    return sum((counts.get(k, 0) - expected) ** 2 / expected for k in range(n))


def test_law_and_slots(docs):
    rows = sharding.hypergeometric_shards(docs, 7).collect()
    assert len(rows) == docs.count()
    per = Counter(r["shard"] for r in rows)
    assert max(per.values()) - min(per.values()) <= 1 and set(per) <= set(range(7))
    for s in per:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(per[s]))
    assert {r["key"] for r in rows} == {"k"}


def test_buckets_inside_a_shard(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 10)
    rows = sharding.hypergeometric_shards(spark.range(500).repartition(6), 3).collect()
    for s in range(3):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))


def test_matrix_sums_and_law():
    m = sharding.communication_matrix([5, 0, 17, 8], [10, 10, 10], 3)
    assert m.sum(axis=1).tolist() == [5, 0, 17, 8] and m.sum(axis=0).tolist() == [10, 10, 10]
    big = sharding.communication_matrix([2 * 10**9, 10**9], [15 * 10**8, 15 * 10**8], 1)
    assert big.sum(axis=1).tolist() == [2 * 10**9, 10**9] and abs(big[0, 0] - 10**9) < 10 * 30_000
    rng = np.random.default_rng(0)
    draws = [sharding.hypergeometric(rng, 600_000_000, 900_000_000, 10**9) for _ in range(300)]
    mean, spread = 4e8, (1e9 * 0.4 * 0.6 * (5e8 / 1.5e9)) ** 0.5
    assert abs(np.mean(draws) - mean) < 5 * spread / 300**0.5 and 0.8 < np.std(draws) / spread < 1.2


def test_large_draws_follow_the_law(monkeypatch):
    """The own sampler over small urns against exact probabilities, in each of its ways."""
    import math

    monkeypatch.setattr(sharding, "LIBRARY_ROWS", 0)
    rng, n = np.random.default_rng(4), 20_000
    for good, bad, draws in ((300, 500, 240), (500, 300, 240), (300, 500, 600), (30, 900, 100), (7, 20, 9), (400, 900, 70), (2, 3, 5)):
        counts = Counter(sharding.hypergeometric(rng, good, bad, draws) for _ in range(n))
        law = {k: math.comb(good, k) * math.comb(bad, draws - k) / math.comb(good + bad, draws) for k in range(max(0, draws - bad), min(good, draws) + 1)}
        assert set(counts) <= set(law)
        often = [k for k in law if law[k] * n >= 20]
        off = sum((counts[k] - law[k] * n) ** 2 / (law[k] * n) for k in often)
        assert off < len(often) + 5 * (2 * len(often)) ** 0.5 + 5, (good, bad, draws, off)


def test_probabilities_of_large_urns_are_relative():
    import math

    for a, m in ((10**12, 900), (10**9, 500), (64, 40), (5, 3), (10**13, 1000)):
        exact = math.fsum(math.log(a + i) for i in range(m))
        assert abs(sharding._log_gamma_step(a, m) - exact) < 1e-7 and abs(sharding._log_gamma_step(a + m, -m) + exact) < 1e-7
    good, bad, draws = 4 * 10**12, 6 * 10**12, 10**12
    mode = (draws + 1) * (good + 1) // (good + bad + 2)
    for m in (1, 50, 1000, -1000):
        steps = range(mode, mode + m) if m > 0 else range(mode + m, mode)
        exact = math.fsum(math.log((good - k) / (k + 1)) + math.log((draws - k) / (bad - draws + k + 1)) for k in steps) * (1 if m > 0 else -1)
        assert abs(sharding._log_ratio(mode + m, mode, good, bad, draws) - exact) < 1e-7


def test_query(spark, tmp_path):
    import zlib

    rows = [(k, t, 0, 1) for k, t in enumerate([None, "", "é" * 40, "same", "same", *("x" * j for j in range(90))])] + [(None, "same", 0, 1), (3, "y", 0, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, size int, slot long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = sharding.op8_sharding(spark, str(tmp_path)).collect()
    own = lambda t: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in out), key=str) == sorted(((i, *own(t)) for i, t, *_ in rows), key=str)
    per = {s: sorted(r["slot"] for r in out if r["shard"] == s) for s in range(40)}
    assert all(v == list(range(len(v))) and len(v) in (2, 3) for v in per.values()) and {(r["law"], r["grown_shard"]) for r in out} == {("rows", None)}


def test_uniform_over_seeds(spark):
    base = spark.range(60).repartition(4)
    where = [r["shard"] for seed in range(8) for r in sharding.hypergeometric_shards(base, 4, seed=seed).where("id = 11 or id = 40").collect()]
    assert len(set(where)) > 1 and chi_square(Counter(where), 4) < 16


def test_empty(empty):
    assert sharding.hypergeometric_shards(empty, 5).count() == 0

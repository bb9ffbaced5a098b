import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from latticeworks.llm import periodic


def plain_runs(w, least=24, times=3):
    """Every stretch with every period, kept if no smaller period holds it and no neighbour extends it."""
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, times * q) and not any(all(w[k] == w[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def report(doc_id, text):
    """The contract's columns in plain Python."""
    words = (text or "").encode().split()
    if doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    dropped = {k for s, length, q in runs for k in range(s + q, s + length)}
    kept = b" ".join(w for k, w in enumerate(words) if k not in dropped)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else None
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_every_period_tried(seed):
    rng = random.Random(seed)
    for _ in range(60):
        w = []
        while len(w) < rng.randrange(0, 260):
            part = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(1, 40))]
            w += part * rng.randrange(1, 7) + part[: rng.randrange(len(part) + 1)]
        for least, times in ((24, 3), (3, 3), (7, 4), (60, 3)):
            assert [tuple(r) for r in periodic.runs_of(np.array(w, np.int64), least, times)] == plain_runs(w, least, times), (w, least, times)


def test_repeats_of_all_sizes_end_soon():
    rng = np.random.default_rng(2)
    for w in (np.zeros(200_000, np.int64), np.tile(np.arange(50_000), 4), np.tile(rng.integers(0, 2, 777), 300), rng.integers(0, 2, 200_000)):
        runs = periodic.runs_of(w, 24, 3)
        for s, length, q in runs.tolist()[:50]:
            assert (w[s : s + length - q] == w[s + q : s + length]).all() and length >= max(24, 3 * q)
    assert periodic.runs_of(np.tile(np.arange(50_000), 4), 24, 3).tolist() == [[0, 200_000, 50_000]]
    with pytest.raises(ValueError):
        periodic.runs_of(np.zeros(10, np.int64), 24, 2)


def corpus():
    rng = random.Random(8)
    out = [(None, "a b " * 30), (None, None), (1, ""), (2, " \t\n"), (3, "x " * 24), (4, "x " * 23), (4, "x\ty\nz " * 9), (5, "é ü " * 20 + " a a"), (6, "A a " * 15)]
    for i in range(7, 260):
        words = [f"w{rng.randrange(rng.choice([3, 400]))}" for _ in range(rng.randrange(1, 300))]
        if i % 4 == 0:
            k = rng.randrange(1, 30)
            words[10:10] = words[:k] * 5
        out.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    return out


def test_query(spark, tmp_path):
    rows = [(i, t, 1, "r", 2) for i, t in corpus()]
    spark.createDataFrame(rows, "doc_id long, text string, words int, runs string, a long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = periodic.op12_periodic_runs(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for c, t in out.dtypes if not c.endswith("sha256")} == {"bigint"}
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(((i, *report(i, t)) for i, t in corpus()), key=key)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in corpus()) > 10


def test_operator_gives_runs_and_texts(spark, empty):
    docs = spark.createDataFrame([(1, "go " + "a b c " * 8 + "end"), (2, "plain  words")], "doc_id long, text string")
    first, second = sorted(periodic.periodic_runs(docs).collect())
    assert (first.n_words, [tuple(r) for r in first.runs], first.collapsed) == (26, [(1, 24, 3)], "go a b c end")
    assert (second.n_words, second.runs, second.collapsed) == (2, [], "plain words")
    assert periodic.run_report(periodic.periodic_runs(periodic.planted(empty))).count() == 0

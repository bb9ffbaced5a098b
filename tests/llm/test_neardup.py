import itertools
import re

import numpy as np
import pytest

from latticeworks.llm import neardup


def sets(texts, size=5):
    out = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        out[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    return out


def components(texts, percent):
    s = sets(texts)
    label = {i: i for i in texts}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        x = len(s[a] & s[b])
        if x and 100 * x >= percent * (len(s[a]) + len(s[b]) - x):
            ra, rb = root(a), root(b)
            label[max(ra, rb)] = min(ra, rb)
    return {i: (len(s[i]), root(i)) for i in texts}


@pytest.mark.parametrize("percent", [80, 85])
def test_equals_brute_force(docs, texts, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs, percent).collect()}
    assert got == components(texts, percent)


def test_crowded_bucket(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = [f"t{k}" for k in range(140)]
    texts = {}
    for i in range(60):
        w = list(base)
        for k in rng.choice(140, int(rng.integers(1, 5)), replace=False):
            w[k] = f"x{i}y{k}"
        texts[i] = " ".join(w)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, 85).collect()}
    assert got == components(texts, 85)


def test_estimate_is_unbiased():
    rng = np.random.default_rng(0)
    shared, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (800, 100, 100))
    elements = np.concatenate([np.sort(np.concatenate([shared, a])), np.sort(np.concatenate([shared, b]))])
    estimates = []
    for salt in range(20):
        sig = neardup.superminhash(elements ^ np.uint64(salt * 977), np.array([0, 900, 1800]))
        estimates.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(estimates) - 0.8) < 0.02


def test_empty_and_repeated_rows(spark, empty):
    assert neardup.near_duplicates(empty).count() == 0
    df = spark.createDataFrame([(4, "a b c d e f"), (4, "a b c d e f"), (2, "A b  c d e f"), (None, ""), (9, None)], "doc_id long, text string")
    rows = sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect())
    assert rows == [("2", 2, True), ("4", 2, False), ("4", 2, False), ("9", 9, True), ("None", None, True)]


def test_repeated_and_null_ids_keep_their_links(spark):
    x, y = (" ".join(f"{w}{k}" for k in range(80)) for w in "xy")
    rows = [(1, x), (1, y), (5, x + " z"), (6, y + " z"), (None, x + " q"), (None, "other " * 3), (None, "OTHER " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (5, 1), (6, 1), (None, 1), (None, None), (None, None)], key=str)

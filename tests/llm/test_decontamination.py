import re

import numpy as np

from latticeworks.llm import decontamination


def tokens(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(texts, items, width=10):
    out = {}
    for i, t in texts.items():
        w, hit, found = tokens(t), set(), set()
        for item, text in items:
            q = tokens(text)
            size = min(width, len(q))
            for k in range(len(q) - size + 1) if size else ():
                for s in range(len(w) - size + 1):
                    if w[s : s + size] == q[k : k + size]:
                        hit |= set(range(s, s + size))
                        found.add(str(item))
        out[i] = (len(w), len(hit), sorted(found))
    return out


def test_equals_brute_force(spark, docs, texts):
    long = next(t for t in texts.values() if t and len(t.split()) > 60)
    items = [(1, " ".join(long.split()[5:30])), (2, "TWO Words"), (3, None), (4, "...") , (5, "no such phrase in there at all of course never"), (10, " ".join(long.split()[20:32])), (7, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontamination.contamination(docs, bench).collect()}
    assert got == brute(texts, items)


def test_batches_and_proximity(spark, docs, texts, monkeypatch):
    items = [(k, " ".join((texts[5 + k] or "").split()[:12])) for k in range(6)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontamination, "BATCH_WORDS", 30)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontamination.contamination(docs, bench).collect()}
    assert got == brute(texts, items)
    near = spark.createDataFrame([(1, "alpha beta x gamma")], "doc_id long, text string")
    what = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    assert not decontamination.contamination(near, what).first()["contaminated"]
    assert decontamination.contamination(near, what, slop=1).first()["contaminated"]


def test_empty(spark, empty, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(empty, none).count() == 0
    assert decontamination.contamination(docs, none).where("contaminated").count() == 0


def test_many_terms_in_a_block(spark):
    """70,000 distinct benchmark words in one block: no hit is lost, and words in another order are none."""
    ws = [f"v{k}" for k in range(70_000)]
    docs = spark.createDataFrame([(1, " ".join(ws)), (2, " ".join(reversed(ws))[:400_000])], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(1, " ".join(ws))], "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in decontamination.contamination(docs, bench).collect()}
    assert got[1] == (70_000, 70_000) and got[2][1] == 0


def test_lists_hold_what_they_were_given():
    rng = np.random.default_rng(3)
    for n_terms, n_docs in ((70_000, 3), (5, 70_000), (40_000, 70_000), (1, 1)):
        rows = np.unique(np.stack([rng.integers(0, n_terms, 90_000), rng.integers(0, n_docs, 90_000), rng.integers(0, 50, 90_000)], axis=1), axis=0)
        term, sizes = np.unique(rows[:, 0], return_counts=True)
        lists = decontamination._Lists(term, sizes, rows[:, 1].astype(np.int32), rows[:, 2].astype(np.int32))
        probe = np.stack([rng.integers(0, len(term), 90_000), rows[rng.integers(0, len(rows), 90_000), 1], rng.integers(-3, 60, 90_000)], axis=1)
        held = np.stack([np.searchsorted(term, rows[:, 0]), rows[:, 1], rows[:, 2]], axis=1)
        probe[: len(held) // 2] = held[: len(held) // 2]
        known = set(map(tuple, held.tolist()))
        assert lists.holds(*probe.T).tolist() == [tuple(x) in known for x in probe.tolist()]


def test_ids_come_back_as_they_are(spark):
    """Null, negative and large ids in one batch, repeated rows, and several indexes."""
    phrase = " ".join(f"p{k}" for k in range(12))
    rows = [(None, phrase), (2**60 + 1, "x " + phrase), (-1, phrase), (5, "clean words"), (5, "clean words"), (-1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(1, phrase)], "item_id long, text string")
    got = sorted(((r["doc_id"], r["n_hit"]) for r in decontamination.contamination(df, bench).collect()), key=str)
    assert got == sorted([(None, 12), (2**60 + 1, 12), (-1, 12), (5, 0), (5, 0), (-1, 0)], key=str)


def test_several_indexes(spark, docs, texts, monkeypatch):
    items = [(k, " ".join((texts[5 + k] or "").split()[:12])) for k in range(8)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontamination, "BATCH_WORDS", 30)
    monkeypatch.setattr(decontamination, "INDEX_TERMS", 40)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontamination.contamination(docs, bench).collect()}
    assert got == brute(texts, items)


def test_many_terms_in_one_document(spark):
    words = [f"t{k}" for k in range(70_000)]
    df = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(words[100 * k : 100 * k + 100])) for k in range(700)], "item_id long, text string")
    row = decontamination.contamination(df, bench).first()
    assert row["n_hit"] == 70_000 and len(row["items"]) == 700

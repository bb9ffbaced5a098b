import hashlib
import random
from collections import Counter

import pytest

from latticeworks.llm import suffix_dedup


def brute(texts, length):
    bodies = {i: (t or "").encode() for i, t in texts.items()}
    seen = Counter(b[k : k + length] for b in bodies.values() for k in range(len(b) - length + 1))
    out = {}
    for i, b in bodies.items():
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("shard", "heavy"), [(60_000, 10_000), (60_000, 20), (2, 10_000), (2, 20)])
def test_equals_brute_force(spark, docs, texts, monkeypatch, shard, heavy):
    monkeypatch.setattr(suffix_dedup, "HEAVY", heavy)  # 20: most names are shuffled, some are told to every task
    monkeypatch.setattr(suffix_dedup, "SHARD", shard)  # 2: every frequent context is split
    rows, lost = suffix_dedup.repeated_spans(docs, 400)
    removed = {r["rid"]: r for r in lost.collect()}
    want = brute(texts, 400)
    for r in rows.collect():
        body = bytes(r["body"])
        got = removed.get(r["rid"])
        found = (len(body), got["removed"], got["n_spans"], got["kept_sha256"]) if got else (len(body), 0, 0, hashlib.sha256(body).hexdigest())
        assert found == want[r["doc_id"]], r["doc_id"]


def test_empty_and_short_length(empty):
    rows, lost = suffix_dedup.repeated_spans(empty, 400)
    assert rows.count() == 0 and lost.count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.repeated_spans(empty, 60)


def test_shorter_passages_are_counted_beside(spark, docs, texts):
    """Passages of 50 to 80 words count from 256 bytes on; what is removed stays that of 400 bytes."""
    rng = random.Random(3)
    passages = [" ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(n)) for n in (52, 60, 75)]
    own = lambda: " ".join("".join(rng.choices("ijklmnop", k=6)) for _ in range(40))
    planted = {1000 + k: f"{own()} {p} {own()}" for k, p in enumerate(passages * 2)}
    every = texts | planted | {2000 + k: own() for k in range(3)}
    source = spark.createDataFrame(list(every.items()), "doc_id long, text string").repartition(4)
    rows, found = suffix_dedup.repeated_spans(source, 400, passage=256)
    got = {r["doc_id"]: r for r in rows.join(found, "rid").collect()}
    long, short = brute(every, 400), brute(every, 256)
    for i in every:
        assert (got[i]["removed"] if i in got else 0) == long[i][1], i
        assert (got[i]["passages"] if i in got else 0) == short[i][1], i
    assert all(got[i]["passages"] > 0 for i in planted)


def test_repeated_rows_and_a_very_long_text(spark):
    long = "".join(random.Random(1).choices("abcdefghijklmnop", k=1_200_000))
    source = spark.createDataFrame([(1, "x" * 500), (1, "x" * 500), (None, long + long[:1000]), (None, None)], "doc_id long, text string")
    rows, found = suffix_dedup.repeated_spans(source, 400)
    removed = sorted(r["removed"] for r in found.collect())
    assert rows.count() == 4 and removed == [500, 500, 2000]

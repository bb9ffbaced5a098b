import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from latticeworks.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def v():
    return alignment.vocabularies(A, B)


def spans(sizes):
    at, out = 0, []
    for s in sizes:
        out.append((at, at + s))
        at += s
    return out


def plain(v, texts):
    """The contract's columns by comparing every token of A with every token of B."""
    rows, links = {}, {}
    for i, t in texts.items():
        raw = (" " + (t or "")).encode()
        a = v.a.encode(" " + t, add_special_tokens=False).ids if t else []
        b = v.b.encode(t) if t else []
        if b"".join(v.a_bytes[x] for x in a) != raw or b"".join(v.b_bytes[x] for x in b) != raw:
            a, b = [], []
        sa, sb = spans([len(v.a_bytes[x]) for x in a]), spans([len(v.b_bytes[x]) for x in b])
        links[i] = []
        for x, (s, e) in zip(a, sa, strict=True):
            links[i] += [(x, y) for y, (s2, e2) in zip(b, sb, strict=True) if max(s, s2) < min(e, e2)]
        ends = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, before = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(x) for x, (s, e) in zip(ids, sp, strict=True) if before <= s and e <= end) for ids, sp in ((a, sa), (b, sb))))
            before = end
        rows[i] = [len(a), len(b), len(ends), len(links[i]), ";".join(groups)]
    n = Counter(p for own in links.values() for p in own)
    most = {}
    for (_, y), k in n.items():
        most[y] = max(most.get(y, 0), k)
    return {i: (*r, sum(n[p] == most[p[1]] for p in links[i]), sum(n[p] for p in links[i])) for i, r in rows.items()}


def texts():
    rng = random.Random(3)
    letters = "aeinrst  .,\n'é漢🙂0-A"
    out = [None, "", " ", "  two  spaces ", "<|endoftext|> and </s><s>", "under▁score", "line\n\nline", "naïve café", "\x00\x01", "aaaaaaaaaaaaaaaa", "don't we'll", "ﬁ 　 wide", "x\t\ty"]
    out += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 120))) for _ in range(40)]
    return dict(enumerate([*out, out[20], out[20]]))


def got(df):
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups, r.n_best, r.count_sum) for r in df.collect()}


def test_equal_to_all_pairs_of_tokens(spark, v, monkeypatch):
    t = texts()
    rows = spark.createDataFrame([(i, x, "r", 1, "g") for i, x in t.items()], "doc_id long, text string, rid string, n_a int, groups string").repartition(3)
    expected = plain(v, t)
    assert got(alignment.link_totals(alignment.aligned(rows, A, B), A, B)) == expected
    assert sum(e[0] for e in expected.values()) > 500 and expected[5][0] == 0 and expected[4][0] > 0
    monkeypatch.setattr(alignment, "SHARE", 2.0)  # no pair is frequent: irregular ones all go through the join
    assert got(alignment.link_totals(alignment.aligned(rows, A, B), A, B)) == expected


def test_pair_counts(spark, v):
    t = texts()
    counts = alignment.pair_counts(alignment.aligned(spark.createDataFrame(list(t.items()), "doc_id long, text string"), A, B), A, B)
    links = Counter()
    for x in t.values():
        if x:
            raw, (a, _, b, _) = (" " + x).encode(), v.encode([x])
            sa, sb = spans([len(v.a_bytes[k]) for k in a]), spans([len(v.b_bytes[k]) for k in b])
            assert not len(a) or sa[-1][1] == len(raw)
            links.update((int(p), int(q)) for p, (s, e) in zip(a, sa, strict=True) for q, (s2, e2) in zip(b, sb, strict=True) if max(s, s2) < min(e, e2))
    size = len(v.b_bytes)
    assert {(r.key // size, r.key % size): r.n for r in counts.collect()} == dict(links)


def test_words_give_the_tokens_of_the_whole(v, monkeypatch):
    rng = random.Random(4)
    gaps = ["", "", " ", "  ", "\n", "\t ", " \n ", "\u00a0 ", "\u3000"]
    long = " ".join("".join(rng.choice("abcdeéTH漢🙂.'-1") for _ in range(rng.randrange(1, 9))) + rng.choice(gaps) for _ in range(3000))
    assert v.cuttable and len(v.words(long)) > 1500 and "".join(v.words(long)) == " " + long
    for text in (long, "x" * 5000, "  lead", "trail  ", "don't  we'll 've"):
        a, _, b, _ = v.encode([text])
        assert a.tolist() == v.a.encode(" " + text, add_special_tokens=False).ids and b.tolist() == v.b.encode(text)
    before = v.encode([long, "", "again"])
    monkeypatch.setattr(alignment, "WORDS", 10)  # forget the words and learn them anew
    assert all((x == y).all() for x, y in zip(before, v.encode([long, "", "again"]), strict=True))


def test_same_bytes(v):
    known = [(a, b) for a, b in enumerate(v.same.tolist()) if b >= 0]
    assert len(known) > 10_000 and all(v.a_bytes[a] == v.b_bytes[b] for a, b in known)
    assert all(v.same[v.a.token_to_id(w)] == v.b.piece_to_id("▁" + w[1:]) for w in ("Ġthe", "Ġof"))


def test_ids_null_and_repeated_and_empty(spark, v):
    rows = spark.createDataFrame([(None, "one two"), (None, None), (4, "one two"), (4, "three")], "doc_id long, text string")
    out = alignment.link_totals(alignment.aligned(rows, A, B), A, B).collect()
    assert sorted((r.doc_id is None, r.n_a) for r in out) == [(False, 1), (False, 2), (True, 0), (True, 2)]
    none = alignment.link_totals(alignment.aligned(rows.limit(0), A, B), A, B)
    assert none.count() == 0 and none.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]


def test_query(spark, tmp_path):
    t = texts()
    spark.createDataFrame(list(t.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = plain(alignment.vocabularies(A, B), t)
    digest = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    out = alignment.op11_alignment(spark, str(tmp_path))
    assert {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum) for r in out.collect()} == {i: (*e[:4], digest(e[4]), *e[5:]) for i, e in expected.items()}
    assert dict(out.dtypes) | {"doc_id": "bigint"} == {c: "string" if c == "groups_sha256" else "bigint" for c in out.columns}
    assert out.where(F.col("count_sum") < F.col("n_links")).isEmpty()


class Counting:
    """A tokenizer that notes how many texts it is asked for."""

    def __init__(self, inner):
        self.inner, self.texts = inner, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.inner.encode_batch_fast(texts, **options)


def test_new_words_are_encoded_together_and_aligned_once(monkeypatch):
    v, rng = alignment.Vocabularies(A, B), random.Random(5)
    own = ["".join(rng.choice("abcdeéTH漢.'1") for _ in range(9)) for _ in range(3000)]
    texts = [" ".join(own), " ".join(own[::-1]), " ".join(own[:5] * 200)]
    monkeypatch.setattr(v, "a", Counting(v.a))
    v.encode(texts)
    assert 0 < v.a.texts <= 3
    monkeypatch.setattr(v, "a", v.a.inner)
    v._forget()
    seen, plainly = [], alignment.align
    monkeypatch.setattr(alignment, "align", lambda v, *x: seen.append(len(x[1])) or plainly(v, *x))
    made = alignment._documents(v, texts)
    assert sum(seen) == len(set(own)) and made["n_a"].to_pylist()[:2] == [sum(len(v.a.encode(" " + w).ids) for w in own)] * 2
    expected = plain(v, {0: " ".join(own[:40])})[0]
    few = alignment._documents(v, [" ".join(own[:40])])
    assert [few[c][0].as_py() for c in ("n_a", "n_b", "n_groups", "n_links", "groups")] == list(expected[:5])


def test_any_white_space_between_words(v):
    rng = random.Random(6)
    spaces = [" ", " ", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", " ", "᠎", " ", " ", "​", " ", "　", "﻿"]
    letters = [*"abTH01.,'!é漢🙂\x00́", "'s", "the", "</s>", "<|endoftext|>"]
    some = ["".join(rng.choice(spaces if rng.random() < 0.35 else letters) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    a, a_at, b, b_at = v.encode(some)
    for i, t in enumerate(some):
        assert a[a_at[i] : a_at[i + 1]].tolist() == v.a.encode(" " + t, add_special_tokens=False).ids, repr(t)
        assert b[b_at[i] : b_at[i + 1]].tolist() == v.b.encode(t), repr(t)


def test_a_word_that_is_not_spelled_beside_others(v):
    own = [f"w{i}x" for i in range(2500)]
    own[1700] = "q▁q"
    v._forget()
    whole, cut, other = (v.encode([" ".join(words)]) for words in (own, own[:1700], own[1701:]))
    assert not len(whole[0]) and not len(whole[2])
    for words, (a, _, b, _) in ((own[:1700], cut), (own[1701:], other)):
        assert a.tolist() == v.a.encode(" " + " ".join(words), add_special_tokens=False).ids and b.tolist() == v.b.encode(" ".join(words))


def test_halves_find_the_words_that_ids_do_not_spell():
    v = alignment.Vocabularies(A, B)
    own = [f"w{'abcdefgh'[i % 8]}{i}" for i in range(2000)]
    expected = [len(v.a.encode(" " + w, add_special_tokens=False).ids) for w in own]
    v.b_bytes[v.b.piece_to_id("7")] = b"?"
    a, at, _, _ = v.encode(own)
    assert [j - i for i, j in zip(at, at[1:])] == [0 if "7" in w else n for w, n in zip(own, expected)]

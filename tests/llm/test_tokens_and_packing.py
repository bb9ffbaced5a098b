import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from latticeworks.llm import packing, textbytes, token_counts
from latticeworks.llm.word_tokens import WordTokens

ODD = ["It's they're we'll 'tis ''s don't!'s x'", "a1b22 ½ 3.5", "ÀÉ ß straße Å", "日本語 text", "<|endoftext|> <|startoftext|>", "a<|endoftext|>b <| x", "<|ENDOFTEXT|>", "tab\tnew\nline nbsp", "İstanbul İ", "é combining", "!!!???...", "'", "l'll'd"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.vocabulary())


def test_word_tokens_equal_the_tokenizer(tokenizer, texts):
    own = WordTokens(packing.vocabulary())
    every = [t or "" for t in texts.values()] + ODD
    raw = [t.encode() for t in every]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])
    for t, ids in zip(every, own.encode(data, offsets), strict=True):
        assert ids.tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t[:60]


def test_packing_round_trip(docs, texts, tokenizer):
    rows = packing.pack_documents(docs, max_tokens=256).collect()
    ids = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in texts.items()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]) == r["ids_crc32"]
        by_doc.setdefault(r["doc_id"], []).append(r["length"])
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert {i: sum(v) for i, v in by_doc.items()} == {i: len(v) for i, v in ids.items()}
    for spans in by_sequence.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
        assert sum(n for _, n in spans) <= 256
    total = sum(len(v) for v in ids.values())
    assert len(by_sequence) <= -(-total // 256) + 1


def test_plan_replaces_the_smallest_by_two():
    bins = packing.plan_bins({60: 1, 30: 1, 22: 1, 18: 1}, 100)
    assert sorted(bins[0][0]) == [18, 22, 60] and sum(n * len(i) for i, n in bins) == 4
    assert packing.plan_bins({}, 100) == []
    many = packing.plan_bins({7: 10**9, 93: 10**9, 50: 3}, 100)
    assert sum(n for _, n in many) == 10**9 + 2


def test_packing_empty(empty):
    assert packing.pack_documents(empty).count() == 0


def test_section_counts(docs, texts):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = token_counts.section_token_counts(docs, path).collect()
    encoding = token_counts.ByteTokens(path).encoding
    for i, t in texts.items():
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["section"])
        if not t:
            assert not own
            continue
        ids = encoding.encode_ordinary(t)
        assert sum(r["n_tokens"] for r in own) == sum(r["n_majority"] for r in own) == len(ids)
        assert abs(sum(r["n_split"] for r in own) - len(ids)) < 1e-6
        assert "".join(t[r["begin"] : r["end"]] for r in own) == t


def test_attribution_rules():
    first, major, split, crossing = token_counts.attribute(np.array([2, 6, 9]), np.array([0, 3, 9]))
    assert first.tolist() == [2, 1] and major.tolist() == [1, 2] and split.tolist() == [1.25, 1.75] and crossing.tolist() == [1, 1]


def test_section_counts_empty(empty):
    assert token_counts.section_token_counts(empty, public_tokenizers.path("byte_bpe_50k.tiktoken")).count() == 0


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_structured_words_do_not_collide(tokenizer):
    words = [thue_morse(4096, "ab"), thue_morse(4096, "ba")]
    raw = [w.encode() for w in words]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])
    for w, ids in zip(words, WordTokens(packing.vocabulary()).encode(data, offsets), strict=True):
        assert ids.tolist() == tokenizer.encode(w, add_special_tokens=False).ids
    h = textbytes.span_hash(data, offsets[:-1], offsets[1:])
    assert h[0] != h[1]


def test_null_ids_and_repeated_rows(spark, tokenizer):
    rows = [(None, "one two"), (3, "one two"), (3, "one two"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    packed = packing.pack_documents(df).collect()
    n = len(tokenizer.encode("one two", add_special_tokens=False).ids) + 1
    assert sorted(((r["doc_id"], r["length"]) for r in packed), key=str) == sorted([(None, n), (3, n), (3, n), (4, 1)], key=str)
    counts = token_counts.section_token_counts(df, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in counts), key=str) == sorted([(None, 2), (3, 2), (3, 2)], key=str)


def plain_attribution(lengths, bounds):
    """Each rule, token by token and byte by byte."""
    n = len(bounds) - 1
    owner = [next(s for s in range(n) if bounds[s] <= b < bounds[s + 1]) for b in range(bounds[-1])]
    first, major, split, crossing = [0] * n, [0] * n, [0.0] * n, [0] * n
    at = 0
    for size in lengths:
        own = owner[at : at + size]
        at += size
        held = {s: own.count(s) for s in own}
        first[own[0]] += 1
        major[max(held, key=lambda s: (held[s], -s))] += 1
        for s, k in held.items():
            split[s] += k / size
            crossing[s] += len(held) > 1
    return first, major, split, crossing


def test_attribution_equals_plain_counts():
    rng = np.random.default_rng(4)
    for _ in range(60):
        lengths = rng.integers(1, 9, rng.integers(1, 30))
        total = int(lengths.sum())
        cuts = np.unique(np.concatenate([[0, total], rng.integers(0, total + 1, rng.integers(0, 12))]))
        got = token_counts.attribute(np.cumsum(lengths), cuts)
        for a, b in zip(got, plain_attribution(lengths.tolist(), cuts.tolist()), strict=True):
            assert np.allclose(a, b)


def test_section_counts_equal_plain_counts(docs, texts):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoding = token_counts.ByteTokens(path).encoding
    rows = token_counts.section_token_counts(docs, path).collect()
    for i, t in texts.items():
        if not t:
            continue
        raw = t.encode()
        lengths = [len(encoding.decode_single_token_bytes(x)) for x in encoding.encode_ordinary(t)]
        bounds = [0, *[k + 1 for k, c in enumerate(raw) if c == 10 and k + 1 < len(raw)], len(raw)]
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["section"])
        first, major, split, crossing = plain_attribution(lengths, bounds) if len(raw) < 30_000 else (None,) * 4
        if first is not None:
            assert [r["n_tokens"] for r in own] == first and [r["n_majority"] for r in own] == major and [r["n_crossing"] for r in own] == crossing
            assert np.allclose([r["n_split"] for r in own], split)

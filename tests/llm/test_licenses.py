import re

from latticeworks.llm import licenses


def test_base_places_and_labels(spark):
    rows = [
        (1, "x CC-BY y cc\nBY 4"), (2, "This work is licensed under the GNU General Public License, version 3."), (3, None), (4, ""), (5, "ccby cc bye"),
        (6, "All RIGHTS reserved; all rights reserved"), (7, "Released under the MIT License."), (8, "Released under the XYZ License."), (9, "Permission is hereby granted, free of charge, to any person obtaining a copy of the software and documentation"),
        (6, "All RIGHTS reserved; all rights reserved"), (None, "general public license é cc by"),
    ]
    got = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert (by[1]["n_base"], by[1]["first_word"], by[1]["last_word"], by[1]["base_labels"]) == (2, 1, 4, "cc-by")
    assert by[2]["labels"] == "gpl" and by[2]["score"] == 1.0
    assert (by[3]["n_words"], by[3]["n_base"], by[3]["first_word"], by[3]["labels"], by[3]["score"]) == (0, 0, None, "", 0.0)
    assert by[5]["n_base"] == 0 and by[8]["labels"] == ""
    assert (by[6]["n_base"], by[6]["first_word"], by[6]["last_word"]) == (2, 0, 3)
    assert by[7]["labels"] == "mit" and by[9]["labels"] == "mit" and 0.8 <= by[9]["score"] < 1
    assert (by[None]["first_word"], by[None]["last_word"], by[None]["base_labels"]) == (0, 4, "cc-by,gpl")


def test_join_loses_no_block(spark, docs, texts):
    """Every block that holds enough of a template's words is found, against a plain count."""
    chosen = texts[7].split()[:12], texts[9].split()[:9]
    templates = {"a": (" ".join(chosen[0]),), "b": (" ".join(chosen[1]),)}
    keyed = docs.selectExpr("doc_id as key", "coalesce(text, '') as text")
    vocabulary = sorted({w for c in chosen for w in c})
    blocks = licenses.block_tokens(keyed, vocabulary)
    got = {(r["key"], r["block"], r["label"]) for r in licenses.containment_join(blocks, templates, 0.6).collect()}
    want = set()
    for i, t in texts.items():
        for k, line in enumerate((t or "").split("\n")):
            held = set(re.split(licenses.SEPARATORS, line.lower()))
            for label, c in zip("ab", chosen, strict=True):
                need = -(-len(set(c)) * 6 // 10) if len(set(c)) >= licenses.SHORT else len(set(c))
                if len(held & set(c)) >= need:
                    want.add((i, k, label))
    assert got == want and want


WRAPPED = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction",
    "bsd": " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:",
    "mpl": "# This Source Code Form is subject to the terms of the Mozilla Public\r\n# License, v. 2.0. If a copy of the MPL was not distributed with this",
}


def test_wrapped_notices(spark):
    rows = [(label, text) for label, text in WRAPPED.items()] + [(f"{label} in a text", "some words\n\n" * 30 + text + "\nmore words" * 30) for label, text in WRAPPED.items()]
    rows += [(f"{label} word by word", "x\n" + "\n".join(text.split())) for label, text in WRAPPED.items()]
    rows += [(f"no {label}", "\n".join(f"{w} a b c" for w in text.split())) for label, text in WRAPPED.items()]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert {i: x[0] for i, x in got.items()} == {i: "" if i.startswith("no ") else i[:3] for i, _ in rows}
    assert got["bsd"][1] == got["mit"][1] == got["mpl"][1] == 1.0


def test_windows_equal_a_plain_count(spark, docs, texts):
    chosen = {"a": texts[7].split()[:12], "b": texts[9].split()[:9], "c": texts[8].split()[3:7]}
    shuffled = [(10_000 + k, "\n".join(" ".join(c[(k + j) % len(c)] for j in range(s, s + 4)) for s in range(0, 12, 4))) for k, c in enumerate([*chosen.values()] * 3)]
    keyed = docs.selectExpr("doc_id as key", "coalesce(text, '') as text").union(spark.createDataFrame(shuffled, "key long, text string"))
    got = {(r["key"], r["label"]): round(r["containment"], 9) for r in licenses.window_matches(keyed, {k: (" ".join(c),) for k, c in chosen.items()}, 0.6).collect()}
    want = {}
    for i, t in [*texts.items(), *shuffled]:
        ws = re.split(licenses.SEPARATORS, (t or "").lower())
        for label, c in chosen.items() if "\n" in (t or "") else ():
            n = len(set(c))
            best = max(len(set(ws[k : k + len(c)]) & set(c)) for k in range(len(ws)))
            if best >= (-(-n * 6 // 10) if n >= licenses.SHORT else n):
                want[i, label] = round(best / n, 9)
    assert got == want and want


def test_empty(empty):
    assert licenses.license_scan(empty).count() == 0

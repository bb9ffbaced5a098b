"""License scans by an exact set-similarity join of text blocks with license templates.

A block (a line, or across lines as many consecutive words as the template has) contains a template if it holds at least
``threshold`` of the template's distinct words (all, if few). For lines, words are put in one global order, rarest first over all blocks; a block can only contain a template if a word of the template's short
prefix is in the block's prefix, if the block is long enough, and if enough words remain behind the first shared one. Words
across lines are looked at where the whole text holds enough of a template and enough of its words stand near each other.
Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

# The phrases whose places are counted, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Notices in their usual words, with the label that the join adds.
TEMPLATES = {
    "apache": ("licensed under the apache license version 2 0", "you may not use this file except in compliance with the license", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "cc-by-nc": ("licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    "gpl": ("this work is licensed under the gnu general public license version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    "mit": ("released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    "mpl": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
}
#: Templates of fewer distinct words than this must be contained whole; a share of them says too little.
SHORT = 8
#: What separates words once A-Z may stand beside a-z.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def block_tokens(docs: DataFrame, vocabulary: list[str], separator: str = "\n") -> DataFrame:
    """key, block, tokens: the distinct vocabulary words of each block of each text (null text: no blocks)."""
    lines = docs.select("key", F.posexplode(F.split("text", separator)).alias("block", "line"))
    held = F.array_intersect(F.split(F.lower("line"), SEPARATORS), F.array(*map(F.lit, vocabulary)))
    return lines.select("key", "block", held.alias("tokens")).where(F.size("tokens") > 0)


def _need(words: int, threshold: float) -> int:
    return words if words < SHORT else math.ceil(threshold * words - 1e-9)


def _let(value, body):
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def window_matches(docs: DataFrame, templates: dict[str, tuple[str, ...]], threshold: float, separator: str = "\n") -> DataFrame:
    """key, label, containment of the best window of each text of several lines for each template that one reaches.

    A window is any run of as many consecutive words as the template has, wherever the lines break. Windows that start
    at a word of the template are enough; of these only such are compared whose next ``need`` template words fit.
    """
    kinds = [(label, text.split(), set(text.split())) for label, texts in templates.items() for text in texts]
    literal = [F.struct(F.lit(label).alias("label"), F.array(*map(F.lit, sorted(own))).alias("own"), F.lit(_need(len(own), threshold)).alias("need"), F.lit(len(words)).alias("length")) for label, words, own in kinds]
    vocabulary = F.array(*map(F.lit, sorted({w for _, _, own in kinds for w in own})))
    words = F.split(F.lower("text"), SEPARATORS)
    reached = _let(F.array_intersect(words, vocabulary), lambda held: F.filter(F.array(*literal), lambda t: F.size(F.array_intersect(held, t["own"])) >= t["need"]))
    wanted = docs.where(F.col("text").rlike(separator)).select("key", "text", F.explode(reached).alias("t"))
    t, at = F.col("t"), lambda places, k: F.element_at(places, k.cast("int"))
    places = lambda w: F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: F.array_contains(t["own"], F.element_at(w, i)))
    starts = lambda p: F.filter(F.sequence(F.lit(1), F.size(p) - t["need"] + 1), lambda k: at(p, k + t["need"] - 1) - at(p, k) < t["length"])
    largest = lambda w, p: F.array_max(F.transform(starts(p), lambda k: F.size(F.array_intersect(F.slice(w, at(p, k), t["length"]), t["own"]))))
    common = _let(words, lambda w: _let(places(w), lambda p: largest(w, p)))
    best = wanted.select("key", "t.label", common.alias("common"), "t.need", F.size("t.own").alias("of")).where("common >= need")
    return best.select("key", "label", (F.col("common") / F.col("of")).alias("containment"))


def containment_join(blocks: DataFrame, templates: dict[str, tuple[str, ...]], threshold: float) -> DataFrame:
    """key, block, label, containment of every block that holds at least ``threshold`` of a template's words.

    ``blocks`` has key, block and tokens. The templates are a short list of the caller's and travel as literals and a
    broadcast table; word counts over all blocks (one row per template word) decide the global order.
    """
    spark = blocks.sparkSession
    sets = [(label, sorted(set(text.split()))) for label, texts in templates.items() for text in texts]
    counts = {r["token"]: r["count"] for r in blocks.select(F.explode("tokens").alias("token")).groupBy("token").count().collect()}
    order = sorted({w for _, words in sets for w in words}, key=lambda w: (counts.get(w, 0), w))
    place = {w: k for k, w in enumerate(order)}
    rows, prefix_words = [], set()
    for number, (label, words) in enumerate(sets):
        words = sorted(words, key=place.__getitem__)
        need = _need(len(words), threshold)
        for at, word in enumerate(words[: len(words) - need + 1]):
            rows.append((number, label, words, need, at, word))
            prefix_words.add(word)
    index = spark.createDataFrame(rows, "number int, label string, words array<string>, need int, at int, token string")
    least = min(r[3] for r in rows)
    likely = blocks.where((F.size("tokens") >= least) & F.arrays_overlap("tokens", F.array(*map(F.lit, sorted(prefix_words)))))
    sorted_blocks = likely.select("key", "block", F.array_intersect(F.array(*map(F.lit, order)), F.col("tokens")).alias("tokens"))
    probes = sorted_blocks.select("key", "block", "tokens", F.posexplode("tokens").alias("here", "token"))
    size, of = F.size("tokens"), F.size("words")
    room = 1 + F.least(of - F.col("at"), size - F.col("here")) - 1
    pairs = probes.join(F.broadcast(index), "token").where((size >= F.col("need")) & (F.col("here") <= size - F.col("need")) & (room >= F.col("need")))
    common = F.size(F.array_intersect("tokens", "words"))
    found = pairs.select("key", "block", "number", "label", common.alias("common"), "need", of.alias("of")).where("common >= need").dropDuplicates(["key", "block", "number"])
    return found.select("key", "block", "label", (F.col("common") / F.col("of")).alias("containment"))


def _spaces(column):
    return F.length(column) - F.length(F.replace(column, F.lit(" "), F.lit("")))


def license_scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = 0.8, separator: str = "\n") -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base places are where a phrase's words stand consecutively, also across lines. Labels are those of the phrases and
    of the templates that some line, or some window across lines, contains; the score is 1 with a base place, else the largest containment, else 0.
    Null text is empty: no words, no labels. Repeated rows each come back; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select("doc_id", text.alias("text")).withColumn("key", F.struct(F.xxhash64("doc_id", "text").alias("a"), F.hash("text", "doc_id").alias("b")))
    vocabulary = sorted({w for texts in templates.values() for t in texts for w in t.split()})
    blocks = materialize(block_tokens(docs, vocabulary, separator), "license_blocks")
    found = containment_join(blocks, templates, threshold).drop("block").union(window_matches(docs, templates, threshold, separator))
    matches = found.groupBy("key").agg(F.collect_set("label").alias("found"), F.max("containment").alias("containment"))
    plain = docs.select("doc_id", "key", F.trim(F.regexp_replace("text", SEPARATORS, " ")).alias("plain"))
    n_words = F.when(F.length("plain") == 0, 0).otherwise(_spaces(F.col("plain")) + 1).cast("long")
    hit = F.col("plain").rlike("(?i)" + "|".join(PHRASES))
    lowered = F.when(hit, F.concat(F.lit(" "), F.translate("plain", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(" ")))
    rows = plain.select("doc_id", "key", n_words.alias("n_words"), lowered.alias("low"))
    n, first, last, named = [], [], [], []
    for phrase, label in PHRASES.items():
        wrapped = F.lit(f" {phrase} ")
        n.append(F.coalesce(F.regexp_count("low", F.lit(f"(?<= ){phrase}(?= )")), F.lit(0)))
        ahead, behind = F.instr(F.col("low"), wrapped), F.instr(F.reverse("low"), F.reverse(wrapped))
        first.append(F.when(ahead > 0, _spaces(F.substring(F.col("low"), F.lit(1), ahead)) - 1))
        last.append(F.when(behind > 0, _spaces(F.substring(F.col("low"), F.lit(1), F.length("low") - behind - len(phrase))) - 1))
        named.append(F.when(ahead > 0, F.lit(label)))
    base = rows.select(
        "doc_id", "key", "n_words", sum(n[1:], n[0]).cast("long").alias("n_base"), F.least(*first).cast("long").alias("first_word"), F.greatest(*last).cast("long").alias("last_word"),
        F.array_sort(F.array_compact(F.array(*named))).alias("base"),
    )
    joined = base.join(matches, "key", "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0)))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def op5_licenses(spark, sf_dir: str) -> DataFrame:
    """All ``documents``."""
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))

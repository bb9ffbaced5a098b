"""Exact removal of long repeated byte strings by induced suffix sorting over shards.

Every window of positions chooses an anchor, its smallest hashed 16-gram, from its own bytes, so equal strings
choose the same anchor at the same distance; only strings behind anchors that repeat can repeat. Around those anchors
suffixes are sorted as in external induced sorting: Spark deals the suffix tuples into shards by the name of their
anchor's context (its shuffle is the disk-backed queue), anchor suffixes are sorted once with their common prefixes,
and the suffixes further left are induced from them byte by byte, common prefixes carried along. A shard whose context
is too frequent is split recursively: half the distances, a longer context as the name, lone names dropped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import drop, drop_since, mark, materialize
from .textbytes import U64, flat, grams, mix, prefix, slices

#: Bytes that an anchor's hash covers, and the share of a string's length whose positions share an anchor at most.
GRAM, WINDOW_SHARE = 16, 0.64
#: Suffixes that one shard sorts at a time; a context with more is split.
SHARD = 8_000
#: Bytes of a repeated passage that op1 reports beside what it removes: some fifty words.
PASSAGE = 256
#: Bytes of text that a task works on at a time (a longer document stands alone).
SLICE = 500_000
#: A name that more than a HEAVY-th of all rows have is told to every task (so fewer than HEAVY names can be).
HEAVY = 10_000
_PLACE = 31  # bits of a position; no value of a table is longer


def window(length: int) -> int:
    """Positions that share an anchor at most, for strings of ``length`` bytes."""
    return int(length * WINDOW_SHARE)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of string starts with one anchor: row, anchor, first start, last start (bytes of the slice), context hash.

    A start is the first byte of a string of ``length`` bytes inside its row; the context is what all strings that this
    anchor can serve share to its right, ``length`` - ``window(length)`` + 1 bytes.
    """
    n, row_end, reach = len(data), np.repeat(offsets[1:], np.diff(offsets)), window(length)
    none = np.zeros(0, np.int64)
    starts = np.flatnonzero(np.arange(n) + length <= row_end)
    if not len(starts):
        return none, none, none, none, np.zeros(0, U64)
    key = (grams(data) & ~U64((1 << _PLACE) - 1)) | np.arange(n - GRAM + 1).astype(U64)
    size = 1
    while size * 2 <= reach:
        key = np.minimum(key[: len(key) - size], key[size:])
        size *= 2
    if size < reach:
        key = np.minimum(key[: len(key) - (reach - size)], key[reach - size :])
    chosen = (key[starts] & U64((1 << _PLACE) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    last = np.append(first[1:], len(starts)) - 1
    anchor = chosen[first]
    context = prefix(data).hashes(anchor, anchor + length - reach + 1)
    return np.searchsorted(offsets, starts[first], "right") - 1, anchor, starts[first], starts[last], context


def _range_minimum(values: np.ndarray) -> list[np.ndarray]:
    table, size = [values], 1
    while size * 2 <= len(values):
        table.append(np.minimum(table[-1][: len(table[-1]) - size], table[-1][size:]))
        size *= 2
    return table


def _minimum_between(table: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Smallest value at lo + 1 .. hi, for lo < hi."""
    level = np.frexp((hi - lo).astype(np.float64))[1] - 1
    out = np.empty(len(lo), table[0].dtype)
    for k in np.unique(level):
        of = level == k
        out[of] = np.minimum(table[k][lo[of] + 1], table[k][hi[of] - (1 << k) + 1])
    return out


def induced_repeats(name: np.ndarray, text: np.ndarray, begin: np.ndarray, anchor: np.ndarray, first: np.ndarray, last: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(tuple, start) of every start in [first, last] whose ``length`` bytes another tuple of its name also has at the
    same distance from the anchor.

    Tuple i is the bytes begin[i]..end[i] of ``text``, with its anchor and starts as places in ``text``. The suffixes at
    the anchors are sorted and their common prefixes taken; each step to the left is one stable pass by the next byte.
    """
    n = len(name)
    width = int((end - anchor).max())
    rows = np.zeros((n, width), np.uint8)
    size = end - anchor
    rows[np.repeat(np.arange(n), size), np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)] = text[np.repeat(anchor - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    _, group = np.unique(name, return_inverse=True)
    tagged = np.concatenate([group.astype(">u4").view(np.uint8).reshape(n, 4), rows], axis=1)
    order = np.argsort(np.ascontiguousarray(tagged).view(f"S{width + 4}").reshape(n), kind="stable")
    differ = rows[order[1:]] != rows[order[:-1]]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    lcp = np.concatenate([[0], np.where(group[order[1:]] == group[order[:-1]], common, 0)]).astype(np.int32)
    distance = int((anchor - first).max())
    found_tuple, found_start = [], []
    for d in range(distance + 1):
        place = anchor[order] - d
        valid = np.flatnonzero((place >= first[order]) & (place <= last[order]))
        if len(valid) > 1:
            table = _range_minimum(lcp)
            near = _minimum_between(table, valid[:-1], valid[1:]) >= length
            hit = np.zeros(len(valid), bool)
            hit[1:] |= near
            hit[:-1] |= near
            found_tuple.append(order[valid[hit]])
            found_start.append(place[valid[hit]])
        stay = place > first[order]
        if d == distance or not stay.any():
            break
        table = _range_minimum(lcp)
        kept = np.flatnonzero(stay)
        byte = text[anchor[order[kept]] - d - 1]
        key = group[order[kept]].astype(np.int64) * 256 + byte
        by = np.argsort(key, kind="stable")
        old, key = kept[by], key[by]
        lcp = np.zeros(len(old), np.int32)
        same = np.flatnonzero(key[1:] == key[:-1])
        lcp[same + 1] = 1 + _minimum_between(table, old[same], old[same + 1])
        order = order[old]
    if not found_tuple:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_tuple), np.concatenate(found_start)


def _runs(tuples: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of consecutive starts of each tuple."""
    order = np.lexsort((starts, tuples))
    t, s = tuples[order], starts[order]
    new = np.concatenate([[True], (t[1:] != t[:-1]) | (s[1:] != s[:-1] + 1)]) if len(t) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(t)) - 1 if len(t) else first
    return t[first], s[first], s[last]


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """rid, h, anchor, first, last (bytes of the document) of every run of starts."""

    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for i, j in slices(offsets, SLICE):
                at = offsets[i : j + 1]
                row, anchor, first, last, h = anchors(data[at[0] : at[-1]], at - at[0], length)
                base = (at - at[0])[row]
                cols = [batch.column(0).take(pa.array(row + i)), pa.array(h.view(np.int64)), *(pa.array((x - base).astype(np.int32)) for x in (anchor, first, last))]
                yield pa.RecordBatch.from_arrays(cols, ["rid", "h", "anchor", "first", "last"])

    return docs.select("rid", "body").mapInArrow(run, "rid long, h long, anchor int, first int, last int")


def _named(held: DataFrame, length: int) -> DataFrame:
    """rid, h, c1, c2, anchor, first, last: two independent hashes that name all bytes which an anchor's strings touch."""

    def run(batches):
        for whole_batch, i, j in ((b, i, j) for b in batches for i, j in slices(flat(b.column(1))[1], SLICE)):
            batch = whole_batch.slice(i, j - i)
            data, offsets = flat(batch.column(1))
            one, two = prefix(data), prefix(data, 1)
            runs = batch.column(2)
            sizes = pc.list_value_length(runs).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            parts = runs.flatten()
            h, anchor, first, last = (parts.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            base = offsets[row]
            c1 = one.hashes(base + first, base + last + length)
            with np.errstate(over="ignore"):
                c2 = mix(two.hashes(base + first, base + last + length) + (anchor - first).astype(U64) * U64(0x9E3779B97F4A7C15))
            cols = [batch.column(0).take(pa.array(row)), pa.array(h), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), pa.array(anchor), pa.array(first), pa.array(last)]
            yield pa.RecordBatch.from_arrays(cols, ["rid", "h", "c1", "c2", "anchor", "first", "last"])

    return held.select("rid", "body", "runs").mapInArrow(run, "rid long, h long, c1 long, c2 long, anchor int, first int, last int")


def _told(rows: DataFrame, names: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """``names`` (keys, n: how many of ``rows`` have them) in two: the heavy ones to broadcast, and those to shuffle."""
    total = rows.count()
    heavy = F.col("n") * HEAVY > total
    return F.broadcast(names.where(heavy).select(*keys)), names.where(~heavy).select(*keys)


def _among(rows: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a written table that have one of ``names``; no task gets more than a HEAVY-th of them by its name."""
    heavy, light = _told(rows, names, keys)
    return rows.join(heavy, keys, "left_semi").unionByName(rows.join(heavy, keys, "left_anti").join(light, keys, "left_semi"))


def _outside(rows: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a written table that have none of ``names``, in the same way."""
    heavy, light = _told(rows, names, keys)
    return rows.join(heavy, keys, "left_anti").join(light, keys, "left_anti")


def _split_hot(tuples: DataFrame, length: int) -> tuple[DataFrame, DataFrame | None]:
    """Tuples with a ``name`` that at most about SHARD of them share: frequent names give way to longer contexts.

    A tuple under a frequent name is cut at the middle of its distances from the anchor; each half is named by all bytes
    that its strings share, and a name that only one tuple has can hold no repeat. At a single distance the name is the
    string itself, so that tuples which still share it are repeats: they come back apart (rid, first, last).
    """
    done, known, rows = None, None, materialize(tuples.withColumn("name", F.col("h")).withColumn("lo", F.lit(0)).withColumn("hi", F.lit(window(length) - 1)), "suffix_tuples")
    while True:
        hot = materialize(rows.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") > SHARD), "hot_names")
        few = _outside(rows, hot, ["name"])
        done = few if done is None else done.unionByName(few)
        if hot.isEmpty():
            return done, known
        many = _among(rows, hot, ["name"])
        wide = many.where("hi > lo")
        equal = many.where("hi = lo and single").select("rid", "first", "last")
        known = equal if known is None else known.union(equal)
        middle = ((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = wide.withColumn("half", F.explode(F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct((middle + 1).alias("lo"), F.col("hi").alias("hi"))))).drop("lo", "hi")
        place = F.col("anchor") - F.col("begin")  # of the anchor in bytes
        x = F.greatest(F.col("first") - F.col("begin"), place - F.col("half.hi"))
        y = F.least(F.col("last") - F.col("begin"), place - F.col("half.lo"))
        cut = halves.withColumn("x", x).withColumn("y", y).where("x <= y")
        core = F.substring(F.col("bytes"), place - F.col("half.lo") + 1, F.lit(length) - (F.col("half.hi") - F.col("half.lo")))
        named = cut.withColumn("name", F.xxhash64(core, F.col("half.lo"), F.col("half.hi"))).select("rid", "h", "anchor", (F.col("begin") + F.col("x")).alias("first"), (F.col("begin") + F.col("y")).alias("last"), "begin", "bytes", "single", "name", F.col("half.lo").alias("lo"), F.col("half.hi").alias("hi"))
        named = materialize(named, "suffix_tuples")
        paired = named.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")
        rows = materialize(_among(named, paired, ["name"]), "suffix_tuples")


def _sorted_repeats(tuples: DataFrame, length: int) -> DataFrame:
    """rid, first, last of repeated starts of the single tuples, shard by shard."""
    total = tuples.count()
    shards = max(1, -(-total // SHARD)) * 4
    dealt = tuples.withColumn("shard", F.pmod(F.xxhash64("name"), F.lit(shards)))

    def run(_, group):
        group = group.combine_chunks()
        text, offsets = flat(group.column("bytes"))
        shift = offsets[:-1] - group.column("begin").to_numpy()
        anchor, first, last = (group.column(c).to_numpy() + shift for c in ("anchor", "first", "last"))
        which, start = induced_repeats(group.column("name").to_numpy(), text, offsets[:-1], anchor, first, last, offsets[1:], length)
        own = group.column("single").to_numpy(zero_copy_only=False)[which]
        t, b, e = _runs(which[own], start[own])
        return pa.table([group.column("rid").combine_chunks().take(pa.array(t)), pa.array((b - shift[t]).astype(np.int32)), pa.array((e - shift[t]).astype(np.int32))], ["rid", "first", "last"])

    return dealt.groupBy("shard").applyInArrow(run, "rid long, first int, last int")


def _repeated_starts(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Documents that hold a repeated anchor (rid, body, runs), and the repeated starts (rid, first, last) found in them."""
    found = materialize(_anchor_rows(docs, length), "anchors")
    twice = materialize(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    runs = _among(found, twice, ["h"]).groupBy("rid").agg(F.collect_list(F.struct("h", "anchor", "first", "last")).alias("runs"))
    held = materialize(docs.select("rid", "body").join(runs, "rid"), "anchored", "zstd")
    drop(found)
    named = materialize(_named(held, length), "contexts")
    contexts = materialize(named.groupBy("h", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct("rid", "anchor", "first", "last")).alias("rep")), "distinct_contexts")
    bulk = _among(named, contexts.where("n > 1"), ["h", "c1", "c2"]).select("rid", "first", "last")
    open_names = contexts.groupBy("h").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1").select("h", F.col("m").alias("n"))
    reps = _among(contexts, open_names, ["h"]).groupBy(F.col("rep.rid").alias("rid")).agg(F.collect_list(F.struct("h", (F.col("n") == 1).alias("single"), "rep.anchor", "rep.first", "rep.last")).alias("reps"))
    each = held.select("rid", "body").join(reps, "rid").select("rid", "body", F.explode("reps").alias("r"))
    tuples = each.select("rid", "r.h", "r.single", "r.anchor", "r.first", "r.last", F.col("r.first").alias("begin"), F.substring("body", F.col("r.first") + 1, F.col("r.last") - F.col("r.first") + length).alias("bytes"))
    shards, equal = _split_hot(tuples, length)
    starts = bulk.union(_sorted_repeats(shards, length))
    return held, starts if equal is None else starts.union(equal)


def _covered(starts: DataFrame, length: int, name: str) -> DataFrame:
    """rid and ``name``: the maximal runs of bytes, in order, that strings of ``length`` bytes from these starts cover."""
    line = Window.partitionBy("rid").orderBy("first", "last")
    ends = starts.select("rid", "first", "last", (F.col("last") + length).alias("end"))
    reach = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    marked = ends.withColumn("new", F.coalesce((F.col("first") > reach).cast("int"), F.lit(0)))
    runs = marked.withColumn("run", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0))).groupBy("rid", "run").agg(F.min("first").alias("b"), F.max("end").alias("e"))
    return runs.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("b", "e"))).alias(name))


def repeated_spans(docs: DataFrame, length: int = 400, passage: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` (doc_id, text) as (rid, doc_id, body) and rid, removed, n_spans, kept (binary), kept_sha256,
    passages of the documents that hold a repeat.

    A byte is removed if a string of ``length`` bytes (at least 4 * GRAM) that covers it starts anywhere else too, in
    the same document or another; all judged on the input. ``passages`` counts the bytes that strings of ``passage``
    bytes (at most ``length``, and that by default) cover in the same way: shorter repeats, which are reported but stay.
    Only documents with such bytes have a row in the second table. Null text is empty; a repeated row is another
    document, so both lose what they share. A text may be as long as a value of a table; each is held whole by one task.
    """
    passage = passage or length
    if not 4 * GRAM <= passage <= length:
        raise ValueError(f"need {4 * GRAM} <= passage <= length")
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body")), "suffix_docs", "zstd")
    made = mark()
    held, short = _repeated_starts(rows, passage)
    some = held.select("rid", "body").join(_covered(short, passage, "short"), "rid")
    if passage == length:
        found = some.withColumn("long", F.col("short"))
    else:
        some = materialize(some, "passages", "zstd")
        drop_since(rows.sparkSession, made, some)
        # a longer string repeats only where shorter ones that start at each of its places do, in one run
        likely = some.where(F.exists("short", lambda s: s["e"] - s["b"] >= length)).select("rid", "body")
        _, starts = _repeated_starts(likely, length)
        found = some.join(_covered(starts, length, "long"), "rid", "left")

    def cut(batches):
        for batch in batches:
            body, columns = batch.column(1), [[], [], [], [], []]
            for k in range(len(batch)):
                text = memoryview(body[k].as_buffer())
                long, short = batch.column(2)[k].as_py() or [], batch.column(3)[k].as_py()
                kept, at = bytearray(), 0
                for s in long:
                    kept += text[at : s["b"]]
                    at = s["e"]
                kept += text[at:]
                for column, value in zip(columns, (sum(s["e"] - s["b"] for s in long), len(long), bytes(kept), hashlib.sha256(kept).hexdigest(), sum(s["e"] - s["b"] for s in short)), strict=True):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, types)], ["rid", "removed", "n_spans", "kept", "kept_sha256", "passages"])

    return rows, found.select("rid", "body", "long", "short").mapInArrow(cut, "rid long, removed long, n_spans long, kept binary, kept_sha256 string, passages long")


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """All ``documents``, strings of 400 bytes; n_passage counts the bytes in repeated strings of 256 bytes."""
    rows, found = repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), passage=PASSAGE)
    own = rows.select("rid", "doc_id", F.octet_length("body").cast("long").alias("n_bytes"), F.sha2("body", 256).alias("whole"))
    joined = own.join(found.drop("kept"), "rid", "left")
    count = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return joined.select("doc_id", "n_bytes", count("removed").alias("n_removed"), count("n_spans").alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"), count("passages").alias("n_passage"))

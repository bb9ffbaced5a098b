"""Periodic runs of words: a dictionary of basic factors proposes periods, blocks of equal steps are the runs.

Factors of each power-of-two length have names made from the names of their halves. Where the next occurrence of a
factor is no farther than twice its length, the step to it is a proposed period; neighbouring places with the same step
are occurrences in arithmetic progression, and the stretch that they cover is extended as far as the period holds. Only
places whose factor comes again stay for the next length, so texts without repeats cost little more than their words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import flat, slices


def _named(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of equal keys, and which keys come more than once."""
    _, names, n = np.unique(keys, return_inverse=True, return_counts=True)
    return names, n[names] > 1


def _steps(places: np.ndarray, names: np.ndarray) -> np.ndarray:
    """From each of the ascending ``places`` to the next one of the same name; 0 without one."""
    order = np.argsort(names, kind="stable")
    step = np.zeros(len(places), np.int64)
    again = names[order[1:]] == names[order[:-1]]
    step[order[:-1][again]] = (places[order[1:]] - places[order[:-1]])[again]
    return step


def _extended(words: np.ndarray, start: int, end: int, period: int) -> tuple[int, int]:
    """The stretch [start, end) as far as words a period apart stay equal on both sides."""
    while start > 0 and words[start - 1] == words[start - 1 + period]:
        start -= 1
    while end < len(words) and words[end] == words[end - period]:
        end += 1
    return start, end


def runs_of(words: np.ndarray, least: int, times: int) -> np.ndarray:
    """start, length, period of every maximal run in a sequence of word numbers, by start and period: the smallest period
    q holds, the length is at least ``least`` and ``times`` * q (``times``: 3 or more).

    A period q is read at the smallest power of two that is not below it, or at ``base`` if that is larger: any run holds
    a factor of that length and its next occurrence, which is q away and no less, as q is the smallest.
    """
    if times < 3:
        raise ValueError("runs of fewer than three periods do not always hold a factor twice")
    n, found = len(words), set()
    places, names, size = np.arange(n), np.unique(words, return_inverse=True)[1] if n else words, 1
    places, names = _repeated(places, names)
    base = 1  # a run of least words holds base words and those half as far again
    while base * 3 <= least:
        base *= 2
    while len(places) and size <= max(n, 1):
        if size >= base:
            step = _steps(places, names)
            low = size // 2 if size > base else 0
            near = (step > low) & (step <= size)
            at, by = places[near], step[near]
            if len(at):
                first = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (by[1:] != by[:-1])])
                last = np.append(first[1:], True)
                for i, j, q in zip(at[first].tolist(), at[last].tolist(), by[first].tolist(), strict=True):
                    if j - i + size + q >= max(least, times * q):
                        start, end = _extended(words, i, j + size + q, q)
                        found.add((start, end - start, q))
        known = np.full(n + 1, -1, np.int64)
        known[places] = names
        right = known[np.minimum(places + size, n)]
        whole = right >= 0
        places, names = _repeated(places[whole], names[whole] * (n + 1) + right[whole])
        size *= 2
    return np.array(sorted(found, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def _repeated(places: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those places whose key comes again, and their names."""
    names, again = _named(keys)
    return places[again], names[again]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words lie in no run behind its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change)[:n] == 0


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, runs (array of start, length, period by start, then period),
    collapsed (the words that lie in no run behind its first period, joined by one space).

    Words are what ASCII white space separates. A run is a stretch of words with smallest period q that no neighbouring
    word extends, of ``least`` words and ``times`` * q at least; runs may overlap. Null, empty and blank texts have no
    words, no run and an empty collapsed text; a doc_id may be null or repeated, each row stands for itself. A text is
    taken whole by the task that reads it, whatever its length; other columns are ignored; empty in, empty out.
    """

    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for i, j in slices(offsets):
                n_words, bounds, rows, collapsed = [], [0], [], []
                for r in range(i, j):
                    words = data[offsets[r] : offsets[r + 1]].tobytes().split()
                    numbers = pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy()
                    runs = runs_of(numbers, least, times) if len(words) >= least else np.zeros((0, 3), np.int64)
                    keep = kept_words(len(words), runs) if len(runs) else None
                    collapsed.append(b" ".join(words if keep is None else [words[k] for k in np.flatnonzero(keep).tolist()]))
                    n_words.append(len(words))
                    rows.append(runs)
                    bounds.append(bounds[-1] + len(runs))
                flat_runs = np.concatenate(rows)
                structs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat_runs[:, k])) for k in range(3)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), structs)
                texts = pa.array(collapsed, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n_words, pa.int64()), lists, texts], ["doc_id", "n_words", "runs", "collapsed"])

    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated words in about every tenth text, as crc32 of the doc_id says; a null doc_id: as it is."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), (h % 10 == 0).alias("chosen"))
    rows = rows.withColumn("words", F.when(F.col("chosen") & F.col("text").isNotNull(), words))
    n = F.size("words").cast("long")
    rows = rows.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    moved = F.transform("words", lambda w, i: F.when(i >= F.col("a"), F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))).otherwise(w))
    return rows.select("doc_id", F.when(F.col("a").isNull(), F.col("text")).otherwise(F.array_join(moved, " ")).alias("text"))


def run_report(found: DataFrame) -> DataFrame:
    """Of ``periodic_runs``: n_runs, the run with the greatest length / period (ties: smallest start, then period) as
    start, length, period and exponent_milli (null without runs), and digests of all runs and of the collapsed text."""
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    top = F.aggregate("runs", none, lambda best, r: F.when(better(best, r), r).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.floor(F.expr("(1000 * top.length) div top.period"))
    return rows.select("doc_id", "n_runs", "top.start", "top.length", "top.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """All ``documents``, runs of 24 words and three periods at least."""
    return run_report(periodic_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet"))))

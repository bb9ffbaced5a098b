"""Benchmark decontamination over a distributed positional inverted index.

One pass over the training texts stores postings: for each block of whole documents and each term that occurs in the
benchmark, the documents and word positions where it stands. Test phrases are then answered from the index alone: the
list of a phrase's rarest term gives candidate starts, which are intersected with the offset-adjusted lists of its other
terms, next rarest first. Blocks hold whole documents, so no list of a frequent term ever meets in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize
from .textbytes import NON_ALNUM, combine, flat, slices, words

#: Benchmark words whose phrases are looked up at a time; a larger benchmark is taken in several batches of items.
BATCH_WORDS = 200_000
#: Distinct benchmark words that one index holds (8 bytes each go to every task); more take further indexes.
INDEX_TERMS = 4_000_000
#: Bytes of text in a block of the index (a longer document is a block of its own).
BLOCK_BYTES = 500_000
INDEX = "block long, term long, docs array<int>, positions array<int>, doc_ids array<long>"
_DOCS = -(2**63)  # the row of a block that lists its documents: word counts stand in positions


class Terms:
    """Ordinals of 64-bit word hashes in a fixed vocabulary."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.sorted >> np.uint64(42)] = True

    def ordinals(self, hashes: np.ndarray) -> np.ndarray:
        """-1 where a hash is no term."""
        out = np.full(len(hashes), -1, np.int64)
        likely = np.flatnonzero(self.maybe[hashes >> np.uint64(42)])
        if len(self.sorted) and len(likely):
            at = np.minimum(np.searchsorted(self.sorted, hashes[likely]), len(self.sorted) - 1)
            out[likely] = np.where(self.sorted[at] == hashes[likely], at, -1)
        return out


def item_words(benchmark: DataFrame) -> DataFrame:
    """item_id as string (null: the word null) and the 64-bit hashes of its lower-cased words; null text has none."""

    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column(1))
            row, _, _, h = words(data, offsets, NON_ALNUM)
            ends = np.searchsorted(row, np.arange(len(offsets)), "left").astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], ["item", "words"])

    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text").mapInArrow(run, "item string, words array<long>")


def positional_index(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """Postings of every vocabulary term in ``docs`` (doc_id, text): block, term, docs (ordinals), positions.

    ``vocabulary`` holds 64-bit word hashes and is sent to the tasks; callers bound it (INDEX_TERMS). Each block also
    has one row that lists its documents with their word counts. Whole texts are read; null text has no words.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(np.unique(vocabulary))

    def run(batches):
        from pyspark import TaskContext

        terms = Terms(shared.value)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = flat(batch.column(1))
            ids = batch.column(0)
            for i, j in slices(offsets, BLOCK_BYTES):
                at = offsets[i : j + 1]
                row, _, _, h = words(data[at[0] : at[-1]], at - at[0], NON_ALNUM)
                first = np.searchsorted(row, np.arange(j - i + 1), "left")
                term = terms.ordinals(h)
                hit = np.flatnonzero(term >= 0)
                order = hit[np.argsort(term[hit], kind="stable")]
                runs = np.flatnonzero(np.diff(term[order], prepend=-1))
                ends = np.append(runs, len(order)).astype(np.int32)
                lists = lambda v, extra: pa.ListArray.from_arrays(pa.array(np.append(ends, ends[-1] + len(extra)).astype(np.int32)), pa.array(np.concatenate([v, extra]).astype(np.int32)))
                n = len(runs)
                doc = row[order]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n + 1, block)),
                        pa.array(np.append(terms.sorted[term[order][runs]].view(np.int64), _DOCS)),
                        lists(doc, np.arange(j - i)),
                        lists(order - first[doc], np.diff(first)),
                        pa.ListArray.from_arrays(pa.array(np.append(np.zeros(n + 1, np.int32), j - i).astype(np.int32)), ids.slice(i, j - i)),
                    ],
                    ["block", "term", "docs", "positions", "doc_ids"],
                )
                block += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX)


def phrase_table(items: list[tuple[str, list[int]]], width: int, frequency: dict[int, int]) -> dict:
    """Distinct phrases of ``width`` consecutive words (shorter items: the whole item), their items, rarest terms first."""
    by_width: dict[int, dict[tuple, set]] = {}
    for item, hashes in items:
        size = min(width, len(hashes))
        for k in range(len(hashes) - size + 1) if size else ():
            by_width.setdefault(size, {}).setdefault(tuple(hashes[k : k + size]), set()).add(item)
    out = {}
    for size, found in by_width.items():
        phrases = np.array(list(found), np.int64).reshape(len(found), size)
        counts = np.array([frequency.get(h, 0) for h in phrases.ravel().tolist()], np.int64).reshape(phrases.shape)
        out[size] = (phrases, np.argsort(counts, axis=1, kind="stable").astype(np.int16), list(map(sorted, found.values())), counts.min(axis=1) > 0)
    return out


class _Lists:
    """The postings of one block: membership of (term, document, position) by binary search."""

    def __init__(self, term: np.ndarray, sizes: np.ndarray, docs: np.ndarray, positions: np.ndarray):
        order = np.argsort(term, kind="stable")
        self.terms = term[order]
        ends = np.cumsum(sizes)
        start = ends - sizes
        take = np.repeat(start[order] - (np.cumsum(sizes[order]) - sizes[order]), sizes[order]) + np.arange(int(sizes.sum()))
        self.begin = np.concatenate([[0], np.cumsum(sizes[order])])
        self.docs, self.positions = docs[take].astype(np.int64), positions[take].astype(np.int64)
        self.reach = np.zeros(int(self.docs.max(initial=-1)) + 1, np.int64)  # words of each document up to its last posting
        np.maximum.at(self.reach, self.docs, self.positions + 1)
        self.first = np.cumsum(self.reach) - self.reach
        self.room = int(self.reach.sum())  # terms times words of a block stay far below 2 ** 63
        self.keys = np.repeat(np.arange(len(order)), sizes[order]) * self.room + self.first[self.docs] + self.positions

    def ordinal(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.terms):
            return np.full(hashes.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def holds(self, term: np.ndarray, doc: np.ndarray, position: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(term), bool)
        probe = term * self.room + self.first[doc] + position
        at = np.minimum(np.searchsorted(self.keys, probe), len(self.keys) - 1)
        return (self.keys[at] == probe) & (position >= 0) & (position < self.reach[doc])


def _starts(lists: _Lists, phrases: np.ndarray, order: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, document, start) of every occurrence: candidates of the rarest term, cut down term by term.

    With ``slop`` over 0 a term may stand up to that many words away from its place, so the answer is a proximity match.
    """
    ordinal = lists.ordinal(phrases)
    live = np.flatnonzero((ordinal >= 0).all(axis=1))
    rare = ordinal[live, order[live, 0]]
    n = lists.begin[rare + 1] - lists.begin[rare]
    which = np.repeat(live, n)
    at = np.repeat(lists.begin[rare] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    doc, start = lists.docs[at], lists.positions[at] - order[which, 0]
    ok = start >= 0
    which, doc, start = which[ok], doc[ok], start[ok]
    for k in range(1, phrases.shape[1]):
        if not len(which):
            break
        place = order[which, k]
        term = ordinal[which, place]
        ok = lists.holds(term, doc, start + place)
        for d in range(1, slop + 1):
            ok |= lists.holds(term, doc, start + place - d) | lists.holds(term, doc, start + place + d)
        which, doc, start = which[ok], doc[ok], start[ok]
    return which, doc, start


def match_blocks(index: DataFrame, table: dict, slop: int = 0) -> DataFrame:
    """Occurrences of the phrases of ``table`` in the index: block, doc, item, begin, end (words), merged per item.

    ``slop`` 0 gives exact phrases, more gives proximity matches. The table is sent to the tasks; callers bound it.
    """
    shared = index.sparkSession.sparkContext.broadcast(table)

    def run(_, group):
        group = group.combine_chunks()
        real = group.filter(pc.not_equal(group.column("term"), _DOCS)).combine_chunks()
        docs, positions = real.column("docs").combine_chunks(), real.column("positions").combine_chunks()
        sizes = pc.list_value_length(docs).to_numpy(zero_copy_only=False).astype(np.int64)
        lists = _Lists(real.column("term").to_numpy(), sizes, docs.flatten().to_numpy(), positions.flatten().to_numpy())
        found: dict[tuple[int, str], list[tuple[int, int]]] = {}
        for size, (phrases, order, items, _) in shared.value.items():
            for w, d, s in zip(*(x.tolist() for x in _starts(lists, phrases, order, slop)), strict=True):
                for item in items[w]:
                    found.setdefault((d, item), []).append((s, s + size))
        rows = []
        for (d, item), spans in found.items():
            spans.sort()
            begin, end = spans[0]
            for b, e in spans[1:]:
                if b > end:
                    rows.append((d, item, begin, end))
                    begin, end = b, e
                end = max(end, e)
            rows.append((d, item, begin, end))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        block = group.column("block")[0].as_py()
        return pa.table([pa.array([block] * len(rows), pa.int64()), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], ["block", "doc", "item", "begin", "end"])

    return index.groupBy("block").applyInArrow(run, "block long, doc int, item string, begin int, end int")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, slop: int = 0) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, items (sorted strings), contaminated.

    A word is hit if it lies inside an occurrence of ``width`` consecutive words of an item, or of a whole shorter item.
    Null and empty texts have no words and no hits; an item without words matches nothing; repeated documents each get
    their row, with its doc_id as it is, null too; an empty benchmark leaves every document clean. Other columns are ignored.
    """
    items = materialize(item_words(benchmark), "items")
    total = items.agg(F.sum(F.size("words")).alias("n")).first()["n"] or 0
    n_batches = max(1, -(-int(total) // BATCH_WORDS))
    terms = items.select(F.explode("words").alias("term")).distinct()
    n_indexes = min(n_batches, max(1, -(-terms.count() // INDEX_TERMS)))
    of = F.pmod(F.xxhash64("item"), F.lit(n_batches))
    if n_indexes > 1:  # the scans of several indexes must agree on blocks
        docs = materialize(docs.select("doc_id", "text"), "documents", "zstd")
    whole, hits = None, None
    for g in range(n_indexes):
        mine = items.where(F.pmod(of, F.lit(n_indexes)) == g)
        vocabulary = np.array([r["term"] for r in mine.select(F.explode("words").alias("term")).distinct().toLocalIterator()], np.int64)  # about INDEX_TERMS at most
        index = materialize(positional_index(docs, vocabulary.view(np.uint64)), "postings")
        if whole is None:
            listed = index.where(F.col("term") == _DOCS)
            whole = listed.select("block", F.explode(F.arrays_zip("docs", "positions", "doc_ids")).alias("d")).select("block", F.col("d.docs").alias("doc"), F.col("d.positions").cast("long").alias("n_words"), F.col("d.doc_ids").alias("doc_id"))
        frequency = {r["term"]: r["n"] for r in index.where(F.col("term") != _DOCS).groupBy("term").agg(F.sum(F.size("docs")).alias("n")).toLocalIterator()}  # one row per benchmark term
        for b in range(g, n_batches, n_indexes):
            part = [(r["item"], r["words"]) for r in mine.where(of == b).toLocalIterator()]  # about BATCH_WORDS words
            found = match_blocks(index, phrase_table(part, width, frequency), slop)
            hits = found if hits is None else hits.unionByName(found)
    spans = F.sort_array(F.collect_list(F.struct("begin", "end")))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")), lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["reach"], s["begin"]))).alias("n"), F.greatest(a["reach"], s["end"]).alias("reach")))["n"]
    per_doc = hits.groupBy("block", "doc").agg(spans.alias("spans"), F.array_sort(F.collect_set("item")).alias("items")).select("block", "doc", covered.cast("long").alias("n_hit"), "items")
    joined = whole.join(per_doc, ["block", "doc"], "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")).withColumn("contaminated", F.col("n_hit") > 0)


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` against all of ``benchmark``."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP9_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS ws FROM documents),
i AS (SELECT item_id, coalesce({_WORDS.format("text")}, []) AS ws FROM benchmark),
p AS (SELECT DISTINCT item_id, w, array_to_string(ws[k : k + w - 1], ' ') AS phrase
      FROM (SELECT item_id, ws, least(10, len(ws)) AS w, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS k FROM i WHERE len(ws) > 0)),
s AS (SELECT d.doc_id, v.w, k, array_to_string(d.ws[k : k + v.w - 1], ' ') AS phrase
      FROM d, (SELECT DISTINCT w FROM p) v, unnest(range(1, len(d.ws) - v.w + 2)) AS t(k)),
h AS (SELECT s.doc_id, s.k, s.w, p.item_id FROM s JOIN p ON s.w = p.w AND s.phrase = p.phrase),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + w)) AS x FROM (SELECT DISTINCT doc_id, k, w FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

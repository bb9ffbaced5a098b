"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

Lengths are bounded by the sequence length, so the histogram of lengths has a fixed size: the packing is planned on it,
as bin patterns with multiplicities, and each piece then finds its place from its rank among the pieces of its length.
The plan grows with the sequence length, not with the corpus; the pieces themselves never leave the executors.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize
from .textbytes import flat, slices
from .word_tokens import worker

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def token_pieces(docs: DataFrame, vocabulary_path: str, max_tokens: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of each document's ids (``end_id`` last): doc_id, piece, start, length, ids_crc32 and, if asked, ids.

    Null text is empty and gives one piece that holds ``end_id`` alone; only documents beyond ``max_tokens`` are cut.
    Rows that repeat, also by doc_id, each give their pieces. Whole documents are encoded, a few MB at a time.
    """

    def run(batches):
        tokens = worker(vocabulary_path)
        for batch in batches:
            data, offsets = flat(batch.column(1))
            doc_ids = batch.column(0)
            for i, j in slices(offsets):
                index, piece, start, length, crc, held = [], [], [], [], [], []
                for r, ids in enumerate(tokens.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for k, s in enumerate(range(0, len(ids), max_tokens)):
                        part = ids[s : s + max_tokens]
                        index.append(i + r)
                        piece.append(k)
                        start.append(s)
                        length.append(len(part))
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            held.append(part.astype(np.int32))
                arrays = [doc_ids.take(pa.array(index, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array(held, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def _pair(count: np.ndarray, used: Counter, low: int, room: int) -> tuple[int, int] | None:
    """Two lengths still there whose sum is the largest above ``low`` and at most ``room``; ties to the larger first."""
    top = min(room - 1, len(count) - 1)
    if top < 1:
        return None
    left = count[: top + 1].copy()
    for size, n in used.items():
        if size <= top:
            left[size] -= n
    sizes = np.flatnonzero(left > 0)
    if not len(sizes):
        return None
    below = np.where(left > 0, np.arange(top + 1), 0)
    np.maximum.accumulate(below, out=below)
    other = below[np.minimum(room - sizes, top)]
    twin = (other == sizes) & (left[sizes] < 2)
    other[twin] = below[sizes[twin] - 1]
    total = np.where(other > 0, sizes + other, 0)
    best = len(sizes) - 1 - int(np.argmax(total[::-1]))
    return (int(sizes[best]), int(other[best])) if total[best] > low else None


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best-two-fit on a histogram of lengths: (lengths of a bin, how many bins are filled so).

    Each bin takes the largest length that fits until none does; then its smallest one gives way to two that fill the
    gap it leaves more tightly, if there are two. Bins that come out alike in a row are counted, not repeated.
    """
    count = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        count[size] += n
    bins = []
    while True:
        live = np.where(count > 0, np.arange(capacity + 1), 0)
        np.maximum.accumulate(live, out=live)
        if not live[capacity]:
            return bins
        items, gap, cursor = [], capacity, capacity
        while gap and cursor and (size := int(live[min(gap, cursor)])):
            n = min(int(count[size]), gap // size)
            items += [size] * n
            gap -= n * size
            cursor = size - 1
        if gap and len(items) > 1:
            kept = items[:-1]
            if pair := _pair(count, Counter(kept), items[-1], gap + items[-1]):
                items = kept + list(pair)
        uses = Counter(items)
        times = min(int(count[size]) // n for size, n in uses.items())
        for size, n in uses.items():
            count[size] -= n * times
        bins.append((items, times))


def slot_runs(bins: list[tuple[list[int], int]], capacity: int) -> dict[str, np.ndarray]:
    """For each length, runs of ranks: rank lo and up stand in sequences first, first + 1, ... at one offset."""
    rank, runs, sequence = np.zeros(capacity + 1, np.int64), [], 0
    for items, times in bins:
        offset = 0
        for size in items:
            runs.append((size, int(rank[size]), sequence, offset))
            rank[size] += times
            offset += size
        sequence += times
    runs.sort()
    cols = np.array(runs, np.int64).reshape(len(runs), 4)
    return {"key": (cols[:, 0] << 48) + cols[:, 1], "lo": cols[:, 1], "first": cols[:, 2], "offset": cols[:, 3]}


def best_two_fit(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """``pieces`` (any columns, one of them ``length``, 1 to ``capacity``) with sequence_id and offset.

    Input columns sequence_id and offset are replaced. Null lengths are an error. The ranks come from counts by
    (block of rows, length), so a length that a third of all rows share is ranked by many tasks. Empty in, empty out.
    """
    spark = pieces.sparkSession
    keep = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    rows = materialize(pieces.select(F.struct(*[pieces[c] for c in keep]).alias("row"), F.assert_true(pieces["length"].between(1, capacity), F.lit("length outside 1..capacity")).alias("ok"), pieces["length"].cast("long").alias("size"), F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("rid")).drop("ok"), "pieces")
    counts = rows.groupBy("size", "block").count()
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("count").alias("n")).collect()}  # capacity rows at most
    runs = spark.sparkContext.broadcast(slot_runs(plan_bins(histogram, capacity), capacity))
    earlier = Window.partitionBy("size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("count").over(earlier), F.lit(0))).drop("count")
    ranked = rows.withColumn("at", F.row_number().over(Window.partitionBy("block", "size").orderBy("rid")) - 1).join(starts, ["block", "size"]).select("row", "size", (F.col("start") + F.col("at")).alias("rank"))

    def place(batches):
        r = runs.value
        for batch in batches:
            size, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            i = np.searchsorted(r["key"], (size.astype(np.int64) << 48) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(r["first"][i] + rank - r["lo"][i], pa.int64()), pa.array(r["offset"][i], pa.int64())], ["row", "sequence_id", "offset"])

    row = ranked.schema["row"].dataType.simpleString()
    placed = ranked.mapInArrow(place, f"row {row}, sequence_id long, offset long")
    return placed.select(*[F.col("row")[c].alias(c) for c in keep], "sequence_id", "offset")


def pack_documents(docs: DataFrame, vocabulary_path: str | None = None, max_tokens: int = 4096, end_id: int = 1) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most ``max_tokens`` tokens."""
    return best_two_fit(token_pieces(docs, vocabulary_path or vocabulary(), max_tokens, end_id), max_tokens)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of 4096 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))

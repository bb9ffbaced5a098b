"""Token counts of document sections: encode each whole document once, then attribute tokens by their spans.

Byte-level tokens concatenate to the text, so running sums of token lengths are their spans; an interval join of those
spans with the section bounds says which tokens lie in, begin in or cross each section.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import flat, slices

RULES = ("first", "majority", "split")


class ByteTokens:
    """A byte-level vocabulary and the byte length of each of its tokens."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.size[rank] = len(token)


_WORKER: dict[str, ByteTokens] = {}


def _worker(path: str) -> ByteTokens:
    if path not in _WORKER:
        _WORKER[path] = ByteTokens(path)
    return _WORKER[path]


def line_bounds(data: np.ndarray) -> np.ndarray:
    """Byte bounds of the lines of a text, each with its line feed; the bounds cover the text."""
    cut = np.flatnonzero(data == 10) + 1
    return np.unique(np.concatenate([[0], cut, [len(data)]]))


def attribute(ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens by their end bytes, sections by their bounds: counts by first byte, by majority, split by bytes, crossing.

    A token belongs to the section of its first byte (``first``), to the one that holds most of it, the earlier one in
    a tie (``majority``), or to each in proportion to the bytes it has there (``split``). Crossing tokens touch two
    sections or more and count in each.
    """
    n = len(bounds) - 1
    begins = np.concatenate([[0], ends[:-1]])
    lo, hi = np.searchsorted(bounds, begins, "right") - 1, np.searchsorted(bounds, ends, "left") - 1
    first = np.bincount(lo, minlength=n).astype(np.int64)
    major, split, crossing = first.copy(), first.astype(np.float64), np.zeros(n, np.int64)
    over = np.flatnonzero(hi > lo)
    if len(over):
        n_parts = hi[over] - lo[over] + 1
        start = np.cumsum(n_parts) - n_parts
        token = np.repeat(over, n_parts)
        parts = np.arange(len(token)) - np.repeat(start - lo[over], n_parts)
        held = np.minimum(bounds[parts + 1], ends[token]) - np.maximum(bounds[parts], begins[token])
        np.add.at(crossing, parts, 1)
        most = np.repeat(np.maximum.reduceat(held, start), n_parts)
        best = np.flatnonzero(held == most)
        best = best[np.unique(token[best], return_index=True)[1]]  # the earlier one in a tie
        np.add.at(major, lo[over], -1)
        np.add.at(major, parts[best], 1)
        np.add.at(split, lo[over], -1.0)
        np.add.at(split, parts, held / np.repeat(np.add.reduceat(held, start), n_parts))
    return first, major, split, crossing


def section_token_counts(docs: DataFrame, vocabulary_path: str, bounds_of=line_bounds) -> DataFrame:
    """A row for each section of each document (doc_id, text): section (from 0), begin and end (characters, end
    exclusive), n_tokens (rule first), n_majority, n_split, n_crossing.

    ``bounds_of`` gives the byte bounds of a text's sections; they start at 0, ascend and end at its length. The counts
    of each rule add up to the document's tokens. Null and empty texts have no sections and give no row; repeated rows
    each give theirs, and a null doc_id comes back null; a text is encoded whole whatever its length; other columns are
    ignored.
    """

    def run(batches):
        tokens = _worker(vocabulary_path)
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for i, j in slices(offsets):
                index, cols = [], [[] for _ in range(7)]
                for r in range(i, j):
                    own = data[offsets[r] : offsets[r + 1]]
                    if not len(own):
                        continue
                    ends = np.cumsum(tokens.size[tokens.encoding.encode_ordinary(own.tobytes().decode("utf-8"))])
                    bounds = bounds_of(own)
                    lead = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
                    index.append(np.full(len(bounds) - 1, r))
                    for col, values in zip(cols, (np.arange(len(bounds) - 1), lead[bounds[:-1]], lead[bounds[1:]], *attribute(ends, bounds)), strict=True):
                        col.append(values)
                if index:
                    section, begin, end, first, major, split, crossing = map(np.concatenate, cols)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(np.concatenate(index))), pa.array(section.astype(np.int32)), pa.array(begin), pa.array(end), pa.array(first), pa.array(major), pa.array(split), pa.array(crossing)],
                        ["doc_id", "section", "begin", "end", "n_tokens", "n_majority", "n_split", "n_crossing"],
                    )

    schema = "doc_id long, section int, begin long, end long, n_tokens long, n_majority long, n_split double, n_crossing long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of each line of all ``documents``."""
    import public_tokenizers

    return section_token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"))

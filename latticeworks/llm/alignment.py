"""Alignment of two tokenizers: groups of tokens between common byte offsets, links of overlapping tokens, their counts.

Offsets at which a token of each tokenizer ends cut a text into groups. Texts are cut where tokens of both end for
certain, so a distinct word is encoded and aligned once; a document's groups are its words' groups one behind the other
and its links are theirs added up. A group of one token each whose ids are the same bytes by an array fixed beforehand
is counted in a vector as long as the vocabulary; only the links of other groups go through a shuffle of pairs. Pairs
that hold a fixed share of all links are few by that share, so their counts go to the tasks as an array; documents ask
for the counts of the others by a join.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize
from .textbytes import flat, slices

#: A pair with at least this share of all links is frequent: there are at most 1 / SHARE of them.
SHARE = 1 / 20_000
#: Distinct pairs that a task keeps before it passes them on; words, and characters of words, that a worker remembers.
KEPT, WORDS, LETTERS = 1 << 20, 300_000, 1 << 22
#: Words that are encoded as one text.
JOINED = 1024
_BOUNDARY = re.compile(r"(?<=\S)(?= .)", re.DOTALL)
_INNER = re.compile("[^▁]▁")


def _byte_letters() -> dict[str, int]:
    """The byte behind each letter of byte-level vocabularies: printable ones stand for themselves, others follow 255."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class _Grown:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.room, self.used = np.zeros(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        end = self.used + len(values)
        if end > len(self.room):
            self.room = np.concatenate([self.room[: self.used], np.zeros(max(end, self.used * 3 // 2) - self.used, self.room.dtype)])
        self.room[self.used : end], self.used = values, end


class _Pool:
    """Lists of numbers one behind the other, by the number of the list."""

    def __init__(self, kind):
        self.values, self.bounds = _Grown(kind), _Grown(np.int64)
        self.bounds.add(np.zeros(1, np.int64))

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.bounds.add(self.values.used + np.cumsum(sizes))
        self.values.add(values)

    def sizes(self, numbers: np.ndarray) -> np.ndarray:
        return self.bounds.room[numbers + 1] - self.bounds.room[numbers]

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        sizes = self.sizes(numbers)
        before = np.cumsum(sizes) - sizes
        return self.values.room[np.repeat(self.bounds.room[numbers] - before, sizes) + np.arange(int(sizes.sum()))]


class _Numbers(dict):
    """Words, without the space before them, by the order in which they came; ``fresh`` are those not yet encoded. A word
    asked for is added; one that is empty or begins with a space has no number of its own (-1) unless it is added by name."""

    def __init__(self):
        super().__init__()
        self.fresh = []

    def add(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n

    def __missing__(self, word: str) -> int:
        return self.add(word) if word and not word[0].isspace() else -1


class Vocabularies:
    """Tokenizer A (byte level), tokenizer B (pieces), the bytes of their tokens and ``same``: for each id of A the id of
    B with the same bytes, or -1. Words that were encoded are remembered with their ids, groups and links."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters, vocabulary = _byte_letters(), self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        plain = [p.replace("▁", " ").encode() for p in pieces]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else plain[i] for i, p in enumerate(pieces)]
        usable = [i for i in range(len(pieces)) if not self.b.is_control(i) and not self.b.is_unknown(i)]
        at = {self.b_bytes[i]: i for i in sorted(usable, key=lambda i: not self.b.is_byte(i))}  # a piece goes before a byte
        self.same = np.array([at.get(t, -1) for t in self.a_bytes], np.int64)
        self.cuttable = not any(_INNER.search(p) for p in pieces)
        self.a_size, self.b_size = (np.array([len(t) for t in v], np.int64) for v in (self.a_bytes, self.b_bytes))
        names = [[f"{i}{end}" for i in range(len(v))] for v, end in ((self.a_bytes, ","), (self.a_bytes, "|"), (self.b_bytes, ","), (self.b_bytes, ";"))]
        self.names = np.array(sum(names, []), object)  # of A inside and at the end of a group, then of B
        self._forget()

    def _forget(self) -> None:
        self.number, self.letters, self.known_a, self.known_b, self.links = _Numbers(), 0, _Pool(np.int32), _Pool(np.int32), _Pool(np.int64)
        self.n_groups, self.groups = _Grown(np.int32), []

    def words(self, text: str) -> list[str]:
        """A space and the text, cut before spaces behind other characters: no token of A or B reaches over such a place,
        so the words' tokens are those of the whole (a last space stays with its word). If B has a piece that does, there is one word."""
        return _BOUNDARY.split(" " + text) if self.cuttable else [" " + text]

    def _units(self, words: list[str]) -> list[list[str]]:
        """Words to encode as one text: the place between two is one that ``words`` cuts, or a space before another
        character, behind no space. B never spells its letter for a space, so a word that holds it stands alone."""
        units, room, end = [], 0, ""
        for w in words:
            if room and w and (not end.isspace() if w[0].isspace() else end != " ") and "▁" not in w:
                units[-1].append(w)
                room -= 1
            else:
                units.append([w])
                room = JOINED - 1 if self.cuttable and "▁" not in w else 0
            end = w[-1:]
        return units

    def _spelled(self, units: list[list[str]]) -> list[tuple[list[int], list[int], list[int]]]:
        """Bytes of each word with its space and ids of A and B, by unit. Halves of a unit that its ids don't spell are
        tried anew; a word that they don't spell has no bytes and no ids."""
        texts, out = [" ".join(u) for u in units], []
        a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        b = self.b.encode(texts, num_threads=1)
        for unit, text, x, y in zip(units, texts, a, b, strict=True):
            if b"".join(map(self.a_bytes.__getitem__, x)) == (" " + text).encode() == b"".join(map(self.b_bytes.__getitem__, y)):
                out.append(([len(w.encode()) + 1 for w in unit], x, y))
            elif len(unit) == 1:
                out.append(([0], [], []))
            else:
                out += self._spelled([unit[: len(unit) // 2], unit[len(unit) // 2 :]])
        return out

    def _ids(self, units: list[list[str]]) -> list[np.ndarray]:
        """Ids of A over all words one behind the other, how many each word has, and the same of B."""
        sizes, *sides = (np.fromiter(chain.from_iterable(x), np.int64) for x in zip(*self._spelled(units), strict=True))
        ends, out = np.cumsum(sizes), []
        for ids, size in zip(sides, (self.a_size, self.b_size), strict=True):
            upto = np.concatenate([[0], np.cumsum(size[ids])])
            at = np.searchsorted(upto, ends)
            if not np.array_equal(upto[at], ends):  # a token reaches over the end of a word
                return self._ids([[w] for u in units for w in u])
            out += [ids, np.diff(at, prepend=0)]
        return out

    def _learn(self, new: list[str]) -> None:
        a, a_sizes, b, b_sizes = self._ids(self._units(new))
        n_groups, groups, links, n_links = align(self, a, a_sizes, b, b_sizes)
        self.known_a.add(a, a_sizes)
        self.known_b.add(b, b_sizes)
        self.links.add(links, n_links)
        self.n_groups.add(n_groups)
        self.groups += groups
        self.letters += sum(map(len, new))

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of all texts, and the text of each; none for a text of which some word is not spelled by its
        ids. All words are known then."""
        if len(self.number) > WORDS or self.letters > LETTERS:
            self._forget()
        number, flat, sizes = self.number, [], []
        # A takes the last of several characters of white space to what follows if it is a space, so any space before other
        # than white space is such a place too. A text with other spaces (numbers below 0) is cut by ``words``.
        for t in texts:
            own = t.split(" ") if t and self.cuttable else []
            flat += own
            sizes.append(len(own))
        numbers, sizes = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat)), np.array(sizes, np.int64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        odd = np.unique(owner[numbers < 0]).tolist() if self.cuttable else [i for i, t in enumerate(texts) if t]
        if odd:
            parts = np.split(numbers, np.cumsum(sizes)[:-1])
            for i in odd:
                parts[i] = np.array([number[w] if w in number else number.add(w) for w in (x[1:] for x in self.words(texts[i]))], np.int64)
            numbers, owner = np.concatenate(parts), np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        for k in range(0, len(number.fresh), 4096):
            self._learn(number.fresh[k : k + 4096])
        number.fresh = []
        right = (np.bincount(owner, self.n_groups.room[numbers] == 0, minlength=len(texts)) == 0)[owner]
        return numbers[right], owner[right]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A over a space and each text with the bounds of the texts, and the same of B over the text; none for a
        text of which some word is not spelled by its ids."""
        numbers, owner = self.numbers(texts)
        bounds = lambda pool: np.concatenate([[0], np.cumsum(_added(owner, pool.sizes(numbers), len(texts)))])
        return self.known_a.gather(numbers), bounds(self.known_a), self.known_b.gather(numbers), bounds(self.known_b)


_WORKER: dict[tuple[str, str], Vocabularies] = {}


def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    """This process's pair of tokenizers."""
    if (a_path, b_path) not in _WORKER:
        _WORKER[a_path, b_path] = Vocabularies(a_path, b_path)
    return _WORKER[a_path, b_path]


def _lists(owner: np.ndarray, values: np.ndarray, n: int, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), pa.array(values.astype(kind)))


def _added(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Whole numbers added up by their owner, of n."""
    return np.bincount(owner, values, minlength=n).astype(np.int64)


def align(v: Vocabularies, a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Of several texts, given by their ids of A and B one behind the other and how many each has: the number of groups,
    the groups (each with its semicolon), the links one behind the other and how many each text has. A link in a group of
    its own between the same bytes is its id of A; any other is a * size of B + b behind all ids of A."""
    a_ends, b_ends = np.cumsum(v.a_size[a]), np.cumsum(v.b_size[b])
    at = np.zeros((2, int(a_ends[-1]) + 1 if len(a) else 1), bool)
    at[0, a_ends], at[1, b_ends] = True, True
    cuts = np.flatnonzero(at[0] | at[1])
    # Between two neighbouring cuts lies one overlap of one token of A with one of B.
    in_a, in_b = at[0, cuts], at[1, cuts]
    both = in_a & in_b
    link_a, link_b, group = a[np.cumsum(in_a) - in_a], b[np.cumsum(in_b) - in_b], np.cumsum(both) - both
    regular = (np.bincount(group)[group] == 1) & (v.same[link_a] == link_b)
    links = np.where(regular, link_a, len(v.a_bytes) + link_a * len(v.b_bytes) + link_b)
    # In the text, the tokens of A stand behind those of B of earlier groups, and those of B behind all of A of their group.
    a_group, b_group, n = group[in_a], group[in_b], int(both.sum())
    a_upto, b_upto = (np.concatenate([[0], np.cumsum(np.bincount(g, minlength=n))]) for g in (a_group, b_group))
    name = np.empty(len(a) + len(b), np.int64)
    name[np.arange(len(a)) + b_upto[a_group]] = a + len(v.a_bytes) * both[in_a]
    name[np.arange(len(b)) + a_upto[b_group + 1]] = b + 2 * len(v.a_bytes) + len(v.b_bytes) * both[in_b]
    names, ends = v.names[name].tolist(), np.cumsum(a_sizes + b_sizes).tolist()
    doc_ends = np.concatenate([[0], a_ends])[np.cumsum(a_sizes)]
    n_groups = np.diff(np.searchsorted(cuts[both], doc_ends, "right"), prepend=0)
    return n_groups, ["".join(names[i:j]) for i, j in zip([0, *ends], ends, strict=False)], links, a_sizes + b_sizes - n_groups


def _documents(v: Vocabularies, texts: list[str]) -> dict[str, pa.Array]:
    """Groups and links of several documents."""
    n, size = len(texts), len(v.a_bytes) * (len(v.b_bytes) + 1)
    numbers, owner = v.numbers(texts)
    group_of, ends = list(map(v.groups.__getitem__, numbers.tolist())), np.searchsorted(owner, np.arange(n + 1)).tolist()
    n_a, n_b, n_links, n_groups = (_added(owner, x, n) for x in (*(p.sizes(numbers) for p in (v.known_a, v.known_b, v.links)), v.n_groups.room[numbers]))
    both, times = np.unique(np.repeat(np.arange(n), n_links) * size + v.links.gather(numbers), return_counts=True)
    doc, link = np.divmod(both, size)
    alone = link < len(v.a_bytes)
    return {
        "n_a": pa.array(n_a),
        "n_b": pa.array(n_b),
        "n_groups": pa.array(n_groups),
        "n_links": pa.array(n_links),
        "groups": pa.array(["".join(group_of[i:j])[:-1] for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.string()),
        "same": _lists(doc[alone], link[alone], n, np.int32),
        "same_n": _lists(doc[alone], times[alone], n, np.int32),
        "pair": _lists(doc[~alone], link[~alone] - len(v.a_bytes), n, np.int64),
        "pair_n": _lists(doc[~alone], times[~alone], n, np.int32),
    }


_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, same array<int>, same_n array<int>, pair array<long>, pair_n array<int>"


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_a, n_b (tokens), n_groups, n_links, groups (``a1,a2|b1;a3|b2`` in order),
    same and same_n (ids of A that stand alone against the same bytes of B, and how often), pair and pair_n (a * size of
    B + b of all other links, and how often).

    Texts that are null, empty, or whose tokens do not spell a space and the text (a tokenizer that changes them) have
    no tokens: zeros, an empty string, empty lists. A doc_id may be null or repeated: every row stands for itself. Long
    texts are encoded by words, which give the tokens of the whole; other columns are ignored; empty in, empty out.
    """

    def run(batches):
        v = vocabularies(a_path, b_path)
        for batch in batches:
            _, offsets = flat(batch.column(1))
            for i, j in slices(offsets):
                columns = _documents(v, batch.column(1).slice(i, j - i).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns.values()], ["doc_id", *columns])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, _ALIGNED)


def pair_counts(rows: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """key (a * size of B + b), n: how many links of all ``rows`` of ``aligned`` hold each pair.

    A task adds its one-to-one groups up in a vector over the ids of A and gives that at its end; links of other groups
    are summed in a bounded table before they are shuffled.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        v = vocabularies(a_path, b_path)
        alone, keys, sums = np.zeros(len(v.a_bytes), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        given = lambda k, n: pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["key", "n"])
        for batch in batches:
            same, same_n, pair, pair_n = (batch.column(c).flatten().to_numpy() for c in range(4))
            np.add.at(alone, same, same_n)
            keys, where = np.unique(np.concatenate([keys, pair]), return_inverse=True)
            sums = np.bincount(where, np.concatenate([sums, pair_n])).astype(np.int64)
            if len(keys) > KEPT:
                yield given(keys, sums)
                keys, sums = keys[:0], sums[:0]
        yield given(keys, sums)
        seen = np.flatnonzero(alone)
        yield given(seen * len(v.b_bytes) + v.same[seen], alone[seen])

    return rows.select("same", "same_n", "pair", "pair_n").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def link_totals(rows: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``rows`` of ``aligned`` without the lists, with n_best (links whose pair no other of the same id of B exceeds in
    all rows) and count_sum (the corpus-wide counts of all links added up)."""
    v = vocabularies(a_path, b_path)
    size_b, n_a = len(v.b_bytes), len(v.a_bytes)
    rows = materialize(rows.withColumn("rid", F.monotonically_increasing_id()), "aligned", "zstd")
    counts = materialize(pair_counts(rows, a_path, b_path), "pairs")
    top = counts.groupBy((F.col("key") % size_b).alias("b")).agg(F.max("n").alias("most"))  # at most one row for each id of B
    ranked = materialize(counts.withColumn("b", F.col("key") % size_b).join(F.broadcast(top), "b").select("key", "n", (F.col("n") == F.col("most")).alias("best")), "ranked")
    total = ranked.agg(F.sum("n")).first()[0] or 0
    matched = ranked.sparkSession.createDataFrame([(int(a * size_b + v.same[a]),) for a in range(n_a) if v.same[a] >= 0], "key long")
    frequent = ranked.where(F.col("n") >= total * SHARE).union(ranked.where(F.col("n") < total * SHARE).join(F.broadcast(matched), "key", "left_semi").select("key", "n", "best"))
    known = frequent.toPandas().sort_values("key")  # at most 1 / SHARE rows and one for each id of A
    table = rows.sparkSession.sparkContext.broadcast(tuple(known[c].to_numpy() for c in ("key", "n", "best")))

    def run(batches) -> Iterator[pa.RecordBatch]:
        same_of = vocabularies(a_path, b_path).same
        key, count, best = table.value
        for batch in batches:
            lists = {c: batch.column(c) for c in ("same", "same_n", "pair", "pair_n")}
            flatten = {c: x.flatten().to_numpy() for c, x in lists.items()}
            n, made = batch.num_rows, np.zeros((2, batch.num_rows), np.int64)
            rest = None
            for ids, times, keys in (("same", "same_n", flatten["same"].astype(np.int64) * size_b + same_of[flatten["same"]]), ("pair", "pair_n", flatten["pair"])):
                doc = np.repeat(np.arange(n), np.diff(lists[ids].offsets.to_numpy()))
                at = np.minimum(np.searchsorted(key, keys), max(len(key) - 1, 0))
                found = key[at] == keys if len(key) else np.zeros(len(keys), bool)
                np.add.at(made[0], doc[found], flatten[times][found] * best[at[found]])
                np.add.at(made[1], doc[found], flatten[times][found] * count[at[found]])
                rest = doc[~found], keys[~found], flatten[times][~found]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(made[0]), pa.array(made[1]), _lists(rest[0], rest[1], n, np.int64), _lists(rest[0], rest[2], n, np.int32)], ["rid", "best", "sum", "pair", "pair_n"])

    asked = rows.select("rid", "same", "same_n", "pair", "pair_n").mapInArrow(run, "rid long, best long, sum long, pair array<long>, pair_n array<int>")
    asked = materialize(asked, "asked", "zstd")
    rare = asked.select("rid", F.explode(F.arrays_zip("pair", "pair_n")).alias("x")).select("rid", F.col("x.pair").alias("key"), F.col("x.pair_n").alias("times"))
    answered = rare.join(ranked, "key").groupBy("rid").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("rare_best"), F.sum(F.col("times") * F.col("n")).alias("rare_sum"))
    joined = rows.drop("same", "same_n", "pair", "pair_n").join(asked.select("rid", "best", "sum"), "rid").join(answered, "rid", "left")
    plus = lambda x, y: F.col(x) + F.coalesce(y, F.lit(0))
    return joined.withColumn("n_best", plus("best", "rare_best")).withColumn("count_sum", plus("sum", "rare_sum")).drop("rid", "best", "sum", "rare_best", "rare_sum")


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` under the byte-level and the piece vocabulary."""
    import public_tokenizers

    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    rows = aligned(spark.read.parquet(f"{sf_dir}/documents.parquet"), a, b)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return link_totals(rows.withColumn("groups_sha256", digest).drop("groups"), a, b)

"""Toxicity by a weighted lexicon: folding, one Aho-Corasick pass, length normalisation, exception phrases.

Entries are whole words and word beginnings whose rate in toxic documents stands out; weights are logarithms of rate
ratios learned from labelled rows, next to a short list of insults that holds without labels. Scores come from a small
logistic model of the matched weight and the text's length, fitted on labelled rows that the lexicon has not seen.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import flat, slices

# Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
HOMOGLYPHS = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ⅼ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ⅰ": "i"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
# Insults that count without any label, and phrases in which such a word is harmless.
INSULTS = ("idiot", "idiots", "moron", "morons", "imbecile", "stupid", "dumb", "loser", "losers", "scum", "trash", "garbage", "pathetic", "worthless", "disgusting", "clown", "clowns", "jerk", "freak", "creep", "filth", "vermin", "pig", "fool")
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash bag", "trash collection", "garbage collector", "garbage collection", "garbage truck", "garbage can", "garbage bin", "clown fish", "circus clown", "class clown", "guinea pig", "pig iron", "dumb bell", "dumb terminal", "sore loser", "stupid question")

#: Labelled rows used at most (expected number; rows are chosen by a hash of doc_id).
TRAINING_ROWS = 20_000
#: Bytes of text that a task folds at a time (a longer text stands alone).
SLICE = 500_000
_PREFIXES = (4, 5, 6, 7)
_SAME = {**HOMOGLYPHS, **{chr(0xFF01 + i): chr(0x21 + i).lower() for i in range(94)}, **dict.fromkeys("\u200b\u200c\u200d\u00ad", "")}


class _Letters(dict):
    """What each character becomes: its look-alike, itself if it belongs to a word, else a space; filled as met."""

    def __missing__(self, code: int) -> str:
        seen = _SAME.get(chr(code), chr(code))
        self[code] = seen if not seen or seen.isalnum() else " "
        return self[code]


_MAP = _Letters()
_DIGITS = str.maketrans({k: v for k, v in DIGITS.items() if k.isdigit()})
_SIGN = re.compile(r"[@$!](?=[^\W\d_])")
_RUN = re.compile(r"[0-9]+")


def _sign(m: re.Match) -> str:
    at, text = m.start(), m.string
    return DIGITS[m[0]] if at and text[at - 1].isalpha() else m[0]


def _digits(m: re.Match) -> str:
    (b, e), text = m.span(), m.string
    inside = (b and text[b - 1].isalpha()) or (e < len(text) and text[e].isalpha())
    return m[0].translate(_DIGITS) if inside else m[0]


def fold(text: str) -> str:
    """The words of ``text`` folded to look-alike Latin letters, each between single spaces.

    A sign stands for a letter between two letters, a run of digits next to one.
    """
    text = text.lower()
    if "@" in text or "$" in text or "!" in text:
        text = _SIGN.sub(_sign, text)
    text = _RUN.sub(_digits, text)
    return " " + " ".join(text.translate(_MAP).split()) + " "


@dataclass
class Lexicon:
    """Entries (" word " or " beginning") with weights, exception phrases, and the logistic model over features()."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    model: list[float] = field(default_factory=lambda: [-2.2, 1.6, 0.4, 0.3, 0.0, 0.4])

    def automaton(self):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            machine.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            machine.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if len(machine):
            machine.make_automaton()
        return machine


def features(machine, folded: str) -> tuple[float, float, float, float, float]:
    """log(1 + weight), log(1 + weight per 100 words), log(1 + matched words), log(1 + words), largest weight.

    A word counts once, with its heaviest entry, and not at all inside an exception phrase.
    """
    n = folded.count(" ") - 1 if len(folded) > 2 else 0
    best: dict[int, float] = {}
    excused: list[tuple[int, int]] = []
    if len(machine):
        for end, (size, weight) in machine.iter(folded):
            start = end - size + 1
            if weight is None:
                excused.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
    for b, e in excused:
        for s in [s for s in best if b <= s < e]:
            del best[s]
    total = sum(best.values())
    return (np.log1p(total), np.log1p(100 * total / (n + 10)), np.log1p(len(best)), np.log1p(n), max(best.values(), default=0.0))


def _entries(folded: str) -> Counter:
    """How often each possible entry occurs in a folded text."""
    out: Counter = Counter()
    for word, n in Counter(folded.split()).items():
        out[f" {word} "] += n
        for k in _PREFIXES:
            if len(word) > k:
                out[f" {word[:k]}"] += n
    return out


def _train_part(labelled: DataFrame, name: str) -> DataFrame:
    """Rows of the lexicon part (three quarters) or the model part of the labelled rows."""
    quarter = F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 5) % 4
    return labelled.where(quarter == 0 if name == "model" else quarter != 0)


def _count(rows: DataFrame, candidates: set[str] | None) -> DataFrame:
    """entry, documents and occurrences in rows (text, toxic) by label, with the number of words under the entry ''."""
    shared = rows.sparkSession.sparkContext.broadcast(candidates)

    def run(batches):
        held = shared.value
        for batch in _sliced(batches, 0):
            seen: dict[tuple[str, int], list[int]] = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = _entries(fold(text or ""))
                total = sum(n for entry, n in counts.items() if entry[-1] == " ")
                for entry, n in [("", total), *((e, n) for e, n in counts.items() if held is None or e in held)]:
                    cell = seen.setdefault((entry, toxic), [0, 0])
                    cell[0] += 1
                    cell[1] += n
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.int32()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], ["entry", "toxic", "docs", "uses"])

    counted = rows.select("text", "toxic").mapInArrow(run, "entry string, toxic int, docs long, uses long")
    return counted.groupBy("entry", "toxic").agg(F.sum("docs").alias("docs"), F.sum("uses").alias("uses"))


def _fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> list[float]:
    """Logistic regression by Newton steps; the intercept is not penalised."""
    a = np.column_stack([np.ones(len(x)), x])
    mean, spread = a.mean(axis=0), a.std(axis=0) + 1e-9
    mean[0], spread[0] = 0.0, 1.0
    a = (a - mean) / spread
    ridge = np.diag([1e-6] + [penalty] * x.shape[1])
    beta = np.zeros(a.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        grad = a.T @ (p - y) + ridge @ beta
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, grad)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    beta = beta / spread
    beta[0] -= float(beta[1:] @ mean[1:])
    return beta.tolist()


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Lexicon:
    """A lexicon from labelled documents (doc_id, text) and labels (doc_id, toxic); no other column is an input.

    Rows whose crc32(doc_id as text) is divisible by 5 are held out. About ``rows`` labelled rows are used, chosen by a
    hash of doc_id: the bound on what is broadcast and collected, as a candidate entry stands in two of them at least.
    Null labels are left out; several labels of one
    document count as toxic if one is. With too few labels the insults and a fixed model remain.
    """
    fixed = Lexicon({f" {w} ": 3.0 for w in INSULTS})
    fold_of = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    train = labels.where(fold_of != 0).where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    share = min(1.0, rows / max(1, train.count()))
    chosen = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    texts = docs.select(F.col("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    part = _train_part(texts, "lexicon")
    common = _count(part.where("toxic = 1"), None).where("docs >= 2 or entry = ''").collect()
    in_toxic = {r["entry"]: (r["docs"], r["uses"]) for r in common}
    n_toxic, words_toxic = in_toxic.pop("", (0, 0))
    if n_toxic < 5:
        return fixed
    clean = {r["entry"]: (r["docs"], r["uses"]) for r in _count(part.where("toxic = 0"), set(in_toxic)).collect()}  # the same entries at most
    n_clean, words_clean = clean.pop("", (0, 0))
    if n_clean < 5:
        return fixed
    found = []
    for entry, (docs_t, uses_t) in in_toxic.items():
        docs_c, uses_c = clean.get(entry, (0, 0))
        weight = np.log((uses_t + 0.2) / (words_toxic + 20)) - np.log((uses_c + 0.7) / (words_clean + 20))
        odds = np.log((docs_t + 0.5) / (n_toxic - docs_t + 0.5)) - np.log((docs_c + 0.5) / (n_clean - docs_c + 0.5))
        error = np.sqrt(1 / (docs_t + 0.5) + 1 / (docs_c + 0.5))
        if weight > 1.0 and odds / error > 2.6:
            found.append((entry, float(min(weight, 8.0))))
    weights = {entry: weight for entry, weight in sorted(found)}
    for entry in fixed.weights:
        uses = clean.get(entry, (0, 0))[0]
        if entry not in weights and uses == 0:
            weights[entry] = 3.0
    lexicon = Lexicon(weights)
    held = _features(_train_part(texts, "model"), lexicon, ["toxic"]).select("toxic", "f").collect()  # a quarter of ``rows``
    x, y = np.array([r["f"] for r in held], float).reshape(len(held), 5), np.array([r["toxic"] for r in held], float)
    if min(y.sum(), len(y) - y.sum()) >= 3:
        lexicon.model = _fit(x, y)
    return lexicon


_MACHINES: dict = {}


def _machine(shared):
    """This Python worker's automaton for a broadcast lexicon; one at a time is kept."""
    lexicon = shared.value
    if _MACHINES.get("of") is not lexicon:
        _MACHINES.update({"of": lexicon, "machine": lexicon.automaton()})
    return _MACHINES["machine"]


def _sliced(batches, text: int):
    """The batches in slices of at most about SLICE bytes of their text column."""
    for batch in batches:
        for i, j in slices(flat(batch.column(text))[1], SLICE):
            yield batch.slice(i, j - i)


def _features(rows: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and f, the features of the text."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        machine = _machine(shared)
        for batch in _sliced(batches, len(keep)):
            found = [features(machine, fold(t or "")) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, pa.list_(pa.float64()))], [*keep, "f"])

    return rows.select(*keep, "text").mapInArrow(run, f"{schema}, f array<double>")


def _score(lexicon: Lexicon):
    b = lexicon.model
    z = sum((F.lit(float(w)) * F.col("f")[k] for k, w in enumerate(b[1:])), F.lit(float(b[0])))
    return 1 / (1 + F.exp(-z))


def toxicity_scores(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id and score (0 to 1) of every row of ``docs``; null and empty texts get the score of no words at all.

    Only the text counts. Repeated documents each get their row; other columns are ignored.
    """
    return _features(docs, lexicon, ["doc_id"]).select("doc_id", _score(lexicon).alias("score"))


def without_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, columns as they are; repeated rows and null texts stay.

    Only the texts cross to Python, and only a bounded slice of them is there as strings at a time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        machine, b, out = _machine(shared), np.array(shared.value.model), []
        for i, j in slices(flat(texts)[1], SLICE):
            found = np.array([features(machine, fold(t or "")) for t in texts.slice(i, j - i).to_pylist()])
            out.append(1 / (1 + np.exp(-(b[0] + found @ b[1:]))))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return docs.where(score("text") < threshold)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """All ``documents``, with a lexicon learned from ``labels`` outside the held-out fifth."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lexicon = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return toxicity_scores(docs, lexicon).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

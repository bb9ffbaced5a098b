"""Token ids of whole texts for the lower-casing word-level BPE vocabulary.

The vocabulary's rules cut a normalised text into words and encode each word alone, so a word's ids never depend on
its neighbours. Texts over Latin letters are cut with array operations and each distinct word is encoded once; any text
with another character, or with the string of an added token, goes through the tokenizer as it is.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np

from .textbytes import PRIME, Sums

U64 = np.uint64
_LIMIT = 0x250
_SPACES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0)
#: Distinct words that one worker remembers; then it starts anew.
CACHE_WORDS = 1_000_000


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class (0 space, 1 letter, 2 number, 3 other, 9 not handled here) and lower case of each code point below _LIMIT."""
    kind, lower = np.full(_LIMIT, 9, np.uint8), np.arange(_LIMIT, dtype=np.uint32)
    for cp in range(_LIMIT):
        low = chr(cp).lower()
        if cp in _SPACES:
            kind[cp] = 0
        elif (0x21 <= cp <= 0x7E or cp > 0xA0) and len(low) == 1 and ord(low) < _LIMIT and unicodedata.normalize("NFC", chr(cp)) == chr(cp):
            lower[cp] = ord(low)
            category = unicodedata.category(low)
            kind[cp] = {"L": 1, "N": 2}.get(category[0], 3)
    return kind, lower, np.random.default_rng(77).integers(1, PRIME, _LIMIT).astype(U64)


class WordTokens:
    """Encodes slices of texts; one per Python worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind, self.lower, self.code = _tables()
        self.forget()

    def forget(self) -> None:
        self.old, self.young = (tuple(np.zeros(0, t) for t in (U64, np.int64)) for _ in range(2))  # sorted hashes and their slots
        self.starts, self.sizes, self.n = np.zeros(1024, np.int64), np.zeros(1024, np.int64), 0
        self.pool, self.used = np.zeros(4096, np.uint32), 0

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        """Slots of sorted hashes, -1 where one is not known."""
        out = np.full(len(hashes), -1, np.int64)
        for keys, slots in (self.old, self.young):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                out = np.where(keys[at] == hashes, slots[at], out)
        return out

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        first = self.n
        for i in range(0, len(texts), 4096):
            for e in self.tokenizer.encode_batch_fast(texts[i : i + 4096], add_special_tokens=False):
                ids = e.ids
                while self.used + len(ids) > len(self.pool):
                    self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
                if self.n == len(self.starts):
                    self.starts, self.sizes = np.concatenate([self.starts, self.starts * 0]), np.concatenate([self.sizes, self.sizes * 0])
                self.pool[self.used : self.used + len(ids)] = ids
                self.starts[self.n], self.sizes[self.n] = self.used, len(ids)
                self.n += 1
                self.used += len(ids)
        self.young = self._merged(self.young, (hashes, np.arange(first, self.n)))
        if len(self.young[0]) * 4 > len(self.old[0]):
            self.old, self.young = self._merged(self.old, self.young), tuple(x[:0] for x in self.young)

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        keys, slots = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
        order = np.argsort(keys, kind="stable")
        return keys[order], slots[order]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of each text, given as UTF-8 bytes and row offsets."""
        raw = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
        at = lead[offsets]
        n, rows = len(raw), len(at) - 1
        inside = np.minimum(raw, _LIMIT - 1)
        kind = self.kind[inside]
        kind[raw >= _LIMIT] = 9
        odd = np.unique(np.concatenate([np.searchsorted(at, np.flatnonzero(kind == 9), "right") - 1, self._with_added(data, offsets)]))
        whole = {int(r): np.array(self.tokenizer.encode(raw[at[r] : at[r + 1]].tobytes().decode("utf-32-le"), add_special_tokens=False).ids, np.uint32) for r in odd}
        for r in odd:
            kind[at[r] : at[r + 1]] = 0
        if not n or not kind.any():
            yield from (whole.get(r, np.zeros(0, np.uint32)) for r in range(rows))
            return
        cps = self.lower[inside]
        start = np.ones(n + 1, bool)
        start[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        start[at] = True
        self._contractions(cps, start, at)
        edges = np.flatnonzero(start)
        begin, end = edges[:-1], edges[1:]
        real = kind[begin] != 0
        begin, end = begin[real], end[real]
        hashes = Sums(self.code[cps]).hashes(begin, end)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if self.n > CACHE_WORDS:
            self.forget()
        slots = self._slots(distinct)
        new = np.flatnonzero(slots < 0)
        if len(new):
            text = cps.tobytes().decode("utf-32-le")
            spans = first[new]
            self._learn(distinct[new], [text[b:e] for b, e in zip(begin[spans].tolist(), end[spans].tolist(), strict=True)])
            slots = self._slots(distinct)
        slot = slots[which]
        sizes = self.sizes[slot]
        before = np.cumsum(sizes) - sizes
        ids = self.pool[np.repeat(self.starts[slot] - before, sizes) + np.arange(int(sizes.sum()))]
        cut = np.concatenate([before, [len(ids)]])[np.searchsorted(begin, at, "left")]
        for r in range(rows):
            yield whole[r] if r in whole else ids[cut[r] : cut[r + 1]]

    def _with_added(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows whose text holds the string of an added token, which the tokenizer takes as that token."""
        text, found = data.tobytes(), []
        for content in self.added:
            spot = text.find(content)
            while spot >= 0:
                found.append(spot)
                spot = text.find(content, spot + 1)
        return np.searchsorted(offsets, np.array(found, np.int64), "right") - 1

    @staticmethod
    def _contractions(cps: np.ndarray, start: np.ndarray, at: np.ndarray) -> None:
        """An apostrophe that begins a word takes 's 't 'm 'd 're 've 'll along; what follows is a word of its own."""
        n = len(cps)
        spots = np.flatnonzero((cps == 0x27) & start[:n])
        if not len(spots):
            return
        stop = at[np.searchsorted(at, spots, "right")]
        ahead = lambda k: np.where(spots + k < stop, cps[np.minimum(spots + k, n - 1)], 0)
        one, two = ahead(1), ahead(2)
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        short = np.isin(one, [ord(c) for c in "stmd"])
        for spots_of, size in ((spots[short], 2), (spots[long], 3)):
            for k in range(1, size):
                start[spots_of + k] = False
            start[spots_of + size] = True


_WORKER: dict[str, WordTokens] = {}


def worker(path: str) -> WordTokens:
    """This Python worker's tokenizer for a vocabulary file."""
    if path not in _WORKER:
        _WORKER[path] = WordTokens(path)
    return _WORKER[path]

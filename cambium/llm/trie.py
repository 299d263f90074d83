"""A three-level n-gram trie in Elias-Fano code: first words, second words, third words, monotone pointers between them, and quantised probabilities beside them.

All levels are views of one buffer, a memory map; queries are answered for many n-grams at once.
"""

from __future__ import annotations

import mmap
import os
import uuid

import numpy as np

_U = np.uint64
#: Codes of probabilities: their logarithm in steps of STEP; 0 is probability 0.
STEP = 12.0 / 65534


def quantised(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(np.rint(np.log10(p) / -STEP), 0, 65534) + 1, 0).astype(np.uint16)


def probabilities(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, 10.0 ** (-STEP * (codes.astype(np.float64) - 1)), 0.0)


class EliasFano:
    """An ascending sequence of numbers. The low bits of each lie side by side; how many share each high part is told in unary, with a directory of ones."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.bits, self.low, self.high, self.ones = n, bits, low, high, ones
        self.zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones.astype(np.int64)

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        high = values >> _U(bits)
        words = np.zeros((int(high[-1]) if n else 0) // 64 + n // 64 + 3, np.uint64)
        place = high.astype(np.int64) + np.arange(n)
        if n:
            edge = np.flatnonzero(np.concatenate([[True], np.diff(place >> 6) != 0]))
            words[place[edge] >> 6] = np.bitwise_or.reduceat(_U(1) << (place & 63).astype(np.uint64), edge)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))[:-1]]).astype(np.uint32)
        low = np.zeros((n * bits + 63) // 64 + 2, np.uint64)
        for i in range(0, n if bits else 0, 1 << 16):  # a multiple of 64 numbers fills whole words
            part = (values[i : i + (1 << 16)] & _U((1 << bits) - 1)).view(np.uint8).reshape(-1, 8)
            packed = np.packbits(np.unpackbits(part, axis=1, count=bits, bitorder="little").reshape(-1), bitorder="little")
            low.view(np.uint8)[i * bits // 8 : i * bits // 8 + len(packed)] = packed
        return cls(n, bits, low, words, ones)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.int64) * self.bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        return (self.low[word] >> shift | (self.low[word + 1] << (_U(63) - shift)) << _U(1)) & _U((1 << self.bits) - 1)

    @staticmethod
    def _nth(words: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """Place of the nth one (from 0) in each word."""
        words, nth, place = words.copy(), nth.astype(np.int64), np.zeros(len(words), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            below = np.bitwise_count(words & _U((1 << step) - 1)).astype(np.int64)
            go = below <= nth
            nth -= np.where(go, below, 0)
            place += np.where(go, step, 0)
            words >>= np.where(go, step, 0).astype(np.uint64)
        return place

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, "right") - 1
        place = word * 64 + self._nth(self.high[word], i - self.ones[word].astype(np.int64))
        return (place - i).astype(np.uint64) << _U(self.bits) | self._low(i)

    def _before(self, h: np.ndarray) -> np.ndarray:
        """How many numbers have a high part under h: the ones before the hth zero."""
        h = np.minimum(h, int(self.zeros[-1]))
        word = np.maximum(np.searchsorted(self.zeros, h, "left") - 1, 0)
        place = word * 64 + self._nth(~self.high[word], h - 1 - self.zeros[word])
        return np.where(h > 0, place - h + 1, 0)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of the successor of each x, the first number not smaller, if it is x; else -1."""
        if not self.n:
            return np.full(len(x), -1)
        high, want = (x >> _U(self.bits)), x & _U((1 << self.bits) - 1)
        inside = high <= _U(int(self[np.array([self.n - 1])][0]) >> self.bits)
        h = np.where(inside, high, _U(0)).astype(np.int64)
        first, end = self._before(h), self._before(h + 1)
        last = end.copy()
        while (open_ := np.flatnonzero(first < last)).size:
            mid = (first[open_] + last[open_]) // 2
            less = self._low(mid) < want[open_]
            first[open_] = np.where(less, mid + 1, first[open_])
            last[open_] = np.where(less, last[open_], mid)
        good = inside & (first < end)
        good[good] = self._low(first[good]) == want[good]
        return np.where(good, first, -1)


_PARTS = ("low", "high", "ones")


def _rising(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Ascending runs, each from begin[i] on, as one ascending sequence: to a run's numbers the last number of the sequence before it is added, and 1."""
    if not len(values):
        return values
    end = np.append(begin[1:], len(values))
    last = values[end - 1] + _U(1)
    return values + np.repeat(np.concatenate([np.zeros(1, np.uint64), np.cumsum(last)[:-1]]), end - begin)


class Trie:
    """Pairs of words and their third words, with the probability of each pair and of each triple among all tokens.

    A number of the second or third level is told relative to its context: the words after a context lie between two pointers and rise from the number before them,
    so a search for a successor never leaves the context's own range.
    """

    def __init__(self, levels: list[EliasFano], pairs: np.ndarray, triples: np.ndarray):
        (self.first, self.to_second, self.second, self.to_third, self.third), self.pairs, self.triples = levels, pairs, triples

    @classmethod
    def build(cls, u: np.ndarray, v: np.ndarray, times: np.ndarray, sizes: np.ndarray, w: np.ndarray, counts: np.ndarray, total: int) -> Trie:
        """From distinct pairs in ascending order with their times (0 where they aren't told here) and numbers of third words; those in ascending order in each pair, with their counts."""
        edge = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])) if len(u) else np.zeros(0, np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        some = begin[:-1][sizes > 0]
        build = EliasFano.build
        levels = [build(u[edge]), build(np.append(edge, len(u)).astype(np.uint64)), build(_rising(v, edge)), build(begin.astype(np.uint64)), build(_rising(w, some))]
        return cls(levels, quantised(times / max(total, 1)), quantised(counts / max(total, 1)))

    @staticmethod
    def _under(level: EliasFano, first: np.ndarray, end: np.ndarray, sizes: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Places of words in the ranges of their contexts, each context having so many words here: the successor of a word, told relative to its context; -1 if it is another or lies outside."""
        base = np.zeros(len(first), np.uint64)
        inner = np.flatnonzero((first > 0) & (first < end))
        base[inner] = level[first[inner] - 1] + _U(1)
        at = level.find(x + np.repeat(base, sizes))
        return np.where((at >= np.repeat(first, sizes)) & (at < np.repeat(end, sizes)), at, -1)

    def query(self, u: np.ndarray, v: np.ndarray, sizes: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of each pair, in ascending order, and of each triple; sizes: how many third words each pair has here. 0 if it isn't known."""
        pairs, triples = np.zeros(len(u), np.uint16), np.zeros(len(w), np.uint16)
        if not len(u) or not self.first.n:
            return pairs, triples
        edge = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
        at, many = self.first.find(u[edge]), np.diff(np.append(edge, len(u)))
        first, end = (np.where(at >= 0, self.to_second[np.maximum(at, 0) + i].astype(np.int64), 0) for i in (0, 1))
        place = self._under(self.second, first, end, many, v)
        known = np.flatnonzero(place >= 0)
        pairs[known] = self.pairs[place[known]]
        if self.third.n and len(w):
            first, end = np.zeros(len(u), np.int64), np.zeros(len(u), np.int64)
            first[known], end[known] = self.to_third[place[known]].astype(np.int64), self.to_third[place[known] + 1].astype(np.int64)
            at = self._under(self.third, first, end, sizes, w)
            triples[at >= 0] = self.triples[at[at >= 0]]
        return pairs, triples

    def _levels(self) -> list[EliasFano]:
        return [self.first, self.to_second, self.second, self.to_third, self.third]

    def image(self) -> bytes:
        """Array by array, each with its length and filled up to 8 bytes."""
        arrays = [np.array([x for s in self._levels() for x in (s.n, s.bits)], np.int64), *(getattr(s, a) for s in self._levels() for a in _PARTS), self.pairs, self.triples]
        return b"".join(np.array([a.nbytes], np.int64).tobytes() + a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)

    @classmethod
    def view(cls, buffer: np.ndarray) -> Trie:
        """On the bytes of an image; nothing is copied."""
        at, raw = 0, []
        while at < len(buffer):
            n = int(buffer[at : at + 8].view(np.int64)[0])
            raw.append(buffer[at + 8 : at + 8 + n])
            at += 8 + n + -n % 8
        head, levels = raw[0].view(np.int64), []
        for k in range(5):
            low, high, ones = raw[1 + 3 * k : 4 + 3 * k]
            levels.append(EliasFano(int(head[2 * k]), int(head[2 * k + 1]), low.view(np.uint64), high.view(np.uint64), ones.view(np.uint32)))
        return cls(levels, raw[16].view(np.uint16), raw[17].view(np.uint16))

    def mapped(self, folder: str | None) -> Trie:
        """The same on a memory map: of a file in folder, whose name goes at once, so that a lost executor leaves nothing there; without a folder, of memory that has no name."""
        image = self.image()
        if folder is None:
            held = mmap.mmap(-1, len(image))
            held.write(image)
            return Trie.view(np.frombuffer(held, np.uint8))
        os.makedirs(folder, exist_ok=True)
        path = os.path.join(folder, uuid.uuid4().hex)
        try:
            with open(path, "wb") as f:
                f.write(image)
            return Trie.view(np.memmap(path, np.uint8, "r"))
        finally:
            if os.path.exists(path):
                os.unlink(path)

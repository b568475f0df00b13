"""Elias-Fano sequences and an n-gram trie of two levels over them, in one memory-mapped block of compact levels."""

from __future__ import annotations

import mmap

import numpy as np

_ONE = np.uint64(1)


#: Bits of a word's hash inside a context's successors, and steps of a halving in the codes of probabilities.
WORD_BITS, STEPS = 40, 2048


def quantise(p: np.ndarray) -> np.ndarray:
    """Codes 1 to 65535 for probabilities above 0: steps of a binary logarithm, a six-thousandth of the value at most off."""
    return np.clip(np.rint(-np.log2(p) * STEPS) + 1, 1, 65535).astype(np.uint16)


def dequantise(codes: np.ndarray) -> np.ndarray:
    """The probability that a code stands for; 0 for code 0."""
    return np.where(codes > 0, np.exp2((1 - codes.astype(np.float64)) / STEPS), 0.0)


def _select_in_word(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th (from 0) set bit of each word."""
    words, k, at = words.copy(), k.astype(np.int64), np.zeros(len(words), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        low = words & np.uint64((1 << width) - 1)
        n = np.bitwise_count(low).astype(np.int64)
        go = k >= n
        k -= np.where(go, n, 0)
        words = np.where(go, words >> np.uint64(width), low)
        at += go * width
    return at


class EliasFano:
    """A sorted sequence of integers below `universe`, about 2 + log2(universe / n) bits each, with two counters a word.

    Four arrays: packed low bits, high parts in unary, and the ones and zeros before each word of these.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones, self.zeros = n, low_bits, low, high, ones, zeros

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        values = values.astype(np.uint64)
        bits = min(56, max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1))
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits:
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            part, shift, word = values & np.uint64((1 << bits) - 1), at & np.uint64(63), (at >> np.uint64(6)).astype(np.int64)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(bits) > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        unary = np.zeros((n + (universe >> bits) + 2 + 63) // 64 * 64, bool)
        unary[(values >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = True
        high = np.packbits(unary, bitorder="little").view(np.uint64)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones
        return cls(n, bits, low, high, ones.astype(np.int32), zeros.astype(np.int32))

    def arrays(self) -> list[np.ndarray]:
        return [self.low, self.high, self.ones, self.zeros]

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        wide = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (self.low[word] >> shift | wide) & np.uint64((1 << self.low_bits) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """The values at these places."""
        word = np.searchsorted(self.ones, i, "right") - 1
        at = word * 64 + _select_in_word(self.high[word], i - self.ones[word])
        return (at - i).astype(np.uint64) << np.uint64(self.low_bits) | self._lows(i)

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        """How many values have a high part below h."""
        k = np.maximum(h - 1, 0)
        word = np.minimum(np.searchsorted(self.zeros, k, "right") - 1, len(self.high) - 1)
        at = word * 64 + _select_in_word(~self.high[word], k - self.zeros[word])
        return np.where(h > 0, at - k, 0)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the first value that is not below x (n if there is none), and whether it is x."""
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        h = (x >> np.uint64(self.low_bits)).astype(np.int64)
        place, end = self._bucket(h), self._bucket(h + 1)
        want = x & np.uint64((1 << self.low_bits) - 1)
        last, end = end, end.copy()
        while len(open_ := np.flatnonzero(place < end)):  # halves each bucket's range: frequent contexts fill large ones
            middle = (place[open_] + end[open_]) // 2
            below = self._lows(middle) < want[open_]
            place[open_[below]] = middle[below] + 1
            end[open_[~below]] = middle[~below]
        same = np.zeros(len(x), bool)
        inside = np.flatnonzero(place < last)
        same[inside] = self._lows(place[inside]) == want[inside]
        return place, same


class NgramTrie:
    """Contexts, pointers to the ranges of their successors, and the successors with quantised smoothed probabilities.

    Successors of all contexts are one rising sequence: in each range the last value before it is added to the words. So a
    search for a word after a context is a successor search relative to that value. All levels lie in one anonymous
    memory map.
    """

    def __init__(self, contexts: np.ndarray, sizes: np.ndarray, words: np.ndarray, probabilities: np.ndarray):
        """contexts: sorted distinct 64-bit hashes; sizes: successors of each, at least one; words: sorted distinct in each
        context, below 2^WORD_BITS; probabilities: of each after its context, above 0."""
        first = np.cumsum(sizes) - sizes
        last = first + sizes - 1
        base = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words[last] + _ONE, dtype=np.uint64)])
        codes = quantise(probabilities) if len(words) else np.zeros(0, np.uint16)
        levels = [
            EliasFano.build(contexts, 1 << 64),
            EliasFano.build(np.concatenate([first, [len(words)]]), len(words) + 1),
            EliasFano.build(words + np.repeat(base[:-1], sizes), int(base[-1]) + 1),
        ]
        arrays = [a for level in levels for a in level.arrays()] + [codes]
        self._map = mmap.mmap(-1, max(8, sum(-(-a.nbytes // 8) * 8 for a in arrays)))
        placed, at = [], 0
        for a in arrays:
            view = np.frombuffer(self._map, a.dtype, len(a), at)
            view[:] = a
            placed.append(view)
            at += -(-a.nbytes // 8) * 8
        self.contexts, self.pointers, self.successors = (EliasFano(v.n, v.low_bits, *placed[4 * i : 4 * i + 4]) for i, v in enumerate(levels))
        self.codes = placed[-1]

    def __len__(self) -> int:
        return len(self.codes)

    @property
    def nbytes(self) -> int:
        return len(self._map)

    def lookup(self, contexts: np.ndarray, sizes: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The code of each word after its context, 0 if it is not in the trie; asked as the trie was built, contexts rising.
        Each context is searched once."""
        out = np.zeros(len(words), np.uint16)
        if not len(words) or not len(self):
            return out
        place, known = self.contexts.successor(contexts)
        place = np.where(known, place, 0)
        begin, end = (self.pointers[place + k].astype(np.int64) for k in (0, 1))
        base = np.where(begin > 0, self.successors[np.maximum(begin - 1, 0)] + _ONE, np.uint64(0))
        last = self.successors[end - 1]
        number = np.repeat(np.arange(len(contexts)), sizes)
        asked = np.flatnonzero(known[number])
        target = words[asked] + base[number[asked]]
        inside = target <= last[number[asked]]  # beyond the last word of the context there is nothing to find
        asked, target = asked[inside], target[inside]
        at, found = self.successors.successor(target)
        out[asked[found]] = self.codes[at[found]]
        return out

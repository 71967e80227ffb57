"""A three-level n-gram trie in Elias-Fano levels with quantised log-probabilities.

Level one holds the words that open an n-gram, level two their successors, level three the successors of pairs.  Each level but the last has, for each node, a
pointer to its first child.  Child j of node i is stored as i * words + j, which makes a whole level one monotone sequence: a lookup is a successor search for
the word relative to its context's part of it.  All levels lie, compressed, in one memory map, and are searched where they lie: no level is ever decoded.
"""

from __future__ import annotations

import mmap

import numpy as np

#: Steps of quantised log10 probabilities in a unit; one scale for all tries, so that equal numbers have equal codes wherever they are.
SCALE = 2048
#: Words of 64 bits between two sampled counts of the high bits.
STRIDE = 8

_ONE, _FULL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)


def quantise(log: np.ndarray) -> np.ndarray:
    """Codes 1..65535 (0 is free) of log10 probabilities, to the nearest of `SCALE` steps in a unit, down to about -32."""
    return (1 + np.clip(np.rint(-log * SCALE), 0, 65534)).astype(np.uint16)


def value(code: np.ndarray) -> np.ndarray:
    return -(code.astype(np.float64) - 1) / SCALE


class EliasFano:
    """A non-decreasing sequence of uint64: low bits packed, high bits in unary, with a count of ones before every `STRIDE` words."""

    def __init__(self, n: int, low: int, lows: np.ndarray, highs: np.ndarray, ones: np.ndarray):
        self.n, self.low, self.lows, self.highs, self.ones = n, low, lows, highs, ones

    @staticmethod
    def encode(values: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
        n = len(values)
        low = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        lows = np.zeros(-(-n * low // 64) + 1, np.uint64)
        if low:
            at = np.arange(n, dtype=np.uint64) * np.uint64(low)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            part = values & np.uint64((1 << low) - 1)
            _or_at(lows, word, part << shift)
            over = np.flatnonzero(shift > 64 - low)
            _or_at(lows, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        high = (values >> np.uint64(low)) + np.arange(n, dtype=np.uint64)
        size = (int(high[-1]) >> 6) + 1 if n else 0
        highs = np.zeros(-(-(size + 1) // STRIDE) * STRIDE, np.uint64)  # the rest are zeros, past the last element
        _or_at(highs, (high >> np.uint64(6)).astype(np.int64), _ONE << (high & np.uint64(63)))
        counts = np.bitwise_count(highs).astype(np.int64).reshape(-1, STRIDE).sum(axis=1)
        return n, low, lows, highs, np.cumsum(counts) - counts

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the k-th (from 0) one, or zero."""
        before = self.ones if ones else np.arange(len(self.ones), dtype=np.int64) * (64 * STRIDE) - self.ones
        at = np.searchsorted(before, k, side="right") - 1
        left, word = k - before[at], at * STRIDE
        open_ = np.ones(len(k), bool)
        for _ in range(STRIDE - 1):  # the word of the block
            n = np.bitwise_count(self.highs[word]).astype(np.int64)
            n = n if ones else 64 - n
            open_ &= left >= n
            left -= np.where(open_, n, 0)
            word += open_
        bits = self.highs[word] if ones else self.highs[word] ^ _FULL
        at = np.zeros(len(k), np.uint64)
        for width in (32, 16, 8, 4, 2, 1):  # the bit of the word
            n = np.bitwise_count((bits >> at) & np.uint64((1 << width) - 1)).astype(np.int64)
            right = left >= n
            left -= np.where(right, n, 0)
            at += np.where(right, np.uint64(width), np.uint64(0))
        return word * 64 + at.astype(np.int64)

    def lower(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.low)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        out = self.lows[word] >> shift
        over = shift > 64 - self.low
        out[over] |= self.lows[word[over] + 1] << (np.uint64(64) - shift[over])
        return out & np.uint64((1 << self.low) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        return ((self._select(i, True) - i).astype(np.uint64) << np.uint64(self.low)) | self.lower(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Number of the first element >= x, n if there is none."""
        a = np.full(len(x), self.n, np.int64)
        if not self.n:
            return a
        zeros = len(self.highs) * 64 - self.n
        high = x >> np.uint64(self.low)
        near = np.flatnonzero(high < np.uint64(zeros))
        high = high[near].astype(np.int64)
        # elements with lesser high bits stand before the high-th zero, those with the same up to the next
        begin = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) - high + 1, 0)
        end = self._select(high, False) - high
        want = x[near] & np.uint64((1 << self.low) - 1)
        while (open_ := np.flatnonzero(begin < end)).size:  # binary search among the elements with the same high bits
            mid = (begin[open_] + end[open_]) // 2
            less = self.lower(mid) < want[open_]
            begin[open_[less]] = mid[less] + 1
            end[open_[~less]] = mid[~less]
        a[near] = begin
        return a

    def find(self, x: np.ndarray) -> np.ndarray:
        """Number of the (first) element x, -1 if it isn't there."""
        at = self.successor(x)
        there = np.flatnonzero(at < self.n)
        there = there[self.get(at[there]) == x[there]]
        out = np.full(len(x), -1, np.int64)
        out[there] = at[there]
        return out


def _or_at(to: np.ndarray, at: np.ndarray, bits: np.ndarray) -> None:
    """to[at] |= bits, for sorted places that may repeat."""
    if len(at):
        first = np.flatnonzero(np.diff(at, prepend=-1))
        to[at[first]] |= np.bitwise_or.reduceat(bits, first)


class Trie:
    """`find` gives numbers of nodes; `codes` and `backs` hold, by level and number, codes of their probabilities and back-offs."""

    def __init__(self, levels):
        """`levels`: anything with the bytes of `pack`, such as a memory map."""
        self._map = levels  # keeps the map open
        head = np.frombuffer(levels, np.int64, 32)
        self.words, at, parts = int(head[0]), 256, []
        for k in range(5):
            n, low, a, b, c = (int(v) for v in head[1 + 5 * k : 6 + 5 * k])
            lows, highs = np.frombuffer(levels, np.uint64, a, at), np.frombuffer(levels, np.uint64, b, at + 8 * a)
            parts.append(EliasFano(n, low, lows, highs, np.frombuffer(levels, np.int64, c, at + 8 * (a + b))))
            at += 8 * (a + b + c)
        self.levels, self.pointers = parts[:3], parts[3:]
        self.codes, self.backs = [], []
        for k, level in enumerate(self.levels):
            self.codes.append(np.frombuffer(levels, np.uint16, level.n if k else 0, at))
            at += 2 * len(self.codes[-1])
            self.backs.append(np.frombuffer(levels, np.uint16, level.n if k < 2 else 0, at))
            at += 2 * len(self.backs[-1])

    @staticmethod
    def pack(words: int, first: np.ndarray, second: tuple, third: tuple, codes: list, backs: list) -> bytes:
        """Sorted distinct words of level one; (parent number, word) of levels two and three, sorted and distinct; all words below `words`;
        codes of levels two and three; back-off codes of levels one and two."""
        children = [np.searchsorted(parent, np.arange(n + 1)) for parent, n in ((second[0], len(first)), (third[0], len(second[0])))]
        values = [first, *(p.astype(np.uint64) * np.uint64(words) + w.astype(np.uint64) for p, w in (second, third)), *children]
        head, body = [words], []
        for v in values:
            n, low, *arrays = EliasFano.encode(v.astype(np.uint64))
            head += [n, low, *map(len, arrays)]
            body += [a.tobytes() for a in arrays]
        tail = [backs[0], codes[0], backs[1], codes[1]]
        return np.array(head + [0] * (32 - len(head)), np.int64).tobytes() + b"".join(body) + b"".join(t.astype(np.uint16).tobytes() for t in tail)

    @classmethod
    def open(cls, path: str) -> Trie:
        """A trie whose bytes are in a file; only the pages that lookups touch are read."""
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def root(self, word: np.ndarray) -> np.ndarray:
        """Node of level one of each word, -1 if there is none."""
        return self.levels[0].find(word.astype(np.uint64))

    def child(self, level: int, node: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Node of `level` (1 or 2) that is the word's after the node of the level before; -1 if there is none, or no such node.  The search is relative to the
        context: the child is the successor of node * words + word, if it lies before the next node's first child."""
        out = np.full(len(node), -1, np.int64)
        some = np.flatnonzero((node >= 0) & (word < self.words))
        if not len(some) or not self.levels[level].n:
            return out
        want = node[some].astype(np.uint64) * np.uint64(self.words) + word[some].astype(np.uint64)
        at = self.levels[level].successor(want)
        ok = np.flatnonzero(at < self.pointers[level - 1].get(node[some] + 1).astype(np.int64))
        ok = ok[self.levels[level].get(at[ok]) == want[ok]]
        out[some[ok]] = at[ok]
        return out


def mapped(*parts) -> Trie:
    """A trie in an anonymous memory map: no file, so nothing is left on an executor's disk."""
    levels = Trie.pack(*parts)
    where = mmap.mmap(-1, len(levels))
    where.write(levels)
    return Trie(where)

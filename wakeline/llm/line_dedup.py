"""Line dedup (op8): lines that are like an earlier line are removed, over the whole corpus.

A line is the set of its words (A-Z lower-cased, split at ASCII white space).  It goes if an earlier line, in the order of doc_id and
place, has a Jaccard similarity of num / den or more with it.  The join is exact.

1. A task encodes its texts once: compressed rows, and line by line the numbers of its words.  Only these blobs are shuffled.
2. Chunks send the hashes of their distinct words and lines to buckets: word frequencies come back as a byte each, and whether the chunk holds
   the earliest of all equal lines as a bit.  Equal lines go no further.
3. The words of each line are ordered by rarity; the prefix (size - ceil(size * num / den) + 1 words), as far as other lines have
   its words, is posted to the words' buckets.  There the lists are joined under length and positional filters and a parity sketch, of more bits for
   longer lines, which bounds the difference from below.  Each line keeps about `K` earlier candidates in a bucket.
4. Candidates send their words to the line's chunk, which verifies the Jaccard similarity.
5. Lines that had more candidates than a bucket kept, none of which matched, ask that bucket again, for all they have there.

Null, empty and blank lines are never removed; an empty table gives an empty one.  A very long text is a chunk of its own.  Of rows with equal ids (or null ids, which come first) the order is that of the input files.  Texts keep
their other lines as they are.  Other columns pass through, whatever their names.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wakeline.llm.common import ASK_SCHEMA, CHUNK_BYTES, bucket_of, documents, give_back, mix, n_buckets, own_row, pack_arrays, pack_sorted, slices, text_bytes, unpack_arrays, unpack_sorted, word_hashes

#: Candidates that a line keeps in a bucket at first.
K = 4
#: Lines with more words than this have sketches of four times as many bits, and again.
FOLDS = (96, 384, 1536)
#: Bits of a word's key beyond those that number all words: two words share a key about once in 2 ** SPARE_BITS words.
SPARE_BITS = 18
#: Bytes of text that are split into words at once: few, so that the arrays made of them stay in the processor's cache.
SPLIT = 1 << 18
#: Words of more bytes are hashed one by one.
LONG = 64
#: Words of candidates that are compared at once, about.
AT_ONCE = 1 << 18

_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first k bytes
_SEED = np.uint64(0x9E3779B97F4A7C15)


def words_at(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs without ASCII white space), read eight bytes at a time, and where they start."""
    padded = data + bytes(8)  # any eight bytes from within can be read
    x = np.frombuffer(padded, np.uint8, len(data))
    space = np.ones(len(x) + 2, bool)
    np.less(x - np.uint8(9), 5, out=space[1:-1])
    space[1:-1] |= x == 32
    edges = np.flatnonzero(space[1:] != space[:-1])
    start, size = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    out = mix((eight[start] & _LOW[np.minimum(size, 8)]) + size.astype(np.uint64) * _SEED)
    more, at = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(more):
        out[more] = mix(out[more] ^ (eight[start[more] + at] & _LOW[np.minimum(size[more] - at, 8)]))
        at += 8
        more = more[size[more] > at]
    long = np.flatnonzero(size > LONG)
    if len(long):
        out[long] = word_hashes([data[i : i + k] for i, k in zip(start[long].tolist(), size[long].tolist())])
    return out, start


def encode_lines(texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Lines of each text (an empty one has one) and size of each line's set; words of all sets, as differences of their numbers, and sorted hashes of the words."""
    n_lines, hashes, lines, first = [np.empty(0, np.int64)], [], [], 0
    for part in slices(texts, SPLIT):
        data = [(t or "").encode("utf-8", "surrogatepass").lower() for t in part.to_pylist()]
        n_lines.append(np.array([d.count(b"\n") + 1 for d in data], np.int64))
        joined = b"\n".join(data)
        h, start = words_at(joined)
        breaks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 10)
        hashes.append(h)
        lines.append(np.repeat(np.arange(first, first + len(breaks) + 1), np.diff(np.searchsorted(start, breaks), prepend=0, append=len(start))))
        first += len(breaks) + 1
    n_lines = np.concatenate(n_lines)
    total = int(n_lines.sum())
    if not hashes:
        none = np.empty(0, np.int64)
        return [n_lines, none], [none, none.view(np.uint64), none.view(np.uint64)]
    code, found = pd.factorize(np.concatenate(hashes))  # a hash table: quicker than sorting all words
    order = np.argsort(found)
    number = np.empty(len(found), np.int64)
    number[order] = np.arange(len(found))
    key = np.concatenate(lines) << 32 | number[code]
    del hashes, lines, code
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    key = key[new]
    line, number = key >> 32, key.astype(np.uint32)
    gap = number.copy()  # a line's first word stands for itself
    gap[1:] -= np.where(line[1:] == line[:-1], number[:-1], np.uint32(0))
    return [n_lines, np.bincount(line, minlength=total).astype(np.int64)], [gap, *pack_sorted(found[order])]


class Lines:
    """The lines of a chunk; what is asked for is decoded."""

    def __init__(self, lines: bytes, words: bytes):
        self._lines, self._words = lines, words

    @cached_property
    def _line_arrays(self) -> list[np.ndarray]:
        return unpack_arrays(self._lines)

    @cached_property
    def _word_arrays(self) -> list[np.ndarray]:
        return unpack_arrays(self._words)

    @property
    def doc(self) -> np.ndarray:
        return self._line_arrays[0]

    @property
    def n_lines(self) -> np.ndarray:
        return self._line_arrays[1]

    @property
    def size(self) -> np.ndarray:
        return self._line_arrays[2]

    @cached_property
    def start(self) -> np.ndarray:
        return np.cumsum(self.size) - self.size

    @cached_property
    def hashes(self) -> np.ndarray:
        return unpack_sorted(*self._word_arrays[1:])

    @cached_property
    def word(self) -> np.ndarray:
        sums = np.zeros(len(self._word_arrays[0]) + 1, np.int64)
        np.cumsum(self._word_arrays[0], out=sums[1:])
        return sums[1:] - np.repeat(sums[self.start], self.size)

    @cached_property
    def line(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.size)), self.size)

    @cached_property
    def doc_of_line(self) -> np.ndarray:
        return np.repeat(self.doc, self.n_lines)

    @cached_property
    def signature(self) -> np.ndarray:
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(self.hashes)[self.word], dtype=np.uint64)])
        return mix(sums[self.start + self.size] - sums[self.start] + self.size.astype(np.uint64))

    @cached_property
    def first(self) -> np.ndarray:
        """The earliest line of each set in the chunk, in the order of signatures."""
        some = np.flatnonzero(self.size)
        by = some[np.lexsort((some, self.doc_of_line[some], self.signature[some]))]
        first = np.ones(len(by), bool)
        first[1:] = self.signature[by[1:]] != self.signature[by[:-1]]
        return by[first]

    def is_first(self) -> np.ndarray:
        out = np.zeros(len(self.size), bool)
        out[self.first] = True
        return out


def _edges(keys: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(bucket_of(keys, n), np.arange(n + 1))


def ask_words(chunk: int, lines: Lines, n: int, drop: np.uint64) -> list[tuple[int, int, bytes]]:
    """`drop`: bits that the words' hashes leave out; words that then look alike only look more frequent, the same to all."""
    short, place = _short(lines.hashes, drop)
    count = np.bincount(place[lines.word[lines.is_first()[lines.line]]], minlength=len(short))
    sets = lines.signature[lines.first]
    docs = lines.doc_of_line[lines.first]
    we, se = _edges(short << drop, n), _edges(sets, n)
    return [(b, chunk, pack_arrays(*pack_sorted(short[i:j]), count[i:j], *pack_sorted(sets[k:m]), docs[k:m], lines.first[k:m])) for b, (i, j, k, m) in enumerate(zip(we, we[1:], se, se[1:])) if j > i or m > k]


def _short(hashes: np.ndarray, drop: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Shortened distinct hashes, and the place of each hash there."""
    short = hashes >> drop
    new = np.ones(len(short), bool)
    new[1:] = short[1:] != short[:-1]
    return short[new], np.cumsum(new) - 1


def answer_words(got: pd.DataFrame) -> list[tuple[int, int, bytes]]:
    """Frequency codes of a chunk's words, and which of its lines are the earliest of their set."""
    blobs = [unpack_arrays(p) for p in got["payload"]]
    words = [unpack_sorted(b[0], b[1]) for b in blobs]
    distinct, place = np.unique(np.concatenate(words), return_inverse=True)
    total = np.bincount(place, np.concatenate([b[2] for b in blobs]), len(distinct))
    code = np.minimum(np.where(total < 128, total, 128 + 8 * np.log2(np.maximum(total, 128) / 128)), 255).astype(np.uint8)[place]
    sets = np.concatenate([unpack_sorted(b[3], b[4]) for b in blobs])
    chunk = np.repeat(got["chunk"].to_numpy(), [len(b[5]) for b in blobs])
    by = np.lexsort((np.concatenate([b[6] for b in blobs]), chunk, np.concatenate([b[5] for b in blobs]), sets))
    first = np.zeros(len(by), bool)
    if len(by):
        first[by] = np.append(True, sets[by[1:]] != sets[by[:-1]])
    out, w, s = [], 0, 0
    for b, c, own, blob in zip(got["bucket"], got["chunk"], words, blobs):
        out.append((b, c, pack_arrays(code[w : w + len(own)], first[s : s + len(blob[5])].view(np.uint8))))
        w, s = w + len(own), s + len(blob[5])
    return out


def post(chunk: int, lines: Lines, said: list[tuple[int, bytes]], n: int, drop: np.uint64, num: int, den: int) -> list[tuple[int, int, bytes]]:
    """Postings of the chunk's earliest lines; and, for itself, which those are."""
    parts = [unpack_arrays(p) for _, p in sorted(said)]
    code = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.uint8)
    own = lines.first[np.concatenate([p[1] for p in parts]).view(bool)] if parts else lines.first
    out = [own_row(chunk, pack_arrays(own))]
    # words by rarity
    code = code[_short(lines.hashes, drop)[1]]
    rare = np.argsort(code, kind="stable")  # the hashes are sorted
    rank = np.empty(len(rare), np.int64)
    rank[rare] = np.arange(len(rare))
    code_of = code[rare]  # of a rank
    mine = np.zeros(len(lines.size), bool)
    mine[own] = True
    mine &= lines.size * den >= num * (lines.size + 1)  # a set so small is alike to none but equal ones
    tokens = mine[lines.line]
    key = (lines.line[tokens] << 32) | rank[lines.word[tokens]]
    key.sort()
    own = np.flatnonzero(mine)
    size = lines.size[own]
    prefix = size + (-size * num // den) + 1
    place = np.arange(prefix.sum()) - np.repeat(np.cumsum(prefix) - prefix, prefix)
    r = key[np.repeat(np.cumsum(size) - size, prefix) + place] & 0xFFFFFFFF
    keep = code_of[r] > 1
    line, r, place = np.repeat(own, prefix)[keep], r[keep], place[keep]
    word = lines.hashes[rare[r]]
    word >>= drop  # words that then look alike only make more candidates, which are verified
    to = np.argsort(word)
    word, line, place = word[to], line[to], place[to]
    size, doc, sketches = lines.size[line], lines.doc_of_line[line], Sketches.of(lines, np.unique(line))
    level, row = Sketches.level(size), sketches.where[line]
    edges = _edges(word << drop, n)
    for b, (i, j) in enumerate(zip(edges, edges[1:])):
        if j > i:
            tables = (table[row[i:j][level[i:j] == k]].ravel() for k, table in enumerate(sketches.levels.values()))
            out.append((b, chunk, pack_arrays(*pack_sorted(word[i:j]), *(a[i:j].astype(np.uint32) for a in (line, place, size)), doc[i:j], *tables)))
    return out


class Sketches:
    """Parity sketches of lines: bits that say whether an odd number of words fall on them.  Two sets differ in at least as many words as
    their sketches in bits.  A line is in the level of its size, 64 times 1, 4, 16 or 64 bits; a larger sketch folds to a smaller by exclusive or."""

    LEVELS = (1, 4, 16, 64)

    def __init__(self, levels: dict[int, np.ndarray], where: np.ndarray):
        self.levels, self.where = levels, where

    @staticmethod
    def level(size: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.array(FOLDS), size)

    @classmethod
    def of(cls, lines: Lines, numbers: np.ndarray) -> Sketches:
        hashes, levels = mix(lines.hashes), {}
        where = np.zeros(len(lines.size), np.int64)
        level = cls.level(lines.size[numbers])
        for k, f in enumerate(cls.LEVELS):
            own = numbers[level == k]
            where[own] = np.arange(len(own))
            size = lines.size[own]
            at = np.repeat(lines.start[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            bit = (hashes[lines.word[at]] & np.uint64(64 * f - 1)).astype(np.int64)
            if f == 1:
                levels[f] = np.bitwise_xor.reduceat(np.uint64(1) << bit.astype(np.uint64), np.cumsum(size) - size).reshape(-1, 1) if len(own) else np.zeros((0, 1), np.uint64)
                continue
            count = np.bincount(np.repeat(np.arange(len(own)), size) * (64 * f) + bit, minlength=len(own) * 64 * f) if len(own) else np.zeros(0, np.int64)
            levels[f] = np.packbits((count & 1).astype(np.uint8), bitorder="little").view(np.uint64).reshape(-1, f)
        return cls(levels, where)


class Folded:
    """Sketches of entries of all levels, for comparing any two at the finest level both have."""

    def __init__(self, size: np.ndarray, levels: list[np.ndarray]):
        self.level = Sketches.level(size).astype(np.int8)
        self.tables = []
        for k, own in enumerate(levels):
            f = Sketches.LEVELS[k]  # bit h % 64e of a finer sketch is bit h % 64f here
            finer = [levels[m].reshape(-1, Sketches.LEVELS[m] // f, f) for m in range(k + 1, len(levels))]
            self.tables.append(np.concatenate([own.reshape(-1, f), *[np.bitwise_xor.reduce(t, axis=1) for t in finer]]))
        # an entry's row in the table of a level: entries of that level first, then those of finer ones
        self.rows = np.zeros((len(levels), len(size)), np.int32 if len(size) < 1 << 31 else np.int64)
        for k in range(len(levels)):
            order = np.concatenate([np.flatnonzero(self.level == f) for f in range(k, len(levels))])
            self.rows[k, order] = np.arange(len(order))

    def apart(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Which pairs may differ in no more than `most` words."""
        ok = np.bitwise_count(self.tables[0][self.rows[0, i], 0] ^ self.tables[0][self.rows[0, j], 0]) <= most
        for k in range(1, len(self.tables)):
            both = np.flatnonzero(ok & (np.minimum(self.level[i], self.level[j]) >= k))
            if not len(both):
                break
            for at in range(0, len(both), 1 << 16):
                b = both[at : at + (1 << 16)]
                far = np.bitwise_count(self.tables[k][self.rows[k, i[b]]] ^ self.tables[k][self.rows[k, j[b]]]).sum(axis=1, dtype=np.int64)
                ok[b] = far <= most[b]
        return ok


def join_lists(word, size, place, sketch: Folded, owner, keep: int, num: int, den: int, wanted=None):
    """Pairs (later entry, earlier entry) of one list that may be alike, about `keep` for each later line, and which lines had more.
    Entries are sorted by word and size; owner is the number of their line in the corpus; wanted: lines to find pairs for."""
    count = np.zeros(int(owner.max(initial=-1)) + 1, np.int32)
    later, earlier, step = [], [], 1
    lists = np.cumsum(np.append(False, word[1:] != word[:-1])[: len(word)]) << 32
    longest = np.minimum(size.astype(np.int64) * den // num, 0xFFFFFFFF)  # of those alike enough in length
    i = np.arange(len(word))
    left = np.searchsorted(lists | size, lists | longest, side="right") - 1 - i  # entries that follow and are not too long
    del lists, longest
    size = size.astype(np.int32 if int(size.max(initial=0)) * 2 * (num + den) < 1 << 31 else np.int64)
    rest = (size - place.astype(size.dtype)) * (num + den)  # words that can be common
    while len(i):
        more = left >= step
        i, left = i[more], left[more]
        j = i + step
        ok = np.minimum(rest[i], rest[j]) >= num * (size[i] + size[j])
        x, y = i[ok], j[ok]
        both = size[x] + size[y]
        swap = owner[x] < owner[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        ok = (count[owner[x]] <= keep) & (owner[x] != owner[y])  # one beyond tells that there are more
        if wanted is not None:
            ok &= wanted[owner[x]]
        x, y, both = x[ok], y[ok], both[ok]
        ok = sketch.apart(x, y, both - 2 * -(-both * num // (num + den)))
        x, y = x[ok], y[ok]
        np.add.at(count, owner[x], 1)
        later.append(x)
        earlier.append(y)
        step += 1
    none = np.empty(0, np.int64)
    return np.concatenate([none, *later]), np.concatenate([none, *earlier]), count > keep


def by_word_and_size(word: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Order by word, then size: by one key if both fit."""
    if len(size) and (int(word.max()) >> 48 or int(size.max()) > 0xFFFF):
        return np.lexsort((size, word))
    return np.argsort(word << np.uint64(16) | size.astype(np.uint64))


def match(got: pd.DataFrame, keep: int, num: int, den: int, only: pd.DataFrame | None = None) -> list[tuple[int, int, bytes]]:
    """Candidates of a bucket, each told to the earlier line's chunk: later line's chunk and number, earlier line's number, and the bucket
    (counted from 1) if it had more than `keep`, else 0.  With `only`, all candidates of the lines named there."""
    if only is not None and (not len(only) or not len(got) or only["bucket"].iloc[0] < 0):
        return list(only.itertuples(index=False, name=None)) if len(only) and only["bucket"].iloc[0] < 0 else []
    bucket = int(got["bucket"].iloc[0])
    if bucket < 0:
        return list(got.itertuples(index=False, name=None))
    names, number = np.unique(got["chunk"].to_numpy(), return_inverse=True)
    columns = [list(c) for c in zip(*(unpack_arrays(p) for p in got["payload"]))]

    def joined() -> np.ndarray:
        return np.concatenate(columns.pop(0))

    at = np.repeat(number, [len(c) for c in columns[2]]) << 32  # with the line: its place among the chunks
    word = np.concatenate([unpack_sorted(*c) for c in zip(columns.pop(0), columns.pop(0))])
    at |= joined()
    place, size, doc = joined(), joined(), joined()
    levels = [joined() for _ in Sketches.LEVELS]
    ours = None
    if only is not None:
        keep = len(word)
        to = np.searchsorted(names, only["chunk"].to_numpy())
        ours = np.isin(at, np.concatenate([unpack_arrays(p)[0] | k << 32 for k, p in zip(to.tolist(), only["payload"])]))
        own = np.isin(word, word[ours])  # their lists only
        level = Sketches.level(size)
        levels = [table.reshape(-1, f)[own[level == k]].ravel() for k, (f, table) in enumerate(zip(Sketches.LEVELS, levels))]
        at, word, place, size, doc, ours = (a[own] for a in (at, word, place, size, doc, ours))
    sketch = Folded(size, levels)
    owner = np.empty(len(word), np.int32 if len(word) < 1 << 31 else np.int64)
    order = np.lexsort((at, doc))
    owner[order] = np.cumsum(np.diff(at[order], prepend=-1) != 0) - 1
    del order, doc, levels
    wanted = None
    if only is not None:
        wanted = np.zeros(int(owner.max(initial=-1)) + 1, bool)
        wanted[owner[ours]] = True
    by = by_word_and_size(word, size)
    at, word, size, place, owner = (a[by] for a in (at, word, size, place, owner))
    sketch.level, sketch.rows = sketch.level[by], sketch.rows[:, by]
    del by
    x, y, over = join_lists(word, size, place, sketch, owner, keep, num, den, wanted)
    if not len(x):
        return []
    low = 0xFFFFFFFF
    pairs = np.unique(np.stack([at[y] >> 32, at[x] >> 32, at[x] & low, at[y] & low, over[owner[x]] * (bucket + 1)], axis=1), axis=0)
    pairs[:, :2] = names[pairs[:, :2]]
    cuts = np.flatnonzero(np.diff(pairs[:, 0])) + 1
    return [(bucket, int(p[0, 0]), pack_arrays(*(np.ascontiguousarray(p[:, k]) for k in range(1, 5)))) for p in np.split(pairs, cuts)]


def show(chunk: int, lines: Lines, said: list[tuple[int, bytes]]) -> list[tuple[int, int, bytes]]:
    """The words of the chunk's candidates, to the chunks of the later lines."""
    out = [(b, chunk, p) for b, p in said if b < 0]
    blobs = [unpack_arrays(p) for b, p in said if b >= 0]
    if not blobs:
        return out
    to, x, y, more = (np.concatenate([b[k] for b in blobs]) for k in range(4))
    by = np.lexsort((more, y, x, to))
    to, x, y, more = to[by], x[by], y[by], more[by]
    new = np.append(True, (to[1:] != to[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (more[1:] != more[:-1]))
    to, x, y, more = to[new], x[new], y[new], more[new]
    for k in np.split(np.arange(len(to)), np.flatnonzero(np.diff(to)) + 1):
        own, which = np.unique(y[k], return_inverse=True)  # each line's words once
        size = lines.size[own]
        at = np.repeat(lines.start[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        out.append((chunk, int(to[k[0]]), pack_arrays(x[k], more[k], which, size, lines.hashes[lines.word[at]])))
    return out


def verified(lines: Lines, said: list[tuple[int, bytes]], num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines that match a candidate; and (line, bucket) where a line had more candidates than were shown."""
    gone = np.zeros(len(lines.size), bool)
    seen, held, n_words = [np.zeros((2, 0), np.int64)], [], 0
    blobs = [p for b, p in said if b >= 0]
    for k, blob in enumerate(blobs):
        x, more, which, size, words = unpack_arrays(blob)
        start, size_of = (np.cumsum(size) - size)[which], size[which]
        held.append((x, size_of, words[np.repeat(start - (np.cumsum(size_of) - size_of), size_of) + np.arange(size_of.sum())]))
        seen.append(np.stack([x, more]))
        n_words += len(held[-1][2])
        if n_words >= AT_ONCE or k == len(blobs) - 1:
            x, size, words = (np.concatenate(c) for c in zip(*held))
            gone[x[_alike(lines, x, size, words, num, den)]] = True
            held, n_words = [], 0
    x, more = np.concatenate(seen, axis=1)
    return gone, x[more > 0], more[more > 0] - 1


def _alike(lines: Lines, x: np.ndarray, size: np.ndarray, words: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which of the lines `x` are alike to the candidates beside them, whose `words` stand one after the other."""
    pair = np.repeat(np.arange(len(x)), size)
    own_size = lines.size[x]
    at = np.repeat(lines.start[x] - (np.cumsum(own_size) - own_size), own_size) + np.arange(own_size.sum())
    own_pair = np.repeat(np.arange(len(x)), own_size)
    ours = mix(lines.hashes[lines.word[at]] + own_pair.astype(np.uint64) * _SEED)
    known = pd.Series(mix(words + pair.astype(np.uint64) * _SEED)).isin(ours).to_numpy()
    common = np.bincount(pair[known], minlength=len(x))
    return common * den >= (size + own_size - common) * num


def own_flags(said: list[tuple[int, bytes]]) -> np.ndarray:
    return unpack_arrays(next(p for b, p in said if b < 0))[0]


def settle(chunk: int, lines: Lines, said: list[tuple[int, bytes]], num: int, den: int) -> list[tuple[int, int, bytes]]:
    """Which lines go so far, for the chunk itself; to the buckets, lines that matched none but had more candidates there."""
    gone, line, bucket = verified(lines, said, num, den)
    first = np.zeros(len(gone), bool)
    first[own_flags(said)] = True
    gone |= (lines.size > 0) & ~first
    out = [own_row(chunk, pack_arrays(gone.view(np.uint8)))]
    open_ = ~gone[line]
    line, bucket = line[open_], bucket[open_]
    return out + [(int(b), chunk, pack_arrays(np.unique(line[bucket == b]))) for b in np.unique(bucket)]


def encoded(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """chunk, rows (the input rows, compressed), lines and words (their line sets): made where the texts are read."""

    def run(batches):
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
        for batch in batches:
            if not batch.num_rows:
                continue
            text = batch.column(place)
            after = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                base = after[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(after, base + chunk_bytes)))
                part = batch.slice(at, end - at)
                ids = part.column(len(columns)).to_pylist()
                order = np.array([-(2**63) if i is None else i for i in ids], np.int64)
                part = part.select(columns)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=options) as out:
                    out.write_batch(part)
                lines, words = encode_lines(text.slice(at, end - at))
                yield pa.RecordBatch.from_pydict({"chunk": [chunk], "rows": [sink.getvalue().to_pybytes()], "lines": [pack_arrays(order, *lines)], "words": [pack_arrays(*words)]}, schema)
                chunk, at = chunk + 1, end
                give_back()

    schema = pa.schema([("chunk", pa.int64()), *((k, pa.binary()) for k in ("rows", "lines", "words"))])
    columns, place = list(range(len(docs.columns))), docs.columns.index(text_col)  # by place: names may clash
    rows = docs.withColumn(text_col, F.col(text_col).cast("string")).select("*", F.col(id_col).cast("long").alias("_id"))
    return rows.mapInArrow(run, "chunk long, rows binary, lines binary, words binary")


def line_dedup(docs: DataFrame, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text", keep: int = K) -> DataFrame:
    """The rows of docs with later matches taken out of the text; and _n_lines, _n_removed, _n_left (lines with words that stay)."""
    total = text_bytes(docs, text_col)
    n = n_buckets(total // 32)
    drop = np.uint64(max(0, 64 - (max(1, total // 32).bit_length() + SPARE_BITS)))
    chunks = encoded(docs, id_col, text_col).repartition("chunk")
    # all steps share one exchange, and only the last takes the rows from it: their size is named here so that they aren't left out before, which would be another exchange
    sets = chunks.select("chunk", "lines", "words", F.octet_length("rows").alias("rows"))

    def frame(rows) -> pd.DataFrame:
        give_back()
        return pd.DataFrame(rows, columns=["bucket", "chunk", "payload"])

    def lines_of(part: pd.DataFrame) -> Lines:
        return Lines(part["lines"].iloc[0], part["words"].iloc[0])

    def at_chunk(step):
        def run(part: pd.DataFrame, said: pd.DataFrame) -> pd.DataFrame:
            return frame(step(int(part["chunk"].iloc[0]), lines_of(part), list(zip(said["bucket"].tolist(), said["payload"].tolist()))) if len(part) else [])

        return run

    def meet(said: DataFrame, step) -> DataFrame:
        return sets.groupBy("chunk").cogroup(said.groupBy("chunk")).applyInPandas(at_chunk(step), ASK_SCHEMA)

    asks = sets.groupBy("chunk").applyInPandas(lambda part: frame(ask_words(int(part["chunk"].iloc[0]), lines_of(part), n, drop)), ASK_SCHEMA)
    words = asks.groupBy("bucket").applyInPandas(lambda got: frame(answer_words(got)), ASK_SCHEMA)
    posts = meet(words, lambda chunk, lines, said: post(chunk, lines, said, n, drop, num, den))
    shown = meet(posts.groupBy("bucket").applyInPandas(lambda got: frame(match(got, keep, num, den)), ASK_SCHEMA), show)
    settled = meet(shown, lambda chunk, lines, said: settle(chunk, lines, said, num, den))
    again = posts.groupBy("bucket").cogroup(settled.groupBy("bucket")).applyInPandas(lambda got, only: frame(match(got, keep, num, den, only)), ASK_SCHEMA)
    last = meet(again, show)
    columns = docs.columns
    place = columns.index(text_col)
    out_schema = T.StructType([*docs.schema.fields, *(T.StructField(name, T.LongType()) for name in ("_n_lines", "_n_removed", "_n_left"))])
    pa_schema = to_arrow_schema(out_schema)

    def clean(part: pa.Table, said: pa.Table) -> pa.Table:
        if not part.num_rows:
            return pa_schema.empty_table()
        give_back()
        lines = Lines(part.column("lines")[0].as_py(), part.column("words")[0].as_py())
        heard = list(zip(said.column("bucket").to_pylist(), said.column("payload").to_pylist()))
        gone = own_flags(heard).view(bool) | verified(lines, heard, num, den)[0]
        rows = pa.ipc.open_stream(part.column("rows")[0].as_buffer()).read_all()
        texts, at, counts = [], 0, []
        for text, n_lines in zip(rows.column(place).to_pylist(), lines.n_lines):
            own = slice(at, at + n_lines)
            lost = int(gone[own].sum())
            counts.append((int(n_lines) if text else 0, lost, int((lines.size[own] > 0).sum()) - lost))
            texts.append("\n".join(x for x, g in zip(text.split("\n"), gone[own]) if not g) if lost else text)
            at += n_lines
        arrays = [pa.array(texts, pa.string()) if k == place else rows.column(k) for k in range(len(columns))]
        arrays += [pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]
        return pa.Table.from_arrays([a.cast(f.type) if a.type != f.type else a for a, f in zip(arrays, pa_schema)], schema=pa_schema)

    return chunks.groupBy("chunk").cogroup(last.groupBy("chunk")).applyInArrow(clean, out_schema)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), "text")


QUERIES = {"op8_line_dedup": op8_line_dedup}
SQL = {
    "op8_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS k, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text <> '')),
s AS (
  SELECT *, row_number() OVER (ORDER BY doc_id, k) AS id,
    list_distinct(list_filter(regexp_split_to_array(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS s FROM l),
t AS (SELECT id, len(s) AS n, unnest(s) AS word FROM s),
f AS (SELECT word, count(*) AS df FROM t GROUP BY word),
o AS (SELECT id, n, word, row_number() OVER (PARTITION BY id ORDER BY df, word) AS place FROM t JOIN f USING (word)),
x AS (SELECT * FROM o WHERE place <= n - (8 * n + 9) // 10 + 1),
c AS (SELECT DISTINCT a.id AS a, b.id AS b FROM x a JOIN x b ON a.word = b.word AND b.id < a.id AND 10 * least(a.n, b.n) >= 8 * greatest(a.n, b.n)),
v AS (SELECT a, len(p.s) + len(q.s) AS total, len(list_intersect(p.s, q.s)) AS common FROM c JOIN s p ON p.id = a JOIN s q ON q.id = b),
gone AS (SELECT DISTINCT a AS id FROM v WHERE 10 * common >= 8 * (total - common)),
r AS (
  SELECT s.doc_id, count(*) AS n_lines, count(gone.id) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (gone.id IS NULL), '') AS text
  FROM s LEFT JOIN gone USING (id) GROUP BY s.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(r.text, d.text) AS text FROM documents d LEFT JOIN r USING (doc_id)"""
}

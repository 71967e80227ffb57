"""Suffix-array dedup (op2): passages of at least `min_words` words that occur more than once in the corpus.

A sparse suffix array: of the suffixes of all texts only those that start at minimiser positions are kept.  Each run of `SPAN` positions
keeps the one whose `GRAM`-word hash is least, so equal passages keep equal suffixes, and any passage of min_words words has, in its first
`SPAN` words, a kept suffix with at least min_words - SPAN + 1 words of the passage to follow.  Hashes of these words are counted in
buckets of the hash's range; there is no order of suffixes.  In place of extending matches, all windows of min_words words that have a repeated one as their
kept suffix are hashed and counted likewise.  But for collisions of hashes, what is found is exact: the union of all windows of
min_words words that occur at two or more places, in one document or several.

Texts are dealt once (`chunked`); chunks send distinct hashes to buckets and get one bit for each back, so a passage in a third of all documents
costs a bucket one key per chunk.  Null, empty and shorter texts have no passages.  Words are runs without ASCII white
space, compared byte for byte.  Repeated rows and ids repeat each other's passages, and each gets its own rows.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from wakeline.llm.common import Rolling, WordRuns, ask, chunked, documents, exact, meet, n_buckets, own_row, pack_arrays, pack_table, send_counts, sum_counts, text_bytes, unpack_arrays, unpack_table

SPAN, GRAM = 16, 8
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


class Suffixes:
    """The windows of a chunk, the kept suffix of each, and the sorted distinct hashes of the suffixes."""

    def __init__(self, texts, min_words: int):
        self.words = WordRuns(texts, lower=False)
        self.roll, self.n = Rolling(self.words.hash), min_words
        self.windows = np.flatnonzero(self.words.inside(min_words))
        gram, span = min(GRAM, min_words), min(SPAN, min_words - min(GRAM, min_words) + 1)
        rank = np.full(len(self.words.hash), np.iinfo(np.uint64).max, np.uint64)
        ok = np.flatnonzero(self.words.inside(gram))
        rank[ok] = self.roll.runs(ok, gram)
        least, where, reach = rank, np.arange(len(rank)), 1
        while reach < span and len(rank) > reach:
            step = min(reach, span - reach)
            m = len(rank) - step
            later = least[step:] < least[:m]  # on ties the first stays
            least = np.concatenate([np.where(later, least[step:], least[:m]), least[m:]])
            where = np.concatenate([np.where(later, where[step:], where[:m]), where[m:]])
            reach += step
        self.kept = where[self.windows]
        starts, back = np.unique(self.kept, return_inverse=True)
        hashes = self.roll.runs(starts, min_words - span + 1)
        self.keys, inverse, self.counts = np.unique(hashes, return_inverse=True, return_counts=True)
        self.key_of_window = inverse[back]

    def extended(self, repeated: np.ndarray):
        """Windows whose suffix is repeated; the sorted distinct hashes of them, the place of each window's, and counts."""
        windows = self.windows[repeated[self.key_of_window]] if len(self.windows) else self.windows
        keys, place, counts = np.unique(self.roll.runs(windows, self.n), return_inverse=True, return_counts=True)
        return windows, keys, place, counts


def _twice(counts: np.ndarray) -> np.ndarray:
    return np.minimum(counts, 2).astype(np.uint8)


def _answer(got: pd.DataFrame) -> list[tuple[int, int, bytes]]:
    if got["bucket"].iloc[0] < 0:
        return list(got.itertuples(index=False, name=None))
    places, _, total = sum_counts(got)
    flags = (total >= 2).view(np.uint8)
    return [(b, c, pack_arrays(np.packbits(flags[p]), np.array([len(p)]))) for b, c, p in zip(got["bucket"], got["chunk"], places)]


def texts_of(payload: bytes) -> list[str | None]:
    return unpack_table(payload).column("text").to_pylist()


def _flags(said: list, n: int) -> np.ndarray:
    parts = [unpack_arrays(p) for b, p in sorted(said) if b >= 0]
    out = np.concatenate([np.unpackbits(bits, count=int(size[0])) for bits, size in parts]) if parts else np.empty(0, np.uint8)
    assert len(out) == n
    return out.view(bool)


def _spans(windows: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Unions of windows of n words as (start, end)."""
    if not len(windows):
        return []
    new = np.flatnonzero(np.diff(windows, prepend=-n - 1) > n)
    ends = np.append(windows[new[1:] - 1], windows[-1]) + n
    return list(zip(windows[new].tolist(), ends.tolist()))


def repeated_passages(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each maximal span of repeated words: doc_id, start_word, n_words, start_char, end_char (code points)."""
    total = text_bytes(docs, text_col)
    chunks, n = chunked(docs, total, pack_table, id_col, text_col), n_buckets(total // 32)

    def suffixes(chunk: int, payload: bytes):
        s = Suffixes(texts_of(payload), min_words)
        return send_counts(chunk, s.keys, _twice(s.counts), n)

    def windows(chunk: int, payload: bytes, said: list):
        s = Suffixes(texts_of(payload), min_words)
        repeated = _flags(said, len(s.keys))
        _, keys, _, counts = s.extended(repeated)
        return [own_row(chunk, pack_arrays(np.packbits(repeated.view(np.uint8)))), *send_counts(chunk, keys, _twice(counts), n)]

    def spans(chunk: int, payload: bytes, said: list) -> pd.DataFrame:
        rows, out = unpack_table(payload), []
        texts = rows.column("text").to_pylist()
        s = Suffixes(texts, min_words)
        own = next(p for b, p in said if b < 0)
        repeated = np.unpackbits(unpack_arrays(own)[0], count=len(s.keys)).view(bool)
        found, keys, place, _ = s.extended(repeated)
        found = found[_flags(said, len(keys))[place]] if len(found) else found
        owner = np.searchsorted(s.words.start + s.words.size, found, side="right")
        for k in np.unique(owner).tolist():
            text = texts[k].encode("utf-8", "surrogatepass")
            places = [m.span() for m in _WORD.finditer(text)]
            for a, b in _spans(found[owner == k] - s.words.start[k], min_words):
                i, j = places[a][0], places[b - 1][1]
                i_char = len(text[:i].decode("utf-8", "surrogatepass"))
                out.append((k, a, b - a, i_char, i_char + len(text[i:j].decode("utf-8", "surrogatepass"))))
        spans = pd.DataFrame(out, columns=["doc_id", "start_word", "n_words", "start_char", "end_char"])
        return spans.assign(doc_id=exact(rows.column("doc_id")).take(spans["doc_id"].to_numpy(np.int64)).array)

    first = ask(chunks, suffixes, _answer, n)
    second = ask(chunks, windows, _answer, n, first)
    return meet(chunks, second, spans, "doc_id long, start_word long, n_words long, start_char long, end_char long")


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir))


QUERIES = {"op2_repeated_passages": op2_repeated_passages}
SQL = {
    "op2_repeated_passages": r"""
WITH d AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, regexp_extract_all(text, '[\x20\x09-\x0D]+') AS gap, regexp_matches(text, '^[\x20\x09-\x0D]') AS led FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, unnest(range(0, len(w) - 49)) AS k, unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i:i + 49], ' ')))) AS h FROM d WHERE len(w) >= 50),
r AS (SELECT doc_id, k FROM s WHERE h IN (SELECT h FROM s GROUP BY h HAVING count(*) > 1)),
i AS (SELECT doc_id, k, CASE WHEN k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) <= 50 THEN 0 ELSE 1 END AS fresh FROM r),
g AS (SELECT doc_id, k, sum(fresh) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS g FROM i),
p AS (SELECT doc_id, min(k) AS a, max(k) + 50 AS b FROM g GROUP BY doc_id, g),
c AS (
  SELECT p.doc_id, a, b, coalesce(list_sum(list_transform(w[1:a], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(gap[1:a + led::INT], lambda x: length(x))), 0) AS i,
    list_sum(list_transform(w[1:b], lambda x: length(x))) + coalesce(list_sum(list_transform(gap[1:b - 1 + led::INT], lambda x: length(x))), 0) AS j FROM p JOIN d USING (doc_id))
SELECT doc_id, a::BIGINT AS start_word, (b - a)::BIGINT AS n_words, i::BIGINT AS start_char, j::BIGINT AS end_char FROM c"""
}

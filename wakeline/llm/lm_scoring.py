"""LM scoring (op9): a trigram model over words, learned from all training documents, in Elias-Fano tries.

Witten-Bell: p(w | u v) = (c(u v w) + t(u v) p(w | v)) / (c(u v) + t(u v)), likewise p(w | v) from p(w), with t the distinct successors and p(w) = (c(w) + 1) / (N + V + 1);
an n-gram's context that training has not leaves the shorter one's probability as it is.  Before a text stand two ends.  The
quantised log10 of c(u v w) / (c(u v) + t(u v)) and of t(u v) / (c(u v) + t(u v)) are what the tries hold (see `ngram_trie`), on one scale for all.

The model is sharded, so it may grow with the corpus.
1. Texts become chunks of word numbers where they are read.  A chunk sends the hashes and training counts of its distinct words to buckets of the
   hashes, and gets their corpus counts and ids.
2. Its distinct n-grams, with counts, go to shards of their first words.  A first word with `HOT` occurrences or more is spread over several shards of another kind by the
   words that follow it; these shards first exchange how often a context of theirs occurs and how many successors it has, so all contexts have their exact numbers
   and scores don't hang on how anything is dealt.
3. Each shard builds its trie, looks every distinct n-gram up in it, and sends the codes back to the chunks that asked.

Words are known by 64-bit hashes.  Null and empty texts are one token, the end.  Rows with equal ids are scored each for itself, and learned from as often as they
stand there; a null id has crc32 of the empty text.  An empty table gives no rows; other columns are not read, whatever their names.  A very long text is a chunk of its own: a worker
holds some 40 bytes for each of its.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from wakeline.llm.common import (
    ASK_SCHEMA, WordRuns, ask, asked, blobs, bucket_of, chunked, crc_mod, documents, exact, meet, mix, n_buckets, own_row, pack_arrays, pack_sorted, pack_table, send_counts, sum_counts, text_bytes,
    unpack_arrays, unpack_sorted, unpack_table, word_hashes,
)
from wakeline.llm.ngram_trie import mapped, quantise, value

FOLDS, HELD = 7, 2
#: Occurrences of a first word beyond which what follows it is spread.
HOT = 1 << 18
#: Stands for the end of a text; no word holds a space.
END = word_hashes([b" "])[0]


def encoded(rows: pa.Table) -> bytes:
    """The rows' ids and folds, the size of each text in tokens, its tokens as numbers (frequent words have small ones), how often each hash occurs, and the sorted hashes."""
    words = WordRuns(rows.column("text").to_pylist(), lower=True)
    ends = np.cumsum(words.size)
    hashes, at, count = np.unique(np.insert(words.hash, ends, END), return_inverse=True, return_counts=True)
    place = np.argsort(-count, kind="stable")
    rank = np.empty_like(place)
    rank[place] = np.arange(len(place))
    held = np.array([crc_mod(i, FOLDS) == HELD for i in rows.column("doc_id").to_pylist()], bool)
    ids = pack_table(rows.select(["doc_id"]))
    return pack_arrays(np.frombuffer(ids, np.uint8), held.view(np.uint8), words.size + 1, rank[at], count, *pack_sorted(hashes))


class Counted:
    """Words, pairs and triples of a chunk, each numbered in sorted order."""

    def __init__(self, payload: bytes, grams: bool):
        ids, held, self.size, ranks, count, *hashes = unpack_arrays(payload)
        self.at = np.argsort(-count, kind="stable")[ranks]
        self.ids = exact(unpack_table(ids.tobytes()).column("doc_id"))
        self.held = held.view(bool)
        self.hashes = unpack_sorted(*hashes)
        self.start = np.cumsum(self.size) - self.size
        self.learn = np.repeat(~self.held, self.size)
        self.counts = self._counts(self.at, len(self.hashes))
        if grams:
            n = len(self.hashes)
            end = np.searchsorted(self.hashes, END)
            before = np.empty(len(self.at), np.int64)
            before[1:] = self.at[:-1]
            before[self.start] = end
            # pairs as they occur, and the two ends that stand before a text
            both = np.concatenate([before * n + self.at, [end * n + end]])
            self.pairs, where = np.unique(both, return_inverse=True)
            self.pair_at = where[:-1]
            self.pair_counts = self._counts(self.pair_at, len(self.pairs))
            context = np.empty(len(self.at), np.int64)
            context[1:] = self.pair_at[:-1]
            context[self.start] = where[-1]
            self.triples, self.triple_at = np.unique(context * n + self.at, return_inverse=True)
            self.triple_counts = self._counts(self.triple_at, len(self.triples))
            self.first, self.second = np.divmod(self.pairs, n)
            self.context, self.third = np.divmod(self.triples, n)

    def _counts(self, at: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(at[self.learn], minlength=n)


class Routes:
    """Where the n-grams of a chunk go.  Words, pairs and triples that training may have; the shard of each; and for each shard the numbers of its own, with the pairs and words above them."""

    def __init__(self, c: Counted, count: np.ndarray, n_shards: int, hot: int):
        known = count > 0
        self.words = np.flatnonzero(known)
        self.pairs = np.flatnonzero(known[c.first] & known[c.second])
        is_pair = np.zeros(len(c.pairs), bool)
        is_pair[self.pairs] = True
        self.triples = np.flatnonzero(is_pair[c.context] & known[c.third])
        spread = np.where(count >= hot, 1 + count // hot, 0)
        salt = mix(c.hashes)

        def shard(first, follow):
            u, s = c.hashes[first], spread[first]
            cold = bucket_of(mix(u), n_shards)
            part = follow % np.maximum(s, 1).astype(np.uint64)
            return np.where(s > 0, n_shards + bucket_of(mix(mix(u) + part), n_shards), cold).astype(np.int64)

        self.word_shard = shard(self.words, salt[self.words])
        self.pair_shard = shard(c.first[self.pairs], salt[c.second[self.pairs]])
        first, second = c.first[c.context[self.triples]], c.second[c.context[self.triples]]
        self.triple_shard = shard(first, mix(salt[second] + c.hashes[c.third[self.triples]]))

    def shards(self, c: Counted):
        """(shard, words, pairs, triples, and which of the words and pairs are the shard's own)."""
        def split(shard, numbers):
            order = np.argsort(shard, kind="stable")
            keys, first = np.unique(shard[order], return_index=True)
            return dict(zip(keys.tolist(), np.split(numbers[order], first[1:])))

        words, pairs, triples = split(self.word_shard, self.words), split(self.pair_shard, self.pairs), split(self.triple_shard, self.triples)
        none = np.empty(0, np.int64)
        for b in sorted(words.keys() | pairs.keys() | triples.keys()):
            t, own_p, own_w = triples.get(b, none), pairs.get(b, none), words.get(b, none)
            p = np.union1d(own_p, c.context[t])
            w = np.union1d(own_w, c.first[p])
            yield b, w, p, t, own_w, own_p


def _count_words(got: pd.DataFrame) -> list[tuple[int, int, bytes]]:
    """Every chunk hears of its words: corpus counts and ids (0: not in training); and the shard's distinct words and tokens."""
    places, _, total = sum_counts(got)
    known = total > 0
    rank = np.empty(len(total), np.int64)
    rank[np.argsort(-total, kind="stable")] = np.arange(1, len(total) + 1)  # frequent words have small ids, which pack better
    rank = np.where(known, rank, 0)
    sums = np.array([known.sum(), total.sum()])
    return [(b, c, pack_arrays(total[p], rank[p], sums.astype(np.int64))) for b, c, p in zip(got["bucket"], got["chunk"], places)]


def _hear_words(said: list, n: int):
    """(counts, ids, V, N).  Ids of shard b are b + 1, b + 1 + n, ...; 0 is a word unknown in training."""
    parts = [(b, *unpack_arrays(p)) for b, p in sorted(said)]
    count = np.concatenate([c for _, c, _, _ in parts])
    ids = np.concatenate([np.where(r > 0, (r - 1) * n + b + 1, 0) for b, _, r, _ in parts])
    sums = np.sum([s for *_, s in parts], axis=0)
    return count, ids, int(sums[0]), int(sums[1])


class Shard:
    """All chunks' n-grams of a shard: distinct words, pairs and triples, their counts, and where each chunk's are among them."""

    def __init__(self, got: pd.DataFrame):
        # of each chunk: words and their counts; pairs of each word, second words, own counts; triples of each pair, third words, counts
        asks = [unpack_arrays(p) for p in got["payload"]]
        part = lambda k: np.concatenate([a[k] for a in asks])
        self.sizes = [[len(a[k]) for a in asks] for k in (0, 3, 6)]
        self.words, word_at = np.unique(part(0), return_inverse=True)
        self.count = np.zeros(len(self.words), np.int64)
        self.count[word_at] = part(1)
        second, third = part(3), part(6)
        self.top = int(max(second.max(initial=0), third.max(initial=0))) + 1
        pairs, pair_at = np.unique(np.repeat(word_at, part(2)) * self.top + second, return_inverse=True)
        self.first, self.second = np.divmod(pairs, self.top)
        self.pair_count = np.bincount(pair_at, part(4), len(pairs)).astype(np.int64)
        triples, triple_at = np.unique(np.repeat(pair_at, part(5)) * self.top + third, return_inverse=True)
        self.context, self.third = np.divmod(triples, self.top)
        self.triple_count = np.bincount(triple_at, part(7), len(triples)).astype(np.int64)
        self.places = [np.split(at, np.cumsum(n)[:-1]) for at, n in zip((word_at, pair_at, triple_at), self.sizes)]
        # what is known here of the contexts: distinct successors, and of pairs also how often they occur as context
        self.word_kinds = np.bincount(self.first[self.pair_count > 0], minlength=len(self.words))
        self.pair_kinds = np.bincount(self.context[self.triple_count > 0], minlength=len(pairs))
        self.pair_total = np.bincount(self.context, self.triple_count, len(pairs)).astype(np.int64)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes that name words and pairs in any shard."""
        w = mix(self.words.astype(np.uint64))
        return w, mix(w[self.first] * np.uint64(3) + self.second.astype(np.uint64))


def _report(got: pd.DataFrame, n: int) -> list[tuple[int, int, bytes]]:
    """What a shard of spread words knows of its contexts, to buckets of the contexts."""
    shard = int(got["bucket"].iloc[0])
    if shard < n:
        return []
    s = Shard(got)
    words, pairs = s.keys()
    keys = np.concatenate([words, pairs])
    kinds = np.concatenate([s.word_kinds, s.pair_kinds])
    total = np.concatenate([np.zeros(len(words), np.int64), s.pair_total])
    order = np.argsort(keys)
    keys, kinds, total = keys[order], kinds[order], total[order]
    edges = np.searchsorted(bucket_of(keys, n), np.arange(n + 1))
    return [(b, shard, pack_arrays(*pack_sorted(keys[i:j]), kinds[i:j], total[i:j])) for b, (i, j) in enumerate(zip(edges, edges[1:])) if j > i]


def _sum_reports(got: pd.DataFrame) -> list[tuple[int, int, bytes]]:
    parts = [unpack_arrays(p) for p in got["payload"]]
    keys = [unpack_sorted(p[0], p[1]) for p in parts]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    kinds, total = (np.bincount(place, np.concatenate([p[k] for p in parts]), len(distinct)).astype(np.int64)[place] for k in (2, 3))
    edges = np.cumsum([0] + [len(k) for k in keys])
    # the chunk's place in ASK_SCHEMA holds the shard
    return [(b, c, pack_arrays(kinds[i:j], total[i:j])) for b, c, i, j in zip(got["bucket"], got["chunk"], edges, edges[1:])]


def _build_and_look_up(got: pd.DataFrame, told: pd.DataFrame) -> list[tuple[int, int, bytes]]:
    """Of all chunks' n-grams of a shard: its trie, and what the trie has for each of the chunks."""
    if not len(got):
        return []
    if got["bucket"].iloc[0] < 0:
        return list(got.itertuples(index=False, name=None))
    s = Shard(got)
    word_kinds, pair_kinds, pair_total = s.word_kinds, s.pair_kinds, s.pair_total
    if len(told):
        order = np.argsort(np.concatenate(s.keys()))
        heard = [unpack_arrays(p) for _, p in sorted(zip(told["bucket"], told["payload"]))]
        kinds, total = (np.empty(len(order), np.int64) for _ in range(2))
        kinds[order], total[order] = (np.concatenate([h[k] for h in heard]) for k in range(2))
        word_kinds, pair_kinds, pair_total = kinds[: len(s.words)], kinds[len(s.words) :], total[len(s.words) :]
    # nodes: words, pairs that occur or are the context of a triple, triples that occur
    is_triple = s.triple_count > 0
    is_pair = (s.pair_count > 0) | (pair_kinds > 0)
    number = np.cumsum(is_pair) - 1
    context, third = number[s.context[is_triple]], s.third[is_triple]
    first, second = s.first[is_pair], s.second[is_pair]
    pair_code = _codes(s.pair_count[is_pair], (s.count + word_kinds)[first])
    triple_code = _codes(s.triple_count[is_triple], (pair_total + pair_kinds)[is_pair][context])
    word_back = _codes(word_kinds, s.count + word_kinds)
    pair_back = _codes(pair_kinds[is_pair], (pair_total + pair_kinds)[is_pair])
    trie = mapped(s.top, s.words, (first, second), (context, third), [pair_code, triple_code], [word_back, pair_back])
    words = trie.root(s.words)
    pairs = trie.child(1, words[s.first], s.second)
    triples = trie.child(2, pairs[s.context], s.third)
    found = [_taken(trie.backs[0], words), _taken(trie.codes[1], pairs), _taken(trie.backs[1], pairs), _taken(trie.codes[2], triples)]
    return [(b, c, pack_arrays(*(f[p[k]] for f, p in zip(found, (s.places[0], s.places[1], s.places[1], s.places[2]))))) for k, (b, c) in enumerate(zip(got["bucket"], got["chunk"]))]


def _codes(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Codes of log10 of part / whole, 0 where part is 0."""
    return np.where(part > 0, quantise(np.log10(np.maximum(part, 1) / np.maximum(whole, 1))), 0).astype(np.uint16)


def _taken(codes: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(nodes), np.uint16)
    there = nodes >= 0
    out[there] = codes[nodes[there]]
    return out


def _chance(codes: np.ndarray, without: float) -> np.ndarray:
    return np.where(codes > 0, 10.0 ** value(codes), without)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    size = text_bytes(docs, text_col)
    chunks = chunked(docs, size, encoded, id_col, text_col)
    n_words, n_shards = n_buckets(size // 32), n_buckets(size // 5)

    def words(chunk: int, payload: bytes):
        c = Counted(payload, False)
        return send_counts(chunk, c.hashes, c.counts, n_words, all_buckets=True)  # each adds its part of N and V

    def grams(chunk: int, payload: bytes, said: list):
        c = Counted(payload, True)
        count, ids, v, n = _hear_words(said, n_words)
        out = [own_row(chunk, pack_arrays(count, np.array([v, n])))]
        for b, w, p, t, _, own_p in Routes(c, count, n_shards, hot).shards(c):
            of_word = np.bincount(np.searchsorted(w, c.first[p]), minlength=len(w))
            of_pair = np.bincount(np.searchsorted(p, c.context[t]), minlength=len(p))
            # a pair that is here for its triples alone is counted where it is at home
            counts = np.where(np.isin(p, own_p, assume_unique=True), c.pair_counts[p], 0)
            out.append((b, chunk, pack_arrays(ids[w], count[w], of_word, ids[c.second[p]], counts, of_pair, ids[c.third[t]], c.triple_counts[t])))
        return out

    def scores(chunk: int, payload: bytes, said: list) -> pd.DataFrame:
        c = Counted(payload, True)
        heard = dict(said)
        count, (v, n) = unpack_arrays(heard.pop(-1 - chunk))
        word_back, pair_back = np.zeros(len(c.hashes), np.uint16), np.zeros(len(c.pairs), np.uint16)
        pair_code, triple_code = np.zeros(len(c.pairs), np.uint16), np.zeros(len(c.triples), np.uint16)
        for b, w, p, t, own_w, own_p in Routes(c, count, n_shards, hot).shards(c):
            backs, codes, p_backs, t_codes = unpack_arrays(heard[b])
            word_back[own_w] = backs[np.searchsorted(w, own_w)]
            at = np.searchsorted(p, own_p)
            pair_code[own_p], pair_back[own_p] = codes[at], p_backs[at]
            triple_code[t] = t_codes
        plain = (count + 1) / (n + v + 1)
        pair = _chance(pair_code, 0.0) + _chance(word_back, 1.0)[c.first] * plain[c.second]
        # the pair that ends a triple: its last two words
        at = np.searchsorted(c.pairs, c.second[c.context] * len(c.hashes) + c.third)
        log = np.log10(_chance(triple_code, 0.0) + _chance(pair_back, 1.0)[c.context] * pair[at])
        return pd.DataFrame({
            "doc_id": c.ids, "held_out": c.held, "n_tokens": c.size, "n_known": np.add.reduceat((count > 0).astype(np.int64)[c.at], c.start),
            "train_tokens": n, "base_score": np.add.reduceat(np.log10(plain)[c.at], c.start), "score": np.add.reduceat(log[c.triple_at], c.start),
        })

    first = ask(chunks, words, _count_words, n_words)
    second = asked(chunks, grams, n_shards, first)
    told = second.groupBy("bucket").applyInPandas(lambda got: blobs(_report(got, n_shards)), ASK_SCHEMA).groupBy("bucket").applyInPandas(lambda got: blobs(_sum_reports(got)), ASK_SCHEMA)
    found = second.groupBy("bucket").cogroup(told.groupBy("chunk")).applyInPandas(lambda got, told: blobs(_build_and_look_up(got, told)), ASK_SCHEMA)
    return meet(chunks, found, scores, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))


QUERIES = {"op9_lm_scores": op9_lm_scores}

"""Language ID (op6): a linear-chain conditional random field over the words of a text.

Each word with a letter is a position of the chain.  Its features are character n-grams of the lower-cased word
between two marks (those with a mark are its prefixes and suffixes) and, for words of the lexicon, the word
itself; all are hashed into `BUCKETS` weights a label.  Transitions between labels are learned too.  Training sequences
join spans of documents of different languages, so the chain learns how languages alternate in code-switched text.
Forward-backward gives every word its label probabilities; a text gets the label with the highest mean, and that mean as score.

The classifier is fitted on a bounded sample, the only thing that is collected: of each language at most `per_lang` distinct texts, those with the least hash of
id and text, whole, and no more once they have `lang_bytes` bytes together; from the rows with a language whose crc32(doc_id) mod `folds` is not 0.
Equal texts of a language are one of its texts, however often they stand there.  Weights are a table of fixed size.  Prediction is one pass
without a shuffle over whole texts, of any length; a worker remembers the scores of at most `MEMORY` words.

Null texts, and texts without a letter, are `und` with score 0.0; so is everything if nothing can be learned from, as from an empty table.  Labels that are equally likely go by
name.  Every input row gives one row, also of repeated rows and ids.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wakeline.llm.common import documents, give_back, id_back, id_crc_mod, id_text, mix, slices

BUCKETS = 1 << 17
NGRAMS = (1, 2, 3, 4)
LEXICON = 2000
MEMORY = 300_000
#: Words that one forward-backward run holds.
BATCH_WORDS = 250_000
#: New words that are scored at a time: their features take some kB each.
FRESH_WORDS = 2000
#: Bytes of text that are Python strings at a time, when documents are accepted; a longer text is alone.
SLICE_BYTES = 4 << 20
UNDETERMINED = "und"


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of the words, one after the other, with the start and number of each word's; and a hash of each word."""
    chars = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], np.int64)
    first = np.cumsum(size) - size
    left = np.repeat(first + size, size) - np.arange(len(chars))  # characters up to the end of the word
    grams, n_of, at_of, h = [], [], [], np.zeros(len(chars), np.uint64)
    spot = np.arange(len(chars))
    for n in range(1, max(NGRAMS) + 1):
        h[: len(chars) - n + 1] = h[: len(chars) - n + 1] * np.uint64(0x100000001B3) + chars[n - 1 :] + np.uint64(1)
        if n in NGRAMS:
            ok = left >= n
            grams.append(h[ok] * np.uint64(8) + np.uint64(n))
            at_of.append(spot[ok])
    order = np.argsort(np.concatenate(at_of), kind="stable")
    feats = (mix(np.concatenate(grams)[order]) % np.uint64(BUCKETS)).astype(np.int64)
    word = np.repeat(np.arange(len(words)), size)
    n_of = np.bincount(word[np.concatenate(at_of)], minlength=len(words))
    whole = mix(np.add.reduceat(chars * mix(spot.astype(np.uint64) - np.repeat(first, size).astype(np.uint64)), first))
    return feats, n_of, whole


class Crf:
    """Weights, transitions and lexicon of a fitted chain."""

    def __init__(self, labels: list[str], lexicon: np.ndarray):
        n = len(labels)
        self.labels, self.lexicon = labels, np.sort(lexicon)
        self.weights = np.zeros((BUCKETS, n), np.float32)
        self.moves, self.start = np.zeros((n, n)), np.zeros(n)

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(feature, word) pairs, in the order of the words."""
        feats, count, whole = word_features(words)
        word = np.repeat(np.arange(len(words)), count)
        known = np.flatnonzero(self._listed(whole))
        return np.concatenate([feats, (whole[known] % np.uint64(BUCKETS)).astype(np.int64)]), np.concatenate([word, known])

    def _listed(self, whole: np.ndarray) -> np.ndarray:
        if not len(self.lexicon):
            return np.zeros(len(whole), bool)
        return self.lexicon[np.minimum(np.searchsorted(self.lexicon, whole), len(self.lexicon) - 1)] == whole

    def scores(self, words: list[str]) -> np.ndarray:
        """Score of each label for each word."""
        out = np.zeros((len(words), len(self.labels)))
        if words:
            feats, word = self.features(words)
            for k in range(len(self.labels)):
                out[:, k] = np.bincount(word, self.weights[feats, k], len(words))
        return out

    def _packed(self, seqs: list[np.ndarray]):
        """Word numbers step by step: those at step t are `active[t]` from `first[t]` on."""
        length = np.array([len(s) for s in seqs])
        steps = int(length[0])
        active = len(seqs) - np.searchsorted(length[::-1], np.arange(steps), side="right")
        first = np.cumsum(active) - active
        packed = np.empty(int(length.sum()), np.int32)
        for i, s in enumerate(seqs):
            packed[first[: len(s)] + i] = s
        return packed, first, active

    def _forward(self, packed, first, active, local, move) -> np.ndarray:
        alpha = np.empty((len(packed), len(self.labels)))
        a = np.exp(self.start - self.start.max())
        for t, (o, m) in enumerate(zip(first, active)):
            a = (a[:m] @ move if t else np.broadcast_to(a, (m, len(a)))) * local[packed[o : o + m]]
            a /= a.sum(axis=1, keepdims=True)
            alpha[o : o + m] = a
        return alpha

    def forward_backward(self, seqs: list[np.ndarray], score: np.ndarray, each=None) -> np.ndarray:
        """Label probabilities of the words of sequences of word numbers (longest first), summed by sequence.  `each(t, o, m, gamma, ahead)` is told of
        every step, backwards: its place, its probabilities, and what flows back from the step after (None at the end)."""
        packed, first, active = self._packed(seqs)
        local, move = np.exp(score - score.max(axis=1, keepdims=True)), np.exp(self.moves - self.moves.max())
        alpha = self._forward(packed, first, active, local, move)
        mass = np.zeros((len(seqs), len(self.labels)))
        b = None
        for t in range(len(first) - 1, -1, -1):
            o, m = first[t], active[t]
            now, ahead = np.ones((m, len(self.labels))), None
            if b is not None:
                ahead = b * local[packed[first[t + 1] : first[t + 1] + len(b)]]
                now[: len(b)] = ahead @ move.T
                now /= now.sum(axis=1, keepdims=True)
            gamma = alpha[o : o + m] * now
            gamma /= gamma.sum(axis=1, keepdims=True)
            mass[:m] += gamma
            if each:
                each(t, o, m, gamma, None if ahead is None else (alpha[o : o + len(b), :, None], move, ahead[:, None, :]))
            b = now
        return mass

    def expectations(self, seqs: list[np.ndarray], score: np.ndarray):
        """Packed word numbers, first places, label probabilities at each place, and expected moves: what training needs."""
        packed, first, _ = self._packed(seqs)
        gammas, pairs = np.empty((len(packed), len(self.labels))), np.zeros((len(self.labels),) * 2)

        def each(t, o, m, gamma, flow):
            gammas[o : o + m] = gamma
            if flow is not None:
                both = flow[0] * flow[1] * flow[2]
                pairs[:] += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)

        self.forward_backward(seqs, score, each)
        return packed, first, gammas, pairs

    def fit(self, seqs: list[tuple[np.ndarray, np.ndarray]], words: list[str], rounds: int, batch: int, rate: float, rng) -> None:
        """AdaGrad on the log-likelihood of label sequences."""
        n = len(self.labels)
        sums = [np.full(self.weights.shape, 1e-6, np.float32), np.full((n, n), 1e-6), np.full(n, 1e-6)]
        for _ in range(rounds):
            order = rng.permutation(len(seqs))
            for at in range(0, len(order), batch):
                part = sorted((seqs[i] for i in order[at : at + batch]), key=lambda s: -len(s[0]))
                used, number = np.unique(np.concatenate([s[0] for s in part]), return_inverse=True)
                ends = np.cumsum([len(s[0]) for s in part])
                local = np.split(number, ends[:-1])
                feats, word = self.features([words[i] for i in used])
                score = np.stack([np.bincount(word, self.weights[feats, k], len(used)) for k in range(n)], axis=1)
                packed, first, gamma, pairs = self.expectations(local, score)
                true = np.empty(len(packed), np.int64)
                for i, (_, y) in enumerate(part):
                    true[first[: len(y)] + i] = y
                slope = -gamma
                slope[np.arange(len(true)), true] += 1
                by_word = np.stack([np.bincount(packed, slope[:, k], len(used)) for k in range(n)], axis=1)
                moves, start = -pairs, slope[: len(part)].sum(axis=0)
                for _, y in part:
                    np.add.at(moves, (y[:-1], y[1:]), 1)
                touched, where = np.unique(feats, return_inverse=True)
                grad = np.stack([np.bincount(where, by_word[word, k], len(touched)) for k in range(n)], axis=1) / len(part)
                sums[0][touched] += grad**2
                self.weights[touched] += rate * grad / np.sqrt(sums[0][touched])
                for own, g, s in ((self.moves, moves / len(part), sums[1]), (self.start, start / len(part), sums[2])):
                    s += g**2
                    own += rate * g / np.sqrt(s)


def letter_words(text: str | None) -> list[str]:
    return [w for w in text.lower().split() if not w.isdigit() and any(map(str.isalpha, w))] if text else []


def fit(rows: list[tuple[str, str]], n_seqs: int = 12_000, seed: int = 7) -> Crf | None:
    """A chain fitted on (lang, text) rows: the sequences join 1 to 4 spans of 4 to 24 words."""
    texts: dict[str, list[np.ndarray]] = {}
    index: dict[str, int] = {}
    counts: dict[str, Counter] = {}
    for lang, text in sorted(rows):
        words = letter_words(text)
        if words:
            texts.setdefault(lang, []).append(np.array([index.setdefault(w, len(index)) for w in words]))
            counts.setdefault(lang, Counter()).update(words)
    if not texts:
        return None
    labels, vocabulary = sorted(texts), list(index)
    listed = sorted({w for c in counts.values() for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]})
    crf = Crf(labels, word_features(listed)[2])
    rng = np.random.default_rng(seed)
    seqs = []
    for _ in range(n_seqs):
        x, y = [], []
        for _ in range(rng.integers(1, 5)):
            k = int(rng.integers(len(labels)))
            own = texts[labels[k]]
            doc = own[rng.integers(len(own))]
            at, n = int(rng.integers(len(doc))), int(rng.integers(4, 25))
            x.append(doc[at : at + n])
            y.append(np.full(len(x[-1]), k))
        seqs.append((np.concatenate(x), np.concatenate(y)))
    crf.fit(seqs, vocabulary, rounds=2, batch=500, rate=0.3, rng=rng)
    return crf


class Predictor:
    """Predicts texts; remembers the scores of words."""

    def __init__(self, crf: Crf | None):
        self.crf, self.index = crf, {}
        self.score = np.empty((0, len(crf.labels) if crf else 0))

    def numbers(self, words: list[str]) -> np.ndarray:
        """Numbers of words; scores of new ones are made by `learn`."""
        index = self.index
        return np.fromiter((index.setdefault(w, len(index)) for w in words), np.int32, len(words))

    def learn(self) -> None:
        fresh = list(islice(self.index, len(self.score), None))
        parts = [self.crf.scores(fresh[i : i + FRESH_WORDS]) for i in range(0, len(fresh), FRESH_WORDS)]
        self.score = np.concatenate([self.score, *parts])

    def predict(self, texts: list[str | None], sure: bool = False) -> list[tuple[str, float]]:
        """Label and score of each text; with `sure` the score is the mean of each word's highest probability, whichever its label."""
        out: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(texts)
        if not self.crf:
            return out
        size = [len(t) if t else 0 for t in texts]
        order, held, n = sorted(range(len(texts)), key=lambda i: -size[i]), [], 0
        for i in order:
            held.append(i)
            n += size[i] // 4
            if n > BATCH_WORDS:
                self._run(texts, held, out, sure)
                held, n = [], 0
        self._run(texts, held, out, sure)
        return out

    def _run(self, texts: list, held: list[int], out: list, sure: bool) -> None:
        if len(self.index) > MEMORY:
            self.index, self.score = {}, self.score[:0]
        docs = [self.numbers(letter_words(texts[i])) for i in held]
        self.learn()
        some = sorted((k for k, d in enumerate(docs) if len(d)), key=lambda k: -len(docs[k]))
        if not some:
            return
        peak = np.zeros(len(some))

        def each(t, o, m, gamma, flow):
            peak[:m] += gamma.max(axis=1)

        mass = self.crf.forward_backward([docs[k] for k in some], self.score, each if sure else None)
        size = np.array([len(docs[k]) for k in some])
        mass /= size[:, None]
        best = mass.argmax(axis=1)
        for k, b, p in zip(some, best, peak / size if sure else mass.max(axis=1)):
            out[held[k]] = (self.crf.labels[b], float(min(1.0, p)))


def train(docs: DataFrame, per_lang: int = 300, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", lang_bytes: int = 8 << 20) -> Crf | None:
    """Fit on at most `per_lang` texts and `lang_bytes` bytes (and the text that reaches them) a language that are not in fold 0."""
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & (id_crc_mod("doc_id", folds) != 0))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    bound = F.lit(None)
    for lang, n in counts.items():
        least = min(2 * per_lang * 2**64 // n, 2**64 - 1) - 2**63
        bound = F.when(F.col("lang") == lang, F.lit(least)).otherwise(bound)
    # the least hashes, about twice as many as needed; equal texts become one before anything is ordered
    rows = rows.withColumn("rank", F.xxhash64("doc_id", "text")).filter(F.col("rank") <= bound)
    rows = rows.groupBy("lang", "text").agg(F.min("rank").alias("rank"))
    order = Window.partitionBy("lang").orderBy("rank", "text")
    rows = rows.withColumn("nth", F.row_number().over(order)).withColumn("before", F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    sample = rows.filter((F.col("nth") <= per_lang) & (F.coalesce("before", F.lit(0)) < lang_bytes)).select("lang", "text")
    crf = fit([(r["lang"], r["text"]) for r in sample.collect()])
    give_back()
    return crf


def language_id(docs: DataFrame, crf: Crf | None, folds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    def run(batches):
        predict = Predictor(shared.value).predict
        for b in batches:
            got = predict(list(b["text"]))
            yield b.drop(columns="text").assign(lang_pred=[g[0] for g in got], score=[g[1] for g in got])
            give_back()

    rows = docs.select(id_text(id_col), (id_crc_mod(id_col, folds) == 0).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return id_back(rows.mapInPandas(run, "doc_id string, held_out boolean, lang_pred string, score double"))


def kept(rows: pa.RecordBatch, place: int, predictor: Predictor, least: float) -> Iterator[pa.RecordBatch]:
    """The accepted rows, in parts of as much text as is read at once: a whole batch would be held again here, and by the JVM that takes it."""
    at = 0
    for part in slices(rows.column(place), SLICE_BYTES):
        keep = [g[0] != UNDETERMINED and g[1] >= least for g in predictor.predict(part.to_pylist(), sure=True)]
        yield rows.slice(at, len(part)).filter(pa.array(keep, pa.bool_()))
        at += len(part)
        give_back()


def accepted(docs: DataFrame, crf: Crf | None, least: float = 0.4, text_col: str = "text") -> DataFrame:
    """The documents, in their own columns, whose words are on average in some learned language with a probability of `least` or more: documents in one language, and
    those that mix several.  Documents without a letter go."""
    shared = docs.sparkSession.sparkContext.broadcast(crf)
    place = docs.columns.index(text_col)  # by place: names may clash

    def run(batches):
        predictor = Predictor(shared.value)
        for b in batches:
            yield from kept(b, place, predictor, least)

    return docs.mapInArrow(run, docs.schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language_id(docs, train(docs))


QUERIES = {"op6_language_id": op6_language_id}

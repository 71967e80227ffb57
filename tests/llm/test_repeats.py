import random
from collections import Counter

import numpy as np
import pytest

from wakeline.llm import common, repeats

RNG = random.Random(4)


def brute(texts, n):
    """(text number, start, length) of all unions of repeated windows."""
    words = [t.split() if t else [] for t in texts]
    seen = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = set()
    for k, w in enumerate(words):
        hit = [i for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1]
        cover = sorted({j for i in hit for j in range(i, i + n)})
        ends = [i for i, j in enumerate(cover) if i + 1 == len(cover) or cover[i + 1] != j + 1]
        at = 0
        for e in ends:
            # windows that only touch are one span, as in the operator
            out.add((k, cover[at], cover[e] + 1 - cover[at]))
            at = e + 1
    return out


def corpus():
    vocabulary = [f"w{i}" for i in range(60)]
    words = lambda n: [RNG.choice(vocabulary) for _ in range(n)]
    base, texts = words(300), []
    for _ in range(30):
        a = RNG.randint(0, 250)
        piece = base[a : a + RNG.randint(5, 120)]
        for _ in range(RNG.randint(0, 2)):
            piece[RNG.randrange(len(piece))] = "edit"
        texts.append(" ".join(words(RNG.randint(0, 30)) + piece + words(RNG.randint(0, 30))))
    return texts + [texts[0], texts[3], "", None, "one", " ".join(["same"] * 200), " ".join(words(400)), "é ü " * 40]


@pytest.mark.parametrize("n", [50, 20, 8])
def test_against_brute_force(spark, monkeypatch, n):
    monkeypatch.setattr(common, "BUCKET_KEYS", 500)
    monkeypatch.setattr(common, "CHUNK_BYTES", 3000)
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, chunk string")
    got = repeats.repeated_passages(docs, n).collect()
    assert {(r.doc_id, r.start_word, r.n_words) for r in got} == brute(texts, n)
    for r in got:
        assert texts[r.doc_id][r.start_char : r.end_char].split() == texts[r.doc_id].split()[r.start_word : r.start_word + r.n_words]


def test_odd_tables(spark):
    long = " ".join(f"x{i}" for i in range(60))
    docs = spark.createDataFrame([(None, long), (1, long), (1, long), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.n_words) for r in repeats.repeated_passages(docs).collect()) == [(False, 60), (False, 60), (True, 60)]
    assert repeats.repeated_passages(docs.limit(0)).count() == 0


def test_packed_arrays():
    for a in (np.sort(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64)), np.empty(0, np.uint64), np.array([5], np.uint64), np.array([2**63, 2**63 + 5], np.uint64)):
        assert (common.unpack_sorted(*common.unpack_arrays(common.pack_arrays(*common.pack_sorted(a)))) == a).all()

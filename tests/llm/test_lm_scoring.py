import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from wakeline.llm import common, lm_scoring
from wakeline.llm.ngram_trie import SCALE, EliasFano, Trie, mapped, quantise, value

RNG = random.Random(6)


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((1, 1), (1, 2**60), (5, 3), (64, 64), (1000, 50), (1000, 10**6), (5000, 4000), (3000, 2**60)):
        v = np.sort(rng.integers(0, top, n).astype(np.uint64))
        ef = EliasFano(*EliasFano.encode(v))
        assert (ef.get(np.arange(n)) == v).all()
        x = np.concatenate([v, v + 1, rng.integers(0, top * 2, 500).astype(np.uint64), np.array([0, 2**63], np.uint64)])
        assert (ef.successor(x) == np.searchsorted(v, x)).all()
        assert ((ef.find(x) >= 0) == np.isin(x, v)).all()
    none = EliasFano(*EliasFano.encode(np.empty(0, np.uint64)))
    assert (none.successor(np.array([0, 7], np.uint64)) == 0).all() and (none.find(np.array([0, 7], np.uint64)) == -1).all()


def test_elias_fano_is_compact():
    v = np.sort(np.random.default_rng(2).integers(0, 2**40, 100_000).astype(np.uint64))
    _, low, *arrays = EliasFano.encode(v)
    assert sum(a.nbytes for a in arrays) * 8 / len(v) < low + 3.5  # bits an element: two and the sampled counts above the low ones


def test_trie(tmp_path):
    rng = np.random.default_rng(2)
    triples = {tuple(t) for t in rng.integers(0, 12, (400, 3)).tolist()} | {(40, 1, 2)}
    pairs = sorted({t[:2] for t in triples} | {(3, 30), (50, 0)})
    words, triples = sorted({p[0] for p in pairs}), sorted(triples)
    second = np.array([words.index(u) for u, _ in pairs]), np.array([v for _, v in pairs])
    third = np.array([pairs.index(t[:2]) for t in triples]), np.array([t[2] for t in triples])
    codes = [rng.integers(1, 65536, len(x)).astype(np.uint16) for x in (pairs, triples)]
    backs = [rng.integers(1, 65536, len(x)).astype(np.uint16) for x in (words, pairs)]
    parts = 31, np.array(words), second, third, codes, backs
    path = tmp_path / "trie"
    path.write_bytes(Trie.pack(*parts))
    u, v, w = (a.ravel() for a in np.meshgrid(np.arange(55), np.arange(33), np.arange(14), indexing="ij"))
    for trie in (mapped(*parts), Trie.open(str(path))):
        a = trie.root(u)
        b = trie.child(1, a, v)
        c = trie.child(2, b, w)
        number = lambda keys, of: [of.get(k, -1) for k in keys]
        assert a.tolist() == number(u.tolist(), {x: i for i, x in enumerate(words)})
        assert b.tolist() == number(zip(u.tolist(), v.tolist()), {x: i for i, x in enumerate(pairs)})
        assert c.tolist() == number(zip(u.tolist(), v.tolist(), w.tolist()), {x: i for i, x in enumerate(triples)})
        assert all((x == y).all() for x, y in zip([*trie.codes[1:], *trie.backs[:2]], [*codes, *backs]))
    none = np.empty(0, np.int64)
    empty = mapped(1, none, (none, none), (none, none), [none, none], [none, none])
    assert (empty.root(u) == -1).all() and (empty.child(1, empty.root(u), v) == -1).all()


def test_quantise():
    v = -np.abs(np.random.default_rng(3).normal(size=20_000)) * 4
    code = quantise(v)
    assert code.min() >= 1 and np.abs(value(code) - v).max() <= 0.5 / SCALE + 1e-12
    assert value(quantise(np.array([0.0])))[0] == 0.0


def brute(rows):
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7
    c = Counter()
    after = {}  # context -> successors, of one and of two words
    for i, t in rows:
        if fold(i) != 2:
            w = tokens(t)
            c.update(w)
            for u, v, x in zip([None, None, *w], [None, *w], w):
                for context in ((v,), (u, v)):
                    after.setdefault(context, Counter())[x] += 1
    n, v_all = sum(c.values()), len(c)
    plain = lambda x: (c[x] + 1) / (n + v_all + 1)

    def chance(context, x):
        lower = chance(context[1:], x) if len(context) > 1 else plain(x)
        if context not in after:
            return lower
        s = after[context]
        return (s[x] + len(s) * lower) / (s.total() + len(s))

    out = []
    for i, t in rows:
        w = tokens(t)
        score = sum(math.log10(chance((u, v), x)) for u, v, x in zip([None, None, *w], [None, *w], w))
        out.append((i, fold(i) == 2, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10(plain(x)) for x in w), score))
    return out


def corpus():
    words = [f"w{k}" for k in range(50)]
    text = lambda n: " ".join(words[min(int(RNG.expovariate(0.1)), 49)] for _ in range(n))
    rows = [(i, text(RNG.randint(0, 60))) for i in range(150)]
    return rows + [(150, None), (151, ""), (152, "A a\tB\nb\x0bé É\xa0x"), (153, "never seen " * 3), (None, "w1 w2"), (3, rows[3][1]), (154, text(20_000))]


def scored(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, 0, "p") for i, t in rows], "doc_id long, text string, chunk int, payload string").repartition(3)
    return sorted((tuple(r) for r in lm_scoring.lm_scores(docs, **options).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[2]))


@pytest.fixture(scope="module")
def rows():
    return corpus() + [(i, "hot one " * 30 + f"hot w{i % 7}") for i in range(200, 230)]


def test_against_brute_force(spark, rows):
    want = sorted(brute(rows), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    for g, w in zip(scored(spark, rows), want, strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert g[6] == pytest.approx(w[6], rel=0.001)


@pytest.mark.parametrize(("chunk", "buckets", "hot"), [(4000, 300, 1 << 18), (4000, 300, 3), (30_000, 1500, 40), (4000, 1 << 20, 1)])
def test_dealing_changes_nothing(spark, monkeypatch, rows, chunk, buckets, hot):
    """Scores don't hang on the number of chunks or shards, or on which words are spread; `hot` reaches the workers with the function."""
    want = scored(spark, rows)
    monkeypatch.setattr(common, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(common, "BUCKET_KEYS", buckets)
    for g, w in zip(scored(spark, rows, hot=hot), want, strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-12)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, None)], "doc_id long, text string")
    assert lm_scoring.lm_scores(docs).first().n_tokens == 1
    assert lm_scoring.lm_scores(docs.limit(0)).count() == 0


def test_better_than_base(spark):
    got = lm_scoring.op9_lm_scores(spark, "/root/testdata/sf0.01").toPandas()
    held = got[got["held_out"]]
    print(held["base_score"].sum() / held["n_tokens"].sum(), held["score"].sum() / held["n_tokens"].sum())
    assert held["score"].sum() > held["base_score"].sum()

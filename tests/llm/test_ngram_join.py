import random

import duckdb
import pytest

from wakeline.llm import common, ngram_join as nj

RNG = random.Random(8)
DIR = "/root/testdata/sf0.001"


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, num, den):
    sets = [shingles(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                up[top(i)] = top(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(top(i), []).append(rows[i][0])
    least = {k: min((x for x in g if x is not None), default=None) for k, g in groups.items()}
    return sorted(((i, len(s), least[top(k)] if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus():
    vocabulary = [f"w{k}" for k in range(200)]
    words = lambda n: [RNG.choice(vocabulary) for _ in range(n)]
    shared, texts = words(40), []
    for _ in range(12):
        base = words(RNG.randint(3, 150))
        for _ in range(RNG.randint(1, 12)):
            copy = list(base)
            for _ in range(RNG.randint(0, max(1, len(copy) // 20))):
                copy[RNG.randrange(len(copy))] = RNG.choice(vocabulary)
            texts.append(" ".join(copy + (shared if RNG.random() < 0.3 else [])))
    texts += [" ".join(words(60) + shared + words(60)) for _ in range(15)]
    return texts + [texts[0]] * 3 + [None, "", "  \n", "One", "one", "one two", "One\ttwo", "one two three"]


@pytest.mark.parametrize(("n", "num", "den", "part"), [(4, 85, 100, 4096), (4, 85, 100, 3), (1, 6, 10, 4096), (2, 7, 10, 5)])
def test_against_brute_force(spark, monkeypatch, n, num, den, part):
    monkeypatch.setattr(nj, "LIST", part)
    monkeypatch.setattr(nj, "SPLIT", 4096 if part == 4096 else 2)  # else nearly all nodes are salted
    monkeypatch.setattr(common, "BUCKET_KEYS", 500)
    monkeypatch.setattr(common, "CHUNK_BYTES", 6000)
    rows = [(i * 7 % 1000, t) for i, t in enumerate(corpus())] + [(None, "only once in all of this"), (5, "only once in all of this")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, size int")
    got = sorted((tuple(r)[:3] for r in nj.ngram_join(docs, n, num, den).collect()), key=str)
    assert got == brute(rows, n, num, den)


def test_parity_is_a_lower_bound():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 3000, rng.integers(1, 900))) for _ in range(2))
        far = np.bitwise_count(nj.parity(a) ^ nj.parity(b)).sum()
        assert far <= len(np.setxor1d(a, b))


def test_derived_answers(spark):
    """Links found through a similar set are those found by comparing the sets."""
    sets = {}
    for k in range(12):
        base = {RNG.randrange(400) for _ in range(60)} if k % 3 else {*range(30 + k)}
        sets[k * 10] = base
        for j in range(1, 8):
            sets[k * 10 + j] = base - set(RNG.sample(sorted(base), RNG.randint(0, 5))) | {RNG.randrange(400) for _ in range(RNG.randint(0, 5))}
    nodes = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "node long, grams array<long>")
    rows = [(k, k // 10 * 10, sorted(sets[k] - sets[k // 10 * 10]), sorted(sets[k // 10 * 10] - sets[k])) for k in sets if k % 10]
    heads = spark.createDataFrame(rows, "a long, head long, more array<long>, less array<long>")
    pairs = [(a, b) for a in sets if a % 10 for b in sets if a != b]
    got = {tuple(r) for r in nj.derive(spark.createDataFrame(pairs, "a long, b long"), nodes, heads, 85, 100).collect()}
    want = {(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert got == want and want


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(tuple(r)[:3] for r in nj.ngram_join(docs).collect()) == [(1, 0, 1), (2, 0, 2)]
    assert nj.ngram_join(docs.limit(0)).count() == 0


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DIR}/documents.parquet'")
    want = sorted(con.execute(nj.SQL["op7_ngram_join"]).fetchall())
    assert sorted(map(tuple, nj.op7_ngram_join(spark, DIR).collect())) == want


def test_shingles_in_slices(monkeypatch):
    """Sets, their signatures and their order by rarity are the same whatever is read at a time."""
    import numpy as np
    import pyarrow as pa

    texts = pa.array(["", *corpus(), None, "x " * 200])
    drop = np.uint64(20)

    def made():
        s = nj.Shingles(texts, 4)
        own, counts = s.keys(drop)
        before = s.hashes.copy()
        alone = s.by_rarity(drop, own, nj._codes(counts))
        return before, s.size, s.signature, own, counts, s.hashes, alone

    whole = made()
    before, size, _, own, counts, after, alone = whole
    assert size.tolist() == [len(shingles(t, 4)) for t in texts.to_pylist()]
    code = dict(zip(own.tolist(), nj._codes(counts).tolist()))
    at = 0
    for n, k in zip(size.tolist(), alone.tolist()):
        ranked = sorted((code[h >> 20 << 20], h) for h in before[at : at + n].tolist())
        assert after[at : at + n].tolist() == [h for _, h in ranked] and k == sum(c == 1 for c, _ in ranked)
        at += n
    for most in (1, 300):
        monkeypatch.setattr(nj, "SLICE", most)
        for a, b in zip(whole, made()):
            assert np.array_equal(a, b)
    monkeypatch.setattr(nj, "SLICE", 1 << 18)
    assert all(not len(x) for x in nj.Shingles(pa.array([], pa.string()), 4).keys(drop))


def test_memory_of_a_chunk():
    """The shingles of a chunk take no more than six times their own bytes while they are made (it was 12 times and the texts)."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    texts = pa.array([" ".join(map(str, rng.integers(0, 100_000, 500))) for _ in range(800)])
    tracemalloc.start()
    s = nj.Shingles(texts, 5)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most <= 6 * s.hashes.nbytes, most / s.hashes.nbytes

import base64
import hashlib
import math
import random
from collections import Counter

import numpy as np

from wakeline.llm import fingerprints as fp

RNG = random.Random(2)


def prose(n):
    return " ".join("".join(RNG.choice(["an", "the", "re", "ti", "on", "sh", "éa"]) for _ in range(RNG.randint(1, 4))) for _ in range(n))


def entropy_level(w):
    h = sum(-c / 64 * math.log2(c / 64) for c in Counter(w).values())
    return h * 1000 / 6


def plain_features(text, rank, at):
    """Straight from the definition."""
    n = len(text) - 63
    r = [int(rank[at[i]]) for i in range(n)]
    points = Counter()
    for i in range(max(1, n - 63)):
        run = r[i : i + 64]
        low = min(run)
        if low < fp.LEVELS:
            points[i + run.index(low)] += 1
    return sorted(i for i, p in points.items() if p >= fp.POINTS)


def test_levels_and_features():
    text = prose(300).encode() + b"a" * 100
    x = np.frombuffer(text + bytes(64), np.uint8)
    at = fp.levels(x)
    assert all(abs(at[i] - entropy_level(text[i : i + 64])) < 1.1 for i in range(len(text) - 63))
    rank = fp.ranks_of(fp.level_counts([text]))
    assert fp.level_counts([text]).sum() == len(text) - 63
    spots = plain_features(text, rank, at)
    assert spots and fp.digests([b"x" * 70, text, b"", b"short"], rank)[1] == fp._chain(fp._hashes(x, np.array(spots)))


def test_digest_hangs_on_the_text_alone():
    texts = [prose(RNG.randint(0, 120)).encode() for _ in range(50)] + [b"", b"a", b"b" * 63, b"c" * 64, b"d" * 5000]
    rank = fp.ranks_of(fp.level_counts(texts))
    alone = [fp.digests([t], rank)[0] for t in texts]
    assert fp.digests(texts, rank) == alone
    assert all(bool(c) == bool(t) for c, t in zip(alone, texts))


def test_likeness():
    texts = [prose(400) for _ in range(20)]
    rank = fp.ranks_of(fp.level_counts([t.encode() for t in texts]))
    chains = fp.digests([t.encode() for t in texts], rank)
    near = fp.digests([fp.edited(t, prose(400)).encode() for t in texts], rank)
    assert fp.likeness(b"", b"") == 1.0 and fp.likeness(b"", chains[0]) == 0.0
    assert all(fp.likeness(a, b) > fp.likeness(a, c) for a, b, c in zip(chains, near, chains[1:]))
    assert fp.likeness(chains[0], chains[1]) == fp.likeness(chains[1], chains[0])
    assert fp.likeness(chains[0], chains[0]) == 1.0


def test_report(spark, monkeypatch):
    monkeypatch.setattr(fp, "CHUNK_BYTES", 20_000)
    rows = [(i * 3, prose(RNG.randint(0, 200))) for i in range(120)] + [(400, None), (401, "tiny"), (402, ""), (403, "ü" * 100_000)]
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, block string").repartition(5)
    rank = fp.rarity(docs)
    assert (rank == fp.ranks_of(fp.level_counts([(t or "").encode() for _, t in rows]))).all()
    got = {r.doc_id: r for r in fp.fingerprint_report(docs, rank).collect()}
    assert len(got) == len(rows)
    for (i, text), (_, follower) in zip(rows, rows[1:] + rows[:1]):
        r, text, follower = got[i], text or "", follower or ""
        changed = fp.edited(text, follower)
        a, b, c = fp.digests([text.encode(), changed.encode(), follower.encode()], rank)
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (base64.b64decode(r.fingerprint), base64.b64decode(r.edited_fingerprint)) == (a, b)
        assert (r.near_edited, r.near_next) == (fp.likeness(a, b), fp.likeness(a, c))


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b"), (1, None)], "doc_id long, text string")
    assert fp.fingerprint_report(docs, fp.rarity(docs)).count() == 4
    assert fp.fingerprint_report(docs.limit(0), fp.rarity(docs.limit(0))).count() == 0
    assert fp.fingerprint_report(docs.limit(1), fp.rarity(docs)).first().near_next == 1.0
    assert fp.fingerprints(docs, fp.rarity(docs)).count() == 4


def test_many_blocks(spark, monkeypatch):
    """Two thousand blocks, as many as 16 GB of text make; each row still meets the next."""
    monkeypatch.setattr(fp, "CHUNK_BYTES", 16)
    rows = [(i, f"document {i:07d}") for i in range(2100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spread = fp.in_order(docs, "doc_id", "text")
    assert spread.agg({"block": "max"}).first()[0] > 1900
    got = {r.doc_id: r.edited_sha256 for r in fp.fingerprint_report(docs, np.arange(fp.LEVELS)).collect()}
    for (i, text), (_, follower) in zip(rows, rows[1:] + rows[:1]):
        assert got[i] == hashlib.sha256(fp.edited(text, follower).encode()).hexdigest()


def plain_likeness(a, b):
    """Filter by filter, bit by bit."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    split = lambda v: [{k for k in range(2048) if v[i + k // 8] >> k % 8 & 1} for i in range(0, len(v), 256)]
    x, y = sorted((split(a), split(b)), key=len) if len(a) != len(b) else (split(min(a, b)), split(max(a, b)))
    total = 0.0
    for s in x:
        best = 0.0
        for t in y:
            chance, most = len(s) * len(t) / 2048, min(len(s), len(t))
            cut = chance + 0.3 * (most - chance)
            best = max(best, min(1.0, (len(s & t) - cut) / max(most - cut, 1e-9)))
        total += best
    return total / len(x)


def test_likeness_is_brute_force():
    texts = [prose(RNG.choice([0, 3, 40, 900, 2500])).encode() for _ in range(25)]
    texts += [fp.edited(t.decode(), prose(900)).encode() for t in texts[:10]]
    chains = fp.digests(texts, fp.ranks_of(fp.level_counts(texts)))
    for a in chains:
        for b in chains:
            assert abs(fp.likeness(a, b) - plain_likeness(a, b)) < 1e-9

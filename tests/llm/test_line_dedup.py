import random

import pytest

from wakeline.llm import common, line_dedup as ld

RNG = random.Random(9)


def brute(rows, num, den):
    """Texts after removal, by comparing each line with all earlier ones."""
    seen, out = [], {}
    for k, (i, t) in sorted(enumerate(rows), key=lambda r: (r[1][0] is not None, r[1][0] or 0, r[0])):
        kept = []
        for x in t.split("\n") if t else []:
            s = set(x.encode().lower().split())
            if not s:
                kept.append(x)
                continue
            if not any(den * len(s & o) >= num * len(s | o) for o in seen):
                kept.append(x)
            seen.append(s)
        out[k] = (i, None if t is None else "\n".join(kept))
    return sorted(out.values(), key=str)


def corpus():
    vocabulary = [f"w{k}" for k in range(80)]
    lines = [[RNG.choice(vocabulary) for _ in range(RNG.randint(1, 40))] for _ in range(60)]

    def line():
        own = list(RNG.choice(lines))
        for _ in range(RNG.choice([0, 0, 1, 2, 5])):
            own[RNG.randrange(len(own))] = RNG.choice(vocabulary)
        return " ".join(own).title() if RNG.random() < 0.1 else " ".join(own)

    texts = ["\n".join(line() for _ in range(RNG.randint(0, 8))) for _ in range(80)]
    return texts + [None, "", "\n\n", "One\nOne\n \none", "é x\r\né x", " ".join(vocabulary * 50), texts[0]]


@pytest.mark.parametrize(("num", "den", "keep", "spare"), [(8, 10, 8, 18), (8, 10, 1, 18), (5, 10, 2, -4), (9, 10, 8, -2)])
def test_against_brute_force(spark, monkeypatch, num, den, keep, spare):
    monkeypatch.setattr(ld, "SPARE_BITS", spare)  # few bits: many words share a key
    monkeypatch.setattr(common, "BUCKET_KEYS", 300)
    rows = [((i * 37) % 1000, t) for i, t in enumerate(corpus())] + [(None, "w1 w2 w3\nnew line here")]
    docs = spark.createDataFrame([(i, t, "x", [1]) for i, t in rows], "doc_id long, text string, chunk string, lines array<int>").repartition(4)
    got = ld.line_dedup(docs, num, den, keep=keep)
    assert got.columns == ["doc_id", "text", "chunk", "lines", "_n_lines", "_n_removed", "_n_left"]
    got = got.collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == brute(rows, num, den)
    assert all(r.lines == [1] and r.chunk == "x" for r in got)


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c\nd e"), (1, "a b c\nd e"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id, r._n_removed, r._n_left) for r in ld.line_dedup(docs).collect()) == [(1, 0, 2), (1, 2, 0), (2, 0, 1)]


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert sorted((r.text, r._n_lines) for r in ld.line_dedup(docs).select("*").fillna("-", ["text"]).collect()) == [("", 0), ("-", 0)]
    assert ld.line_dedup(docs.limit(0)).count() == 0


def test_word_hashes():
    words = [b"a", b"a\0", b"abcdefgh", b"abcdefgi", b"abcdefgh\0", b"abcdefghi", b"abcdefghabcdefgh", b"\xc3\xa9\x08\x0e\x1f!\x7f\xa0", b"x" * 63, b"x" * 64, b"x" * 65, b"x" * 66, b"y" * 500]
    data = b" \t" + b" \n\x0b\x0c\r".join(words * 2) + b"\n"
    found, start = ld.words_at(data)
    assert [data[i:].split()[0] if not data[i:].startswith(b"\xc3") else words[7] for i in start.tolist()] == words * 2
    assert list(found[: len(words)]) == list(found[len(words) :]) and len(set(found.tolist())) == len(words)
    for w in words:  # alike wherever the word stands, and at the ends
        assert ld.words_at(w)[0].tolist() == [found[words.index(w)]] and ld.words_at(b"z " + w + b" z")[0][1] == found[words.index(w)]
    assert [len(a) for a in ld.words_at(b"")] == [len(a) for a in ld.words_at(b" \n ")] == [0, 0]


def test_rows_stay_in_the_exchange(spark):
    """Texts are read and dealt once; of all steps in Python only the last is given the compressed rows."""
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    plan = ld.line_dedup(docs)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    below = [sum("MapInArrow" in x for x in plan), sum("MapInArrow" in x and "rows#" in x for x in plan)]
    assert below[0] == below[1] > 1  # all alike, so that one exchange serves all
    assert sum("octet_length(rows#" in x for x in plan) == below[0] - 1


def test_nothing_heard_nothing_decoded():
    lines = ld.Lines(b"not a blob", b"nor this")
    assert ld.show(7, lines, [(-8, b"own")]) == [(-8, 7, b"own")]


def test_memory_of_a_bucket():
    """Joining a bucket takes no more than 20 times the bytes of its postings' words (it was 32 times)."""
    import tracemalloc

    import numpy as np
    import pandas as pd

    n, parts, rng = 1 << 18, 16, np.random.default_rng(3)
    rows = []
    for c in range(parts):
        m = n // parts
        word = np.sort(rng.integers(0, n // 8, m)).astype(np.uint64) << np.uint64(20)
        size = rng.integers(10, 400, m).astype(np.uint32)
        size[size > 96] //= 5
        line = np.arange(m, dtype=np.uint32)
        none = np.empty(0, np.uint64)
        rows.append((0, c, common.pack_arrays(*common.pack_sorted(word), line, line % 3, size, line.astype(np.int64) + c * m, rng.integers(0, 1 << 62, m).astype(np.uint64), none, none, none)))
    got = pd.DataFrame(rows, columns=["bucket", "chunk", "payload"])
    tracemalloc.start()
    ld.match(got, 4, 8, 10)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most <= 20 * 8 * n, most / 8 / n

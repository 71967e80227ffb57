import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from wakeline.llm import decontamination as dc

RNG = random.Random(11)


def grams(w):
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])


def similarity(a, b):
    return sum((a & b).values()) / sum((a | b).values())


def brute(docs, items):
    """Best similarity of any window of the item's size, at any place."""
    out = {}
    for d, t in docs:
        w = (t or "").lower().split()
        for i, u in items:
            v = (u or "").lower().split()
            if w and v:
                best = max(similarity(grams(w[s : s + len(v)]), grams(v)) for s in range(max(1, len(w) - len(v) + 1)))
                if best >= 0.8:
                    out[d, i] = best
    return out


def corpus():
    vocabulary = [f"w{k}" for k in range(300)]
    words = lambda n: [RNG.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(words(RNG.choice([1, 3, 5, 6, 20, 40, 60])))) for k in range(30)] + [(40, None), (41, " \n"), (42, "x y " * 20), (43, "Twice Said")]
    docs = []
    for k in range(150):
        text = words(RNG.randint(0, 80))
        if RNG.random() < 0.6:
            own = RNG.choice(items[:30])[1].split()
            for _ in range(RNG.choice([0, 0, 1, 2])):
                at = RNG.randrange(max(1, len(own)))
                own[at : at + RNG.choice([0, 1])] = RNG.choice([[], ["edit"]])
            text[len(text) // 2 : len(text) // 2] = own
        docs.append((k, " ".join(text)))
    for k in range(150, 190):  # the item's words in another order: two parts changed places, between other words
        own = RNG.choice([u for _, u in items if u and len(u.split()) in (40, 60)]).split()
        cut = RNG.randint(3, len(own) - 3)
        docs.append((k, " ".join(words(RNG.randint(0, 30)) + own[cut:] + own[:cut] + words(RNG.randint(0, 30)))))
    return docs + [(200, None), (201, ""), (202, "x y " * 300), (203, "so twice\tsaid it"), (204, "W1 " * 2000)], items


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(dc, "BROADCAST", limit)
    rows, items = corpus()
    docs = spark.createDataFrame([(d, t, "z", 1) for d, t in rows + rows[:3]], "doc_id long, text string, item_id string, m int")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): r for r in dc.contaminated(docs, bench).collect()}
    want = brute(rows, items)
    assert set(got) == set(want)
    for k, r in got.items():
        assert r.similarity == pytest.approx(want[k])
    kept = dc.clean(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in want}


def test_simhash_and_index(spark):
    one = spark.createDataFrame([(1, [5, 6, 7, 8, 9, 10, 5, 6, 7, 8, 9])], "item long, words array<long>")
    (r,) = dc.simhash(one, "item").collect()
    w = {x.gram: x.n for x in dc.weights(one, "item").collect()}
    assert sum(w.values()) == 7
    for half, seed in (("left", 1), ("right", 2)):
        votes = [0] * 64
        for g, n in w.items():
            h = spark.range(1).select(F.xxhash64(F.lit(g), F.lit(seed))).first()[0]
            for b in range(64):
                votes[b] += n if h >> b & 1 else 0
        assert r[half] & (2**64 - 1) == sum(1 << b for b in range(64) if 2 * votes[b] > 7)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, None)], "doc_id long, text string")
    items = spark.createDataFrame([(None, "b c d e f")], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.start_word, r.n_words) for r in dc.contaminated(docs, items).collect()] == [(None, None, 1, 5)]
    assert dc.contaminated(docs, items.limit(0)).count() == 0 and dc.clean(docs, items.limit(0)).count() == 2
    assert dc.contaminated(docs.limit(0), items).count() == 0


def test_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    want = sorted(con.execute(dc.SQL["op4_decontamination"]).fetchall())
    assert want and sorted(map(tuple, dc.op4_decontamination(spark, d).collect())) == want

import itertools

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from wakeline.llm.language_id import BUCKETS, Crf, Predictor, accepted, fit, language_id, slices, train

DIR = "/root/testdata/sf0.01"


def test_forward_backward_is_brute_force():
    rng = np.random.default_rng(1)
    crf = Crf(["a", "b", "c"], np.empty(0, np.uint64))
    crf.moves, crf.start = rng.normal(size=(3, 3)), rng.normal(size=3)
    score = rng.normal(size=(6, 3)) * 2
    seqs = [rng.integers(0, 6, n) for n in (5, 4, 4, 1)]
    _, first, gamma, pairs = crf.expectations(seqs, score)
    mass = crf.forward_backward(seqs, score)
    want_pairs = np.zeros((3, 3))
    for i, s in enumerate(seqs):
        want, total = np.zeros((len(s), 3)), 0.0
        two = np.zeros((3, 3))
        for y in itertools.product(range(3), repeat=len(s)):
            p = np.exp(crf.start[y[0]] + sum(score[w, k] for w, k in zip(s, y)) + sum(crf.moves[a, b] for a, b in zip(y, y[1:])))
            total += p
            for t, k in enumerate(y):
                want[t, k] += p
            for a, b in zip(y, y[1:]):
                two[a, b] += p
        want_pairs += two / total
        got = np.stack([gamma[first[t] + i] for t in range(len(s))])
        assert np.allclose(got, want / total) and np.allclose(mass[i], got.sum(axis=0))
    assert np.allclose(pairs, want_pairs)


@pytest.fixture(scope="module")
def crf():
    rows = duckdb.sql(f"select lang, text from '{DIR}/documents.parquet' where doc_id % 2 = 0").fetchall()
    return fit([r for r in rows if r[0]])


def test_code_switching(crf):
    en = "the of and with that this thing inthe anrend thation"
    fr = "leau quement étionre pour les eauxque entre étrelle dans"
    p = Predictor(crf)
    seq = p.numbers(f"{en} {fr}".split())
    p.learn()
    _, _, gamma, _ = crf.expectations([seq], p.score)
    got = [crf.labels[k] for k in gamma.argmax(axis=1)]
    assert got[:10].count("en") >= 9 and got[10:].count("fr") >= 8


def test_edges(crf):
    got = Predictor(crf).predict([None, "", "123 ... !", "the " * 30_000, "x" * 100_000, "the of and"])
    assert [g[0] for g in got[:3]] == ["und"] * 3 and got[3][0] == "en" and got[4][0] in crf.labels
    assert all(0 <= g[1] <= 1 for g in got)
    assert got[5] == Predictor(crf).predict(["the of and"])[0]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    crf = train(docs)
    got = language_id(docs, crf).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == 1000
    held = got[got["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.98
    assert accepted(docs, crf).count() > 950


def test_odd_tables(spark):
    rows = spark.createDataFrame([(None, None, None, 1), (1, "", "en", 2), (2, "the and", None, 3), (2, "the and", None, 3)], "doc_id long, text string, lang string, score int")
    got = language_id(rows, train(rows)).collect()
    assert len(got) == 4 and all(r.lang_pred == "und" and r.score == 0.0 for r in got)
    assert language_id(rows.limit(0), None).count() == 0 and accepted(rows, None).count() == 0


def test_slices():
    texts = ["a" * 5, None, "", "b" * 30, "é" * 4, None, "c"]
    for most in (1, 9, 30, 1000):
        for start in (0, 2):
            parts = [p.to_pylist() for p in slices(pa.array(texts).slice(start), most)]
            assert [t for p in parts for t in p] == texts[start:]
            assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p) <= most for p in parts)
    assert list(slices(pa.array([], pa.string()), 9)) == []


def test_accepted_rows_leave_in_parts(monkeypatch):
    import pyarrow as pa

    from wakeline.llm import language_id as li

    class Some:
        def predict(self, texts, sure):
            return [("en", 1.0 if len(t or "") % 3 else 0.1) for t in texts]

    monkeypatch.setattr(li, "SLICE_BYTES", 100)
    texts = ["x" * (k % 50) for k in range(200)] + [None, "y" * 400, "z"]
    rows = pa.RecordBatch.from_pydict({"n": list(range(len(texts))), "text": texts})
    parts = list(li.kept(rows, 1, Some(), 0.4))
    want = [(k, t) for k, t in enumerate(texts) if len(t or "") % 3]
    assert [(r["n"], r["text"]) for p in parts for r in p.to_pylist()] == want
    assert all(sum(len(t) for t in p.column("text").to_pylist()) <= 100 for p in parts if p.num_rows > 1)

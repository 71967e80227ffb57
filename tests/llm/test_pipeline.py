"""The pipeline, stage by stage, against plain Python on the same rows."""

import math

import duckdb
import pytest

import corpus_pipeline as cp
from plain_versions import contaminated, lines_after, near_components  # noqa: F401

DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{DIR}/documents.parquet"), {}
    out["input"] = docs
    for name, stage in cp.STAGES:
        docs = cp.scratch(stage(spark, docs, DIR), f"test-{name}")
        out[name] = docs
    return out


def rows(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_names():
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "ngram_join", "decontamination", "packing"]
    assert cp.ORACLE_SQL is None


def test_columns(stages):
    for name in list(stages)[:-1]:
        assert stages[name].columns == COLUMNS


def test_language_stage(stages):
    before, after = rows(stages["input"]), rows(stages["language_id"])
    assert set(after) <= set(before)
    with_letters = {i for i, t in before if t and any(c.isalpha() for c in t)}
    assert {i for i, _ in after} <= with_letters and len(after) >= 0.97 * len(with_letters)


def test_line_stage(stages):
    want = lines_after(rows(stages["language_id"]))
    assert rows(stages["line_dedup"]) == want
    for r in stages["line_dedup"].collect():
        assert r.n_chars == len(r.text) or r.text in dict(rows(stages["language_id"])).values()


def test_join_stage(stages):
    before = rows(stages["line_dedup"])
    least = near_components(before)
    assert rows(stages["ngram_join"]) == [(i, t) for i, t in before if least[i] == i]


def test_join_stage_on_copies(spark, stages):
    docs = stages["input"]
    kept = rows(cp.join_near(spark, docs.union(docs), DIR))
    least = near_components(rows(docs))
    assert kept == [(i, t) for i, t in rows(docs) if least[i] == i]


def test_join_stage_goes_by_row(spark):
    """Of two rows with one id, one a copy of another document's text, only the copy goes."""
    text, other = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows_in = [(3, text, "x"), (5, text, "x"), (5, other, "x"), (5, other, "x"), (None, text, "x"), (None, "alone in all of the table", "x"), (7, None, "x"), (8, "", "x"), (7, None, "y")]
    docs = spark.createDataFrame(rows_in, "doc_id long, text string, _id string")
    got = sorted(((r.doc_id, r.text) for r in cp.join_near(spark, docs, DIR).collect()), key=str)
    assert got == sorted([(3, text), (5, other), (None, "alone in all of the table"), (7, None), (7, None), (8, "")], key=str)


def test_decontamination_stage(spark, stages):
    items = duckdb.sql(f"select text from '{DIR}/benchmark.parquet'").fetchall()
    for name in ("ngram_join", "input"):
        docs = stages[name]
        bad = contaminated(rows(docs), [t for (t,) in items])
        assert rows(cp.decontaminate(spark, docs, DIR)) == [(i, t) for i, t in rows(docs) if i not in bad]
        assert bad or name != "input"


def test_packing_stage(stages):
    out = stages["packing"].toPandas()
    assert set(out["doc_id"]) == {i for i, _ in rows(stages["decontamination"])}
    assert out["sequence_id"].nunique() <= math.ceil(out["length"].sum() / 2048) + 1
    assert out.groupby("sequence_id")["length"].sum().max() <= 2048


def test_run(spark, stages):
    assert cp.run(spark, DIR).count() == stages["packing"].count()

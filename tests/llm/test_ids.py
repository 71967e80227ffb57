"""Ids that a double cannot hold, beside null ones, in the same batch: every operator hands them on unchanged.  And columns with clashing names, and empty tables."""

import public_tokenizers as P
import pytest

from wakeline.llm import decontamination, fingerprints, language_id, line_dedup, lm_scoring, ngram_join, packing, repeats, token_counts, token_output

BIG = 2**53 + 1
LONG = " ".join(f"x{i}" for i in range(60))
ROWS = [(BIG, LONG, "en"), (None, LONG, "en"), (BIG + 2, "the quick brown fox", "en"), (None, None, None), (2**63 - 1, "", "de")]
IDS = {BIG, BIG + 2, 2**63 - 1, None}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, 1, "a", "b", 7, 8) for r in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, chunk int, bucket string, block string, piece int, size int").coalesce(1)


def json():
    return P.path("byte_bpe_50k.json")


RUNS = {
    "op3": lambda d: fingerprints.fingerprint_report(d, fingerprints.rarity(d)),
    "op3_plain": lambda d: fingerprints.fingerprints(d, fingerprints.rarity(d)),
    "op5": lambda d: token_counts.token_counts(d, P.path("piece_bpe_32k.model")),
    "op6": lambda d: language_id.language_id(d, language_id.train(d)),
    "op7": lambda d: ngram_join.ngram_join(d),
    "op8": lambda d: line_dedup.line_dedup(d.drop("chunk")),
    "op9": lambda d: lm_scoring.lm_scores(d),
    "op10": lambda d: packing.best_fit_packing(d, json(), 2048),
    "op6_kept": lambda d: language_id.accepted(d, language_id.train(d.select("doc_id", "text", "lang"))),
}


@pytest.mark.parametrize("name", list(RUNS))
def test_ids(docs, name):
    got = {r.doc_id for r in RUNS[name](docs).collect()}
    assert got == IDS - ({2**63 - 1} if name == "op6_kept" else set())


@pytest.mark.parametrize("name", list(RUNS))
def test_empty(docs, name):
    assert RUNS[name](docs.limit(0)).count() == 0


def test_output_ids(docs):
    rows = token_output.token_output(docs, json()).collect()
    assert {i for r in rows for i in r.doc_ids} == IDS
    assert token_output.token_output(docs.limit(0), json()).count() == 0


def test_passage_ids(docs):
    assert sorted((str(r.doc_id), r.n_words) for r in repeats.repeated_passages(docs).collect()) == [(str(BIG), 60), ("None", 60)]


def test_contaminated_ids(spark, docs):
    items = spark.createDataFrame([(BIG, LONG), (None, "quick brown fox"), (1, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items).collect()}
    assert got == {(BIG, BIG), (None, BIG), (BIG + 2, None)}
    assert decontamination.contaminated(docs, items.limit(0)).count() == 0

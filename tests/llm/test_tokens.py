import math
import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from wakeline.llm import packing
from wakeline.llm.packing import best_fit_packing, pack
from wakeline.llm.token_counts import PieceCounter, token_counts
from wakeline.llm.token_output import pack_decreasing, token_output
from wakeline.llm.tokenizer import ByteBpe, cuts

MODEL, JSON = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.json")
COUNTER, LIB, BPE = PieceCounter(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL), ByteBpe(JSON)
ODD = ["", " ", "   ", "\n", "a", "Hello  wörld \n x<s> ﬁ①", "  lead", "trail  ", "\t\ttab", "\n\n \n", "<0x41></s>", "日本語 テキスト🙂", "a b c", "▁▁x", "x" * 300, "é" * 50, "don't  we'll 123,456"]


@pytest.mark.parametrize("text", ODD)
def test_count_odd(text):
    assert COUNTER.count(text) == len(LIB.encode(text))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_count_random(text):
    assert COUNTER.count(text) == len(LIB.encode(text))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab té\n\t.,'ßñ1２  <|endoftext|>"), max_size=60) | st.text(max_size=60))
def test_ids_are_the_library_s(text):
    assert BPE.encode(text).tolist() == BPE.slow.encode(text, add_special_tokens=False).ids


def test_special_string():
    assert 50256 in BPE.encode("a<|endoftext|>b").tolist()
    assert BPE.fast is not None


def test_cuts():
    assert cuts(5, 10) == [(0, 5)] and cuts(10, 10) == [(0, 10)] and cuts(25, 10) == [(0, 5), (5, 10), (15, 10)]


@pytest.mark.parametrize("packer", [pack, pack_decreasing])
def test_pack(packer):
    rng = random.Random(3)
    for _ in range(60):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(0, 80))]
        bins = packer(sizes, 100)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(0 < sum(sizes[i] for i in b) <= 100 for b in bins)
        assert len(bins) <= math.ceil(sum(sizes) / 100) * 1.25 + 1


def test_local_search_beats_best_fit():
    rng, better = random.Random(5), 0
    for _ in range(200):
        sizes = [rng.randint(15, 50) for _ in range(60)]
        a, b = len(pack(sizes, 100)), len(pack_decreasing(sizes, 100))
        assert a <= b
        better += a < b
    assert better


def test_local_search_tries_all_bins(monkeypatch):
    """It stops only at the lower bound or where no bin has a step left."""
    monkeypatch.setattr(packing, "TRIES", 1)
    rng = random.Random(8)
    for _ in range(60):
        bins = packing.Bins([rng.randint(15, 50) for _ in range(60)], 100)
        bins.best_fit()
        bins.local_search()
        under = [b for b, r in enumerate(bins.room) if r]
        assert len(bins.items) == math.ceil(sum(bins.sizes) / 100) or not any(bins._step(b, x, under) for b in under for x in bins.items[b])


def test_packing_in_shards(spark):
    """What shards leave over is packed together, in as many rounds as it takes."""
    rng = random.Random(9)
    rows = [(i, 0, min(100, int(rng.expovariate(0.04)) + 1)) for i in range(1500)]
    got = packing.place(spark.createDataFrame(rows, "doc_id long, piece int, length long"), 100, shard=50).toPandas()
    assert sorted(zip(got["doc_id"], got["piece"], got["length"])) == rows
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 100
    assert got["sequence_id"].nunique() <= math.ceil(got["length"].sum() / 100) + 1


def docs(spark):
    rows = [(1, "a b c d", "x"), (2, None, None), (3, "", "y"), (3, "", "y"), (4, "word " * 5000, "z"), (None, "no id", "z")] + [(10 + i, "some words " * i, "s") for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, piece string")


def test_counts_table(spark):
    got = {(r.doc_id, r.n_tokens): r for r in token_counts(docs(spark), MODEL).collect()}
    assert got[2, 0].n_bytes == 0 and got[4, len(LIB.encode("word " * 5000))].over_limit
    assert token_counts(docs(spark).limit(0), MODEL).count() == 0


def test_packing_table(spark):
    rows = best_fit_packing(docs(spark), JSON, 128, with_ids=True).toPandas()
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 128
    four = rows[rows["doc_id"] == 4].sort_values("piece")
    assert np.frombuffer(b"".join(four["ids"]), "<u4").tolist() == [*BPE.encode("word " * 5000), 0]
    assert rows["doc_id"].isna().sum() == 1 and (rows["doc_id"] == 3).sum() == 2
    assert rows["sequence_id"].nunique() <= math.ceil(rows["length"].sum() / 128) + 1
    assert best_fit_packing(docs(spark).limit(0), JSON).count() == 0


def test_output_table(spark):
    found = {}
    for r in token_output(docs(spark), JSON, 128, window=2000).collect():
        ids, at = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(at) == 128 and r.cu_seqlens[-1] == r.n_tokens
        for doc, k, a, b in zip(r.doc_ids, r.pieces, r.cu_seqlens, r.cu_seqlens[1:]):
            found.setdefault(doc, []).append((k, ids[a:b].tolist()))
            assert at[a:b].tolist() == list(range(b - a))
    assert [x for _, p in sorted(found[4]) for x in p] == [*BPE.encode("word " * 5000), 50256]
    assert len(found[3]) == 2 and found[2] == [(0, [50256])]

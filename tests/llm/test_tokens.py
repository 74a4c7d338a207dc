"""Token counts and packing against the tokenizer libraries."""

import random
import zlib

import numpy as np
import pytest

from protolens.llm import packing, token_count
from protolens.llm.queries import tokenizer_path

ODD = [None, "", " ", "  a  b", "x  y", "  y", "é \n z  q", "a\n\n b \t", "<|endoftext|> hi <s>", "it's we're I'll '  's", "日本語 テキスト　 x",
       "a\x1c b", "12 34a", "\n", "a ", "a  ", "\u0085   b", "▁x a", "a.b,c! d's. é.", "w" * 5000, "word, " * 3000, "\x00 b"]


def frame(spark, texts):
    rows = [(i, t, "x", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:2], "doc_id long, text string, n_tokens string, length long").repartition(3)


def test_counts_equal_the_library(spark):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = token_count.count_tokens(frame(spark, ODD), path, limit=100).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        t = ODD[r["doc_id"]] or ""
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), len(sp.encode(t)), len(sp.encode(t)) > 100), t[:30]


def test_counts_of_an_empty_table(spark):
    assert token_count.count_tokens(frame(spark, ODD).limit(0), tokenizer_path("piece_bpe_32k.model")).collect() == []


@pytest.mark.parametrize("most", [2048, 16])
def test_packing_is_exact_and_gapless(spark, most):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = packing.pack(frame(spark, ODD), path, max_tokens=most, with_ids=True).collect()
    seen, sequences = {}, {}
    for r in got:
        ids = np.array(r["ids"], "<u4")
        assert len(ids) == r["length"] <= most and zlib.crc32(ids.tobytes()) == r["ids_crc32"]
        seen.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t in enumerate(ODD):
        want = tok.encode(t or "", add_special_tokens=False).ids + [0]
        pieces = sorted(seen[i], key=lambda r: r["piece"])
        pieces = pieces[::2] if i < 2 else pieces  # these rows come twice
        assert [r["start"] for r in pieces] == [0, *range((len(want) - 1) % most + 1, len(want), most)]
        assert [x for r in pieces for x in r["ids"]] == want
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= most


def test_packing_of_an_empty_table(spark):
    assert packing.pack(frame(spark, ODD).limit(0), tokenizer_path("byte_bpe_50k.json")).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece_and_is_near_the_bound(seed):
    r = random.Random(seed)
    histogram = np.zeros(2049, np.int64)
    for _ in range(6000):
        histogram[min(2048, int(r.expovariate(1 / 500)) + 1) if seed else r.randint(1, 2048)] += 1
    left, n = histogram.copy(), 0
    for lengths, times in packing.plan(histogram):
        assert sum(lengths) <= 2048 and times > 0
        n += times
        for v in lengths:
            left[v] -= times
    assert (left == 0).all()
    total = int((np.arange(2049) * histogram).sum())
    assert n <= 1.02 * total / 2048 + 1


def test_nonnegative_fit_meets_its_conditions():
    rng = np.random.default_rng(0)
    a, b = rng.random((12, 30)), rng.random(12)
    x = packing.fit_nonnegative(a, b, 1e-9)
    g = a.T @ (b - a @ x)
    assert (x >= 0).all() and (g < 1e-6).all() and np.abs(g[x > 0]).max() < 1e-6

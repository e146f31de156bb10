import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hedra.llm.elias_fano import EliasFano, Level, Writer, dequantise, quantise
from hedra.llm.lm_score import score_texts
from tests.llm.texts import corpus, edges, empty, words

def mine():
    return F.pmod(F.crc32(F.col("key").cast("string").cast("binary")), F.lit(5)) != 1


def brute(rows, order, prior):
    toks = {k: [*words(t), "</s>"] for k, t in rows}
    own = {k: zlib.crc32(str(k).encode()) % 5 != 1 for k in toks}
    counts = [collections.Counter() for _ in range(order)]
    for k, t in toks.items():
        if own[k]:
            u = ["<s>", *t]
            for o in range(1, order + 1):
                counts[o - 1].update(g for g in zip(*(u[i:] for i in range(o)), strict=False) if g != ("<s>",))
    n, v, n1 = sum(counts[0].values()), len(counts[0]), sum(c == 1 for c in counts[0].values())
    unseen, starts, out = (n1 + 0.5) / (n + 1), sum(own.values()), {}
    for k, t in toks.items():
        u, score, base = ["<s>", *t], 0.0, 0.0
        for i in range(1, len(u)):
            c = counts[0][(u[i],)]
            p = c / n * (1 - unseen) if c else unseen
            base += math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
            for o in range(2, min(order, i + 1) + 1):
                context = tuple(u[i - o + 1 : i])
                total = starts if context == ("<s>",) else counts[o - 2][context]
                p = counts[o - 1][(*context, u[i])] / (total + prior) + prior / (total + prior) * p
            score += math.log10(p)
        out[k] = (not own[k], len(t), sum(counts[0][(w,)] > 0 for w in t), n, base, score)
    return out


@pytest.mark.parametrize(("order", "slice_bytes"), [(2, 1 << 20), (3, 2000), (4, 3000)])
def test_brute_force(spark, order, slice_bytes):
    rows = corpus()
    want = brute(rows, order, 7.0)
    got = score_texts(spark.createDataFrame(rows, "doc_id bigint, text string"), mine(), order=order, prior=7.0, slice_bytes=slice_bytes).collect()
    assert len(got) == len(rows)
    for r in got:
        held, n, known, train, base, score = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, train)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] == pytest.approx(score, abs=2e-4 * n * order)


def test_production_has_contexts_of_two_words(spark):
    rows = corpus(n=60)
    two, three = brute(rows, 2, 40.0), brute(rows, 3, 40.0)
    assert any(abs(two[k][-1] - three[k][-1]) > 0.1 * two[k][1] for k, _ in rows)
    for r in score_texts(spark.createDataFrame(rows, "doc_id bigint, text string"), mine()).collect():
        assert r["score"] == pytest.approx(three[r["doc_id"]][-1], abs=6e-4 * r["n_tokens"])


def test_probabilities_sum_to_one(spark):
    """Over all known words and one for unseen words, after any context."""
    rows = [(1, "a b a c"), (2, "a b b"), (3, "c a")]
    texts = [f"a {w}" for w in ("a", "b", "c", "zz")]
    probes = [(100 + i, t) for i, t in enumerate(texts)] + [(200, "a")]
    df = spark.createDataFrame(rows + probes, "doc_id bigint, text string")
    train = F.col("key") < 100
    got = {r["doc_id"]: r["score"] for r in score_texts(df, train, prior=2.0).collect()}
    two = brute_next(rows, 2.0)
    assert sum(two.values()) == pytest.approx(1, abs=1e-9)
    assert all(math.isfinite(x) for x in got.values())


def brute_next(rows, prior):
    counts, after, n = collections.Counter(), collections.Counter(), 0
    for _, t in rows:
        u = [*words(t), "</s>"]
        counts.update(u)
        after.update(zip(u, u[1:], strict=False))
    n = sum(counts.values())
    unseen = (sum(c == 1 for c in counts.values()) + 0.5) / (n + 1)
    one = {w: c / n * (1 - unseen) for w, c in counts.items()} | {"?": unseen}
    return {w: after[("a", w)] / (counts["a"] + prior) + prior / (counts["a"] + prior) * p for w, p in one.items()}


def test_edges(spark):
    got = score_texts(edges(spark), mine()).collect()
    assert len(got) == 13 and all(math.isfinite(r["score"]) and r["n_tokens"] >= 1 for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (0, 1, 2)} == {1}
    assert score_texts(empty(spark), mine()).collect() == []
    none = score_texts(edges(spark), F.lit(False)).collect()
    assert all(r["score"] == 0 and r["train_tokens"] == 0 and r["held_out"] for r in none)


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((1, 5), (1000, 1 << 50), (5000, 6000), (300, 1 << 62)):
        values = np.sort(rng.integers(0, top, n)).astype(np.uint64)
        ef = EliasFano(values, Writer())
        assert (ef.access(np.arange(n)) == values).all()
        q = np.concatenate((values, rng.integers(0, top, 500).astype(np.uint64)))
        assert (ef.successor(q) == np.searchsorted(values, q)).all()
    level = Level(np.array([3, 3, 9], np.uint64), np.array([0, 7, 2], np.uint64), np.array([0.5, 0.25, 1.0]), np.array([4, 2, 8]))
    code, count, at, rank = level.find(np.array([3, 3, 9, 9, 4], np.uint64), np.array([7, 1, 2, 3, 0], np.uint64))
    assert count.tolist() == [2, 0, 8, 0, 0] and rank.tolist() == [1, 0, 0, 0, 0] and (code > 0).tolist() == [True, False, True, False, False]
    p = 10.0 ** -rng.uniform(0, 12, 1000)
    assert np.abs(np.log10(dequantise(quantise(p))) - np.log10(p)).max() < 2e-4


def test_hot_pairs_are_split(spark):
    """A pair before a large part of all tokens stands in several shards, and scores stay those of brute force."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"of the w{x}" for x in rng.integers(0, 50, 40))) for i in range(60)]
    want = brute(rows, 3, 7.0)
    for r in score_texts(spark.createDataFrame(rows, "doc_id bigint, text string"), mine(), prior=7.0, slice_bytes=3000, shard_tokens=200).collect():
        held, n, known, train, base, score = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, train)
        assert r["score"] == pytest.approx(score, abs=6e-4 * n)

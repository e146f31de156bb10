import random
import zlib

import numpy as np
import pytest

from hedra.llm import toxicity
from hedra.llm.queries import op11_gru_toxicity
from tests.llm.texts import SCHEMA, edges, sentence, vocabulary


def laid(texts):
    low, hashes, starts, ends, at = toxicity.tokens(np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))))
    return toxicity.Words(low, hashes, starts, ends), at


def test_gradients_are_those_of_the_loss():
    words, at = laid([b"you idiot there a b", b"Hello, kind friend", b"x"])
    place, real = toxicity.placed(words, at[:-1], np.diff(at))
    p = {k: v.astype(float) if v.dtype == np.float32 else v for k, v in toxicity.fresh(np.sort(words.word), np.unique(words.gram), 3).items()}
    due, share = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    g, _ = toxicity.gradients(p, words, place, real, due, share)

    def loss(p):
        said = toxicity.forward(p, words.inputs(p) @ p["x"] + p["bias"], place, real)[0]
        return (np.logaddexp(0, said) - due * said) @ share / 3

    rng = np.random.default_rng(0)
    for k, own in g.items():
        at = np.argwhere(np.abs(own) > 1e-4)
        for i in map(tuple, at[rng.permutation(len(at))[:3]]):
            ends = [loss(p | {k: np.where(np.arange(own.size).reshape(own.shape) == np.ravel_multi_index(i, own.shape), p[k] + d, p[k])}) for d in (1e-2, -1e-2)]
            assert own[i] == pytest.approx((ends[0] - ends[1]) / 2e-2, rel=2e-2), (k, i)


def test_one_window_equals_plain_recurrence():
    words, at = laid([b"one two three four five"])
    p = toxicity.fresh(np.sort(words.word), np.unique(words.gram))
    x = (words.inputs(p) @ p["x"] + p["bias"])[words.row]
    sigmoid, states = lambda v: 1 / (1 + np.exp(-v)), []
    for side, order in ((0, range(5)), (1, range(4, -1, -1))):
        h, own = np.zeros(8), {}
        for t in order:
            a, g = x[t, side * 24 : side * 24 + 24], h @ p[f"u{side}"]
            z, r = sigmoid(a[:8] + g[:8]), sigmoid(a[8:16] + g[8:16])
            h = (1 - z) * np.tanh(a[16:] + r * g[16:]) + z * h
            own[t] = h
        states.append(np.array([own[t] for t in range(5)]))
    states = np.hstack(states)
    weight = np.exp(states @ p["attention"])
    assert toxicity.outputs(p, words, at[:-1], np.diff(at))[0] == pytest.approx((weight / weight.sum()) @ states @ p["out"] + p["base"][0], abs=1e-5)


def test_windows_overlap_and_cover():
    at = np.cumsum([0, 0, 1, 32, 33, 48, 49, 1000])
    text, start, size = toxicity.windows(at)
    for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
        own = [(s, s + n) for t, s, n in zip(text, start, size, strict=True) if t == k]
        assert own == [(a + i, min(a + i + 32, b)) for i in range(0, b - a, 16) if i == 0 or i + 16 < b - a]
        assert {w for x, y in own for w in range(x, y)} == set(range(a, b))


def corpus(spark, n=600):
    rng, vocab = random.Random(3), vocabulary(3)
    bad = ["zwulgar", "zwulgig", "mokrat"]
    rows, labels = [], []
    for i in range(n):
        w = sentence(rng, vocab, rng.choice([5, 40, 300])).split()
        toxic = i % 4 == 0
        for _ in range(1 + len(w) // 60 if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w), "en", "s", 1, "clash", None))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_held_out_accuracy_and_edges(spark):
    from pyspark.sql import functions as F

    docs, labels = corpus(spark)
    learn = F.pmod(F.crc32(F.col("key").cast("string").cast("binary")), F.lit(3)) != 1
    odd = edges(spark).withColumn("doc_id", F.col("doc_id") + 10_000)
    got = toxicity.score_toxicity(docs.unionByName(odd), labels, learn).collect()
    assert len(got) == 600 + odd.count() and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 4 == 0) for r in held]) > 0.95
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[10_000][0].n_windows == 0 and by[10_001][0].worst_window is None and by[10_001][0].score == by[10_000][0].score < 0.5
    assert len(by[10_004]) == 2 and len(by[None]) == 2
    assert by[10_009][0].n_windows == -(-(20_000 - 16) // 16)
    # a label of a held-out document changes nothing
    turned = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, turned, learn).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score, abs=1e-4) for r in got if r.doc_id is not None and r.doc_id < 600)


def test_nothing_to_learn_from(spark):
    docs, labels = corpus(spark, 20)
    assert {r.score for r in toxicity.score_toxicity(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert {r.score for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0


def test_query(spark, sf):
    got = op11_gru_toxicity(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert dict(got.dtypes) | {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"} == dict(got.dtypes)
    assert got.where((got.score >= 0.7).cast("int") != got.predicted).count() == 0

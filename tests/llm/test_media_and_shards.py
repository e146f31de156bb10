import collections
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hedra.llm import telephony
from hedra.llm.hilbert_shards import hilbert_index, shard_documents
from tests.llm.texts import edge_rows, edges, empty


def test_tables():
    code = np.arange(256)
    for table in (telephony.MULAW_TABLE, telephony.ALAW_TABLE):
        assert len(set(table.tolist())) >= 255 and abs(table.astype(int)).max() in (32124, 32256)
    assert telephony.MULAW_TABLE[0xFF] == 0 and telephony.MULAW_TABLE[0] == -32124 and telephony.MULAW_TABLE[0x80] == 32124
    assert telephony.ALAW_TABLE[0xD5] == 8 and telephony.ALAW_TABLE[0x55] == -8 and len(code) == 256


def test_adpcm_against_a_loop():
    rng = np.random.default_rng(3)
    blocks = rng.integers(0, 256, (5, 64), dtype=np.uint8)
    got = telephony.decode_adpcm(blocks)
    for b, row in zip(blocks, got, strict=True):
        now, index = int.from_bytes(bytes(b[:2]), "little", signed=True), min(int(b[2]), 88)
        want = [now]
        for byte in b[4:]:
            for code in (int(byte) & 15, int(byte) >> 4):
                step = telephony.STEPS[index]
                jump = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                want.append(max(-32768, min(32767, want[-1] + (-jump if code & 8 else jump))))
                index = max(0, min(88, index + telephony.CHANGES[code & 7]))
        assert row.tolist() == want


def test_round_trip(spark):
    got = telephony.store_telephony(edges(spark)).collect()
    texts = collections.Counter((r[0], r[1]) for r in edge_rows())
    seen = collections.Counter()
    for r in got:
        body = bytes(r["payload"])
        assert len(body) % 64 == 0 and len(body) >= 64 and not any(body[r["n_bytes"] :])
        seen[(r["doc_id"], body[: r["n_bytes"]].decode())] += 1
        tag, rate, data = telephony.unwav(bytes(r["pcm"]))
        assert (tag, rate, len(data)) == (1, 16000, 4 * len(body))
        assert np.array_equal(np.frombuffer(data, "<i2")[::2], telephony.MULAW_TABLE[np.frombuffer(body, np.uint8)])
    assert seen == collections.Counter({(k, t or ""): 0 for k, t in texts} | collections.Counter((k, t or "") for k, t in texts.elements()))
    assert telephony.store_telephony(empty(spark)).collect() == []


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (1, 4)])
def test_hilbert_curve(spark, dims, bits):
    cells = list(itertools.product(range(1 << bits), repeat=dims))
    df = spark.createDataFrame(cells, ", ".join(f"a{i} int" for i in range(dims)))
    got = {r["h"]: tuple(r)[:dims] for r in df.withColumn("h", hilbert_index([F.col(f"a{i}") for i in range(dims)], bits)).collect()}
    assert sorted(got) == list(range(len(cells)))
    assert all(sum(abs(a - b) for a, b in zip(got[i], got[i + 1], strict=True)) == 1 for i in range(len(cells) - 1))


def test_shards(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 7).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("source"), F.lit("en").alias("lang"), (F.col("id") * 37 % 101).alias("n_chars"))
    got = shard_documents(docs, ["source", "lang", "n_chars"], 24).toPandas()
    assert len(got) == 1000 and got.doc_id.nunique() == 1000
    sizes = got.groupby("shard").size()
    assert len(sizes) == 24 and sizes.max() - sizes.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert all(a.hilbert.max() <= b.hilbert.min() for (_, a), (_, b) in itertools.pairwise(got.groupby("shard")))
    again = shard_documents(docs.repartition(9), ["source", "lang", "n_chars"], 24).toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))
    few = shard_documents(edges(spark), ["source", "lang", "n_chars"], 24).toPandas()
    assert len(few) == 13 and few["size"].min() == 8 and math.isclose(few.groupby("shard").size().max(), 1)
    assert shard_documents(empty(spark), ["source"], 24).count() == 0

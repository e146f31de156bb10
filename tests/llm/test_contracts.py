"""Every query's contract on the smallest tables, recomputed row by row in plain Python."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor

from pyspark.sql import functions as F

from hedra.llm import queries, telephony
from tests.llm.test_near_duplicates import classes
from tests.llm.texts import sentence, vocabulary, words


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").toPandas()


def test_op3(spark, sf, docs):
    got = queries.op3_elias_fano_scores(spark, sf).toPandas().set_index("doc_id")
    texts = {k: [*words(t), "</s>"] for k, t in zip(docs.doc_id, docs.text, strict=True)}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in texts}
    counts = Counter(w for k, t in texts.items() if not held[k] for w in t)
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(docs)
    for k, t in texts.items():
        r = got.loc[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(t), sum(counts[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel=1e-9)
        assert r.score < 0


def test_op5(spark, sf, docs):
    got = queries.op5_family_languages(spark, sf).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    learned = {c for k, c in zip(docs.doc_id, docs.lang, strict=True) if zlib.crc32(str(k).encode()) % 4 != 2}
    for k, t in zip(docs.doc_id, docs.text, strict=True):
        r = got.loc[k]
        assert r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in t or "")) and (r.lang_pred == "und" or r.lang_pred in learned)


def test_op6(spark, sf, docs):
    got = queries.op6_prefix_orders(spark, sf).toPandas()
    want = classes(list(zip(docs.doc_id, docs.text, strict=True)))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == want


def test_op8(spark, sf, docs):
    got = queries.op8_hilbert_shards(spark, sf).toPandas()
    assert len(got) == len(docs) and set(got.law) == {"rows"} and got.grown_shard.isna().all() and set(got.shard) == set(range(24))
    sizes = got.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    texts = dict(zip(docs.doc_id, docs.text, strict=True))
    for r in got.itertuples():
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    # shards and slots are ranks along the curve
    order = got.sort_values(["shard", "slot"]).hilbert.to_numpy()
    assert (order[1:] >= order[:-1]).all()


def test_op9(spark, sf, docs):
    library = SentencePieceProcessor(model_proto=queries.piece_model())
    got = queries.op9_offset_pieces(spark, sf).toPandas().set_index("doc_id")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for k, t in zip(docs.doc_id, docs.text, strict=True):
        ids = library.encode(t or "")
        r = got.loc[k]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_op10(spark, sf, docs):
    got = queries.op10_telephony_audio(spark, sf).toPandas().set_index("doc_id")
    for k, t in zip(docs.doc_id, docs.text, strict=True):
        raw = (t or "").encode()
        whole = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        media = telephony.wav(whole, telephony.MULAW, telephony.RATE, 8)
        r = got.loc[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        if len(whole) < 2000:
            assert r.feature == feature(whole)


def feature(body):
    """The feature string by loops over samples."""
    mulaw, alaw = ([int(table[b]) for b in body] for table in (telephony.MULAW_TABLE, telephony.ALAW_TABLE))
    squares = [sum(x * x for x in s) // len(s) for s in (mulaw, alaw)]
    decoded = [int(x) for at in range(0, len(body), 64) for x in telephony.decode_adpcm(np.frombuffer(body[at : at + 64], np.uint8).reshape(1, 64))[0]]
    squares.append(sum(x * x for x in decoded) // len(decoded))
    turns, out = sum((a < 0) != (b < 0) for a, b in zip(mulaw, mulaw[1:], strict=False)), []
    for i, x in enumerate(mulaw):
        at = lambda j: mulaw[min(max(j, 0), len(mulaw) - 1)]
        out += [x, max(-32768, min(32767, (9 * (x + at(i + 1)) - at(i - 1) - at(i + 2) + 8) >> 4))]
    return f"mulaw={squares[0]};alaw={squares[1]};adpcm={squares[2]};turns={turns};pcm16k={zlib.crc32(np.array(out, '<i2').tobytes()):08x}"


def test_companding_tables_by_rule():
    """All values, by the formulas of the two laws."""
    for code in range(256):
        u = ~code & 255
        size = (((u & 15) << 3) + 132 << (u >> 4 & 7)) - 132
        assert telephony.MULAW_TABLE[code] == (-size if u & 128 else size)
        a = code ^ 0x55
        part, step = a >> 4 & 7, (a & 15) << 4
        size = step + 8 if part == 0 else step + 264 << (part - 1)
        assert telephony.ALAW_TABLE[code] == (size if a & 128 else -size)


def test_op1_and_chats_cover_their_tables(spark, sf, docs):
    got = queries.op1_weak_quality(spark, sf).toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id) and got[["quality", "toxicity"]].stack().between(0, 1).all()
    again = queries.op1_weak_quality(spark, sf).toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))


def test_language_features_and_votes_by_loops():
    """Features and votes of a few texts, one n-gram and one machine at a time."""
    from hedra.llm import language_id as li

    rng, texts = random.Random(3), ["The cat, the DOG. 12 é", "Übung macht den Meister", "", "x", "les élèves de l'école ÀÉ"] * 4
    body = b"".join(t.encode() for t in texts)
    bounds = np.cumsum([0, *(len(t.encode()) for t in texts)])
    got = li.vectors(np.frombuffer(body, np.uint8), bounds)
    for row, t in zip(got, texts, strict=True):
        low, want = bytearray(t.encode()), np.zeros(li.DIMS)
        for i, b in enumerate(low):
            if b < 128:
                low[i] = b if 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32
        for i in range(1, len(low)):
            if low[i - 1] == 0xC3 and 0x80 <= low[i] <= 0x9E and low[i] != 0x97:
                low[i] += 32
        for order in li.ORDERS:
            for i in range(len(low) - order + 1):
                if low[i] == 32 and low[i + 1] == 32:
                    continue
                h = low[i]
                for b in low[i + 1 : i + order]:
                    h = (h * 0x01000193 + b) & 0xFFFFFFFF
                want[((h * 0x9E3779B1 + order) & 0xFFFFFFFF) >> 20] += 1
        want = np.sqrt(want)
        assert np.allclose(row, want / max(np.linalg.norm(want), 1e-9), atol=1e-6)
    langs = np.array([rng.choice(["en", "de", "fr", "es", "fi"]) for _ in texts], object)
    model = li.Model(got, langs)
    lang, family, _ = model.predict(got)

    def best(x, node):
        """The language of a node by plain votes, level by level."""
        if isinstance(node, str):
            return node
        wins, pairs = [0.0] * len(node.kids), list(itertools.combinations(range(len(node.kids)), 2))
        for k, (a, b) in enumerate(pairs):
            m = float(x @ model.weights[:, node.first + k] + model.bias[node.first + k])
            p = 1 / (1 + math.exp(-3 * max(-20, min(20, m))))
            wins[a] += (m >= 0) + p / 1e3
            wins[b] += (m < 0) + (1 - p) / 1e3
        return best(x, node.kids[wins.index(max(wins))])

    assert [k if isinstance(k, str) else k.leaves() for k in model.root.kids] == [["de", "en"], ["es", "fr"], "fi"]
    for x, c, f in zip(got, lang, family, strict=True):
        assert c == best(x, model.root) and f == li.family_of(c)


def test_op5_many_labels(spark):
    """More labels than a node has kids, and more than are learned: machines stay in proportion, and every row gets a learned label."""
    from hedra.llm import language_id as li

    rng = random.Random(4)
    vocab = {f"x{k:03d}": vocabulary(100 + k, 40) for k in range(60)}
    rows = [(i, sentence(rng, vocab[c], 30), c) for i, c in enumerate(list(vocab) * 12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = li.fit(docs, F.lit(True))
    assert model.weights.shape[1] < 60 * 8 and model.langs == sorted(vocab)
    got = {r["doc_id"]: r["lang_pred"] for r in li.identify_languages(docs).collect()}
    assert sum(got[i] == c for i, _, c in rows) > 0.9 * len(rows)
    assert li.fit(docs, F.lit(True), most_languages=5).langs == sorted(vocab)[:5]

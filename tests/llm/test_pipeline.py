import random

import pandas as pd
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

import corpus_pipeline
from hedra.llm import decontaminate, line_dedup
from hedra.llm.language_id import identify_languages
from hedra.llm.queries import piece_model
from tests.compare import duck
from tests.llm.texts import edges, frame, sentence, shingles, vocabulary


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        now = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert len(now) == len(set(now)) and set(now) <= ids and len(now) > 0.8 * len(ids), name
        ids = set(now)
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()} == ids


def test_edges(spark, sf):
    docs = edges(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() >= 5
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_rows_are_told_apart_by_id_and_text(spark, sf, tmp_path):
    rng, vocab = random.Random(2), vocabulary(2, 900)
    a, b, c, d, item = (sentence(rng, vocab, 60) for _ in range(5))
    rows = [(1, a), (1, a), (None, a), (2, b), (2, a), (3, c), (3, c), (None, d), (None, d)]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), sf).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted([(1, a), (2, b), (3, c), (0, d)])
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, a), (1, f"{b} {item}"), (None, item), (None, c)]
    got = corpus_pipeline.decontaminate(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted([(1, a), (0, c)])


def test_sure_predictions_take_the_place_of_labels(spark, sf):
    rng, vocab = random.Random(5), {"en": vocabulary(5), "fr": ["é" + w for w in vocabulary(6)]}
    rows = [(i, sentence(rng, vocab["en" if i % 2 else "fr"], 40), "en" if i % 2 else "fr") for i in range(5000)]
    wrong = {i: {"en": "fr", "fr": "en"}[rows[i][2]] for i in range(40, 80)}
    docs = spark.createDataFrame([(i, t, None if i == 7 else wrong.get(i, x)) for i, t, x in rows] + [(5000, "12 34", "en"), (5001, None, "fr")], "doc_id bigint, text string, lang string")
    said = {r["doc_id"]: r for r in identify_languages(docs, keep=("lang",)).collect()}
    want = {k: r["lang_pred"] if r["lang"] is None or r["score"] >= corpus_pipeline.SURE else r["lang"] for k, r in said.items() if k < 5000}
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.language_id(spark, docs, sf).collect()}
    assert got == want and got[7] == "en"
    # a row that was drawn to learn from can keep its label
    assert sum(got[i] == rows[i][2] for i in wrong) > len(wrong) / 2


CLASHES = ("score", "lang_pred", "family_pred", "n_lines", "removed_lines", "removed_chunks", "_id", "_row", "_text", "_in0", "_rest", "key", "keep0", "component_id", "item_id", "w", "row")


def test_clashing_columns_go_through(spark, sf):
    docs = edges(spark).select("doc_id", "text", "lang", "source", "n_chars", *[F.concat(F.lit(f"{c}:"), F.coalesce("doc_id", F.lit(0)).cast("string")).alias(c) for c in CLASHES])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns, name
        assert all(r[c] == f"{c}:{r['doc_id'] or 0}" for r in got.collect() for c in CLASHES), name
    assert corpus_pipeline.encode(spark, docs, sf).count() == docs.count()


def test_the_survivor_of_repeated_rows_is_defined(spark, sf):
    rows = [(1, "a b c d e f", s) for s in ("x", "y", "z", "x")]
    kept = set()
    for parts in (1, 3, 5):
        got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(parts), sf).collect()
        assert len(got) == 1
        kept.add(got[0]["source"])
    assert len(kept) == 1


def test_run_equals_brute_force(spark, tmp_path):
    """Every row of a small run, from plain versions of all stages."""
    rng, vocab = random.Random(12), vocabulary(12, 2000)
    base = [[sentence(rng, vocab, rng.randint(5, 25)) for _ in range(rng.randint(1, 6))] for _ in range(40)]
    passage, items = [sentence(rng, vocab, 15) for _ in range(5)], [sentence(rng, vocab, rng.randint(20, 40)) for _ in range(4)]
    docs = []
    for i in range(120):
        lines = list(rng.choice(base)) if i % 3 == 0 else [sentence(rng, vocab, rng.randint(3, 30)) for _ in range(rng.randint(1, 8))]
        if i % 7 == 0:
            lines[rng.randrange(len(lines))] += " " + rng.choice(vocab)
        if i % 11 == 0:
            lines[rng.randrange(len(lines) + 1) : 0] = passage
        if i % 13 == 0:
            lines.append(f"{sentence(rng, vocab, 4)} {rng.choice(items)}")
        docs.append((i, "\n".join(lines), "en" if i % 2 else "de", "s", 1))
    docs += [(120, None, "en", "s", None), (121, "", "en", "s", 0), (122, "12 34", None, "s", 5)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: (r["ids"], r["decoded"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    left = {i: t for i, t, *_ in docs if t and any(c.isalpha() for c in t)}
    lines = duck(line_dedup.PASSAGES_SQL, None, documents=frame(list(left.items())))
    left = {r.doc_id: r.text for r in lines.itertuples() if not r.removed_lines or r.text.strip()}
    own = {i: shingles(t) for i, t in left.items()}
    top = {i: i for i in own}
    for i in sorted(own):
        for j in sorted(own):
            if i < j and 100 * len(own[i] & own[j]) >= 75 * len(own[i] | own[j]):
                a, b = sorted((top[i], top[j]))
                top = {k: a if v == b else v for k, v in top.items()}
    left = {i: t for i, t in left.items() if top[i] == i}
    leaked = duck(decontaminate.SQL, None, documents=frame(list(left.items())), benchmark=pd.DataFrame(list(enumerate(items)), columns=["item_id", "text"]))
    left = {i: t for i, t in left.items() if i not in set(leaked.doc_id)}
    library = SentencePieceProcessor(model_proto=piece_model())
    want = {i: (library.encode(t), library.decode(library.encode(t))) for i, t in left.items()}
    assert got == want and len(leaked) and 50 < len(want) < 120

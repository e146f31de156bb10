import random

from pyspark.sql import functions as F

from hedra.llm.chat_snapshots import SQL, collapse_snapshots
from hedra.llm.language_id import family_of, identify_languages
from hedra.llm.weak_quality import judge_quality
from tests.compare import duck, rows
from tests.llm.texts import edges, empty, sentence, vocabulary


def test_languages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    train = F.pmod(F.xxhash64("key"), F.lit(4)) != 2
    got = identify_languages(docs, train, keep=("source",)).withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 2).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    held = got[got.held & (got.lang_pred != "und")]
    assert (held.lang == held.lang_pred).mean() >= 0.9
    assert family_of("pt-BR") == "romance" and family_of("xx") == "own:xx"


def test_languages_edges(spark):
    got = identify_languages(edges(spark)).collect()
    assert len(got) == 13
    assert {r["lang_pred"] for r in got if r["doc_id"] in (0, 1, 2)} == {"und"} and {r["lang_pred"] for r in got if r["doc_id"] in (3, 4, 9)} == {"en"}
    assert identify_languages(empty(spark)).collect() == []
    assert {r["lang_pred"] for r in identify_languages(edges(spark), F.lit(False)).collect()} == {"und"}


def test_quality(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = judge_quality(docs, labels).join(labels, "doc_id").toPandas()
    assert got[got.toxic == 0].toxicity.mean() < got[got.toxic == 1].toxicity.mean()
    assert judge_quality(edges(spark)).count() == 13 and judge_quality(empty(spark)).collect() == []
    assert judge_quality(edges(spark), labels.limit(0)).count() == 13


def chats():
    rng, vocab = random.Random(2), vocabulary(2)
    out = []
    for c in range(20):
        turns = [("user" if i % 2 == 0 else "assistant", sentence(rng, vocab, 6)) for i in range(rng.randint(1, 8))]
        for k in range(1, len(turns) + 1):  # every state is logged
            out += [(c * 100 + k, i, *t) for i, t in enumerate(turns[:k])]
        out += [(c * 100 + 99, i, *t) for i, t in enumerate(turns)]  # and the last one twice
    out += [(9000, 0, None, None), (9000, 0, None, None), (None, 0, "user", "lost"), (9001, None, "user", "x"), (9001, 2, "user", "y"), (9001, 2, "assistant", "y"), (9002, 0, "user", "")]
    return out


def test_chats(spark):
    import pandas as pd

    table = pd.DataFrame(chats(), columns=["conv_id", "turn", "role", "text"])
    df = spark.createDataFrame(chats(), "conv_id bigint, turn bigint, role string, text string")
    got = collapse_snapshots(df.withColumn("pos", F.lit("clash"))).toPandas()
    assert len(got) == 20 + 3
    want = duck(SQL.replace("FROM conversations", "FROM (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations)"), None, conversations=table)
    plain = lambda f: f[f.conv_id < 9000]
    assert rows(plain(got)) == rows(plain(want))
    assert got.set_index("conv_id").text[9000] == "<|unknown|>\n" and set(got.conv_id) >= {9000, 9001, 9002}
    assert collapse_snapshots(df.limit(0)).collect() == []


def test_copied_texts_are_drawn_once_and_never_missed(spark):
    from hedra.llm import language_id

    rows = [(f"{w} text {k}" * 3, lang) for lang, w in (("en", "the"), ("fr", "une"), ("fi", "yksi"), ("pl", "jest")) for k in range(3) for _ in range(1000)]
    seen, init = [], language_id.Model.__init__
    try:
        language_id.Model.__init__ = lambda self, x, langs: seen.extend(langs)
        language_id.fit(spark.createDataFrame(rows, "text string, lang string"), F.lit(True))
    finally:
        language_id.Model.__init__ = init
    assert sorted(seen) == sorted(lang for lang in ("en", "fr", "fi", "pl") for _ in range(3))


def test_null_texts_and_copies_leave_scores_as_they_were(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    copied = docs.orderBy("doc_id").limit(1).select("text").first()["text"]
    more = spark.range(3000).select((F.col("id") + 10**6).alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit(copied)).alias("text"))
    plain = judge_quality(docs, labels, sample_rows=150).toPandas().set_index("doc_id")
    full = judge_quality(docs.union(more), labels, sample_rows=150).toPandas().set_index("doc_id").loc[plain.index]
    assert full.quality_score.nunique() > 0.8 * len(plain)
    # the posteriors that teach the scorer move a little with the votes of the added rows
    assert plain.quality_score.corr(full.quality_score) > 0.9 and plain.toxic_score.corr(full.toxic_score) > 0.9


def test_expectation_maximisation_by_loops():
    import itertools
    import math

    import numpy as np

    from hedra.llm.weak_quality import LabelModel

    rng = random.Random(9)
    votes = []
    for _ in range(400):
        truth = rng.random() < 0.7
        votes.append(tuple(rng.choice([-1, 0, 1]) if rng.random() < noise else (1 if truth else -1) for noise in (0.1, 0.3, 0.6)))
    kinds = sorted(set(votes))
    model = LabelModel(np.array(kinds), np.array([votes.count(k) for k in kinds], float), -1)
    p = [0.1 if -1 in v else 0.9 for v in votes]
    for _ in range(40):
        share = (sum(p) + 1) / (len(p) + 2)
        chance = {}
        for j, value, k in itertools.product(range(3), (-1, 1), (0, 1)):
            lean = 1.0 if (value == 1) == (k == 1) else 0.2
            chance[j, value, k] = lean + sum((q if k else 1 - q) for q, v in zip(p, votes, strict=True) if v[j] == value)
        odds = lambda v: math.log(share / (1 - share)) + sum(math.log(chance[j, v[j], 1] / (chance[j, -1, 1] + chance[j, 1, 1])) - math.log(chance[j, v[j], 0] / (chance[j, -1, 0] + chance[j, 1, 0])) for j in range(3) if v[j])  # noqa: E731, B023
        p = [1 / (1 + math.exp(-max(-30, min(30, odds(v))))) for v in votes]
    want = dict(zip(votes, p, strict=True))
    assert np.allclose(model.posterior(np.array(kinds)), [want[k] for k in kinds], atol=1e-9)

import math

import pytest
from pyspark.sql import functions as F

from hedra.operators import profile, regress, resample


def frame(spark, n=300):
    u = lambda s: F.pmod(F.xxhash64("id", F.lit(s)), F.lit(10_000)) / 10_000.0
    return spark.range(n).select("id", (1 + 9 * u(1)).alias("x"), F.exp(u(2) * 3).alias("z")).withColumn("y", 3 + 2 * F.col("x") + F.sin("id"))


def test_hash_tells_states_apart_and_not_orders(spark):
    df = frame(spark)
    plain, same = (profile.dataset_hash(d, "id").first()[0] for d in (df, df.repartition(7).orderBy(F.desc("y"))))
    assert plain == same
    others = [profile.dataset_hash(d, "id").first()[0] for d in (df.where("id > 0"), df.union(df.limit(1)), df.union(df.limit(1).withColumn("id", F.lit(None).cast("bigint"))))]
    states = [profile.canonical_state(df), profile.canonical_state(df.drop("z")), profile.canonical_state(df, roles={"x": "predictor"}), profile.canonical_state(df, '{"numeric": {"x": 1.0}}')]
    assert len({plain, *others, *(profile.dataset_hash(df, "id", s).first()[0] for s in states)}) == 8
    assert profile.canonical_state(df, roles={"a": "1", "b": "2"}) == profile.canonical_state(df, roles={"b": "2", "a": "1"})


def test_fingerprint_has_heads_and_tails(spark):
    df = frame(spark).withColumn("x", F.when(F.col("id") == 1, None).otherwise(F.col("x")))
    own = df.orderBy("id").collect()
    for d in (df, df.repartition(5)):
        r = {r["column"]: r for r in profile.numeric_fingerprint(d, "id", ["x", "y"], 3).collect()}
        assert r["x"]["head"] == [own[0]["x"], None, own[2]["x"]] and r["y"]["tail"] == [v["y"] for v in own[-3:]] and r["x"]["n"] == 299
        assert r["y"]["sum"] == pytest.approx(sum(v["y"] for v in own))
    assert profile.numeric_fingerprint(df.limit(0), "id", ["x"]).first().asDict() == {"column": "x", "n": 0, "sum": None, "mean": None, "sd": None, "head": [], "tail": []}


def test_histograms(spark):
    df = frame(spark).withColumns({"one": F.lit(4.0), "none": F.lit(None).cast("double")})
    got = regress.histogram(df, {c: F.col(c) for c in ("x", "one", "none")}, 10).collect()
    x = sorted(r["x"] for r in df.collect())
    assert [r["n"] for r in sorted((r for r in got if r["measure"] == "x"), key=lambda r: r["bin"])] == [sum(min(int((v - x[0]) / ((x[-1] - x[0]) / 10)), 9) == k for v in x) for k in range(10)]
    assert [(r["low"], r["high"], r["n"]) for r in got if r["measure"] == "one"] == [(4.0, 4.0, 300)] and not [r for r in got if r["measure"] == "none"]
    assert 5 < regress.histogram(df, {"x": F.col("x")}, rule="fd").count() < 30 and regress.histogram(df.limit(0), {"x": F.col("x")}).count() == 0
    fit = regress.fit_ols(df, "y", ["x"])
    tables, grid = regress.residual_tables(df, fit, "y", 8)
    assert grid.agg(F.sum("n")).first()[0] == 300 and {r["measure"] for r in tables.collect()} == {"residual", "standardized"}


def test_normality_of_transforms_against_published_values(spark):
    weights = [148.0, 154.0, 158.0, 160.0, 161.0, 162.0, 166.0, 170.0, 182.0, 195.0, 236.0]  # of Shapiro and Wilk's paper
    df = spark.createDataFrame(list(enumerate(weights)), "id bigint, w double")
    got = {r["transform"]: r for r in regress.transform_diagnostics(df, "id", ["w"]).collect()}
    assert len(got) == 7 and got["linear"]["w"] == pytest.approx(0.79, abs=0.005) and got["linear"]["p"] == pytest.approx(0.0067, abs=3e-4) and got["linear"]["skewness"] > 1
    assert got["inv_sqr"]["w"] > got["linear"]["w"] and all(r["n"] == 11 for r in got.values())
    constant = {r["transform"]: r for r in regress.transform_diagnostics(df.withColumn("w", F.lit(2.0)), "id", ["w"]).collect()}
    assert constant["linear"]["w"] is None and constant["linear"]["skewness"] is None
    assert regress.transform_diagnostics(df.limit(0), "id", ["w"]).count() == 0
    many = frame(spark, 6000)
    assert {r["n"] for r in regress.transform_diagnostics(many, "id", ["z"]).collect()} == {5000}
    assert {r["transform"]: r["w"] for r in regress.transform_diagnostics(many, "id", ["z"]).collect()} == {r["transform"]: r["w"] for r in regress.transform_diagnostics(many.repartition(9), "id", ["z"]).collect()}


def test_stability_is_that_of_its_parts(spark):
    df = frame(spark, 200)
    out, models = resample.stability(df, "id", "y", ["x", "z"], 5, 4, 17, removed=df.where("id < 10"))
    boot = resample.bootstrap(df, "id", "y", ["x", "z"], 5, 17)
    for k, fit in boot.items():
        assert list(models[f"replicate_{k}"].beta) == pytest.approx(list(fit.beta))
    got = {r["id"]: r for r in out.collect()}
    for want, name in ((resample.bootstrap_dispersion(df, "id", boot), "replicates"), (resample.perturbation(df, "id", ["x", "z"], models["base"], 4, 17), "copies")):
        for r in want.collect():
            assert [got[r["id"]][f"{name}_{k}"] for k in ("mean", "sd", "min", "max")] == pytest.approx([r[k] for k in ("mean", "sd", "min", "max")])
    again = resample.revision(df, df.where("id < 10"), "id", "y", ["x", "z"], models["base"]).first()
    assert again["max_change"] == pytest.approx(max(abs(r["revision_change"]) for r in got.values())) and not math.isnan(again["mean_change"])


def test_names_with_accents_say_what_they_hold():
    assert profile.PRICE_TOKENS & profile._tokens("Preço (R$)") and profile.IDENTITY_TOKENS & profile._tokens("Nº_matrícula") and profile.IDENTITY_TOKENS & profile._tokens("ENDEREÇO completo")

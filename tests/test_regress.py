import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hedra.operators import distributions, regress, resample, search

# Longley's data with the certified results that NIST publishes.
LONGLEY = """60323 83.0 234289 2356 1590 107608 1947
61122 88.5 259426 2325 1456 108632 1948
60171 88.2 258054 3682 1616 109773 1949
61187 89.5 284599 3351 1650 110929 1950
63221 96.2 328975 2099 3099 112075 1951
63639 98.1 346999 1932 3594 113270 1952
64989 99.0 365385 1870 3547 115094 1953
63761 100.0 363112 3578 3350 116219 1954
66019 101.2 397469 2904 3048 117388 1955
67857 104.6 419180 2822 2857 118734 1956
68169 108.4 442769 2936 2798 120445 1957
66513 110.8 444546 4681 2637 121950 1958
68655 112.6 482704 3813 2552 123366 1959
69564 114.2 502601 3931 2514 125368 1960
69331 115.7 518173 4806 2572 127852 1961
70551 116.9 554894 4007 2827 130081 1962"""
CERTIFIED = [-3482258.63459582, 15.0618722713733, -0.0358191792925910, -2.02022980381683, -1.03322686717359, -0.0511041056535807, 1829.15146461355]


@pytest.fixture(scope="module")
def longley(spark):
    return spark.createDataFrame(pd.DataFrame([[float(v) for v in x.split()] for x in LONGLEY.splitlines()], columns=["y", *(f"x{i}" for i in range(1, 7))]))


@pytest.mark.parametrize("parts", [1, 5])
def test_longley(longley, parts):
    fit = regress.fit_ols(longley.repartition(parts), "y", [f"x{i}" for i in range(1, 7)])
    assert fit.status == "fitted"
    assert np.allclose(fit.beta, CERTIFIED, rtol=1e-8)
    assert fit.sigma == pytest.approx(304.854073561965, rel=1e-9)
    s = fit.statistics()
    assert s["r2"] == pytest.approx(0.995479004577296, rel=1e-10)
    assert s["f"] == pytest.approx(330.285339234588, rel=1e-8)


def sample(n=300, seed=3):
    rng = np.random.default_rng(seed)
    x = pd.DataFrame({"id": np.arange(n), "a": rng.uniform(1, 9, n), "b": rng.normal(size=n)})
    x["y"] = 4 * x.a - 2 * x.b + 10 + rng.normal(0, 0.4, n)
    return x


def test_against_numpy(spark):
    f = sample()
    df = spark.createDataFrame(f)
    fit = regress.fit_ols(df.repartition(7), "y", ["a", "b"])
    x = np.column_stack((np.ones(len(f)), f.a, f.b))
    beta, *_ = np.linalg.lstsq(x, f.y, rcond=None)
    assert np.allclose(fit.beta, beta, rtol=1e-11)
    hat = x @ np.linalg.inv(x.T @ x) @ x.T
    e = f.y - x @ beta
    s2 = e @ e / (len(f) - 3)
    out = regress.influence(df, fit, "y").orderBy("id").toPandas()
    assert np.allclose(out.leverage, np.diag(hat), rtol=1e-9)
    assert np.allclose(out.cook, e**2 / (3 * s2) * np.diag(hat) / (1 - np.diag(hat)) ** 2, rtol=1e-8)
    assert np.allclose(fit.errors**2, np.diag(s2 * np.linalg.inv(x.T @ x)), rtol=1e-9)
    vif = fit.vif()["a"]
    assert vif == pytest.approx(1 / (1 - np.corrcoef(f.a, f.b)[0, 1] ** 2), rel=1e-9)
    scaled = regress.fit_ols(df.withColumn("y", 1000 * F.col("y")), "y", ["a", "b"])
    assert np.allclose(scaled.beta, 1000 * fit.beta, rtol=1e-9)


def test_gates(spark):
    df = spark.createDataFrame(sample(40)).withColumn("c", 2 * F.col("a") + 1)
    assert regress.fit_ols(df, "y", ["a", "c"]).status == "rank_deficient"
    assert regress.fit_ols(df.limit(2), "y", ["a", "b"]).status == "insufficient_n"
    assert regress.fit_ols(df.withColumn("c", F.col("a") + 1e-13 * F.col("b")), "y", ["a", "c"]).status in ("ill_conditioned", "rank_deficient")
    assert regress.fit_ols(df.limit(0), "y", ["a"]).status == "insufficient_n"
    assert regress.correlations(df.withColumn("k", F.lit(1.0)), ["a", "k"]).where("a != b AND r IS NOT NULL").count() == 0
    exact = spark.range(1, 9).select(F.col("id").cast("double").alias("a"), (2.0 * F.col("id")).alias("y"))
    fit = regress.fit_ols(exact, "y", ["a"], intercept=False)
    fit.beta = fit.beta.round(12)
    assert regress.exact_fit(exact, fit, "y")
    assert not regress.exact_fit(df, regress.fit_ols(df, "y", ["a"]), "y")


def test_distributions():
    assert distributions.t_quantile(0.9, 30) == pytest.approx(1.3104150253913947, rel=1e-10)
    assert distributions.t_two_sided(2.0, 10) == pytest.approx(0.07338803477074037, rel=1e-9)
    assert distributions.f_tail(3.3158295, 2, 30) == pytest.approx(0.05, rel=1e-6)
    assert distributions.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    assert distributions.chi2_tail(30.0, 4) == pytest.approx(math.exp(-15) * 16, rel=1e-9)
    assert distributions.normal_cdf(1.96) == pytest.approx(0.9750021048517795, rel=1e-12)


def test_shapiro():
    rng = np.random.default_rng(1)
    assert regress.shapiro_wilk(rng.normal(size=200))[1] > 0.01
    assert regress.shapiro_wilk(rng.exponential(size=200))[1] < 1e-6
    # weights of men, the example of Shapiro and Wilk's paper
    w, p = regress.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert w == pytest.approx(0.79, abs=0.005) and p < 0.01


def test_search(spark):
    f = sample(80)
    df = spark.createDataFrame(f)
    units = search.units_of(df, ["a", "b"])
    assert units[0].options == ("linear", "inverse", "ln", "sqr", "sqrt", "inv_sqr", "inv_sqrt") and units[1].options == ("linear", "inverse", "sqr", "inv_sqr")
    found = search.search_models(df, "y", units)
    assert found.audit["exact_optimum_guaranteed"] and found.audit["possible"] == 8 * 5 - 1 == found.records.count()
    best = found.records.where("rank = 1").first()
    assert best["candidate_id"] == "a:linear|b:linear|y:identity|int:1"
    fit = regress.fit_ols(df, "y", ["a", "b"])
    assert best["rmse"] == pytest.approx(math.sqrt(fit.sse / fit.n), rel=1e-9)
    part = search.search_models(df, "y", units, budget=10, mode="approximate")
    assert part.audit["evaluated"] == 10 and not part.audit["exact_optimum_guaranteed"]
    assert search.count_candidates([7] * 6) == 262_143
    assert search.count_candidates([2, 3, 4], 2) == 2 + 3 + 4 + 6 + 8 + 12
    roles = {r["role"] for r in search.winner(found.records).collect()}
    assert "winner" in roles


def test_folds(spark):
    f = sample(200)
    df = resample.k_folds(spark.createDataFrame(f), "id", 4, 1)
    models = resample.fold_models(df, "fold", "y", ["a", "b"])
    own = df.toPandas()
    for k, fit in models.items():
        rest = own[own.fold != int(k)]
        beta, *_ = np.linalg.lstsq(np.column_stack((np.ones(len(rest)), rest.a, rest.b)), rest.y, rcond=None)
        assert np.allclose(fit.beta, beta, rtol=1e-9)
    out = resample.evaluate_procedure(df, "fold", "y", ["a", "b"]).toPandas()
    assert (out.mae < 0.6).all() and not out.no_better.any() and out.n.sum() == 200
    again = resample.k_folds(spark.createDataFrame(f).repartition(9), "id", 4, 1).toPandas().set_index("id").fold
    assert (again.sort_index() == own.set_index("id").fold.sort_index()).all()
    boot = resample.bootstrap(df, "id", "y", ["a", "b"], 5, 2)
    assert len(boot) == 5 and all(abs(m.beta[1] - 4) < 0.2 for m in boot.values())
    fit = regress.fit_ols(df, "y", ["a", "b"])
    moved = resample.perturbation(df, "id", ["a", "b"], fit, 20, 3).toPandas()
    assert len(moved) == 200 and (moved.sd > 0).all()


def test_rounding_of_great_sums_is_no_rank(spark):
    """A column twice another one leaves only rounding, which is far above the tolerance where sums are great; a small column of its own counts beside them."""
    df = spark.range(20_000).select((1e8 + F.pmod(F.xxhash64("id"), F.lit(1000)) * 1e6).alias("x"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(7)) * 1e-4).alias("z")).withColumn("twice", 3 * F.col("x"))
    assert regress.parameter_ranks(df, ["x", "twice", "z"]) == {"n_effective": 20_000, "n_columns": 3, "rank_slopes": 2, "rank_with_intercept": 3}
    assert regress.parameter_ranks(df.withColumn("none", F.lit(0.0)), ["x", "z", "none"])["rank_slopes"] == 2

"""The whole procedure in folds, models of logarithms, saved projects, medians and hot order keys."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from hedra.functions import transforms
from hedra.operators import ordered, profile, regress, resample, search
from hedra.operators.score import Frozen, score_batch
from hedra.plans.valuation import Request, value
from tests.compare import rows


def market(spark, n=240, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        area, age, zone = rng.uniform(30, 200), rng.uniform(1, 40), rng.choice(["north", "south", "east"])
        price = math.exp(8 + 0.9 * math.log(area) - 0.01 * age + {"north": 0.2, "south": 0.0, "east": -0.1}[zone] + rng.gauss(0, 0.05))
        out.append((i, area, age, zone, price, i % 4))
    return spark.createDataFrame(out, "id bigint, area double, age double, zone string, price double, fold int")


def test_no_reserved_row_is_learned_from(spark):
    """Values of reserved rows can be anything: what a fold chooses and predicts for untouched rows stays the same, and unseen levels fail."""
    df = market(spark)
    plain = resample.fit_procedure(df.where("fold <> 0"), "price", ["area", "age"], ["zone"], targets=("identity", "log"))
    assert plain.log and "area" in plain.candidate
    odd = df.withColumn("price", F.when(F.col("fold") == 0, -1e9).otherwise(F.col("price"))).withColumn("zone", F.when((F.col("fold") == 0) & (F.col("id") % 8 == 0), "moon").otherwise(F.col("zone")))
    again, chosen = resample.evaluate_selection(odd, "fold", "price", ["area", "age"], ["zone"], targets=("identity", "log"))
    assert chosen["0"] == plain.candidate
    row = {r["fold"]: r for r in again.collect()}
    assert row[0]["n_reserved"] == 60 and row[0]["n_scored"] < 60 and row[0]["coverage"] == row[0]["n_scored"] / 60
    honest, _ = resample.evaluate_selection(df, "fold", "price", ["area", "age"], ["zone"], targets=("identity", "log"))
    for r in honest.collect():
        assert r["n_scored"] == 60 and r["rmse"] < 0.3 * r["mean_rmse"] and "|y:log|" in r["candidate_id"]
    got = plain.predict(df.where("fold = 0")).toPandas()
    assert (got.status == "ok").all() and abs(np.log(got.predicted / got.price)).mean() < 0.1
    assert resample.fit_procedure(df.where("fold > 9"), "price", ["area"], []) is None


def test_log_search_against_loops(spark):
    df = market(spark, 60)
    found = search.search_models(df, "price", search.units_of(df, ["area", "age"]), targets=("identity", "log")).records.toPandas().set_index("candidate_id")
    own = df.toPandas()
    x = np.column_stack([np.ones(60), np.log(own.area), own.age])
    for kind, y, back in (("identity", own.price, lambda v: v), ("log", np.log(own.price), np.exp)):
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        want = math.sqrt(((back(x @ beta) - own.price) ** 2).mean())
        assert found.loc[f"age:linear|area:ln|y:{kind}|int:1"].rmse == pytest.approx(want, rel=1e-8)
    assert found.loc[found["rank"] == 1].index[0].endswith("y:log|int:1")
    with_zero = df.withColumn("price", F.when(F.col("id") == 3, 0.0).otherwise(F.col("price")))
    assert search.search_models(with_zero, "price", search.units_of(df, ["area"]), targets=("identity", "log")).audit["targets"] == ("identity",)


@pytest.mark.parametrize("estimand", ["median", "lognormal_mean", "smearing"])
def test_saved_projects(spark, estimand):
    df = market(spark)
    made = value(df, Request("price", ["area", "age"], ["zone"], transform="log", estimand=estimand, unit="BRL", domain={"zone": ["north", "south"], "area": (None, 150.0)}))
    text = made.frozen.dumps()
    again = Frozen.loads(text)
    assert again.dumps() == text and again.reuse_key() == made.frozen.reuse_key()
    a, b = (score_batch(df, f).orderBy("id").toPandas() for f in (made.frozen, again))
    assert rows(a.drop(columns=["arbitration", "admissible"])) == rows(b.drop(columns=["arbitration", "admissible"]))
    ok = a[a.status == "succeeded"]
    assert (ok.area <= 150).all() and set(ok.zone) == {"north", "south"} and (ok.pred_low < ok.mean_low).all() and (ok.mean_low < ok.point).all()
    assert a[a.status != "succeeded"].point.isna().all() and again.conflicts("value", "BRL") == ["policy_mismatch:target_col"]
    state = made.frozen.state()
    del state["fit"]
    assert Frozen.issues(state) == ["frozen_project_incomplete:fit"] and Frozen.issues(state | {"fit": 1, "scope": "x", "version": 9}) == ["frozen_schema_version", "invalid_model_scope"]


def test_bootstrap_selection(spark):
    df = market(spark, 80)
    chosen, often, spread = resample.procedure_stability(df, "id", "price", search.units_of(df, ["area", "age"]), 6, 3)
    found = chosen.collect()
    assert sorted(r["replicate"] for r in found) == list(range(6)) and all(r["status"] == "ok" for r in found)
    assert {r["variable"]: r["n"] for r in often.collect()}["area"] == 6 and spread.first()["n_scored"] == 6
    # one replicate by hand
    weights = df.select("id", resample.multiplicity(F.col("id"), F.lit(2), 3).alias("w")).toPandas().set_index("id").w
    own = df.toPandas()
    w = own.id.map(weights).to_numpy(float)
    best = next(r for r in found if r["replicate"] == 2)
    cols = [np.ones(80)]
    for part in best["candidate_id"].split("|")[:-2]:
        b, o = part.split(":")
        cols.append({"linear": lambda v: v, "inverse": lambda v: 1 / v, "ln": np.log, "sqr": lambda v: v * v, "sqrt": np.sqrt, "inv_sqr": lambda v: 1 / v**2, "inv_sqrt": lambda v: 1 / np.sqrt(v)}[o](own[b].to_numpy()))
    x = np.column_stack(cols)
    root = np.sqrt(w)
    beta = np.linalg.lstsq(x * root[:, None], own.price * root, rcond=None)[0]
    assert best["score"] == pytest.approx(math.sqrt((w * (x @ beta - own.price) ** 2).sum() / (w > 0).sum()), rel=1e-6)


def test_draws_of_replicates_are_short_code(spark):
    """Weights are those of multiplicity, also at the cuts, and a replicate adds little to the expression that the JVM must compile."""
    df = spark.range(3000).select(F.col("id"), resample._chances("id", 5, 9), F.array(*[resample.multiplicity(F.col("id"), F.lit(i), 9) for i in range(5)]).alias("m")).toPandas()
    assert (resample._times(np.stack(df["_w"])) == np.stack(df["m"])).all() and 0.9 < np.stack(df["m"]).mean() < 1.1
    assert resample._times(np.array([0.0, *resample._CUTS])).tolist() == [0, *range(1, 10)]
    assert str(resample._chances("id", 8, 9)).count("xxhash64") == 8 and str(resample.multiplicity(F.col("id"), F.lit(0), 9)).count("xxhash64") == 1


@pytest.mark.parametrize("values", [[], [3.0], [1.0, 2.0], [5.0] * 900 + [1.0, 9.0], [float(i % 7) for i in range(1000)], [random.Random(4).gauss(0, 1) for _ in range(3001)], [float("nan"), 2.0, 4.0], [-1.0] * 500 + [1.0] * 500])
def test_medians_by_narrowing(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    kept = [v for v in values if not math.isnan(v)]
    want = statistics.median(kept) if kept else None
    for small in (1_000_000, 40, 1):
        got = profile.medians(df, {"x": F.col("x"), "y": F.col("x") * 2}, small)
        assert got == {"x": want, "y": want and want * 2}


def test_a_hot_order_key_is_cut_by_its_ties(spark):
    rng = random.Random(8)
    keyed = [(7 if rng.random() < 0.5 else rng.randrange(15), i) for i in range(4000)]
    rng.shuffle(keyed)
    df = spark.createDataFrame(keyed, "t int, id bigint")
    got = ordered.number_rows(df, "t", "id", count=20).toPandas().sort_values(["t", "id"])
    assert got.pos.tolist() == list(range(4000))
    sizes = df.groupBy(ordered.buckets(df, "t", 20, ("id",)).alias("b")).count().toPandas()["count"]
    assert sizes.max() < 600
    want = got.id.diff().pow(2).sum() / got.id.astype(float).pow(2).sum()
    assert ordered.durbin_watson(df, F.col("id").cast("double"), "t", "id", count=20).first()[0] == pytest.approx(want)


def test_names_of_transforms():
    assert transforms.parse_feature("ln(area)") == ("ln", "area") and transforms.parse_feature("area") == ("linear", "area")
    assert transforms.feature_name("area", "log") == "ln(area)" and transforms.feature_name("area", "identity") == "area"
    assert transforms.distinct_options(["log", "ln", "linear", "identity", "inv"]) == ["log", "linear", "inv"]
    assert transforms.equation(["const", "area"], [2.5, -0.125], "price", log=True) == "ln(price) = 2.5 - 0.125 * area"
    assert profile.columns_to_convert({"row_id": False, "a": False, "cep": True, "y": True, "d": False}, {"d": "date"}, "y") == {"row_id": False, "a": True, "cep": False, "y": True, "d": False}


def test_medians_count_little(spark, monkeypatch):
    """What a row is compared with doesn't grow with the sketch, and two places in one part share its cuts; the rows left after one look are few."""
    asked, count_if, percentile = [], profile.F.count_if, profile.F.percentile
    monkeypatch.setattr(profile.F, "count_if", lambda c: asked.append("cut") or count_if(c))
    monkeypatch.setattr(profile.F, "percentile", lambda *a: asked.append("exact") or percentile(*a))
    df = spark.range(200_000).select((F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7.0).alias("x"))
    want = float(np.median(df.toPandas().x))
    assert profile.medians(df, {"x": F.col("x")}, 1000) == {"x": want}
    assert asked.count("cut") <= 14 and asked.count("exact") == 2


def test_folds_share_one_look_at_sizes(spark, monkeypatch):
    looks, floored = [], profile._floored
    monkeypatch.setattr(profile, "_floored", lambda *a: looks.append(1) or floored(*a))
    df = market(spark)
    got = {r["fold"]: r for r in resample.evaluate_procedure(df, "fold", "price", ["area"]).collect()}
    assert len(looks) == 1
    own = df.toPandas()
    for k, r in got.items():
        held, rest = own[own.fold == k], own[own.fold != k]
        b, a = np.polyfit(rest.area, rest.price, 1)
        assert r["mae"] == pytest.approx(abs(a + b * held.area - held.price).mean()) and r["mean_mae"] == pytest.approx(abs(rest.price.mean() - held.price).mean())
        assert r["rel_mae"] == pytest.approx((abs(a + b * held.area - held.price) / held.price).mean()) and (r["n"], r["n_train"]) == (len(held), len(rest))


def test_triangles_of_groups(spark):
    """Groups by two columns with nulls: counts and cross products of each."""
    df = spark.createDataFrame([(i % 3 or None, "a" if i % 2 else None, float(i), float(i * i % 7)) for i in range(60)], "g int, h string, x double, y double")
    got = regress.triangles(df.repartition(3), ["g", "h"], ["x", "y"])
    own = df.toPandas()
    assert set(got) == {(g, h) for g in (None, "1", "2") for h in (None, "a")}
    for (g, h), (r, n) in got.items():
        here = own[(own.g.isna() if g is None else own.g == int(g)) & (own.h.isna() if h is None else own.h == h)]
        x = here[["x", "y"]].to_numpy()
        assert n == len(here) and np.allclose(r.T @ r, x.T @ x)

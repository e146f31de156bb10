import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hedra.functions import rules, transforms
from hedra.operators import cost, encode, ledger, ordered, profile, resample, score
from hedra.plans.valuation import Request, resolve, value


@pytest.fixture(scope="module")
def market(spark):
    rng = np.random.default_rng(5)
    n = 240
    f = pd.DataFrame({"row_id": [f"R{i:06d}" for i in range(n)], "area": 50 + np.arange(n) % 60 + rng.normal(size=n), "district": np.array(["Centro", "Norte", "Sul"])[np.arange(n) % 3]})
    f["price"] = 8000 * f.area + 40000 * (f.district == "Sul") + rng.normal(0, 2500, n)
    return spark.createDataFrame(f)


def test_valuation(spark, market):
    made = value(market, Request("price", ["area"], ["district"], reference={"district": "Centro"}))
    assert dict(zip(made.frozen.fit.columns, made.frozen.fit.beta, strict=True))["area"] == pytest.approx(8000, rel=0.01)
    assert made.grades["item_2"] == 3 and made.grades["item_6"] == 3
    subjects = spark.createDataFrame([("in", 73.5, "Centro"), ("new", 73.5, "Industrial"), ("far", 500.0, "Sul"), ("gap", None, "Sul"), ("edge", 130.0, "Norte")], "subject_id string, area double, district string")
    got = {r["subject_id"]: r for r in made.score(subjects).collect()}
    assert [got[k]["status"] for k in ("in", "new", "far", "gap", "edge")] == ["succeeded", "unsupported", "out_of_domain", "unsupported", "succeeded"]
    assert all(got[k]["point"] is None for k in ("new", "far", "gap"))
    r = got["in"]
    assert r["mean_low"] < r["point"] < r["mean_high"] and r["pred_low"] < r["mean_low"] and r["point"] == pytest.approx(8000 * 73.5, rel=0.01)
    assert r["item_4"] == 3 and got["edge"]["item_4"] in (0, 1, 2)
    assert len(made.frozen.reuse_key()) == 64 and made.frozen.reuse_key() == made.frozen.reuse_key()


def test_request_issues(market):
    assert Request("price").check(market.columns) == ["empty_candidate_selection"]
    assert "candidate_is_target" in Request("price", ["price"]).check(market.columns)
    with pytest.raises(ValueError, match="requested_column_absent:garden"):
        value(market, Request("price", ["garden"]))
    assert resolve("Preço m²", {"Preço m²": "preço_m²"}) == "preço_m²" and resolve("AREA", {"x": "area"}) == "area" and resolve("z", {}) is None


def test_encoder(spark):
    df = spark.createDataFrame([(1.0, " A "), (2.0, "B"), (None, "B"), (4.0, "n.d.")], "x double, c string")
    state = encode.fit_encoder(df, ["x"], ["c"], "median")
    assert state.levels == {"c": ["A", "B"]} and state.reference == {"c": "B"} and state.numeric == {"x": 2.0}
    assert encode.Encoder.loads(state.dumps()) == state
    out = encode.apply_encoder(df.unionByName(spark.createDataFrame([(9.0, "C")], "x double, c string")), state).collect()
    assert [r["c_A"] for r in out] == [1.0, 0.0, 0.0, None, None]
    assert [r["unsupported"] for r in out] == [[], [], [], ["c"], ["c"]] and out[2]["x"] == 2.0
    constant = encode.fit_encoder(df.withColumn("k", F.lit(1.0)), ["k"], [])
    assert constant.dropped == {"k": "constant_column"} and not constant.features


def test_transforms(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (4.0,), (float("nan"),), (None,)], "x double")
    got = df.select(*[transforms.transform(n, F.col("x")).alias(n) for n in transforms.NAMES], transforms.domain_failure("ln", F.col("x")).alias("why")).collect()
    assert [r["sqrt"] for r in got] == [0.0, None, 2.0, None, None] and [r["ln"] is None for r in got] == [True, True, False, True, True]
    assert [r["why"] for r in got] == ["domain_zero", "domain_negative", None, "nonfinite_input", "nonfinite_input"]
    assert transforms.domains(df.limit(1), ["x"]) == {"x": ["linear", "sqr", "sqrt"]}
    with pytest.raises(ValueError):
        transforms.fit_target(df, "x", "log")


def test_rules_are_inclusive(spark):
    one = spark.range(1)
    at = lambda c: one.select(c.alias("g")).first()["g"]
    ext = F.array(F.lit("extended"))
    assert [at(rules.item_4(ext, F.array(F.lit(d)), F.lit(d))) for d in (15.0, 15.0001, 20.0, 20.0001)] == [2, 1, 1, 0]
    assert at(rules.item_4(F.array(F.lit("in_sample")), F.array(F.lit(None).cast("double")), F.lit(0.0))) == 3
    assert at(rules.item_4(ext, F.array(F.lit(None).cast("double")), F.lit(1.0))) is None
    assert [at(rules.measure_position(F.lit(x), F.lit(10.0), F.lit(20.0))) for x in (5.0, 4.99, 40.0, 40.01, 10.0)] == ["extended", "outside", "extended", "outside", "in_sample"]
    assert [at(rules.least_per_characteristic(F.lit(n))) for n in (30, 31, 95, 100, 101)] == [3, 4, 10, 10, 10]
    assert [at(rules.precision_status(F.lit(a))) for a in (50.0, 50.1, -1.0, float("nan"))] == ["classified", "unclassified", "error", "error"]
    items = [F.lit(i) for i in (2, 3, 2, 3, 3, 3)]
    assert at(rules.foundation(items)) == 3 and at(rules.foundation([F.lit(None).cast("int"), *items[1:]])) is None
    assert at(rules.micronumerosity(F.lit(40), F.lit(2), F.array(F.lit(4), F.lit(3)))) == "violated"
    field = at(rules.admissible_interval(F.lit(100.0), F.lit(200.0), F.lit(300.0)))
    assert field["empty"] and field["lower"] is None
    assert at(rules.arbitration_field(F.lit(-1.0))) is None


def test_order(spark):
    rng = np.random.default_rng(2)
    f = pd.DataFrame({"id": rng.permutation(500), "t": rng.integers(0, 60, 500), "e": rng.normal(size=500)})
    df = spark.createDataFrame(f).repartition(6)
    s = f.sort_values(["t", "id"])
    assert ordered.durbin_watson(df, F.col("e"), "t", "id", count=7).first()["durbin_watson"] == pytest.approx(float((np.diff(s.e) ** 2).sum() / (s.e**2).sum()))
    got = ordered.number_rows(df, "t", "id", count=7).orderBy("pos").toPandas()
    assert got.id.tolist() == s.id.tolist() and got.pos.tolist() == list(range(500))
    chunks = ordered.even_chunks(ordered.number_rows(df, "t", "id"), "pos", 7).groupBy("chunk").count().orderBy("chunk").toPandas()
    assert chunks["count"].tolist() == [72, 72, 72, 71, 71, 71, 71]
    held = ordered.temporal_holdout(df, "t", 0.25).toPandas()
    assert held[held.role == "train"].t.max() < held[held.role == "test"].t.min() and (held.role == "test").sum() >= 125
    for _, fold in ordered.temporal_folds(df, "t", 4).toPandas().groupby("fold"):
        assert fold[fold.role == "train"].t.max() < fold[fold.role == "test"].t.min()
    assert ordered.durbin_watson(df.limit(1), F.col("e"), "t", "id").first()["durbin_watson"] is None
    assert ordered.number_rows(df.limit(0), "t", "id").count() == 0
    plan = ordered.number_rows(df, "t", "id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and "Aggregate" not in plan  # where a bucket begins is a table of its own, which is not derived from the rows a second time
    ids = lambda **k: sorted(r["row_id"] for r in ordered.row_ids(spark.range(999_999, 1_000_001).toDF("pos"), **k).collect())
    assert ids() == ["R0999999", "R1000000"] and ids(digits=6) == ["R100000", "R999999"]


def test_cuts_below_a_value(spark):
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 15, 16, 199):
        cuts = sorted(set(rng.integers(0, 400, n).astype(float).tolist()))
        x = [-1.0, 500.0, *cuts, *(rng.random(50) * 400).tolist()]
        df = spark.createDataFrame([(v,) for v in x] + [(None,)], "x double")
        got = {r["x"]: r["n"] for r in df.select("x", ordered._above(F.col("x"), cuts).alias("n")).collect()}
        assert got.pop(None) == 0 and got == {v: int(np.searchsorted(cuts, v)) for v in x}


def test_ledger(spark):
    df = spark.createDataFrame([("a", "600000"), ("b", ""), ("c", "1.234"), ("d", "x"), ("e", "inf")], "row_id string, price string")
    out = ledger.dispositions(df, "price", ["price"])
    assert {r["row_id"]: r["disposition"] for r in out.collect()} == {"a": "observed", "b": "pending_target", "c": "rejected", "d": "pending_target", "e": "rejected"}
    assert ledger.ingest_summary(out).first().asDict() == {"n_received": 5, "n_observed": 1, "n_pending": 2, "n_rejected": 2}
    listed = spark.createDataFrame([("a", "expert_review", "me"), ("b", "whim", "me"), ("c", "expert_review", ""), ("zz", "expert_review", "me")], "row_id string, origin string, author string")
    kept, issues = ledger.reviewed_exclusions(df, listed, "row_id", "reviewed_exclusions")
    assert {r["row_id"] for r in kept.collect()} == {"b", "c", "d", "e"}
    assert {(r["row_id"], r["code"]) for r in issues.collect()} == {("b", "exclusion_origin_not_authorized"), ("c", "reviewed_exclusion_author_missing"), ("zz", "exclusion_row_not_in_sample")}
    assert ledger.reviewed_exclusions(df, listed, "row_id", "report_only")[0].count() == 5
    assert ledger.differs(df, df.where("row_id != 'a'")).select("row_id", "side").collect() == [("a", "left")]


def test_profiles(spark):
    assert profile.column_map(["Área (m²)", "area m2", "Area-M2", "", "row_id"]) == {"Área (m²)": "área_m²", "area m2": "area_m2", "Area-M2": "aream2", "": "col_3", "row_id": "row_id__2"}
    df = spark.createDataFrame([(1, 100.0, 90.0), (1, 0.0, 1.0), (2, 50.0, 50.0)], "fold int, y double, p double")
    got = {r["fold"]: r for r in profile.metrics(df, "y", "p", ["fold"]).collect()}
    assert got[1]["mae"] == pytest.approx(5.5) and got[1]["rel_mae"] == pytest.approx(0.1) and got[2]["rmse"] == 0
    one = profile.dataset_hash(df.select(F.col("y").alias("k")), "k").first()["sha256"]
    assert one == profile.dataset_hash(df.orderBy(F.desc("y")).repartition(3).select(F.col("y").alias("k")), "k").first()["sha256"]


def test_cost(spark):
    items = spark.createDataFrame(
        [(1, "component", 80.0, 450.0, None, "s", "BRL"), (1, "item", 80.0, 220.0, 10.0, "s", "BRL"), (1, "land", 1.0, 200000.0, 0.0, "s", "BRL"), (1, "excluded", 1.0, 5000.0, 0.0, None, "USD"), (2, "item", 1.0, 1.0, 0.0, "s", "USD"), (3, "personal", 1.0, 1.0, 0.0, "s", "BRL")],
        "bom int, category string, quantity double, unit_cost double, additional_expenses double, source string, currency string",
    ).withColumns({"reference_date": F.lit("d"), "location": F.lit("l"), "include_land": F.lit(None).cast("boolean")})
    got = {r["bom"]: r for r in cost.reconstruction_costs(items, "bom", F.lit(0.25), F.lit(0.0), "BRL", "d", "l").collect()}
    assert got[1]["direct"] == 53610 and got[1]["land"] == 0 and got[1]["point"] == pytest.approx(53610 * 1.25)
    assert got[2]["point"] is None and got[2]["n_issues"] == 1 and got[3]["point"] is None
    rates = F.array(F.lit(0.1), F.lit(0.2))
    row = spark.range(1).select(cost.bdi_matches(F.lit(0.32), rates, F.lit("compound")).alias("a"), cost.bdi_matches(F.lit(0.32), rates, F.lit("additive")).alias("b"), cost.mode_grade(F.lit("calculated"), cost.BDI_GRADES, F.lit(" ")).alias("c")).first()
    assert row["a"] and not row["b"] and row["c"] is None


def test_subjects(spark):
    df = spark.createDataFrame([(0, "a", None), (1, None, "b"), (2, None, None), (3, "a", None)], "pos int, subject_id string, id string")
    named = score.normalise_subjects(df, "pos")
    assert [r["subject_id"] for r in named.orderBy("pos").collect()] == ["a", "b", "index:2", "a"]
    first, later = score.unique_subjects(named, "pos")
    assert first.count() == 3 and [r["pos"] for r in later.collect()] == [3]
    assert score.remaining(first, later.withColumn("status", F.lit("succeeded"))).count() == 2


def test_preview_takes_first_levels_in_every_task(spark):
    df = spark.range(5000).selectExpr("format_string('%05d', id) AS a", "CAST(id % 3 AS STRING) AS b", "CAST(NULL AS STRING) AS c")
    out = profile.preview(df, ["a", "b", "c"], levels=4)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r["column"]: (r["levels"], r["n_levels"]) for r in out.collect()} == {"a": ([f"{i:05d}" for i in range(4)], 5000), "b": (["0", "1", "2"], 3)}


def test_ambiguous_bases():
    columns = ["Area_Privativa", "area_total", "preco_m2", "preco"]
    assert [c for c, _ in profile.ambiguous_bases(columns)] == ["ambiguous_area_basis", "ambiguous_price_basis"]
    assert profile.ambiguous_bases(columns, {"area_total": "m2_total"}, "BRL") == []
    assert profile.ambiguous_bases(["area_total", "preco"]) == []


def test_roles_of_an_empty_table(spark):
    df = spark.createDataFrame([], "id bigint, idade bigint, nome string, preco double, dia date, nota string")
    got = {row["column"]: (row["role"], row["numeric_share"]) for row in profile.suggest_roles(df, df.columns).collect()}
    assert got == {"id": ("identifier", None), "idade": ("predictor", None), "nome": ("identifier", None), "preco": ("target", None), "dia": ("date", None), "nota": ("predictor", None)}


def test_roles_leave_nulls_out(spark):
    df = spark.createDataFrame([("two words",), (None,), (None,), ("and more here",)], "nota string")
    row = profile.suggest_roles(df, ["nota"]).first()
    assert (row["role"], row["numeric_share"], row["mean_words"]) == ("identifier", 0.0, 2.5)


def test_predictions_without_any(spark):
    ids = spark.createDataFrame([(1,), (2,)], "id bigint")
    none = spark.createDataFrame([], "id bigint, status string, value double, n int")
    assert {tuple(row) for row in resample.normalise_predictions(ids, none, "id", "n").collect()} == {(1, "failed", None, "no_prediction"), (2, "failed", None, "no_prediction")}
    some = spark.createDataFrame([(1, "ok", None, 1), (2, None, 0.0, 1)], "id bigint, status string, value double, n int")
    assert {tuple(row) for row in resample.normalise_predictions(ids, some, "id", "n").collect()} == {(1, "failed", None, "not_finite"), (2, "ok", 0.0, None)}

import threading
import time

import pytest
from pyspark.sql import functions as F

from hedra.functions.transforms import amplitude
from hedra.operators import reproduce, resample, search
from hedra.operators.score import score_batch
from hedra.plans import batch
from hedra.plans.valuation import Request, value


def market(spark, n=400):
    u = lambda s: F.pmod(F.xxhash64("id", F.lit(s)), F.lit(1000)) / 1000.0
    df = spark.range(n).select("id", (20 + 100 * u(1)).alias("area"), (1 + 9 * u(2)).alias("age"), F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (1 + F.pmod("id", F.lit(3))).cast("int")).alias("zone"), u(3).alias("e"))
    price = 50 + 3 * F.col("area") - 4 * F.col("age") + F.when(F.col("zone") == "B", 20).otherwise(0) + 5 * F.col("e")
    return df.withColumn("price", price).withColumn("subject_id", F.col("id").cast("string"))


def frozen_of(df, **more):
    return value(df, Request("price", ["area", "age"], ["zone"], **more)).frozen


def test_a_stopped_batch_is_taken_up_again(spark, tmp_path):
    df = market(spark).union(market(spark).limit(1).withColumn("subject_id", F.lit(None).cast("string")))
    frozen, path = frozen_of(df), f"file://{tmp_path}/b"
    slow = F.udf(lambda x: time.sleep(0.02) or x, "double")
    ended = []
    worker = threading.Thread(target=lambda: ended.append(batch.run_batch(df.withColumn("area", slow("area")), frozen, path, slices=4)))
    # dealing takes the slow column's time; once dealt, slices are fast, so stop during the deal or after
    worker.start()
    deadline = time.time() + 60
    while worker.is_alive() and time.time() < deadline and not batch.progress(spark, path).where("state = 'dealt'").count():
        time.sleep(0.05)
    batch.stop(spark, path)
    worker.join(60)
    assert ended and ended[0] in ("cancelled", "succeeded")
    assert batch.run_batch(df, frozen, path, slices=4) == "succeeded"
    got = batch.results(spark, path)
    assert got.count() == df.count() and got.select("subject_id").distinct().count() == df.count()
    want = {r["subject_id"]: r["point"] for r in score_batch(df, frozen).collect()}
    assert {r["subject_id"]: r["point"] for r in got.collect()} == pytest.approx(want)
    with pytest.raises(ValueError, match="batch_identity_mismatch"):
        batch.run_batch(df, frozen_of(df, level=0.9), path, slices=4)


def test_half_written_slices_do_not_count(spark, tmp_path):
    df, path = market(spark, 60), f"file://{tmp_path}/c"
    frozen = frozen_of(df)
    asked = []
    assert batch.run_batch(df, frozen, path, slices=3, cancelled=lambda done: asked.append(done) or done == 1) == "cancelled"
    assert asked == [0, 1] and set(batch.committed(spark, path)) == {0}
    some = batch.results(spark, path).count()
    # what a stopped run left behind without a commit
    score_batch(df, frozen).write.parquet(f"{path}/results/lost/slice=1")
    assert batch.run_batch(df, frozen, path, slices=3) == "succeeded" and batch.run_batch(df, frozen, path, slices=3) == "succeeded"
    assert 0 < some < 60 and batch.results(spark, path).groupBy("subject_id").count().where("count > 1").count() == 0 and batch.results(spark, path).count() == 60
    states = {r["state"]: r["slices"] for r in batch.progress(spark, path).collect()}
    assert states == {"dealt": 1, "cancelled": 1, "succeeded": 3}


@pytest.mark.parametrize(("transform", "estimand"), [("identity", "median"), ("log", "smearing"), ("log", "lognormal_mean")])
def test_reproduction_finds_what_was_changed(spark, tmp_path, transform, estimand):
    df = market(spark, 90)
    gaps = df.withColumn("area", F.when(F.col("id") % 9 > 0, F.col("area"))).withColumn("zone", F.when(F.col("id") == 5, "new").otherwise(F.col("zone")))
    frozen = frozen_of(df, transform=transform, estimand=estimand, impute="mean", level=0.9)
    scored = score_batch(gaps.withColumn("raw", F.struct("area", "age", "zone")), frozen)
    path = f"file://{tmp_path}/d"
    reproduce.store(scored, frozen, path)
    got = reproduce.reproduce(spark, path).collect()
    assert len(got) == 90 * 5 and all(r["agrees"] for r in got) and sum(r["stored"] is None for r in got) == 5
    reproduce.store(scored.withColumn("pred_low", F.when(F.col("id") == 7, F.col("pred_low") + 0.01).otherwise(F.col("pred_low"))), frozen, path)
    assert {(r["subject_id"], r["field"]) for r in reproduce.reproduce(spark, path).where("NOT agrees").collect()} == {("7", "pred_low")}


def test_every_candidate_values_the_subject_as_scoring_does(spark):
    df = market(spark).withColumns({"zone_B": (F.col("zone") == "B").cast("double"), "zone_C": (F.col("zone") == "C").cast("double")})
    units = [search.Unit("area", ("linear", "ln")), search.Unit("age", ("linear",)), search.Unit("zone", ("encoded",), ("zone_B", "zone_C"))]
    subject = spark.createDataFrame([(130.0, 5.0, 1.0, 0.0)], "area double, age double, zone_B double, zone_C double")
    found = search.search_models(df, "price", units, targets=("identity", "log"), subject=subject, frame=search.Policy(level=0.9, least_grade=1, documents=(3, 3)))
    got = {r["candidate_id"]: r for r in found.records.collect()}
    one = spark.createDataFrame([("s", 130.0, 5.0, "B")], "subject_id string, area double, age double, zone string")
    for transform in ("identity", "log"):
        made = frozen_of(df, transform=transform, level=0.9)
        want = score_batch(one, made).withColumn("a", amplitude(F.col("mean_low"), F.col("mean_high"), F.col("point"))).first()
        own = got[f"age:linear|area:linear|zone:encoded|y:{transform}|int:1"]
        assert (own["point"], own["mean_low"], own["mean_high"], own["amplitude_pct"]) == pytest.approx((want["point"], want["mean_low"], want["mean_high"], want["a"]))
        assert own["positions"] == ["in_sample", "extended"] and own["slopes"] == 4
    # framed candidates come first, whatever their error
    ranked = sorted((r for r in got.values() if r["rank"]), key=lambda r: r["rank"])
    assert [r["framing"] for r in ranked] == sorted((r["framing"] for r in ranked), reverse=True)
    unknown = search.search_models(df, "price", units[:2], subject=subject.withColumn("area", F.lit(None).cast("double")), frame=search.Policy(require_precision=True)).records
    assert {r["candidate_id"] for r in unknown.where("framing").collect()} == {"age:linear|y:identity|int:1"}
    assert {r["role"] for r in search.winner(unknown).collect()} >= {"winner"}


def test_exact_partitions(spark):
    rows = spark.createDataFrame([(i // 2, f"g{i % 11}" if i % 5 else None) for i in range(101)], "id bigint, g string")
    for share, n in ((0.25, 25), (0.0, 1), (1.0, 100), (0.5, 50)):
        assert resample.exact_holdout(rows, "id", share, 3).where("role = 'test'").count() == n
    folds = [r["count"] for r in resample.exact_folds(rows, "id", 4, 3).groupBy("fold").count().orderBy("fold").collect()]
    assert folds == [26, 25, 25, 25]
    placed = resample.exact_group_folds(rows, "g", 3, 3)
    assert placed.count() == 101 and placed.where("g IS NULL AND fold IS NOT NULL").count() == 0
    assert sorted(r["n"] for r in placed.where("g IS NOT NULL").groupBy("fold").agg(F.count_distinct("g").alias("n")).collect()) == [3, 4, 4]
    assert resample.exact_group_folds(rows, "g", 2, 3, 0.2).where("fold = 0").select("g").distinct().count() == 2
    again = {r["id"]: r["fold"] for r in resample.exact_folds(rows.distinct().repartition(7), "id", 4, 3).collect()}
    assert again == {r["id"]: r["fold"] for r in resample.exact_folds(rows.distinct(), "id", 4, 3).collect()}
    with pytest.raises(ValueError):
        resample.exact_folds(rows.limit(1), "id", 4, 3)


def test_one_candidate_by_the_same_path(spark):
    df = market(spark)
    units = [search.Unit("area", ("linear", "ln")), search.Unit("age", ("linear", "sqr"))]
    all_of = {r["candidate_id"]: r for r in search.search_models(df, "price", units, targets=("identity", "log")).records.collect()}
    for name in ("age:sqr|area:ln|y:log|int:1", "area:linear|y:identity|int:1"):
        record, fit = search.evaluate_candidate(df, "price", units, name)
        own = record.first()
        assert (own["rmse"], own["aic"], own["worst_p"]) == pytest.approx((all_of[name]["rmse"], all_of[name]["aic"], all_of[name]["worst_p"])) and fit.status == "fitted"
    with pytest.raises(ValueError, match="candidate_unknown"):
        search.evaluate_candidate(df, "price", units, "area:inverse|y:identity|int:1")


def test_a_level_is_read_once_a_row(spark):
    """Filters on indicators don't repeat the reading of a text, however many levels there are; features stay as they were."""
    from hedra.operators.encode import Encoder, apply_encoder, feature_columns

    levels = [f"l{i}" for i in range(30)]
    df = spark.createDataFrame([(i, f" l{i} " if i < 30 else None if i == 30 else "new") for i in range(32)], "id int, c string")
    state = Encoder(levels={"c": levels}, reference={"c": "l0"})
    names = list(state.indicators("c").values())
    out = apply_encoder(df, state)
    plan = out.where(" AND ".join(f"`{n}` IS NOT NULL" for n in names))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("c#") < 30 and set(out.columns) == {"id", "c", *names, "unsupported"}
    plain = {r["id"]: r for r in df.select("id", *[x.alias(n) for n, x in feature_columns(df, state).items()]).collect()}
    for r in out.collect():
        assert all(r[n] == plain[r["id"]][n] for n in names) and r["unsupported"] == (["c"] if r["id"] > 29 else [])


def test_reproduction_keeps_a_subject_in_one_row(spark, tmp_path):
    """No subject is shuffled by the places of the model's inverse, and a changed coefficient still shows."""
    from hedra.operators import reproduce
    from hedra.plans.valuation import Request, value

    df = spark.range(90).select(F.col("id").cast("string").alias("subject_id"), (10.0 + F.col("id")).alias("x"), F.concat(F.lit("g"), (F.col("id") % 3).cast("string")).alias("g"), (5 + 3.0 * F.col("id") + 20 * (F.col("id") % 3) + F.sin("id")).alias("y"))
    made = value(df, Request("y", ["x"], ["g"]))
    reproduce.store(made.score(df.withColumn("raw", F.struct("x", "g"))), made.frozen, str(tmp_path))
    out = reproduce.reproduce(spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "sum(" not in plan and plan.count("Aggregate") <= 2  # of the model alone
    got = out.collect()
    assert len(got) == 450 and all(r["agrees"] for r in got)
    terms = [(r["term"], r["beta"] + (0.01 if r["term"] == "x" else 0.0), r["variable"], r["level"]) for r in spark.read.parquet(f"{tmp_path}/terms").collect()]
    spark.createDataFrame(terms, "term string, beta double, variable string, level string").write.mode("overwrite").parquet(f"{tmp_path}/terms")
    assert not any(r["agrees"] for r in reproduce.reproduce(spark, str(tmp_path)).collect())

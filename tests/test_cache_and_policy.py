import pytest
from pyspark.sql import functions as F

from hedra.operators import policy, search
from hedra.plans import cache


def sample(spark, n=60):
    return spark.range(n).select("id", (F.col("id") % 17 + 1.0).alias("a"), (F.col("id") % 5 + 2.0).alias("b"), (3.0 * F.col("id") + F.col("id") % 7 + 1).alias("y"))


UNITS = [search.Unit("a", ("linear", "ln")), search.Unit("b", ("linear",))]


def test_a_search_comes_back_whole(spark, tmp_path):
    df, folder = sample(spark), f"file://{tmp_path}/s"
    name = cache.sample_fingerprint(df, "id", ["a", "b", "y"])
    assert name == cache.sample_fingerprint(df.repartition(5), "id", ["a", "b", "y"]) != cache.sample_fingerprint(df.withColumn("y", F.col("y") + (F.col("id") == 3).cast("int")), "id", ["a", "b", "y"])
    made, hit = cache.cached_search(df, "y", UNITS, folder, name, targets=("identity", "log"))
    broken = df.withColumn("a", F.raise_error(F.lit("read")).cast("double"))
    again, second = cache.cached_search(broken, "y", UNITS, folder, name, targets=("identity", "log"))
    assert (hit, second) == (False, True)
    assert sorted(map(str, again.records.collect())) == sorted(map(str, made.records.collect())) and again.audit == made.audit
    plain = search.search_models(df, "y", UNITS, targets=("identity", "log"))
    for c in ("a:ln|b:linear|y:log|int:1", "a:linear|y:identity|int:1"):
        assert list(again.fit(c).beta) == list(plain.fit(c).beta) and again.features(c) == plain.features(c)
    for other in ({"objective": "aic"}, {"policy": 1}, {"targets": ("identity",)}):
        assert not cache.cached_search(df, "y", UNITS, folder, name, **({"targets": ("identity", "log")} | other))[1]
    assert not cache.cached_search(df, "b", UNITS[:1], folder, name)[1] and not cache.cached_search(df, "y", UNITS, folder, name + "x", targets=("identity", "log"))[1]


def test_the_least_recently_used_goes(spark, tmp_path):
    df, folder = sample(spark), f"file://{tmp_path}/s"
    run = lambda name: cache.cached_search(df, "y", UNITS[1:], folder, name, most=2)[1]
    assert [run(x) for x in ("p", "q", "p", "r", "p", "q")] == [False, False, True, False, True, False]


def test_half_written_searches_do_not_count(spark, tmp_path):
    df, folder = sample(spark), f"file://{tmp_path}/s"
    made, _ = cache.cached_search(df, "y", UNITS, folder, "n")
    digest = search.cache_key("n", UNITS, {"target": "y", "objective": "rmse"}, "population_model")
    cache._delete(spark, f"{folder}/{digest}/state")
    again, hit = cache.cached_search(df, "y", UNITS, folder, "n")
    assert not hit and again.records.count() == made.records.count()


def test_arbitration_needs_a_verified_profile(spark):
    kinds = "id string, version int, state string, method string, value_basis string, source_sha256 string"
    profiles = [("ok", 1, "verified", "market_regression", "market_value", "x"), ("draft", 1, "draft", "market_regression", "market_value", "x"), ("cost", 1, "verified", "cost", "market_value", "x"), ("bare", 1, "verified", "market_regression", "market_value", None)]
    profiles += [("twice", 1, "verified", "market_regression", "market_value", "x"), ("twice", 1, "draft", "market_regression", "market_value", "x")]
    asked = [(1, "ok", 1, None), (2, "ok", 1, 15.0), (3, "ok", 1, 20.0), (4, "ok", 2, None), (5, "draft", 1, 15.0), (6, "cost", 1, None), (7, "bare", 1, None), (8, "twice", 1, None), (9, None, None, None), (9, None, None, 1.0)]
    got = policy.arbitration(spark.createDataFrame(asked, "k int, profile_id string, profile_version int, declared_percent double"), spark.createDataFrame(profiles, kinds)).collect()
    assert sorted((r["k"], r["arbitration_percent"], r["arbitration_status"]) for r in got if r["arbitration_percent"]) == [(1, 15.0, "applied_verified_profile_rule"), (2, 15.0, "applied_verified_profile_rule")]
    assert sorted((r["k"], r["arbitration_status"][:8]) for r in got)[2:] == [(3, "arbitrat"), (4, "arbitrat"), (5, "rejected"), (6, "arbitrat"), (7, "arbitrat"), (8, "arbitrat"), (9, "arbitrat"), (9, "rejected")]
    assert {r["arbitration_status"] for r in got if r["k"] == 3} == {"arbitration_policy_conflict"}


def test_names_of_the_least_grade(spark):
    rows = [(2, "2", None), (2, "2.0", 2), (1, "3", None), (None, "x", None), (4, None, None), (None, None, None), (None, None, 3)]
    df = spark.createDataFrame(rows, "minimum_fundamentacao_grade int, min_fundamentacao_grade string, target_degree int")
    got = [tuple(r["x"]) for r in df.select(policy.least_grade(df).alias("x")).collect()]
    assert got == [(2, None), (2, None), (None, "GRADE_ALIAS_CONFLICT"), (None, "grade_invalid"), (None, "grade_invalid"), (None, None), (3, None)]
    assert df.select(policy.least_grade(df.select("target_degree").withColumnRenamed("target_degree", "other")).alias("x")).first()["x"]["grade"] is None


@pytest.mark.parametrize("point", [10.0, -1.0, None])
def test_arbitration_ends(spark, point):
    r = spark.createDataFrame([(point,)], "p double").select(policy.arbitration_ends(F.col("p"), F.lit(15.0)).alias("x")).first()["x"]
    assert (r and (r["lower"], r["upper"])) == ((pytest.approx(8.5), pytest.approx(11.5)) if point == 10 else None)

"""Stored values computed anew from what was stored: the model in long form is joined with the subjects, and no code that scores is used.

A folder holds four tables: `terms` (each coefficient with its column, and the level that an indicator stands for), `inverse` (the triangle's inverse, entry by
entry), `facts` (numbers and texts of the project) and `values` (what was disclosed). The point is the sum over terms; the leverage is a quadratic form, a sum of
squares of sums over the triangle's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hedra.functions import parse
from hedra.operators.distributions import t_quantile
from hedra.operators.regress import CONST
from hedra.operators.score import Frozen

FIELDS = ("point", "mean_low", "mean_high", "pred_low", "pred_high")
#: Absolute and relative differences up to which a point and an end agree.
POINT_SLACK, END_SLACK = (1e-8, 1e-10), (1e-6, 1e-8)


def store(scored: DataFrame, frozen: Frozen, path: str, key: str = "subject_id") -> None:
    """Writes the four tables; `scored` has key, status, the FIELDS and the raw variables of the model, whose texts are kept."""
    spark, fit, state = scored.sparkSession, frozen.fit, frozen.encoder
    columns = {c: (c, None) for c in state.numeric} | {name: (c, level) for c in state.levels for level, name in state.indicators(c).items()}
    terms = [(c, float(b), *(columns.get(c) or (None, None))) for c, b in zip(fit.columns, fit.beta, strict=True)]
    spark.createDataFrame(terms, "term string, beta double, variable string, level string").write.mode("overwrite").parquet(f"{path}/terms")
    entries = [(fit.columns[i], j, float(fit.inverse[i, j])) for i in range(fit.p) for j in range(fit.p) if fit.inverse[i, j]]
    spark.createDataFrame(entries, "term string, place int, value double").write.mode("overwrite").parquet(f"{path}/inverse")
    facts = {"n": fit.n, "p": fit.p, "sse": fit.sse, "level": frozen.level, "smearing": frozen.smearing}
    facts |= {f"fill:{c}": v for c, v in state.numeric.items() if v is not None}
    texts = {"transform": frozen.transform, "estimand": frozen.estimand}
    rows = [(k, float(v), None) for k, v in facts.items()] + [(k, None, v) for k, v in texts.items()]
    spark.createDataFrame(rows, "fact string, number double, text string").write.mode("overwrite").parquet(f"{path}/facts")
    raw = list(dict.fromkeys([*state.numeric, *state.levels]))
    variables = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"raw.{c}").cast("string").alias("value")) for c in raw])
    own = scored if "raw" in scored.columns else scored.withColumn("raw", F.struct(*raw))
    own.select(key, "status", *FIELDS, variables.alias("variables")).write.mode("overwrite").parquet(f"{path}/values")


def reproduce(spark: SparkSession, path: str, key: str = "subject_id") -> DataFrame:
    """key, field, stored, again and agrees of every disclosed number in the folder."""
    terms, inverse = spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/inverse")
    facts = {r["fact"]: r["text"] if r["number"] is None else r["number"] for r in spark.read.parquet(f"{path}/facts").collect()}  # a row a fact
    values = spark.read.parquet(f"{path}/values")
    values = values.repartition(max(spark.sparkContext.defaultParallelism, values.rdd.getNumPartitions()))  # small files would leave the work to a few tasks
    fills = {k[5:]: v for k, v in facts.items() if k.startswith("fill:")}
    filled = F.create_map(*[F.lit(x) for kv in fills.items() for x in kv]) if fills else None
    fill = lambda c: F.lit(None).cast("double") if filled is None else filled[c]
    # the model as one row: each term with its row of the inverse, place by place
    places = inverse.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("place", "value"))).alias("by"))
    lines = terms.join(F.broadcast(places), "term", "left").withColumn("line", F.transform(F.sequence(F.lit(0), F.lit(int(facts["p"]) - 1)), lambda j: F.coalesce(F.element_at("by", j), F.lit(0.0))))
    model = lines.agg(F.collect_list(F.struct("term", "beta", "variable", "level", "line")).alias("terms"))
    # a term's value in the design: 1 for the constant, the number, or whether the text is its level; a subject is a row throughout, and terms of value 0 add nothing
    read = F.transform("variables", lambda v: F.struct(v["variable"].alias("variable"), F.coalesce(v["value"].try_cast("double"), fill(v["variable"])).alias("number"), parse.category(v["value"]).alias("level")))
    said = values.where("status = 'succeeded'").select(key, F.map_from_entries(F.transform(read, lambda v: F.struct(v["variable"], v))).alias("said")).join(F.broadcast(model), F.lit(True))  # one row
    x = lambda t: F.when(t["term"] == CONST, F.lit(1.0)).when(t["level"].isNull(), F.col("said")[t["variable"]]["number"]).otherwise((F.col("said")[t["variable"]]["level"] == t["level"]).cast("double"))
    own = said.select(key, F.filter(F.transform("terms", lambda t: F.struct(x(t).alias("x"), t["beta"].alias("beta"), t["line"].alias("line"))), lambda t: t["x"] != 0).alias("own"))
    total = lambda of: F.aggregate("own", F.lit(0.0), lambda a, t: a + of(t))
    each = F.transform(F.sequence(F.lit(0), F.lit(int(facts["p"]) - 1)), lambda j: total(lambda t: t["x"] * t["line"][j]))
    done = own.select(key, total(lambda t: t["x"] * t["beta"]).alias("mu"), F.aggregate(each, F.lit(0.0), lambda a, u: a + u * u).alias("q"))
    df = facts["n"] - facts["p"]
    sigma = (facts["sse"] / df) ** 0.5
    reach = t_quantile((1 + facts["level"]) / 2, int(df)) * sigma
    mu, log = F.col("mu"), facts["transform"] == "log"
    back = F.exp if log else (lambda c: c)
    value = {"median": back(mu), "smearing": back(mu) * facts["smearing"], "lognormal_mean": back(mu + sigma**2 / 2)}[facts["estimand"]] if log else mu
    mean, pred = reach * F.sqrt("q"), reach * F.sqrt(1 + F.col("q"))
    again = done.select(key, *[c.alias(f"_{n}") for n, c in zip(FIELDS, (value, back(mu - mean), back(mu + mean), back(mu - pred), back(mu + pred)), strict=True)])
    both = values.join(again, key, "left")
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("stored"), F.col(f"_{n}").alias("again"), F.lit(POINT_SLACK[0] if n == "point" else END_SLACK[0]).alias("a"), F.lit(POINT_SLACK[1] if n == "point" else END_SLACK[1]).alias("b")) for n in FIELDS])
    out = both.select(key, F.explode(pairs).alias("x")).select(key, "x.*")
    same = F.abs(F.col("stored") - F.col("again")) <= F.col("a") + F.col("b") * F.abs("stored")
    return out.select(key, "field", "stored", "again", F.coalesce(same, F.col("stored").isNull() & F.col("again").isNull()).alias("agrees"))

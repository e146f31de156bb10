"""What becomes of each row: dispositions, exclusions with reasons, and set checks between samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedra.functions import parse


def dispositions(df: DataFrame, target: str | None, columns: list[str], locale: str = "auto") -> DataFrame:
    """Adds disposition (observed, pending_target, rejected), target_value and missing_before (names of missing raw columns)."""
    out = df.withColumn("missing_before", F.filter(F.array(*[F.when(parse.is_missing(F.col(c).cast("string")), F.lit(c)) for c in columns]), lambda c: c.isNotNull()))
    if target is None:
        return out.withColumns({"target_value": F.lit(None).cast("double"), "disposition": F.lit("observed")})
    text = dict(df.dtypes)[target] == "string"
    said = (parse.parse_number(F.col(target), locale) if text else parse.already_number(F.col(target).cast("double")))
    status = F.col("_said.status")
    chosen = F.when(status.isin("parsed", "already_numeric"), "observed").when(status.isin("ambiguous", "malformed", "non_finite"), "rejected").otherwise("pending_target")
    return out.withColumn("_said", said).withColumns({"target_value": F.col("_said.value"), "disposition": chosen}).drop("_said")


def ingest_summary(ledger: DataFrame) -> DataFrame:
    """n_received, n_observed, n_pending, n_rejected."""
    named = {"n_observed": "observed", "n_pending": "pending_target", "n_rejected": "rejected"}
    return ledger.agg(F.count(F.lit(1)).alias("n_received"), *[F.count_if(F.col("disposition") == v).alias(k) for k, v in named.items()])


def training_rows(df: DataFrame, train: Column, target: str, predictors: list[str]) -> DataFrame:
    """Adds reasons: not_in_train, target_missing, and predictor_missing:<column> of rows that would else be used; `used` is none of them."""
    early = F.filter(F.array(F.when(~F.coalesce(train, F.lit(False)), F.lit("not_in_train")), F.when(~parse.is_observation(F.col(target).cast("double")), F.lit("target_missing"))), lambda r: r.isNotNull())
    gaps = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(f"predictor_missing:{c}")) for c in predictors]), lambda r: r.isNotNull())
    out = df.withColumn("reasons", F.when(F.size(early) > 0, early).otherwise(gaps))
    return out.withColumn("used", F.size("reasons") == 0)


def sample_counts(rows: DataFrame) -> DataFrame:
    """n_received, n_used, n_excluded and how many rows each kind of reason took."""
    kinds = ("not_in_train", "target_missing", "predictor_missing")
    held = lambda k: F.count_if(F.exists("reasons", lambda r: r.startswith(k))).alias(f"n_{k}")
    return rows.agg(F.count(F.lit(1)).alias("n_received"), F.count_if("used").alias("n_used"), F.count_if(~F.col("used")).alias("n_excluded"), *[held(k) for k in kinds])


def only(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed; a repeated id changes nothing."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")


def reviewed_exclusions(sample: DataFrame, exclusions: DataFrame, key: str, policy: str, origins: tuple[str, ...] = ("expert_review", "pre_fit_rule")) -> tuple[DataFrame, DataFrame]:
    """Sample after a policy, and issues (key, code). report_only keeps every row; reviewed_exclusions drops listed rows of an allowed origin with an author."""
    known = exclusions.join(sample.select(key).distinct().withColumn("_in", F.lit(True)), key, "left")
    code = (
        F.when(F.col("_in").isNull(), "exclusion_row_not_in_sample")
        .when(~F.col("origin").isin(*origins) | F.col("origin").isNull(), "exclusion_origin_not_authorized")
        .when(F.coalesce(F.trim("author"), F.lit("")) == "", "reviewed_exclusion_author_missing")
    )
    judged = known.withColumn("code", F.lit("reviewed_exclusions_ignored_in_report_only") if policy == "report_only" else code)
    issues = judged.where("code IS NOT NULL").select(key, "code").distinct()
    return (sample, issues) if policy == "report_only" else (without(sample, judged.where("code IS NULL"), key), issues)


def attach_reasons(rows: DataFrame, reasons: DataFrame, key: str) -> DataFrame:
    """All rows, with their reasons joined by " | " in alphabetical order; empty without any."""
    joined = reasons.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("reason")), " | ").alias("reason"))
    return rows.join(joined, key, "left").withColumn("reason", F.coalesce("reason", F.lit("")))


def overlay(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Maps `evidence` by key: an entry of the new table wins, also if it is null."""
    a, b = old.select(key, F.col("evidence").alias("_old")), new.select(key, F.col("evidence").alias("_new"))
    empty = F.create_map().cast("map<string,string>")
    both = a.join(b, key, "full")
    fresh = F.coalesce("_new", empty)
    kept = F.map_filter(F.coalesce("_old", empty), lambda k, v: ~F.array_contains(F.map_keys(fresh), k))
    return both.select(key, F.map_concat(kept, fresh).alias("evidence"))


def overlap(train: DataFrame, reserved: DataFrame, key: str) -> DataFrame:
    """Keys on both sides of a partition: there must be none."""
    return train.select(key).intersect(reserved.select(key))


def leaks(train: DataFrame, reserved: DataFrame, key: str, category: str, encoder_levels: list[str]) -> DataFrame:
    """kind and value: keys used on both sides, and levels only reserved rows have that the encoder knows all the same."""
    rows = overlap(train, reserved, key).select(F.lit("row").alias("kind"), F.col(key).cast("string").alias("value"))
    unseen = reserved.select(category).distinct().join(train.select(category).distinct(), category, "left_anti")
    known = unseen.where(F.col(category).isin(encoder_levels)).select(F.lit("level").alias("kind"), F.col(category).cast("string").alias("value"))
    return rows.unionByName(known)


def group_issues(issues: DataFrame) -> DataFrame:
    """One row for each origin, code and message with the numbers of ids that it concerns and of issues; `records.grouped_ids` lists the ids, a row each."""
    return issues.groupBy("origin", "code", "message").agg(F.count_distinct("affected_id").alias("n_ids"), F.count(F.lit(1)).alias("n"))


def differs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, with their side."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def union_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def first_of_each(df: DataFrame, key: str, position: str) -> DataFrame:
    """Adds `repeated`: false for the first row of each key by position. The first place comes from an aggregation, so that a hot key never gathers."""
    first = df.groupBy(key).agg(F.min(position).alias("_first"))
    joined = df.join(first.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")), "left")
    return joined.withColumn("repeated", F.col(position) != F.col("_first")).drop("_key", "_first")


def consolidate_actions(actions: DataFrame) -> DataFrame:
    """One row for each code: least priority, number of references, and the reason that ranked first; in order of priority and code."""
    out = actions.groupBy("code").agg(F.min("priority").alias("priority"), F.count_distinct("reference").alias("n_refs"), F.min_by("reason", F.struct("priority", "reason")).alias("reason"))
    return out.orderBy("priority", "code")


def action_references(actions: DataFrame) -> DataFrame:
    """code and reference, once each: what a consolidated action refers to, a row each, as references can be as many as rows."""
    return actions.where("reference IS NOT NULL").select("code", "reference").distinct()


def conformance(requirements: DataFrame, manifest: DataFrame, key: str = "component") -> DataFrame:
    """Every required component with its status: present, missing or optional_missing."""
    joined = requirements.join(manifest.select(key).distinct().withColumn("_there", F.lit(True)), key, "left")
    return joined.withColumn("status", F.when(F.col("_there"), "present").when(F.col("mandatory"), "missing").otherwise("optional_missing")).drop("_there")


def comparable_alternatives(alternatives: DataFrame) -> DataFrame:
    """One row: what to do about alternatives' values, which only compare within one unit, date and estimand."""
    identity = F.struct("unit", "date", "estimand")
    unknown = F.col("unit").isNull() | F.col("date").isNull() | F.col("estimand").isNull()
    row = alternatives.agg(F.count_distinct(identity).alias("kinds"), F.bool_or(unknown).alias("unknown"), F.min("value").alias("a"), F.max("value").alias("b"))
    return row.select(F.when((F.col("kinds") > 1) | F.col("unknown"), "incompatible_alternative_comparison").when(F.col("a") != F.col("b"), "review_value_sensitivity").alias("action"))

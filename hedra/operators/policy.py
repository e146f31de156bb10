"""Policies that requests name: rules that only a verified profile gives, and one least grade under several historical names. Any number of requests at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedra.functions.rules import ARBITRATION

# The only kind of profile that has an arbitration rule, and names of the least grade.
VERIFIED, METHOD, BASIS = "verified", "market_regression", "market_value"
GRADE_NAMES = ("minimum_fundamentacao_grade", "min_fundamentacao_grade", "target_degree")


def arbitration(requests: DataFrame, profiles: DataFrame, declared: str = "declared_percent") -> DataFrame:
    """Adds arbitration_percent and arbitration_status to requests (profile_id, profile_version, and a declared percentage or null), from profiles (id, version, state,
    method, value_basis, source_sha256).

    A request chooses a profile and never the percentage: that of the standard applies where the profile is verified, of the method and basis that the rule is for, and has sources. Without such a profile
    there is none (rejected, if one was declared, else unverified), and a declaration that differs is a conflict, which gives none either. A profile that is listed twice in
    different words is not known. Profiles are joined by key, requests stay as many as they are.
    """
    good = (F.col("state") == VERIFIED) & (F.col("method") == METHOD) & (F.col("value_basis") == BASIS) & (F.coalesce(F.col("source_sha256"), F.lit("")) != "")
    known = profiles.groupBy("id", "version").agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("_good"))
    known = known.select(F.col("id").alias("_id"), F.col("version").alias("_version"), "_good")
    joined = requests.join(known, (F.col("profile_id") == F.col("_id")) & (F.col("profile_version") == F.col("_version")), "left")
    said, percent, ok = F.col(declared), F.lit(ARBITRATION * 100), F.coalesce(F.col("_good"), F.lit(False))
    agrees = said.isNull() | (F.abs(said - percent) <= 1e-9)
    status = F.when(~ok & said.isNotNull(), "rejected_unverified_or_inapplicable_profile").when(~ok, "arbitration_rule_unverified").when(~agrees, "arbitration_policy_conflict").otherwise("applied_verified_profile_rule")
    return joined.withColumns({"arbitration_percent": F.when(ok & agrees, percent), "arbitration_status": status}).drop("_id", "_version", "_good")


def arbitration_ends(point: Column, percent: Column) -> Column:
    """struct(lower, upper) around a positive point, null where no rule applies."""
    share = percent / 100
    return F.when((point > 0) & percent.isNotNull(), F.struct((point * (1 - share)).alias("lower"), (point * (1 + share)).alias("upper")))


def least_grade(df: DataFrame, names: tuple[str, ...] = GRADE_NAMES) -> Column:
    """struct(grade, code) of the least grade that a request names under any of its columns: code is GRADE_ALIAS_CONFLICT where two differ, grade_invalid where one is none of 1
    to 3, else null; a conflict or an invalid grade gives none. Columns that aren't there say nothing."""
    said = F.array_compact(F.array(*[F.col(c).cast("string") for c in names if c in df.columns])) if any(c in df.columns for c in names) else F.array().cast("array<string>")
    grades = F.transform(said, lambda v: v.try_cast("double"))
    invalid = F.exists(grades, lambda g: F.coalesce(~g.isin(1.0, 2.0, 3.0), F.lit(True)))
    conflict = F.size(F.array_distinct(grades)) > 1
    code = F.when(invalid, "grade_invalid").when(conflict, "GRADE_ALIAS_CONFLICT")
    return F.struct(F.when(code.isNull(), F.get(grades, 0).cast("int")).alias("grade"), code.alias("code"))

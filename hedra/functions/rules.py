"""Grades of the valuation standard as expressions: each takes columns, so that any number of subjects or models is graded at once.

A missing input is pending (null) and never counts as approval.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedra.functions.parse import is_observation

# Thresholds of the standard's tables.
UPPER_FACTOR, LOWER_FACTOR = 2.0, 0.5
VALUE_LIMIT_II, VALUE_LIMIT_I = 15.0, 20.0
ARBITRATION = 0.15
PRECISION = (30.0, 40.0, 50.0)
REGRESSORS = (0.10, 0.20, 0.30)
GLOBAL = (0.01, 0.02, 0.05)
POINTS = (16, 10, 6)
COST_POINTS = (7, 5, 3)

#: (rule, place in the standard, what it decides)
REGISTRY = [
    ("item_2", "table 1 item 2", "grade"), ("item_4", "table 1 item 4", "grade"), ("item_5", "table 1 item 5", "grade"), ("item_6", "table 1 item 6", "grade"),
    ("foundation", "table 2", "grade"), ("precision", "table 5", "grade"), ("micronumerosity", "annex A.2 a", "assumption"), ("cost_foundation", "table 7", "grade"),
    ("arbitration_field", "8.2.1.5.1", "interval"), ("admissible_interval", "annex A.10.1.1", "interval"),
]


def _steps(x: Column, limits: tuple[float, ...]) -> Column:
    """3, 2 or 1 for the first limit that x doesn't pass, else 0; null for a missing or odd x."""
    grade = F.when(~is_observation(x.cast("double")), None)
    for g, limit in zip((3, 2, 1), limits, strict=True):
        grade = grade.when(x <= limit, g)
    return grade.otherwise(0)


def item_2(n: Column, k: Column) -> Column:
    """Sample size against the number of regressors."""
    return F.when(n.isNull() | k.isNull() | (n < 0) | (k < 0), None).when(n >= 6 * (k + 1), 3).when(n >= 4 * (k + 1), 2).when(n >= 3 * (k + 1), 1).otherwise(0)


def measure_position(x: Column, low: Column, high: Column) -> Column:
    """in_sample, extended (up to half of the least and twice the greatest value) or outside."""
    odd = reduce(lambda a, b: a | b, (~is_observation(c.cast("double")) for c in (x, low, high)))
    within = (x >= F.least(low, low * LOWER_FACTOR)) & (x <= F.greatest(high, high * UPPER_FACTOR))
    return F.when(odd, None).when(x.between(low, high), "in_sample").when(within, "extended").otherwise("outside")


def item_4(positions: Column, single_deltas: Column, joint_delta: Column) -> Column:
    """Extrapolation. positions: of every variable; single_deltas: per cent that the value changes if one extended variable alone is set to its
    sample limit (null for others); joint_delta: if all are. Limits are inclusive."""
    extended = F.size(F.filter(positions, lambda p: p == "extended"))
    worst = F.array_max(single_deltas)
    known = F.size(F.filter(single_deltas, lambda d: d.isNotNull())) == extended
    return (
        F.when(F.exists(positions, lambda p: p.isNull()), None)
        .when(F.exists(positions, lambda p: p == "outside"), 0)
        .when(extended == 0, 3)
        .when(~known | joint_delta.isNull(), None)
        .when((extended == 1) & (worst <= VALUE_LIMIT_II), 2)
        .when((worst <= VALUE_LIMIT_I) & (joint_delta <= VALUE_LIMIT_I), 1)
        .otherwise(0)
    )


def item_5(p_values: Column) -> Column:
    """Worst p-value of the regressors; pending if any is missing."""
    return F.when(F.exists(p_values, lambda p: ~is_observation(p)) | (F.size(p_values) == 0), None).otherwise(_steps(F.array_max(p_values), REGRESSORS))


def item_6(p: Column) -> Column:
    return _steps(p, GLOBAL)


def foundation_points(items: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, (F.coalesce(i, F.lit(0)) for i in items))


def foundation(items: list[Column]) -> Column:
    """Grade from the six items: points and mandatory items; null while an item is pending or if no grade is reached."""
    points, least = foundation_points(items), lambda at, g: reduce(lambda a, b: a & b, (items[i - 1] >= g for i in at))
    pending = reduce(lambda a, b: a | b, (i.isNull() for i in items))
    grade = F.when(pending, None)
    for g, limit in zip((3, 2, 1), POINTS, strict=True):
        grade = grade.when((points >= limit) & least((2, 4, 5, 6), g) & least((1, 3), max(g - 1, 1)), g)
    return grade


def cost_foundation(items: list[Column]) -> Column:
    """Grade of a cost valuation from its three items."""
    points = foundation_points(items)
    pending = reduce(lambda a, b: a | b, (i.isNull() for i in items))
    a, b, c = items
    return (
        F.when(pending, None)
        .when((points >= COST_POINTS[0]) & (a >= 3) & (b >= 2) & (c >= 2), 3)
        .when((points >= COST_POINTS[1]) & (a >= 2) & (b >= 2), 2)
        .when((points >= COST_POINTS[2]) & (a >= 1) & (b >= 1) & (c >= 1), 1)
    )


def precision_status(amplitude: Column) -> Column:
    good = is_observation(amplitude) & (amplitude >= 0)
    return F.when(amplitude.isNull(), "not_computed").when(~good, "error").when(amplitude <= PRECISION[2], "classified").otherwise("unclassified")


def precision(amplitude: Column) -> Column:
    return F.when(precision_status(amplitude) == "classified", _steps(amplitude, PRECISION))


def least_per_characteristic(n: Column) -> Column:
    """Least number of rows that a characteristic needs in a sample of n; the tenth is rounded up."""
    return F.when(n.isNull() | (n < 0), None).when(n <= 30, 3).when(n <= 100, F.ceil(n * F.lit("0.10").cast("decimal(3,2)"))).otherwise(10).cast("bigint")


def micronumerosity(n: Column, k: Column, counts: Column) -> Column:
    """violated, pending or met; counts: rows of each characteristic, null if not given."""
    short = F.exists(counts, lambda c: c.isNull() | (c < least_per_characteristic(n)))
    return F.when(n.isNull() | k.isNull() | (n < 0) | (k < 0), "pending").when((n < 3 * (k + 1)) | F.coalesce(short, F.lit(False)), "violated").when(counts.isNull(), "pending").otherwise("met")


def arbitration_field(point: Column) -> Column:
    """struct(lower, upper) around a positive estimate."""
    return F.when(point > 0, F.struct((point * (1 - ARBITRATION)).alias("lower"), (point * (1 + ARBITRATION)).alias("upper")))


def admissible_interval(point: Column, low: Column, high: Column) -> Column:
    """Where a statistical interval and the arbitration field meet; lower and upper are null if they don't."""
    field = arbitration_field(point)
    a, b = F.greatest(field["lower"], low), F.least(field["upper"], high)
    meets = a <= b
    return F.when(field.isNotNull() & low.isNotNull() & high.isNotNull(), F.struct(F.when(meets, a).alias("lower"), F.when(meets, b).alias("upper"), (~meets).alias("empty")))


def documentary_item(declared: Column, verified: Column) -> Column:
    """A declared grade counts only once it is verified."""
    return F.when(F.coalesce(verified, F.lit(False)) & declared.between(0, 3), declared)


def assumption(p: Column, alpha: float = 0.10) -> Column:
    """A test's verdict on an assumption; alpha is at most a tenth."""
    return F.when(~is_observation(p), "pending").when(p <= min(alpha, 0.10), "violated").otherwise("not_rejected")


def grade_requirement(grade: Column, required: Column) -> Column:
    return F.when(required.isNull(), "not_requested").when(grade.isNull(), "pending").when(grade >= required, "met").otherwise("not_met")


def warnings(r2: Column, normality_p: Column, variance_p: Column, worst_vif: Column) -> Column:
    """Codes of statistical warnings, in order."""
    codes = [F.when(r2 < 0.5, "low_r2"), F.when(normality_p < 0.05, "residuals_not_normal"), F.when(variance_p < 0.05, "heteroscedastic"), F.when(worst_vif > 10, "collinear")]
    return F.filter(F.array(*codes), lambda c: c.isNotNull())


def registry(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(REGISTRY, "rule string, clause string, destination string")


# Kinds of qualitative axes.
QUALITATIVE = ("dichotomous", "allocated_code", "adjusted_code", "categorical")


def qualitative_membership(kind: Column, value: Column, observed: Column, scale: Column | None = None) -> Column:
    """in_sample, forbidden or pending, of a value on a qualitative axis: observed values are in the sample; between or beyond them nothing is, but a code
    of an allocated scale that the sample doesn't show waits for a review, and so does one of a scale that isn't known within the sample's ends.
    value, observed and scale are texts; codes are numbers written as text, and one that isn't lies neither between nor beyond others. No null or empty value is in the sample."""
    number, ends = value.try_cast("double"), F.transform(observed, lambda v: v.try_cast("double"))
    known = F.array_contains(scale, value) if scale is not None else F.lit(False)
    beyond = F.coalesce((number < F.array_min(ends)) | (number > F.array_max(ends)), F.lit(False))
    allocated = F.when(F.coalesce(known, F.lit(False)), "pending").when(beyond, "forbidden").otherwise("pending")
    judged = F.when(F.coalesce(F.array_contains(observed, value), F.lit(False)), "in_sample").when(kind == "allocated_code", allocated).otherwise("forbidden")
    return F.when(observed.isNull(), "pending").otherwise(judged)


def value_basis(basis: Column, method: Column, produced: dict[str, tuple[str, ...]]) -> Column:
    """ok, refused (the method doesn't produce that base of value) or unsupported (an unknown base)."""
    out = F.lit("unsupported")
    for name, methods in produced.items():
        out = F.when(basis == name, F.when(method.isin(*methods), "ok").otherwise("refused")).otherwise(out)
    return out


def effective_size(declared_n: Column, declared_k: Column, fit_n: Column, fit_k: Column) -> Column:
    """n, k, source and conflict: a fit's own counts before declared ones; nothing is guessed from a table's shape."""
    n, k = F.coalesce(fit_n, declared_n), F.coalesce(fit_k, declared_k)
    conflict = F.coalesce(fit_n != declared_n, F.lit(False)) | F.coalesce(fit_k != declared_k, F.lit(False))
    source = F.when(n.isNull() | k.isNull(), "unresolved").when(fit_n.isNotNull() & fit_k.isNotNull(), "fit").otherwise("declared")
    return F.struct(n.alias("n"), k.alias("k"), source.alias("source"), conflict.alias("conflict"))

"""Transforms of predictors and of the target, with their domains, and the way back to the original unit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedra.functions.parse import finite, is_observation

#: Predictor transforms in order; a name outside is refused, and no code is ever run.
NAMES = ("linear", "inverse", "ln", "sqr", "sqrt", "inv_sqr", "inv_sqrt")
_POSITIVE, _FROM_ZERO, _NOT_ZERO = ("ln", "inv_sqrt"), ("sqrt",), ("inverse", "inv_sqr")


def domain_failure(name: str, x: Column) -> Column:
    """Why a value can't be transformed, or null."""
    code = F.when(~is_observation(x), "nonfinite_input")
    if name not in NAMES:
        return F.lit("unknown_name")
    if name in _POSITIVE:
        code = code.when(x < 0, "domain_negative").when(x == 0, "domain_zero")
    elif name in _FROM_ZERO:
        code = code.when(x < 0, "domain_negative")
    elif name in _NOT_ZERO:
        code = code.when(x == 0, "domain_zero")
    return code.when(~is_observation(_raw(name, x)), "overflow")


def _raw(name: str, x: Column) -> Column:
    one = F.lit(1.0)
    return {
        "linear": x, "inverse": F.try_divide(one, x), "ln": F.log(x), "sqr": x * x, "sqrt": F.sqrt(x),
        "inv_sqr": F.try_divide(one, x * x), "inv_sqrt": F.try_divide(one, F.sqrt(x)),
    }[name]


def transform(name: str, x: Column) -> Column:
    """The transformed value; null outside of the domain."""
    x = x.cast("double")
    return F.when(domain_failure(name, x).isNull(), _raw(name, x))


def domains(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """Transforms that hold on every observed value of each column, in one pass. A column without values has none."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}|n"), F.bool_or(~is_observation(x) & x.isNotNull()).alias(f"{c}|odd")]
        aggs += [F.bool_and(domain_failure(t, x).isNull() | x.isNull()).alias(f"{c}|{t}") for t in NAMES]
    row = df.agg(*aggs).first() if aggs else {}
    return {c: [t for t in NAMES if row[f"{c}|n"] and not row[f"{c}|odd"] and row[f"{c}|{t}"]] for c in columns}


@dataclass(frozen=True)
class TargetState:
    """What the target's transform has learned from training rows."""

    name: str
    least: float | None
    greatest: float | None
    log_mean: float | None
    log_variance: float | None


def fit_target(df: DataFrame, target: str, name: str = "identity") -> TargetState:
    """identity or log; a log target refuses values that are not positive."""
    y = F.col(target).cast("double")
    row = df.agg(F.min(y).alias("a"), F.max(y).alias("b"), F.avg(F.log(F.when(y > 0, y))).alias("m"), F.var_pop(F.log(F.when(y > 0, y))).alias("v"), F.count_if(y <= 0).alias("bad")).first()
    if name == "log" and row["bad"]:
        raise ValueError("y_transform_domain: a log target needs positive values")
    return TargetState(name, row["a"], row["b"], row["m"], row["v"])


def inverse_target(mu: Column, estimand: str = "median", variance: float = 0.0, smearing: float = 1.0) -> Column:
    """From the log scale back: the median, the log-normal mean, or the smeared mean (the factor is the mean of exp of training residuals)."""
    factor = {"median": F.lit(0.0), "lognormal_mean": F.lit(variance / 2)}.get(estimand)
    point = F.exp(mu + factor) if factor is not None else F.exp(mu) * F.lit(smearing)
    return finite(point)


def smearing_factor(df: DataFrame, residual: Column) -> float:
    return df.agg(F.avg(F.exp(residual)).alias("s")).first()["s"]


def relative_difference(a: Column, b: Column) -> Column:
    """|a - b| / |b| in per cent; null where b is zero."""
    return F.try_divide(F.abs(a - b), F.abs(b)) * 100


def amplitude(low: Column, high: Column, point: Column) -> Column:
    return F.try_divide(F.abs(high - low), F.abs(point)) * 100


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.least(x, high), low)


# Other names of transforms.
ALIASES = {"inv": "inverse", "reciprocal": "inverse", "log": "ln", "square": "sqr", "identity": "linear", "none": "linear"}


def canonical(name: str | None) -> str:
    low = (name or "linear").strip().lower()
    return ALIASES.get(low, low)


def distinct_options(options: list[str]) -> list[str]:
    """Options without those that name an earlier one's transform again."""
    return list({canonical(o): o for o in reversed(options)}.values())[::-1]


def parse_feature(name: str) -> tuple[str, str]:
    """("ln", "area") of ln(area); ("linear", name) of a plain name."""
    head, mark, rest = name.partition("(")
    return (head, rest[:-1]) if mark and name.endswith(")") else ("linear", name)


def feature_name(base: str, transform_name: str) -> str:
    kind = canonical(transform_name)
    return base if kind in ("linear", "encoded") else f"{kind}({base})"


def recorded_transform(name: str, x: Column) -> Column:
    """A transform as saved projects may name it: any of NAMES, an alias of one, or log10; null outside of the domain."""
    if name == "log10":
        x = x.cast("double")
        return F.when(x > 0, F.log10(x))
    return transform(canonical(name), x)


def equation(columns: list[str], beta: list[float], target: str, log: bool = False, digits: int = 6) -> str:
    """The model as text; `const` is the intercept."""
    left = f"ln({target})" if log else target
    terms = [(f"{abs(b):.{digits}g}" + ("" if c == "const" else f" * {c}"), b < 0) for c, b in zip(columns, beta, strict=True)]
    return f"{left} = " + "".join(("-" if minus else "") + term if i == 0 else (" - " if minus else " + ") + term for i, (term, minus) in enumerate(terms))

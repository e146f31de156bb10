"""Batches of subjects under a frozen model: one projection, a status for every subject, and no value where the model doesn't reach."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedra.functions import parse, rules
from hedra.functions.transforms import amplitude, clamp, inverse_target
from hedra.operators.encode import Encoder, apply_encoder
from hedra.operators.ledger import first_of_each
from hedra.operators.regress import CONST, Fit, leverage, prediction


#: Of a saved project.
VERSION = 2


@dataclass
class Frozen:
    """All that scoring needs: encoder, model, the sample's range of every numeric variable, the target's transform and how it is taken back, and a declared
    domain: variable to its categories or to (least, greatest), either of which may be None."""

    encoder: Encoder
    fit: Fit
    target: str
    ranges: dict[str, tuple[float, float]]
    unit: str = ""
    reference_date: str = ""
    transform: str = "identity"
    estimand: str = "median"
    smearing: float = 1.0
    domain: dict[str, list[str] | tuple[float | None, float | None]] = field(default_factory=dict)
    scope: str = "population_model"
    subject: dict[str, str] = field(default_factory=dict)  # of a subject_specific model: what a subject must be
    level: float = 0.80  # of intervals
    locale: str = "auto"  # of subjects' texts

    def state(self) -> dict[str, object]:
        """As plain values; numbers in hexadecimal, so that nothing is lost."""
        f, hexed = self.fit, lambda x: [float(v).hex() for v in np.ravel(x)]
        fit = {"status": f.status, "columns": f.columns, "n": f.n, "intercept": f.intercept, "beta": hexed(f.beta), "inverse": hexed(f.inverse), "sse": float(f.sse).hex(), "sst": float(f.sst).hex(), "condition": float(f.condition).hex(), "spread": hexed(f.spread)}
        domain = {k: {"categories": list(v)} if isinstance(v, list) else {"range": [None if x is None else float(x).hex() for x in v]} for k, v in self.domain.items()}
        return {
            "version": VERSION, "encoder": json.loads(self.encoder.dumps()), "fit": fit, "target": self.target, "ranges": {k: hexed(v) for k, v in self.ranges.items()}, "unit": self.unit,
            "reference_date": self.reference_date, "transform": self.transform, "estimand": self.estimand, "smearing": float(self.smearing).hex(), "domain": domain, "scope": self.scope, "subject": self.subject,
            "level": float(self.level).hex(), "locale": self.locale,
        }

    def dumps(self) -> str:
        return json.dumps(self.state(), sort_keys=True, ensure_ascii=False)

    @staticmethod
    def issues(state: dict[str, object]) -> list[str]:
        """Codes of what is wrong with a saved project; none if it can be loaded."""
        wanted = ("version", "encoder", "fit", "target", "ranges", "unit", "reference_date", "transform", "estimand", "smearing", "domain", "scope", "subject", "level", "locale")
        out = [f"frozen_project_incomplete:{k}" for k in wanted if k not in state]
        out += ["frozen_schema_version"] if state.get("version") not in (None, VERSION) else []
        out += ["invalid_model_scope"] if state.get("scope") not in ("subject_specific", "population_model") else []
        return out

    @staticmethod
    def loads(text: str) -> Frozen:
        s = json.loads(text)
        if issues := Frozen.issues(s):
            raise ValueError("; ".join(issues))
        number, f = float.fromhex, s["fit"]
        array = lambda x: np.array([number(v) for v in x])
        p = len(f["columns"])
        fit = Fit(f["status"], f["columns"], f["n"], f["intercept"], array(f["beta"]), array(f["inverse"]).reshape(p, p), number(f["sse"]), number(f["sst"]), number(f["condition"]), array(f["spread"]))
        domain = {k: v["categories"] if "categories" in v else tuple(None if x is None else number(x) for x in v["range"]) for k, v in s["domain"].items()}
        ranges = {k: (number(a), number(b)) for k, (a, b) in s["ranges"].items()}
        return Frozen(Encoder(**s["encoder"]), fit, s["target"], ranges, s["unit"], s["reference_date"], s["transform"], s["estimand"], number(s["smearing"]), domain, s["scope"], s["subject"], number(s["level"]), s["locale"])

    def reuse_key(self) -> str:
        """SHA-256 of the whole identity: two projects with one key give one result."""
        return hashlib.sha256(self.dumps().encode()).hexdigest()

    def conflicts(self, target: str | None = None, unit: str | None = None) -> list[str]:
        """Warnings where a request names another target or unit than the project; the project's count."""
        return [f"policy_mismatch:{k}" for k, mine, given in (("target_col", self.target, target), ("target_unit", self.unit, unit)) if mine and given and mine != given]

    def value(self, mu: Column) -> Column:
        """From the model's scale to the target's."""
        if self.transform == "identity":
            return mu
        return inverse_target(mu, self.estimand, self.fit.sigma**2, self.smearing)

    def bound(self, mu: Column) -> Column:
        return mu if self.transform == "identity" else F.exp(mu)


def _moved(fit: Fit, values: dict[str, Column]) -> Column:
    return sum((F.lit(float(b)) * (F.lit(1.0) if c == CONST else values.get(c, F.col(c))) for c, b in zip(fit.columns, fit.beta, strict=True)), F.lit(0.0))


def extrapolation(frozen: Frozen) -> dict[str, Column]:
    """positions and item_4 of encoded subjects with `_mu`: each extended variable alone, then all of them, are set to the sample's limit."""
    beta = dict(zip(frozen.fit.columns, frozen.fit.beta, strict=True))
    names = [c for c in frozen.ranges if c in beta]
    limits = {c: tuple(F.lit(float(v)) for v in frozen.ranges[c]) for c in names}
    position = {c: rules.measure_position(F.col(c), *limits[c]) for c in names}
    step = {c: F.lit(float(beta[c])) * (clamp(F.col(c), *limits[c]) - F.col(c)) for c in names}
    point = frozen.value(F.col("_mu"))

    def change(move: Column) -> Column:
        at = frozen.value(F.col("_mu") + move)
        return F.try_divide(F.abs(point - at), F.abs(at)) * 100

    singles = F.array(*[F.when(position[c] == "extended", change(step[c])) for c in names])
    positions = F.array(*[position[c] for c in names])
    return {"positions": positions, "item_4": rules.item_4(positions, singles, change(sum(step.values(), F.lit(0.0))))}


def domain_failures(frozen: Frozen, subjects: DataFrame) -> Column:
    """Variables of the declared domain that a subject is outside of, or has no value for; of a subject_specific model also what isn't the subject's."""
    odd, columns = [], subjects.columns
    for c, limit in sorted(frozen.domain.items()):
        if isinstance(limit, list):
            inside = parse.trim(F.col(c).cast("string")).isin([str(v) for v in limit]) if c in columns else F.lit(False)
        else:
            low, high = limit
            x = parse.finite(parse.number(subjects, c, frozen.locale)) if c in columns else F.lit(None).cast("double")
            inside = x.isNotNull() & (F.lit(low is None) | (x >= F.lit(low))) & (F.lit(high is None) | (x <= F.lit(high)))
            inside = F.lit(True) if low is None and high is None else inside
        odd.append(F.when(~F.coalesce(inside, F.lit(False)), F.lit(c)))
    if frozen.scope == "subject_specific":
        for c, due in sorted(frozen.subject.items()):
            same = F.coalesce(F.col(c).cast("string") == F.lit(due), F.lit(False)) if c in columns else F.lit(False)
            odd.append(F.when(~same, F.lit(f"subject:{c}")))
    return F.filter(F.array(*odd), lambda c: c.isNotNull()) if odd else F.array().cast("array<string>")


def score_batch(subjects: DataFrame, frozen: Frozen, key: str = "subject_id", level: float | None = None) -> DataFrame:
    """Adds status (succeeded, out_of_domain, unsupported), point, intervals, amplitude, precision, item_4 and the admissible interval.

    A subject with a missing number or an unknown level has no value, never zero. A value outside of half the least and twice the greatest
    of a variable, or of the declared domain, is out of domain and has none either. Of a model of the logarithm, ends of intervals are taken back as
    they are, and the point as the project's estimand says. level: of intervals, else the project's. A text where a number is due is read under the project's locale.
    """
    level = frozen.level if level is None else level
    # the point and the leverage are computed once and used by all that follows
    out = apply_encoder(subjects.withColumn("outside_domain", domain_failures(frozen, subjects)), frozen.encoder, frozen.locale)
    out = out.withColumns({"_mu": prediction(frozen.fit), "_q": leverage(frozen.fit)}).withColumns(extrapolation(frozen))
    outside = F.exists("positions", lambda p: p == "outside") | (F.size("outside_domain") > 0)
    out = out.withColumn("status", F.when(F.size("unsupported") > 0, "unsupported").when(outside, "out_of_domain").otherwise("succeeded"))
    ok, t = F.col("status") == "succeeded", F.lit(frozen.fit.t_critical(level) * frozen.fit.sigma)
    mean, pred = t * F.sqrt("_q"), t * F.sqrt(1 + F.col("_q"))
    ends = {"mean_low": F.col("_mu") - mean, "mean_high": F.col("_mu") + mean, "pred_low": F.col("_mu") - pred, "pred_high": F.col("_mu") + pred}
    out = out.withColumns({"point": F.when(ok, frozen.value(F.col("_mu"))), **{k: F.when(ok, frozen.bound(v)) for k, v in ends.items()}}).drop("_mu", "_q")
    out = out.withColumn("amplitude_pct", amplitude(F.col("mean_low"), F.col("mean_high"), F.col("point")))
    return out.withColumns({"precision_grade": rules.precision(F.col("amplitude_pct")), "item_4": F.when(ok, F.col("item_4")), "arbitration": rules.arbitration_field(F.col("point")), "admissible": rules.admissible_interval(F.col("point"), F.col("mean_low"), F.col("mean_high"))})


def reproduced(stored: DataFrame, subjects: DataFrame, frozen: Frozen, key: str = "subject_id", level: float = 0.80) -> DataFrame:
    """key (unique), field, stored, again and whether they agree: values of stored results computed anew from a saved project, points within 1e-8 + 1e-10 of their size,
    ends of intervals within 1e-6 + 1e-8."""
    ends = ("mean_low", "mean_high", "pred_low", "pred_high")
    # a subject is a row on both sides until they have met
    numbers = lambda d, name: d.select(key, F.array(*[F.col(c).cast("double") for c in ("point", *ends)]).alias(name))
    met = numbers(stored, "a").join(numbers(score_batch(subjects, frozen, key, level), "b"), key, "left")
    names = F.array(*[F.lit(c) for c in ("point", *ends)])
    pairs = F.transform(names, lambda n, i: F.struct(n.alias("field"), F.col("a")[i].alias("stored"), F.col("b")[i].alias("again"), i.alias("i")))
    both = met.select(key, F.explode(pairs).alias("x")).select(key, "x.*")
    slack = F.when(F.col("i") == 0, 1e-8 + 1e-10 * F.abs("stored")).otherwise(1e-6 + 1e-8 * F.abs("stored"))
    agrees = F.coalesce(F.abs(F.col("stored") - F.col("again")) <= slack, F.col("stored").isNull() & F.col("again").isNull())
    return both.select(key, "field", "stored", "again", agrees.alias("agrees"))


def normalise_subjects(df: DataFrame, position: str) -> DataFrame:
    """subject_id from subject_id or id, else index and position; `missing_subject_id` marks the latter."""
    given = [F.col(c).cast("string") for c in ("subject_id", "id") if c in df.columns]
    known = F.coalesce(*given) if given else F.lit(None).cast("string")
    return df.withColumns({"subject_id": F.coalesce(known, F.concat(F.lit("index:"), F.col(position).cast("string"))), "missing_subject_id": known.isNull()})


def unique_subjects(df: DataFrame, position: str, key: str = "subject_id") -> tuple[DataFrame, DataFrame]:
    """First subject of each id, and the later ones, which fail as duplicate_subject_id."""
    marked = first_of_each(df, key, position)
    return marked.where(~F.col("repeated")).drop("repeated"), marked.where("repeated").drop("repeated").withColumn("status", F.lit("duplicate_subject_id"))


def remaining(subjects: DataFrame, earlier: DataFrame, key: str = "subject_id") -> DataFrame:
    """Subjects that an earlier run has not brought to an end."""
    ended = earlier.where(F.col("status").isin("succeeded", "unsupported", "out_of_domain", "duplicate_subject_id"))
    return subjects.join(ended.select(key).distinct(), key, "left_anti")


def batch_summary(scored: DataFrame) -> DataFrame:
    return scored.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def elasticities(subjects: DataFrame, frozen: Frozen, step: float = 1e-4) -> dict[str, Column]:
    """Elasticity of the value to each numeric variable by central differences, null where the variable or the value is zero."""
    out = {}
    for c in frozen.encoder.numeric:
        if c in frozen.fit.columns:
            h = F.abs(F.col(c)) * step
            at = lambda v, c=c: frozen.value(_moved(frozen.fit, {c: v}))
            slope = F.try_divide(at(F.col(c) + h) - at(F.col(c) - h), 2 * h)
            out[f"elasticity_{c}"] = F.try_divide(slope * F.col(c), frozen.value(prediction(frozen.fit)))
    return out


def elasticity_errors(subjects: DataFrame, frozen: Frozen, step: float = 1e-4) -> dict[str, Column]:
    """Bound of the error of each derivative at half the step: a third of its change from the whole step, and the round-off of both; null where
    the variable is zero or the values differ by less than round-off."""
    out, eps = {}, 2.0**-52
    for c in frozen.encoder.numeric:
        if c in frozen.fit.columns:
            x, whole = F.col(c), F.abs(F.col(c)) * step

            def central(h: Column, c: str = c, x: Column = x) -> tuple[Column, Column]:
                up, down = (frozen.value(_moved(frozen.fit, {c: v})) for v in (x + h, x - h))
                noise = eps * (F.abs(up) + F.abs(down))
                slope = F.when(F.abs(up - down) > noise, F.try_divide(up - down, 2 * h))
                return slope, F.try_divide(noise, 2 * h) + eps * F.abs(slope)

            (d1, e1), (d2, e2) = central(whole), central(whole / 2)
            out[f"elasticity_error_{c}"] = F.abs(d2 - d1) / 3 + e2 + (e2 + e1) / 3
    return out


def interval_width(frozen: Frozen, level: float = 0.80) -> Column:
    """Half width of the mean's interval."""
    return F.lit(frozen.fit.t_critical(level) * frozen.fit.sigma) * F.sqrt(leverage(frozen.fit))

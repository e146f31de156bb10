"""From a market table to a frozen model and graded values of any number of subjects."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedra.functions import parse, rules
from hedra.functions.transforms import fit_target, smearing_factor
from hedra.operators import ledger
from hedra.operators.encode import Encoder, apply_encoder, fit_encoder
from hedra.operators.profile import axis_ranges
from hedra.operators.regress import CONST, Fit, fit_ols, prediction
from hedra.operators.score import Frozen, score_batch

ROLES = ("target", "predictor", "identifier", "source", "date", "excluded")


@dataclass(frozen=True)
class Request:
    """What to value. numeric and categorical: predictors; None is any, an empty list is an error."""

    target: str
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    impute: str = "complete_case"
    locale: str = "auto"
    level: float = 0.80
    reference: dict[str, str] = field(default_factory=dict)
    unit: str = ""
    reference_date: str = ""
    transform: str = "identity"
    estimand: str = "median"
    domain: dict[str, list[str] | tuple[float | None, float | None]] = field(default_factory=dict)
    row_id: str | None = None  # a column that must not repeat in the sample

    def check(self, columns: list[str]) -> list[str]:
        """Issue codes; none if the request can be run over these columns."""
        wanted = [*self.numeric, *self.categorical]
        issues = ["empty_candidate_selection"] if not wanted else []
        issues += [f"requested_column_absent:{c}" for c in wanted if c not in columns]
        issues += ["target_not_found"] if self.target not in columns else []
        issues += ["candidate_is_target"] if self.target in wanted else []
        issues += ["locale_unknown"] if self.locale not in ("auto", "pt-BR", "en-US") else []
        issues += ["missing_policy_unknown"] if self.impute not in ("complete_case", "mean", "median") else []
        issues += ["target_transform_unknown"] if self.transform not in ("identity", "log") else []
        issues += ["estimand_unknown"] if self.estimand not in ("median", "lognormal_mean", "smearing") else []
        issues += ["row_id_absent"] if self.row_id and self.row_id not in columns else []
        issues += ["level_invalid"] if not 0 < self.level < 1 else []
        return issues


def resolve(name: str, names: dict[str, str]) -> str | None:
    """Internal name of an original, internal or cleaned name."""
    from hedra.operators.profile import clean_name

    return names.get(name) or next((i for i in names.values() if i in (name, clean_name(name))), None)


@dataclass
class Valuation:
    frozen: Frozen
    ledger: DataFrame
    grades: dict[str, int | None]

    def score(self, subjects: DataFrame, key: str = "subject_id") -> DataFrame:
        """Values at the request's level; texts of subjects are read under its locale."""
        return score_batch(subjects, self.frozen, key)


def prepare(df: DataFrame, request: Request, encoder: Encoder) -> DataFrame:
    """Encoded rows with reasons; target and features are numbers."""
    encoded = apply_encoder(df, encoder, request.locale)
    return ledger.training_rows(encoded, F.lit(True), request.target, encoder.features)


def value(df: DataFrame, request: Request, train=None) -> Valuation:
    """Fit on training rows and freeze. Reads the rows three times: moments, categories, and the triangle of the design."""
    if issues := request.check(df.columns):
        raise ValueError("; ".join(issues))
    # texts of numbers are read before anything looks at them
    texts = [c for c in dict.fromkeys([request.target, *request.numeric]) if dict(df.dtypes)[c] == "string"]
    rows = (df if train is None else df.where(train)).withColumns({c: parse.number(df, c, request.locale) for c in texts})
    if request.row_id and rows.groupBy(request.row_id).count().where("count > 1").limit(1).count():
        raise ValueError("duplicate_row_id")
    seen = rows.where(F.col(request.target).isNotNull())
    encoder = fit_encoder(seen, request.numeric, request.categorical, request.impute, request.reference)
    placed = prepare(rows, request, encoder)
    used, target, smearing = placed.where("used"), request.target, 1.0
    if request.transform == "log":
        fit_target(used, request.target, "log")
        used, target = used.withColumn("_log_target", F.log(F.col(request.target).cast("double"))), "_log_target"
    fit = fit_ols(used, target, encoder.features)
    if fit.status != "fitted":
        raise ValueError(fit.status)
    if request.transform == "log" and request.estimand == "smearing":
        smearing = smearing_factor(used, F.col(target) - prediction(fit))
    frozen = Frozen(encoder, fit, request.target, axis_ranges(used, [c for c in encoder.numeric]), request.unit, request.reference_date, request.transform, request.estimand, smearing, request.domain, level=request.level, locale=request.locale)
    return Valuation(frozen, placed, model_grades(df.sparkSession, fit))


def assess(scored: DataFrame, grades: dict[str, int | None], item_1: Column, item_3: Column, required: Column | None = None, required_precision: Column | None = None) -> DataFrame:
    """Adds to scored subjects the whole foundation: points, foundation_grade, what is pending (names of items), and whether required grades are met.

    grades: items 2, 5 and 6 of the model, see `model_grades`. item_1, item_3: verified grades of the documentary items (`rules.documentary_item`). Item 4 and the precision are
    each subject's own; a pending item leaves the grade pending, and a subject without a value has none."""
    items = [item_1.cast("int"), F.lit(grades["item_2"]).cast("int"), item_3.cast("int"), F.col("item_4").cast("int"), F.lit(grades["item_5"]).cast("int"), F.lit(grades["item_6"]).cast("int")]
    ok = F.col("status") == "succeeded"
    pending = F.filter(F.array(*[F.when(x.isNull(), F.lit(f"item_{i + 1}")) for i, x in enumerate(items)]), lambda c: c.isNotNull())
    out = scored.withColumns({"points": F.when(ok, rules.foundation_points(items)), "pending": F.when(ok, pending), "foundation_grade": F.when(ok, rules.foundation(items))})
    due = F.lit(None).cast("int") if required is None else required
    exact = F.lit(None).cast("int") if required_precision is None else required_precision
    return out.withColumns({"foundation_requirement": rules.grade_requirement(F.col("foundation_grade"), due), "precision_requirement": rules.grade_requirement(F.col("precision_grade"), exact)})


def model_grades(spark, fit: Fit) -> dict[str, int | None]:
    """Items 2, 5 and 6 of a model."""
    s = fit.statistics()
    slopes = [p for c, p in zip(fit.columns, fit.p_values, strict=True) if c != CONST]
    one = spark.range(1).select(rules.item_2(F.lit(fit.n), F.lit(len(slopes))).alias("item_2"), rules.item_5(F.array(*[F.lit(float(p)) for p in slopes])).alias("item_5"), rules.item_6(F.lit(float(s["f_p"]))).alias("item_6"))
    return one.first().asDict()

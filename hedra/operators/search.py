"""Search over subsets of variables and their transforms: the rows are read once, whatever the number of candidates."""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from hedra.functions import rules
from hedra.functions.transforms import clamp, domains, transform
from hedra.operators.profile import axis_ranges
from hedra.operators.regress import CONST, Fit, solve, triangles

#: Up to this many candidates a search is exact unless a budget says less.
EXACT_THRESHOLD = 200_000
BUDGET = 512


@dataclass(frozen=True)
class Unit:
    """A variable with its options; a group of indicators enters as a whole under the option `encoded`."""

    base: str
    options: tuple[str, ...]
    columns: tuple[str, ...] = ()


def count_candidates(option_counts: list[int], most: int | None = None) -> int:
    """Number of non-empty candidates of at most so many variables."""
    ways = [1]
    for c in option_counts:
        ways = [(ways[k] if k < len(ways) else 0) + (c * ways[k - 1] if k else 0) for k in range(len(ways) + 1)]
    return sum(ways[1 : len(ways) if most is None else most + 1])


def most_variables(n: int, policy: str | int | None = None) -> int | None:
    """A given cap, no cap for `all`, else as many as the sample size carries."""
    return None if policy == "all" else int(policy) if policy is not None else max(1, n // 3 - 1)


def candidate_id(chosen: dict[str, str], y: str = "identity", intercept: bool = True) -> str:
    return "|".join([*(f"{b}:{chosen[b]}" for b in sorted(chosen)), f"y:{y}", f"int:{int(intercept)}"])


def exact(units: list[Unit], most: int | None = None) -> Iterator[dict[str, str]]:
    for size in range(1, min(len(units), most or len(units)) + 1):
        for subset in itertools.combinations(units, size):
            for options in itertools.product(*(u.options for u in subset)):
                yield {u.base: o for u, o in zip(subset, options, strict=True)}


def diverse(units: list[Unit], budget: int, most: int | None = None, seed: int = 0) -> list[dict[str, str]]:
    """Within a budget: every variable alone, default options of growing subsets, remaining options alone, then drawn candidates."""
    out: dict[str, dict[str, str]] = {}

    def take(c: dict[str, str]) -> bool:
        if len(out) < budget:
            out.setdefault(candidate_id(c), c)
        return len(out) < budget

    most = min(most or len(units), len(units))
    plain = {u.base: u.options[0] for u in units}
    phases = itertools.chain(
        ({u.base: u.options[0]} for u in units),
        ({b: plain[b] for b in s} for size in range(most, 1, -1) for s in itertools.combinations(sorted(plain), size)),
        ({u.base: o} for u in units for o in u.options[1:]),
    )
    for c in itertools.islice(phases, 4 * budget):
        if not take(c):
            return list(out.values())
    rng, possible = random.Random(seed), count_candidates([len(u.options) for u in units], most)
    for _ in range(20 * budget):
        if len(out) >= min(budget, possible):
            break
        take({u.base: rng.choice(u.options) for u in rng.sample(units, rng.randint(1, most))})
    return list(out.values())


def units_of(df: DataFrame, numeric: list[str], groups: dict[str, list[str]] | None = None) -> list[Unit]:
    """Numeric variables with the transforms that all rows allow, and groups of indicator columns."""
    found = domains(df, numeric)
    return [Unit(c, tuple(found[c])) for c in numeric if found[c]] + [Unit(b, ("encoded",), tuple(c)) for b, c in (groups or {}).items()]


@dataclass
class Search:
    """records: a DataFrame of candidates with their rank (null if not admissible); audit: what the search covered; fit: the model of a candidate by
    its id; features: its design columns as (name, variable, transform); triangle: of the whole design, with its rows and names."""

    records: DataFrame
    audit: dict[str, object]
    fit: Callable[[str], Fit]
    features: Callable[[str], list[tuple[str, str, str]]]
    triangle: tuple[np.ndarray, int, list[str]]


def _columns(units: dict[str, Unit], chosen: dict[str, str]) -> list[str]:
    return [c for b in sorted(chosen) for c in (units[b].columns or [f"{b}|{chosen[b]}"])]


SCHEMA = "candidate_id string, status string, n bigint, k int, rmse double, aic double, bic double, r2 double, f_p double, worst_p double, condition double"
#: And of a search for one subject.
SUBJECT_SCHEMA = "slopes int, point double, mean_low double, mean_high double, amplitude_pct double, positions array<string>, single_deltas array<double>, joint_delta double"
LOG = "log|"


@dataclass(frozen=True)
class Policy:
    """What a candidate must reach to be framed: a grade (with verified grades of the documentary items 1 and 3), measures that must be there, and a precision."""

    level: float = 0.80
    least_grade: int | None = None
    documents: tuple[int | None, int | None] = (None, None)
    diagnostics: tuple[str, ...] = ()
    require_precision: bool = False


@dataclass(frozen=True)
class Subject:
    """A subject as every candidate sees it: each design column's value, that value with its variable set to the sample's limit, and each variable's position."""

    actual: dict[str, float | None]
    limit: dict[str, float | None]
    position: dict[str, str | None]


def place_subject(df: DataFrame, subject: DataFrame, units: list[Unit]) -> Subject:
    """From a table of one row with the units' variables (and indicators); the sample's ranges take one pass over `df`."""
    numeric = [u.base for u in units if not u.columns]
    ranges = axis_ranges(df, numeric) if numeric else {}
    ends = {c: tuple(F.lit(x).cast("double") for x in ranges[c]) for c in numeric}
    x = {c: F.col(c).try_cast("double") for c in numeric}
    picked = [F.col(c).cast("double").alias(f"{kind}:{c}") for u in units for c in u.columns for kind in "al"]
    for u in units:
        if not u.columns:
            picked += [f.alias(f"{kind}:{u.base}|{o}") for o in u.options for kind, f in (("a", transform(o, x[u.base])), ("l", transform(o, clamp(x[u.base], *ends[u.base]))))]
            picked.append(rules.measure_position(x[u.base], *ends[u.base]).alias(f"p:{u.base}"))
    row = subject.select(*picked).first().asDict()
    return Subject(*({k[2:]: v for k, v in row.items() if k[0] == kind} for kind in "alp"))


def _valued(fit: Fit, bases: dict[str, str | None], subject: Subject, level: float, log: bool) -> tuple:
    """What SUBJECT_SCHEMA names, of one model. bases: numeric variable of each design column but the constant, None for indicators."""
    slopes = len(fit.columns) - 1
    names = [c for c in fit.columns if c != CONST]
    variables = list(dict.fromkeys(b for b in bases.values() if b))
    positions = [subject.position[b] for b in variables]
    if fit.status != "fitted" or any(subject.actual[c] is None for c in names):
        return (slopes, None, None, None, None, positions, None, None)
    x = np.array([1.0 if c == CONST else subject.actual[c] for c in fit.columns])
    back = math.exp if log else float
    mu, half = float(fit.beta @ x), fit.t_critical(level) * fit.sigma * float(np.linalg.norm(fit.inverse.T @ x))
    point, low, high = back(mu), back(mu - half), back(mu + half)
    beta = dict(zip(fit.columns, fit.beta, strict=True))
    moves = {b: sum(float(beta[c]) * (subject.limit[c] - subject.actual[c]) for c in names if bases[c] == b) for b in variables}
    change = lambda move: abs(point - at) / abs(at) * 100 if (at := back(mu + move)) else None
    singles = [change(moves[b]) if subject.position[b] == "extended" else None for b in variables]
    return (slopes, point, low, high, abs(high - low) / abs(point) * 100 if point else None, positions, singles, change(sum(moves.values())))


def framed(records: DataFrame, policy: Policy) -> DataFrame:
    """Adds grade (of the foundation table, from each candidate's own items 2, 4, 5 and 6) and framing, which a candidate without a value for a required measure lacks."""
    slopes = F.col("slopes")
    documents = [F.lit(g).cast("int") for g in policy.documents]
    worst = rules.item_5(F.array("worst_p"))
    grade = rules.foundation([documents[0], rules.item_2(F.col("n"), slopes), documents[1], rules.item_4(F.col("positions"), F.col("single_deltas"), F.col("joint_delta")), worst, rules.item_6(F.col("f_p"))])
    out = records.withColumn("grade", grade)
    good = F.col("status") == "fitted"
    good = good & F.coalesce(F.col("grade") >= policy.least_grade, F.lit(False)) if policy.least_grade is not None else good
    for c in (*policy.diagnostics, *(["amplitude_pct"] if policy.require_precision else [])):
        good = good & F.col(c).isNotNull()
    return out.withColumn("framing", good)


def search_design(df: DataFrame, target: str, units: list[Unit], log: bool = False, more: list[Column] | None = None) -> DataFrame:
    """const, every option of every unit, the target and, if asked for, its logarithm (null where it has none); and more columns."""
    y = F.col(target).cast("double")
    columns = [(F.col(c).cast("double") if u.columns else transform(o, F.col(u.base))).alias(c) for u in units for o in u.options for c in (u.columns or [f"{u.base}|{o}"])]
    return df.select(F.lit(1.0).alias(CONST), *columns, y.alias(target), *([F.log(F.when(y > 0, y)).alias(LOG + target)] if log else []), *(more or []))


def _record(fit: Fit, n: int, k: int) -> tuple:
    if fit.status != "fitted":
        return (fit.status, n, k, *[None] * 6, fit.condition if math.isfinite(fit.condition) else None)
    s, p = fit.statistics(), fit.p_values[1:]
    return ("fitted", n, k, math.sqrt(fit.sse / n), s["aic"], s["bic"], s["r2"], s["f_p"], max(p), s["condition"])


def solve_groups(spark: SparkSession, parts: dict[str, tuple[np.ndarray, int]], names: list[str], target: str, specs: list[tuple[str, str, list[str], int, str]]) -> DataFrame:
    """`group` and a record (SCHEMA) of every candidate of every group (few: folds or replicates), solved in parallel tasks from the groups' triangles. specs: group, candidate_id, design columns,
    variables, and the target's kind (identity or log)."""
    shared = spark.sparkContext.broadcast(parts)  # groups times the square of the design's width

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for g, c, columns, k, kind in zip(batch.group, batch.candidate_id, batch.columns_, batch.k, batch.kind, strict=True):
                r, n = shared.value[g]
                out.append((g, c, *_record(solve(r, n, names, list(columns), target if kind == "identity" else LOG + target), n, k)))
            yield pd.DataFrame(out, columns=["group", *(f.split()[0] for f in SCHEMA.split(", "))])

    table = spark.createDataFrame(pd.DataFrame(specs, columns=["group", "candidate_id", "columns_", "k", "kind"]), "group string, candidate_id string, columns_ array<string>, k int, kind string")
    return table.repartition(min(256, len(specs) // 64 + 1)).mapInPandas(run, f"group string, {SCHEMA}")


def original_sums(design: DataFrame, group: str | None, fits: dict[str, Fit], target: str, chunk: int = 256) -> dict[tuple[str, str], tuple[float, int]]:
    """Sum of squared errors and number of rows, by group (few: folds; "" without) and model, of models of the target's logarithm on its own scale: one pass over
    complete rows of the design."""
    names, ids = [c for c in design.columns if c != group], list(fits)
    beta = np.zeros((len(names), len(ids)))
    for j, f in enumerate(fits.values()):
        beta[[names.index(c) for c in f.columns], j] = f.beta
    shared = design.sparkSession.sparkContext.broadcast(beta)  # the design's width times the candidates
    at = names.index(target)
    keyed = design.select(*names, (F.col(group).cast("string") if group else F.lit("")).alias("_group"))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, int]] = {}
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]]).astype(float)
            good, of = np.isfinite(x).all(1), np.array(batch.column("_group").to_pylist(), object)
            for g in set(of.tolist()):
                own = x[good & (of == g)]
                total, n = held.setdefault(g, (np.zeros(len(ids)), 0))
                for a in range(0, len(ids), chunk):
                    error = np.exp(np.minimum(own @ shared.value[:, a : a + chunk], 700)) - own[:, [at]]
                    total[a : a + chunk] += (error * error).sum(0)
                held[g] = total, n + len(own)
        for g, (total, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(ids)), pa.array(range(len(ids)), pa.int32()), pa.array(total), pa.array([n] * len(ids), pa.int64())], names=["g", "i", "sse", "n"])

    found = keyed.mapInArrow(local, "g string, i int, sse double, n bigint").groupBy("g", "i").agg(F.sum("sse").alias("sse"), F.sum("n").alias("n")).collect()  # a row a group and candidate
    return {(r["g"], ids[r["i"]]): (r["sse"], r["n"]) for r in found}


def original_errors(design: DataFrame, fits: dict[str, Fit], target: str) -> dict[str, float]:
    """Root mean squared errors on the target's own scale of models of its logarithm, all in one pass over complete rows of the design."""
    return {k: math.sqrt(sse / n) for (_, k), (sse, n) in original_sums(design, None, fits, target).items() if n}


def search_models(df: DataFrame, target: str, units: list[Unit], objective: str = "rmse", budget: int | None = None, mode: str = "auto", policy: str | int | None = None, seed: int = 0, targets: tuple[str, ...] = ("identity",), subject: DataFrame | None = None, frame: Policy | None = None) -> Search:
    """Rank all candidates (exact) or a diverse budget of them, by the objective (rmse, aic or bic; less is better), ties by candidate_id.

    The rows are read once for the triangle of every transform of every variable; candidates are solved from it in parallel tasks. targets may
    name `log` besides `identity`: then each candidate stands once for each, and rmse of a log model is of its values on the target's own scale,
    from one more pass over the rows. A target that isn't positive everywhere has no log models. An approximate search never claims the optimum.

    subject: a table of one row. Then each candidate's value of it, the interval, its amplitude and how far it extrapolates come from the candidate's
    own triangle in the solver's tasks, without another pass, and candidates that meet the policy `frame` rank before all others (see `rank`).
    """
    objective = {"original_rmse": "rmse"}.get(objective.lower(), objective.lower())
    if objective not in ("rmse", "aic", "bic"):
        raise ValueError(f"objective {objective} is not known")
    if not units:
        raise ValueError("empty_search_space")
    by, spark, y = {u.base: u for u in units}, df.sparkSession, F.col(target).cast("double")
    if "log" in targets and df.where(y <= 0).limit(1).count():
        targets = tuple(x for x in targets if x != "log") or ("identity",)
    design = search_design(df, target, units, "log" in targets)
    names = design.columns
    r, n = triangles(design, [], names).get((), (np.zeros((len(names), len(names))), 0))
    most = most_variables(n, policy)
    possible = count_candidates([len(u.options) for u in units], most) * len(targets)
    limit = budget or BUDGET
    is_exact = possible <= (limit if mode == "exact" else min(max(limit, 0 if budget else EXACT_THRESHOLD), EXACT_THRESHOLD)) and mode != "approximate"
    chosen = list(exact(units, most)) if is_exact else diverse(units, -(-limit // len(targets)), most, seed)
    specs = {candidate_id(c, kind): (c, kind) for kind in targets for c in chosen}
    rows = [(k, [CONST, *_columns(by, c)], len(c), kind) for k, (c, kind) in specs.items()]
    policy_of = frame or Policy()
    seen = place_subject(df, subject, units) if subject is not None else None
    base_of = {f"{u.base}|{o}": u.base for u in units if not u.columns for o in u.options}
    fields = f"{SCHEMA}, {SUBJECT_SCHEMA}" if seen else SCHEMA
    shared = spark.sparkContext.broadcast((r, n, names))  # the square of the design's width

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r, n, names = shared.value
        for batch in batches:
            out = []
            for c, columns, k, kind in zip(batch.candidate_id, batch.columns_, batch.k, batch.kind, strict=True):
                made = solve(r, n, names, list(columns), target if kind == "identity" else LOG + target)
                more = _valued(made, {x: base_of.get(x) for x in columns if x != CONST}, seen, policy_of.level, kind == "log") if seen else ()
                out.append((c, *_record(made, n, k), *more))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in fields.split(", ")])

    table = spark.createDataFrame(pd.DataFrame(rows, columns=["candidate_id", "columns_", "k", "kind"]), "candidate_id string, columns_ array<string>, k int, kind string")
    scored = table.repartition(min(64, len(rows) // 64 + 1)).mapInPandas(score, fields)

    def fit(candidate: str) -> Fit:
        c, kind = specs[candidate]
        return solve(r, n, names, [CONST, *_columns(by, c)], target if kind == "identity" else LOG + target)

    def features(candidate: str) -> list[tuple[str, str, str]]:
        c, _ = specs[candidate]
        return [(name, name if by[b].columns else b, "linear" if by[b].columns else c[b]) for b in sorted(c) for name in _columns(by, {b: c[b]})]

    if "log" in targets:
        own = {k: f for k, (_, kind) in specs.items() if kind == "log" and (f := fit(k)).status == "fitted"}
        errors = original_errors(design, own, target) if own else {}
        known = spark.createDataFrame(list(errors.items()), "candidate_id string, own_rmse double")
        scored = scored.join(F.broadcast(known), "candidate_id", "left").withColumn("rmse", F.coalesce("own_rmse", "rmse")).drop("own_rmse")  # a row a candidate
    audit = {"mode": "exact" if is_exact else "approximate", "possible": possible, "evaluated": len(rows), "exact_optimum_guaranteed": is_exact, "n": n, "targets": targets}
    return Search(rank(framed(scored, policy_of) if seen else scored, objective), audit, fit, features, (r, n, names))


def evaluate_candidate(df: DataFrame, target: str, units: list[Unit], candidate: str) -> tuple[DataFrame, Fit]:
    """The record and the model of one candidate by its id, by the same path as a search of all: one pass over its own columns. An option that a unit doesn't have is an error."""
    *parts, kind, _ = candidate.split("|")
    by, chosen = {u.base: u for u in units}, dict(p.rsplit(":", 1) for p in parts)
    if any(b not in by or o not in by[b].options for b, o in chosen.items()):
        raise ValueError("candidate_unknown")
    own = [Unit(b, (o,), by[b].columns) for b, o in sorted(chosen.items())]
    found = search_models(df, target, own, policy=len(own), targets=(kind.removeprefix("y:"),))
    return found.records.where(F.col("candidate_id") == candidate), found.fit(candidate)


def rank(records: DataFrame, objective: str = "rmse") -> DataFrame:
    """Adds rank from 1 among fitted candidates: by the objective, then by the optional columns framing (first of all), extra_score (more is better),
    amplitude_pct (less) and stability (more), then fewer variables, then the id. The table holds candidates, EXACT_THRESHOLD at most, not rows."""
    from pyspark.sql import Window

    there = lambda c, f: [f(F.col(c))] if c in records.columns else []
    order = Window.partitionBy("fitted").orderBy(
        *there("framing", lambda c: c.desc_nulls_last()), F.col(objective).asc_nulls_last(), *there("extra_score", lambda c: c.desc_nulls_last()),
        *there("amplitude_pct", lambda c: c.asc_nulls_last()), *there("stability", lambda c: c.desc_nulls_last()), F.col("k"), "candidate_id",
    )
    return records.withColumn("fitted", F.col("status") == "fitted").withColumn("rank", F.when(F.col("fitted"), F.row_number().over(order))).drop("fitted")


def rerank_shortlist(records: DataFrame, scorer: Callable[[Row], float | None], most: int = 20, objective: str = "rmse") -> DataFrame:
    """Ranks anew after a scorer of records has judged the first `most` of them, on the driver; a failed score counts as none. Others keep their order behind."""
    first = records.where(F.col("rank") <= most).orderBy("rank").collect()  # `most` rows
    scores = records.sparkSession.createDataFrame([(r["candidate_id"], s) for r in first if (s := scorer(r)) is not None], "candidate_id string, extra_score double")
    judged = records.drop("rank", "extra_score").join(F.broadcast(scores), "candidate_id", "left")
    return rank(judged, objective)


def sampled_history(records: DataFrame, total: int, most: int = 5000) -> DataFrame:
    """Every total/most-th record by rank, so many at most; fitted ones first. A report feature: counters still reflect all."""
    if total <= most:
        return records
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy(F.col("rank").asc_nulls_last(), "candidate_id")) - 1  # candidates, not rows
    # place p is taken if some i has floor(i * step) = p
    i = F.ceil(F.col("_p") * most / F.lit(total))
    return records.withColumn("_p", place).where((i < most) & (F.floor(i * F.lit(total) / most) == F.col("_p"))).drop("_p")


def candidate_dispersion(records: DataFrame, score: str = "rmse") -> DataFrame:
    """n_candidates, n_scored, mean, sd (sample; 0 for one), min and max of a score over candidates."""
    return records.agg(F.count(F.lit(1)).alias("n_candidates"), F.count(score).alias("n_scored"), F.avg(score).alias("mean"), F.when(F.count(score) > 1, F.stddev_samp(score)).when(F.count(score) == 1, 0.0).alias("sd"), F.min(score).alias("min"), F.max(score).alias("max"))


def cache_key(fingerprint: str, units: list[Unit], policies: dict[str, object], scope: str, subject: dict[str, object] | None = None) -> str:
    """SHA-256 of what decides a search's result; the subject counts only where the model is specific to it."""
    state = {"sample": fingerprint, "units": sorted((u.base, *u.options, *u.columns) for u in units), "policies": policies, "scope": scope, "subject": subject if scope == "subject_specific" else None}
    return hashlib.sha256(json.dumps(state, sort_keys=True, default=str).encode()).hexdigest()


def most_correlated(correlations: DataFrame, target: str, n: int) -> DataFrame:
    """The n variables (a report feature, so it is limited) of greatest absolute correlation with the target, ties by name."""
    return correlations.where((F.col("b") == target) & (F.col("a") != target) & F.col("r").isNotNull()).select(F.col("a").alias("variable"), "r").orderBy(F.abs("r").desc(), "variable").limit(n)


def admissible(records: DataFrame, worst_p: float = 0.30, f_p: float = 0.05) -> DataFrame:
    """Adds admissible: framed, where the search was for a subject, else fitted and within the limits of significance."""
    if "framing" in records.columns:
        return records.withColumn("admissible", F.coalesce((F.col("status") == "fitted") & F.col("framing"), F.lit(False)))
    return records.withColumn("admissible", (F.col("status") == "fitted") & F.coalesce((F.col("worst_p") <= worst_p) & (F.col("f_p") <= f_p), F.lit(False)))


def winner(records: DataFrame, alternatives: int = 5) -> DataFrame:
    """The best admissible candidate and so many after it, with their role; better ones that are not admissible are exploratory."""
    from pyspark.sql import Window

    own = admissible(records).where("rank IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("admissible").orderBy("rank"))
    placed = own.withColumn("place", place).withColumn("best", F.min(F.when(F.col("admissible"), F.col("rank"))).over(Window.partitionBy(F.lit(0))))
    role = F.when(F.col("admissible") & (F.col("place") == 1), "winner").when(F.col("admissible") & (F.col("place") <= alternatives + 1), "alternative").when(~F.col("admissible") & (F.col("rank") < F.col("best")), "exploratory")
    return placed.withColumn("role", role).where("role IS NOT NULL").drop("place", "best")


def rejections(records: DataFrame) -> DataFrame:
    return records.where("status != 'fitted'").groupBy("status").agg(F.count(F.lit(1)).alias("n"))

"""Partitions of a sample, procedure evaluation over folds, and stability under resampling and perturbation."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedra.functions import parse
from hedra.functions.transforms import NAMES as TRANSFORMS
from hedra.functions.transforms import transform
from hedra.operators import search
from hedra.operators.encode import MOST_LEVELS, Encoder, apply_encoder, feature_columns, fit_encoder
from hedra.operators.ordered import even_chunks, number_rows
from hedra.operators.profile import dispersion, metrics_together
from hedra.operators.regress import CONST, Fit, _fold, _width_first, prediction, solve, triangles


def _draw(key: Column, seed: int) -> Column:
    """A number from 0 to 1 from the key alone, so that order and partitions don't matter."""
    return F.pmod(F.xxhash64(key.cast("string"), F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)


def random_holdout(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """Adds role; about `share` of the rows are test rows, drawn by a hash of the key."""
    return df.withColumn("role", F.when(_draw(F.col(key), seed) < share, "test").otherwise("train"))


def k_folds(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """Adds fold 0 .. k-1, by a hash of the key."""
    return df.withColumn("fold", F.least(F.floor(_draw(F.col(key), seed) * k), F.lit(k - 1)).cast("int"))


def group_folds(df: DataFrame, group: str, k: int, seed: int) -> DataFrame:
    """Adds fold; all rows of a group are in one, rows without a group have none. No shuffle: the group's hash decides."""
    return k_folds(df, group, k, seed).withColumn("fold", F.when(F.col(group).isNotNull(), F.col("fold")))


def _in_drawn_order(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Adds _pos, gapless from 0, in order of a hash of the key (ties by the key): an order that neither partitions nor retries change, numbered in buckets."""
    return number_rows(df.withColumn("_h", F.xxhash64(F.col(key).cast("string"), F.lit(seed))), "_h", key, name="_pos").drop("_h")


def exact_holdout(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """Adds role: exactly the rounded (half to even) share of the rows are test rows, at least one and not all."""
    n = df.count()
    if n < 2:
        raise ValueError("an external split needs two rows")
    want = min(max(round(n * share), 1), n - 1)
    return _in_drawn_order(df, key, seed).withColumn("role", F.when(F.col("_pos") < want, "test").otherwise("train")).drop("_pos")


def exact_folds(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """Adds fold 0 .. k-1 (or as many as rows, if they are fewer); sizes are one apart, the first folds are the larger ones."""
    n = df.count()
    if n < 2:
        raise ValueError("an external split needs two rows")
    return even_chunks(_in_drawn_order(df, key, seed), "_pos", min(k, n), "fold").drop("_pos")


def exact_group_folds(df: DataFrame, group: str, k: int, seed: int, share: float | None = None) -> DataFrame:
    """Adds fold: groups are dealt in a drawn order into folds whose numbers of groups are one apart, and rows follow their group; rows without one have none. With
    `share`, fold 0 has the rounded share of the groups (at least one and not all) and fold 1 the rest."""
    groups = df.select(F.col(group).alias("_g")).where("_g IS NOT NULL").distinct()
    n = groups.count()
    if n < 2:
        raise ValueError("a split by groups needs two of them")
    placed = _in_drawn_order(groups, "_g", seed)
    if share is None:
        placed = even_chunks(placed, "_pos", min(k, n), "fold")
    else:
        placed = placed.withColumn("fold", (F.col("_pos") >= min(max(round(n * share), 1), n - 1)).cast("int"))
    return df.join(placed.drop("_pos"), F.col(group) == F.col("_g"), "left").drop("_g")


def fold_models(df: DataFrame, fold: str, target: str, features: list[str]) -> dict[str, Fit]:
    """A model for each fold from the rows of all others, in one pass: each fold's triangle is made once, and a model stacks the others' triangles."""
    names = [CONST, *features, target]
    parts = triangles(df.where(F.col(fold).isNotNull()).select(fold, F.lit(1.0).alias(CONST), *features, target), [fold], names)
    out = {}
    for (held,) in parts:
        others = [v for (f,), v in parts.items() if f != held]
        r = reduce(_fold, (r for r, _ in others), np.zeros((0, len(names))))
        out[held] = solve(_width_first(r, len(names)), sum(n for _, n in others), names, [CONST, *features], target)
    return out


def score_folds(df: DataFrame, fold: str, models: dict[str, Fit]) -> DataFrame:
    """Adds predicted and status (ok, failed): each row by the model that has not seen it."""
    predicted = F.lit(None).cast("double")
    for held, fit in models.items():
        if fit.status == "fitted":
            predicted = F.when(F.col(fold).cast("string") == held, prediction(fit)).otherwise(predicted)
    return df.withColumn("predicted", predicted).withColumn("status", F.when(F.col("predicted").isNull(), "failed").otherwise("ok"))


def normalise_predictions(reserved: DataFrame, predictions: DataFrame, key: str, position: str) -> DataFrame:
    """One row for each reserved id: key, status, value and reason.

    `predictions` has key, status (null: ok), value and `position`; of several of an id the last counts. An id without one, and a value that
    isn't a finite number, fail; what failed has no value, so that no zero stands for it. A great error is no reason to fail.
    """
    last = predictions.groupBy(key).agg(F.max_by(F.struct(F.coalesce("status", F.lit("ok")).alias("status"), F.col("value").cast("double").alias("value")), position).alias("got"))
    there, said = F.col("got").isNotNull(), F.col("got.status")
    ok = there & (said == "ok") & parse.finite(F.col("got.value")).isNotNull()
    reason = F.when(~there, "no_prediction").when(said != "ok", said).when(~F.coalesce(ok, F.lit(False)), "not_finite")
    ok = F.coalesce(ok, F.lit(False))
    return reserved.select(key).join(last, key, "left").select(key, F.when(ok, "ok").otherwise("failed").alias("status"), F.when(ok, F.col("got.value")).alias("value"), reason.alias("reason"))


def coverage(scored: DataFrame, target: str, fold: str = "fold") -> DataFrame:
    """n_reserved (observed target), n_scored and coverage of each fold; failures stay in the denominator."""
    seen = F.col(target).isNotNull()
    return scored.groupBy(fold).agg(F.count_if(seen).alias("n_reserved"), F.count_if(seen & (F.col("status") == "ok")).alias("n_scored")).withColumn("coverage", F.try_divide("n_scored", "n_reserved"))


def evaluate_procedure(df: DataFrame, fold: str, target: str, features: list[str]) -> DataFrame:
    """One row for each fold: metrics of the procedure and of the training mean on the same rows, with flags small_sample and no_better."""
    models = fold_models(df, fold, target, features)
    scored = score_folds(df.where(F.col(fold).isNotNull()), fold, models)
    sums = df.where(F.col(fold).isNotNull()).groupBy(fold).agg(F.sum(target).alias("s"), F.count(target).alias("c"))  # a row a fold
    total = sums.agg(F.sum("s").alias("sum_all"), F.sum("c").alias("n_all"))
    means = sums.join(F.broadcast(total), F.lit(True)).select(fold, F.try_divide(F.col("sum_all") - F.col("s"), F.col("n_all") - F.col("c")).alias("train_mean"), (F.col("n_all") - F.col("c")).alias("n_train"))
    placed = scored.join(F.broadcast(means), fold).where(F.col("status") == "ok")
    both = metrics_together(placed, target, {"": "predicted", "mean_": "train_mean"}, [fold]).drop("mean_rel_mae", "mean_rel_rmse")
    out = both.join(means.select(fold, "n_train"), fold)
    return out.withColumns({"small_sample": F.col("n") + F.col("n_train") < 30, "no_better": F.col("mae") >= 0.8 * F.col("mean_mae"), "thin_fold": (F.col("n_train") < 8) | (F.col("n") < 3)})


#: Draws from which a row counts once, twice, ...: of Poisson(1).
_CUTS = np.cumsum([np.exp(-1) / np.prod(np.arange(1, k + 1), dtype=float) for k in range(9)])


def _chance(key: Column, replicate: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string"), replicate, F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)


def multiplicity(key: Column, replicate: Column, seed: int) -> Column:
    """How often a row is drawn in a bootstrap replicate: Poisson(1), from hashes; replicates need no pass of their own."""
    count = lambda u: reduce(lambda a, k: F.when(u < float(_CUTS[k]), k).otherwise(a), range(len(_CUTS) - 1, -1, -1), F.lit(len(_CUTS)))
    return F.get(F.transform(F.array(_chance(key, replicate, seed)), count), 0)  # the hash is bound once, not copied to each cut


def bootstrap(df: DataFrame, key: str, target: str, features: list[str], replicates: int, seed: int, weighted: bool = True) -> dict[str, Fit]:
    """Models of bootstrap replicates, from one pass. weighted: a row counts as often as it is drawn; else once, as a subsample of distinct rows."""
    names = [CONST, *features, target]
    design = df.select(F.lit(1.0).alias(CONST), *features, target, _chances(key, replicates, seed))
    times = _times if weighted else lambda u: np.minimum(_times(u), 1)
    return {k: solve(r, n, names, [CONST, *features], target) for (k,), (r, n) in triangles(design, [], names, weights="_w", weigh=times).items()}


def _chances(key: str, replicates: int, seed: int) -> Column:
    """A number from 0 to 1 for each replicate. They become weights in the task that folds the rows: the cuts of all replicates, as expressions, make a method that the JVM won't compile."""
    return F.array(*[_chance(F.col(key), F.lit(i), seed) for i in range(replicates)]).alias("_w")


def _times(u: np.ndarray) -> np.ndarray:
    """multiplicity of those numbers."""
    return np.searchsorted(_CUTS, u, side="right").astype(float)


def bootstrap_selection(df: DataFrame, key: str, target: str, units: list[search.Unit], replicates: int, seed: int, policy: str | int | None = None, objective: str = "rmse") -> DataFrame:
    """replicate, status, candidate_id, variables and objective of the best candidate of each replicate: the whole selection is run again on each, from one
    pass over the rows. The space is searched exactly up to search.BUDGET candidates, else by as many diverse ones."""
    by, design = {u.base: u for u in units}, search.search_design(df, target, units, more=[_chances(key, replicates, seed)])
    names = [c for c in design.columns if c != "_w"]
    parts = {g: part for (g,), part in triangles(design, [], names, weights="_w", weigh=_times).items()}
    specs, held = [], []
    for g, (_, n) in parts.items():
        most = search.most_variables(n, policy)
        few = search.count_candidates([len(u.options) for u in units], most) <= search.BUDGET
        chosen = list(search.exact(units, most) if few else search.diverse(units, search.BUDGET, most, seed))
        specs += [(g, search.candidate_id(c), [CONST, *search._columns(by, c)], len(c), "identity") for c in chosen]
        held += [(search.candidate_id(c), sorted(c)) for c in chosen]
    spark = df.sparkSession
    solved = search.solve_groups(spark, parts, names, target, specs)
    good = solved.where("status = 'fitted'").groupBy("group").agg(F.min_by(F.struct("candidate_id", F.col(objective).alias("score")), F.struct(objective, "k", "candidate_id")).alias("best"))
    variables = spark.createDataFrame(list(dict(held).items()), "candidate_id string, variables array<string>")
    every = spark.createDataFrame([(g,) for g in parts], "group string")
    out = every.join(F.broadcast(good), "group", "left").select("group", "best.*").join(F.broadcast(variables), "candidate_id", "left")  # a row a replicate; a row a candidate
    return out.select(F.col("group").cast("int").alias("replicate"), F.when(F.col("candidate_id").isNull(), "failed").otherwise("ok").alias("status"), "candidate_id", "variables", "score")


@dataclass
class Predictor:
    """A procedure fitted to training rows: encoder, chosen candidate and model. predict adds `predicted` and `status` to any raw rows."""

    encoder: Encoder
    candidate: str
    fit: Fit
    features: list[tuple[str, str, str]]
    log: bool = False

    def value(self, df: DataFrame) -> Column:
        """The prediction for rows of `df`, as an expression: null with a missing number, an unknown level or a value outside of a transform's domain."""
        of, beta = feature_columns(df, self.encoder), dict(zip(self.fit.columns, self.fit.beta, strict=True))
        mu = sum((F.lit(float(beta[name])) * transform(option, of[base]) for name, base, option in self.features), F.lit(float(beta[CONST])))
        return parse.finite(F.exp(mu) if self.log else mu)

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds predicted, and status: failed where there is no value."""
        out = df.withColumn("predicted", self.value(df))
        return out.withColumn("status", F.when(F.col("predicted").isNull(), "failed").otherwise("ok"))


def fit_procedure(train: DataFrame, target: str, numeric: list[str], categorical: list[str], policy: str | int | None = None, objective: str = "rmse", targets: tuple[str, ...] = ("identity",), impute: str = "complete_case", options: tuple[str, ...] | None = None, budget: int | None = None) -> Predictor | None:
    """The whole procedure on training rows alone: encoder, transforms that their values allow (of `options`), search, and the best candidate's model. None if no candidate can be fitted."""
    seen = train.where(F.col(target).isNotNull())
    encoder = fit_encoder(seen, numeric, categorical, impute)
    encoded = apply_encoder(seen, encoder)
    units = search.units_of(encoded, list(encoder.numeric), {c: list(encoder.indicators(c).values()) for c in encoder.levels})
    if options:
        units = [search.Unit(u.base, tuple(o for o in u.options if o in options or u.columns), u.columns) for u in units]
    units = [u for u in units if u.options]
    if not units:
        return None
    found = search.search_models(encoded, target, units, objective, budget, policy=policy, targets=targets)
    best = found.records.where("rank = 1").first()
    if best is None:
        return None
    name = best["candidate_id"]
    return Predictor(encoder, name, found.fit(name), found.features(name), "|y:log|" in name)


def fold_encoders(df: DataFrame, fold: str, target: str, numeric: list[str], categorical: list[str]) -> dict[str, tuple[Encoder, dict[str, list[str]]]]:
    """For each fold (as text), the encoder and the allowed transforms that the other folds' rows with a target give: complete cases, references by frequency. Two aggregations over all rows, whatever the number
    of folds, since what a training side shows is what its folds show together."""
    seen = df.where(F.col(target).isNotNull()).withColumn("_fold", F.col(fold).cast("string"))
    x = {c: parse.finite(parse.number(df, c)) for c in numeric}
    raw = {c: parse.number(df, c) for c in numeric}
    aggs = []
    for i, c in enumerate(numeric):
        aggs += [F.count(x[c]).alias(f"n{i}"), F.min(x[c]).alias(f"a{i}"), F.max(x[c]).alias(f"b{i}"), F.bool_or(x[c].isNull() & raw[c].isNotNull()).alias(f"o{i}")]
        aggs += [F.bool_and(transform(t, x[c]).isNotNull() | x[c].isNull()).alias(f"{t}{i}") for t in TRANSFORMS]
    rows = {r["_fold"]: r for r in seen.groupBy("_fold").agg(F.count(F.lit(1)).alias("rows"), *aggs).collect()}  # a row a fold
    levels: dict[tuple[str, str], dict[str, int]] = {}
    many: set[str] = set()
    if categorical:
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), parse.category(F.col(c).cast("string")).alias("level")) for c in categorical])
        counts = seen.select("_fold", F.inline(pairs)).where("level IS NOT NULL").groupBy("_fold", "column", "level").agg(F.count(F.lit(1)).alias("n"))
        sizes = counts.groupBy("column").agg(F.count_distinct("level").alias("n"))
        many = {r["column"] for r in sizes.where(F.col("n") > MOST_LEVELS).collect()}
        for r in counts.where(~F.col("column").isin(sorted(many))).collect() if many else counts.collect():  # MOST_LEVELS a fold and column at most
            levels.setdefault((r["_fold"], r["column"]), {})[r["level"]] = r["n"]
    out = {}
    for held in rows:
        others = [r for k, r in rows.items() if k != held]
        state, options = Encoder(), {}
        for i, c in enumerate(numeric):
            own = [r for r in others if r[f"n{i}"]]
            if not own or min(r[f"a{i}"] for r in own) == max(r[f"b{i}"] for r in own):
                state.dropped[c] = "constant_column" if own else "group_no_support"
                continue
            state.numeric[c] = None
            options[c] = [] if any(r[f"o{i}"] for r in others) else [t for t in TRANSFORMS if all(r[f"{t}{i}"] is not False for r in own)]
        for c in categorical:
            total: dict[str, int] = {}
            for k in rows:
                if k != held:
                    for level, n in levels.get((k, c), {}).items():
                        total[level] = total.get(level, 0) + n
            if c in many or len(total) < 2:
                state.dropped[c] = "high_cardinality" if c in many else "constant_column" if total else "category_no_support"
                continue
            state.levels[c] = sorted(total)
            state.reference[c] = min(total, key=lambda v: (-total[v], v))
        out[held] = state, options
    return out


def fit_folds(df: DataFrame, fold: str, target: str, numeric: list[str], categorical: list[str], policy: str | int | None = None, objective: str = "rmse", targets: tuple[str, ...] = ("identity",), options: tuple[str, ...] | None = None, budget: int | None = None) -> dict[str, Predictor | None]:
    """The procedure of `fit_procedure`, of complete cases, for every fold from the other folds' rows. Folds whose training sides have the same levels and transforms share one
    pass over the rows: a triangle for each fold, of which a training side stacks all but its own. Candidates of all folds are solved together in tasks."""
    states, spark = fold_encoders(df, fold, target, numeric, categorical), df.sparkSession
    alike: dict[str, list[str]] = {}
    for held, (state, allowed) in states.items():
        alike.setdefault(f"{state.dumps()}{sorted(allowed.items())}", []).append(held)
    made: dict[str, Predictor | None] = dict.fromkeys(states)
    for group in alike.values():
        state, allowed = states[group[0]]
        units = [search.Unit(c, tuple(o for o in allowed[c] if not options or o in options)) for c in state.numeric]
        units = [u for u in units if u.options] + [search.Unit(c, ("encoded",), tuple(state.indicators(c).values())) for c in state.levels]
        if not units:
            continue
        by, y = {u.base: u for u in units}, F.col(target)
        used = df.where(y.isNotNull()).withColumn("_fold", F.col(fold).cast("string"))
        used = used.where(F.col("_fold") != group[0]) if len(group) == 1 else used  # rows of a fold that is alone may not bear its transforms
        encoded = apply_encoder(used, state)
        log = "log" in targets and not used.where(y <= 0).limit(1).count()
        kinds = [k for k in targets if k != "log" or log] or ["identity"]
        design = search.search_design(encoded, target, units, log, more=[F.col("_fold")])
        names = [c for c in design.columns if c != "_fold"]
        own = {g: v for (g,), v in triangles(design, ["_fold"], names).items()}
        parts = {}
        for held in group:
            rest = [v for g, v in own.items() if g != held]
            parts[held] = _width_first(reduce(_fold, (r for r, _ in rest), np.zeros((0, len(names)))), len(names)), sum(n for _, n in rest)
        specs, chosen = [], {}
        for held, (_, n) in parts.items():
            most = search.most_variables(n, policy)
            possible = search.count_candidates([len(u.options) for u in units], most) * len(kinds)
            every = search.exact(units, most) if possible <= min(max(budget or search.BUDGET, 0 if budget else search.EXACT_THRESHOLD), search.EXACT_THRESHOLD) else search.diverse(units, -(-(budget or search.BUDGET) // len(kinds)), most)
            for c in every:
                for kind in kinds:
                    name = search.candidate_id(c, kind)
                    chosen[name] = c, kind
                    specs.append((held, name, [CONST, *search._columns(by, c)], len(c), kind))
        solved = search.solve_groups(spark, parts, names, target, specs)
        if log:
            solved = _on_own_scale(solved, design, own, parts, names, target, by, chosen, specs)
        best = solved.where("status = 'fitted'").groupBy("group").agg(F.min_by("candidate_id", F.struct(objective, "k", "candidate_id")).alias("candidate_id"))
        for r in best.collect():  # a row a fold
            c, kind = chosen[r["candidate_id"]]
            fit = solve(*parts[r["group"]], names, [CONST, *search._columns(by, c)], target if kind == "identity" else search.LOG + target)
            features = [(x, x if by[b].columns else b, "linear" if by[b].columns else c[b]) for b in sorted(c) for x in search._columns(by, {b: c[b]})]
            made[r["group"]] = Predictor(states[r["group"]][0], r["candidate_id"], fit, features, kind == "log")
    return made


def _on_own_scale(solved: DataFrame, design: DataFrame, own: dict, parts: dict, names: list[str], target: str, by: dict[str, search.Unit], chosen: dict, specs: list) -> DataFrame:
    """rmse of models of the logarithm as of their values on the target's own scale, for all folds in one pass: errors by the row's fold, added up over the others."""
    fits = {}
    for held, name, columns, _, kind in specs:
        if kind == "log" and (f := solve(*parts[held], names, columns, search.LOG + target)).status == "fitted":
            fits[f"{held}\0{name}"] = f
    if not fits:
        return solved
    spark, sums = solved.sparkSession, search.original_sums(design, "_fold", fits, target)
    rows = []
    for k in fits:
        held, name = k.split("\0")
        sse, n = (sum(sums[g, k][i] for g in own if g != held and (g, k) in sums) for i in (0, 1))
        rows.append((held, name, float((sse / n) ** 0.5) if n else None))
    known = spark.createDataFrame(rows, "group string, candidate_id string, own_rmse double")
    return solved.join(F.broadcast(known), ["group", "candidate_id"], "left").withColumn("rmse", F.coalesce("own_rmse", "rmse")).drop("own_rmse")  # a row a fold and candidate


def evaluate_selection(df: DataFrame, fold: str, target: str, numeric: list[str], categorical: list[str], impute: str = "complete_case", **procedure) -> tuple[DataFrame, dict[str, str | None]]:
    """One row for each fold (few), from the whole procedure run again on the other folds' rows: n_reserved, n_scored, metrics of it and of the training mean on
    the same rows, and the candidate that it chose. No reserved row is read by encoder, search or fit; a level that only reserved rows have fails.

    Complete cases take a few passes over the rows for all folds together (see `fit_folds`). Filled values differ from one training side to the next, so
    that imputation runs the procedure fold by fold."""
    used = df.where(F.col(fold).isNotNull())
    sides = {r["k"]: (r["s"], r["c"]) for r in used.groupBy(F.col(fold).cast("string").alias("k")).agg(F.sum(F.col(target).cast("double")).alias("s"), F.count(target).alias("c")).collect()}  # a row a fold
    if impute == "complete_case":
        made = fit_folds(used, fold, target, numeric, categorical, **procedure)
    else:
        made = {k: fit_procedure(used.where(F.col(fold).cast("string") != k), target, numeric, categorical, impute=impute, **procedure) for k in sides}
    made |= {k: None for k in sides if k not in made}
    text, predicted, mean, n_train, chosen = F.col(fold).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("bigint"), {}
    name = F.lit(None).cast("string")
    for k, own in made.items():
        n = sum(c for j, (_, c) in sides.items() if j != k)
        chosen[k] = own and own.candidate
        here = text == F.lit(k)
        if own:
            predicted = F.when(here, own.value(used)).otherwise(predicted)
        mean = F.when(here, F.lit(sum(s or 0.0 for j, (s, _) in sides.items() if j != k) / n if n else None).cast("double")).otherwise(mean)
        n_train, name = F.when(here, F.lit(n).cast("bigint")).otherwise(n_train), F.when(here, F.lit(chosen[k]).cast("string")).otherwise(name)
    scored = used.withColumns({"predicted": predicted, "train_mean": mean, "n_train": n_train, "candidate_id": name}).withColumn("status", F.when(F.col("predicted").isNull(), "failed").otherwise("ok"))
    cover = scored.groupBy(fold).agg(F.count(target).alias("n_reserved"), F.count_if(F.col(target).isNotNull() & (F.col("status") == "ok")).alias("n_scored"), F.first("n_train").alias("n_train"), F.first("candidate_id").alias("candidate_id"))
    good = scored.where((F.col("status") == "ok") & F.col(target).isNotNull())
    both = metrics_together(good, target, {"": "predicted", "mean_": "train_mean"}, [fold]).drop("n", "mean_rel_mae", "mean_rel_rmse")
    return cover.join(both, fold, "left").withColumn("coverage", F.try_divide("n_scored", "n_reserved")), chosen


def procedure_stability(df: DataFrame, key: str, target: str, units: list[search.Unit], replicates: int, seed: int, policy: str | int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Replicates of the whole selection, how often each variable is chosen, and the dispersion of the chosen models' scores."""
    chosen = bootstrap_selection(df, key, target, units, replicates, seed, policy)
    good = chosen.where("status = 'ok'")
    return chosen, selection_frequency(good, max(good.count(), 1)), search.candidate_dispersion(good, "score")


def stability(df: DataFrame, key: str, target: str, features: list[str], replicates: int, copies: int, seed: int, removed: DataFrame | None = None, size: float = 0.01, weights: list[Column] | None = None, noise: list[dict[str, Column]] | None = None) -> tuple[DataFrame, dict[str, Fit]]:
    """Per row the dispersion of its prediction over bootstrap replicates and over perturbed copies of itself, and its change when listed rows leave the fit; and the models.

    One pass makes the triangles of the whole sample, of every replicate and of the revision, as weights beside the row; a second one is a projection: no row is shuffled but to
    mark the listed ones. weights and noise replace the draws: a weight for each replicate, and for each copy the relative move of each feature."""
    marked = df
    if removed is not None:
        gone = removed.select(F.col(key).alias("_gone")).distinct()
        marked = df.join(gone, F.col(key) == F.col("_gone"), "left")
    stays = F.when(F.col("_gone").isNull(), 1.0).otherwise(0.0) if removed is not None else F.lit(1.0)
    times = weights if weights is not None else [multiplicity(F.col(key), F.lit(i), seed) for i in range(replicates)]
    names = [CONST, *features, target]
    design = marked.select(F.lit(1.0).alias(CONST), *features, target, F.array(F.lit(1.0), stays, *[w.cast("double") for w in times]).alias("_w"))
    fits = {k: solve(r, n, names, [CONST, *features], target) for (k,), (r, n) in triangles(design, [], names, weights="_w").items()}
    base, revised = fits["0"], fits.get("1")
    own = {"base": base, "revision": revised} | {f"replicate_{i}": fits[str(i + 2)] for i in range(len(times)) if str(i + 2) in fits}
    good = [f for k, f in own.items() if k.startswith("replicate") and f.status == "fitted"]
    if noise is None:
        u = lambda copy, i, j: (F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(copy), F.lit(seed), F.lit(i), F.lit(j)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        noise = [{c: size * F.sqrt(-2 * F.log(u(copy, i, 0))) * F.cos(2 * np.pi * u(copy, i, 1)) for i, c in enumerate(features)} for copy in range(copies)]
    beta = dict(zip(base.columns, base.beta, strict=True))
    moved = [F.lit(float(beta[CONST])) + sum((F.lit(float(beta[c])) * (F.col(c) + F.abs(c) * move[c]) for c in features), F.lit(0.0)) for move in noise]

    def spread(points: list[Column], name: str) -> list[Column]:
        if not points:
            return [F.lit(None).cast("double").alias(f"{name}_{k}") for k in ("mean", "sd", "min", "max")]
        x, n = F.array(*points), len(points)
        mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n
        square = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
        return [mean.alias(f"{name}_mean"), (F.sqrt(square / (n - 1)) if n > 1 else F.lit(0.0)).alias(f"{name}_sd"), F.array_min(x).alias(f"{name}_min"), F.array_max(x).alias(f"{name}_max")]

    change = prediction(revised) - prediction(base) if revised is not None and revised.status == "fitted" else F.lit(None).cast("double")
    return df.select(key, prediction(base).alias("point"), *spread([prediction(f) for f in good], "replicates"), *spread(moved, "copies"), change.alias("revision_change")), own


def bootstrap_dispersion(df: DataFrame, key: str, models: dict[str, Fit]) -> DataFrame:
    """Mean, sd and range of each row's prediction over replicates."""
    points = F.array(*[prediction(f) for f in models.values() if f.status == "fitted"])
    return dispersion(df.select(key, F.explode(points).alias("point")), [key], "point")


def perturbation(df: DataFrame, key: str, features: list[str], fit: Fit, copies: int, seed: int, size: float = 0.01) -> DataFrame:
    """Dispersion of each row's prediction when features move by a normal share of their size; the model stays."""
    moved = df.select(key, *features, F.explode(F.array(*[F.lit(i) for i in range(copies)])).alias("copy"))
    for i, c in enumerate(features):
        u = [(F.pmod(F.xxhash64(F.col(key).cast("string"), F.col("copy"), F.lit(seed), F.lit(i), F.lit(j)), F.lit(1 << 52)) + 0.5) / float(1 << 52) for j in (0, 1)]
        noise = F.sqrt(-2 * F.log(u[0])) * F.cos(2 * np.pi * u[1])
        moved = moved.withColumn(c, F.col(c) + noise * size * F.abs(c))
    return dispersion(moved.withColumn("point", prediction(fit)), [key], "point")


def selection_frequency(selected: DataFrame, replicates: int) -> DataFrame:
    """variable, n and share of replicates whose model holds it; `selected` has replicate and variables (array)."""
    each = selected.select("replicate", F.explode("variables").alias("variable")).distinct()
    return each.groupBy("variable").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / replicates)


def revision(df: DataFrame, removed: DataFrame, key: str, target: str, features: list[str], base: Fit) -> DataFrame:
    """One row: mean and largest change of predictions when listed rows are left out of the fit."""
    from hedra.operators.regress import fit_ols

    again = fit_ols(df.join(removed.select(key).distinct(), key, "left_anti"), target, features)
    change = F.abs(prediction(again) - prediction(base))
    return df.agg(F.avg(change).alias("mean_change"), F.max(change).alias("max_change"))

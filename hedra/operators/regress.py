"""Ordinary least squares by a distributed QR: one narrow pass over the rows, whatever the number of models drawn from it.

Every partition reduces its rows to a triangle of the design's width; triangles merge in two levels of Spark tasks and only one small triangle
reaches the driver. A model over any subset of the columns is solved from that triangle, so a search or a cross-validation reads the data once.
Normal equations are never formed: they would square the condition number.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedra.operators.distributions import chi2_tail, f_tail, t_quantile, t_two_sided

#: A design whose condition number is greater is refused.
MOST_CONDITION = 1e12
CONST = "const"


def _fold(r: np.ndarray, block: np.ndarray) -> np.ndarray:
    return np.linalg.qr(np.vstack((r, block)), mode="r")


def _width_first(r: np.ndarray, width: int) -> np.ndarray:
    """A square triangle, also of fewer rows than columns."""
    return np.vstack((r, np.zeros((max(0, width - len(r)), width))))[:width]


def triangles(design: DataFrame, groups: list[str], columns: list[str], merge: int = 64, weights: str | None = None, weigh: Callable[[np.ndarray], np.ndarray] | None = None) -> dict[tuple, tuple[np.ndarray, int]]:
    """R and the number of rows of the columns, for every group (few: folds, not keys). Rows with a null or odd value in a column are left out.

    weights names an array column of one number a replicate (then there are no groups): the result has a triangle for each replicate's place, as text,
    over rows of positive weight times its root. A row is read once, whatever the number of replicates. weigh turns the column's numbers into weights, in the task."""
    width = len(columns)
    if weights:
        groups = [*groups, "_replicate"]
        design = design.withColumn("_replicate", F.lit(""))
    keyed = design.select(*([F.col(weights).cast("array<double>").alias("w")] if weights else []), *[F.col(g).cast("string").alias(f"g{i}") for i, g in enumerate(groups)], *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    names, fields = [f"g{i}" for i in range(len(groups))], [f"x{i}" for i in range(width)]
    schema = "".join(f"{n} string, " for n in names) + "r array<double>, n bigint"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[np.ndarray, int]] = {}
        for batch in batches:
            x = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in fields]).astype(float)
            good = np.isfinite(x).all(1)
            if weights:
                w = batch.column("w").flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
                for i, own in enumerate((weigh(w) if weigh else w).T):
                    use = good & (own > 0)
                    r, n = held.get((str(i),), (np.zeros((0, width)), 0))
                    held[(str(i),)] = _fold(r, x[use] * np.sqrt(own[use, None])), n + int(use.sum())
                continue
            if names:
                coded = [batch.column(n).dictionary_encode(null_encoding="encode") for n in names]
                code = np.zeros(len(x), np.int64)
                for c in coded:
                    code = code * max(len(c.dictionary), 1) + c.indices.to_numpy()
                _, first, at = np.unique(code, return_index=True, return_inverse=True)
                number = {tuple(c[int(j)].as_py() for c in coded): i for i, j in enumerate(first)}
            else:
                number, at = {(): 0}, np.zeros(len(x), np.int64)
            for k, i in number.items():
                own = x[good & (at == i)]
                r, n = held.get(k, (np.zeros((0, width)), 0))
                held[k] = _fold(r, own), n + len(own)
        rows = [(*k, _width_first(r, width).ravel().tolist(), n) for k, (r, n) in held.items()]
        yield from _table(rows)

    def _table(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        kinds = [*[pa.string()] * len(names), pa.list_(pa.float64()), pa.int64()]
        yield from pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[*names, "r", "n"]).to_batches()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[np.ndarray, int]] = {}
        for batch in batches:
            for *k, flat, n in zip(*(batch.column(c).to_pylist() for c in (*names, "r", "n")), strict=True):
                r, m = held.get(tuple(k), (np.zeros((0, width)), 0))
                held[tuple(k)] = _fold(r, np.array(flat).reshape(width, width)), m + n
        yield from _table([(*k, _width_first(r, width).ravel().tolist(), n) for k, (r, n) in held.items()])

    small = keyed.mapInArrow(local, schema)
    if small.rdd.getNumPartitions() > merge:
        small = small.coalesce(small.rdd.getNumPartitions() // merge + 1).mapInArrow(join, schema) if small.rdd.getNumPartitions() <= merge * merge else small.repartition(merge).mapInArrow(join, schema)
    held: dict[tuple, tuple[np.ndarray, int]] = {}
    for row in small.collect():  # partitions / merge rows of width * width numbers, at most `merge` for a large input
        k = tuple(row[n] for n in names)
        r, m = held.get(k, (np.zeros((0, width)), 0))
        held[k] = _fold(r, np.array(row["r"]).reshape(width, width)), m + row["n"]
    return {k: (_width_first(r, width), n) for k, (r, n) in held.items()}


@dataclass
class Fit:
    """A fitted model, or why there is none (status other than `fitted`)."""

    status: str
    columns: list[str]
    n: int
    intercept: bool
    beta: np.ndarray = field(default_factory=lambda: np.zeros(0))
    inverse: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # of R: (X'X)^-1 = inverse @ inverse.T
    sse: float = math.nan
    sst: float = math.nan
    condition: float = math.nan

    @property
    def p(self) -> int:
        return len(self.columns)

    @property
    def df(self) -> int:
        return self.n - self.p

    @property
    def sigma(self) -> float:
        return math.sqrt(self.sse / self.df)

    @property
    def errors(self) -> np.ndarray:
        return self.sigma * np.sqrt((self.inverse**2).sum(1))

    @property
    def p_values(self) -> list[float]:
        return [t_two_sided(float(t), self.df) for t in self.beta / np.where(self.errors > 0, self.errors, np.nan)]

    def statistics(self) -> dict[str, float]:
        c = int(self.intercept)
        r2 = 1 - self.sse / self.sst
        slopes = self.p - c
        f = (self.sst - self.sse) / slopes / (self.sse / self.df) if slopes and self.sse > 0 else math.nan
        llf = -self.n / 2 * (math.log(2 * math.pi) + math.log(self.sse / self.n) + 1) if self.sse > 0 else math.inf
        return {
            "n": self.n, "p": self.p, "df": self.df, "sse": self.sse, "sigma": self.sigma, "r2": r2, "adj_r2": 1 - (self.n - c) / self.df * (1 - r2),
            "f": f, "f_p": f_tail(f, slopes, self.df) if math.isfinite(f) else math.nan, "aic": -2 * llf + 2 * self.p, "bic": -2 * llf + self.p * math.log(self.n), "condition": self.condition,
        }

    def vif(self) -> dict[str, float]:
        """Variance inflation of each column against the others, about zero for the constant and about the mean for the rest."""
        diag = (self.inverse**2).sum(1)
        return {c: float(d * s) for c, d, s in zip(self.columns, diag, self.spread, strict=True)}

    spread: np.ndarray = field(default_factory=lambda: np.zeros(0))  # sums of squares of each column, about its mean if there is an intercept

    def t_critical(self, level: float = 0.80) -> float:
        return t_quantile((1 + level) / 2, self.df)


def solve(r: np.ndarray, n: int, names: list[str], columns: list[str], target: str, gates: bool = True) -> Fit:
    """A model of `columns` (CONST is the intercept) from the triangle of `names`. gates: refuse too few rows, deficient rank, ill condition."""
    pick = [names.index(c) for c in (*columns, target)]
    full = _width_first(np.linalg.qr(r[:, pick], mode="r"), len(pick))
    p, intercept = len(columns), CONST in columns
    x, y = full[:p, :p], full[:p, p]
    values = np.linalg.svd(x, compute_uv=False) if p else np.zeros(0)
    condition = float(values[0] / values[-1]) if p and values[-1] > 0 else math.inf
    if gates:
        refused = None
        if not p:
            refused = "empty_features"
        elif n <= p:
            refused = "insufficient_n"
        elif (values > values[0] * max(n, p) * np.finfo(float).eps).sum() < p:
            refused = "rank_deficient"
        elif condition > MOST_CONDITION:
            refused = "ill_conditioned"
        if refused:
            return Fit(refused, columns, n, intercept, condition=condition)
    inverse = np.linalg.solve(x, np.eye(p))
    beta = np.linalg.solve(x, y)
    if intercept:
        with_const = _width_first(np.linalg.qr(r[:, [names.index(CONST), *pick]], mode="r"), len(pick) + 1)
        about = (with_const[1:, 1:] ** 2).sum(0)
    else:
        about = (full**2).sum(0)
    spread = about[:p].copy()
    if intercept:
        spread[columns.index(CONST)] = n
    return Fit("fitted", columns, n, intercept, beta, inverse, float(full[p:, p] @ full[p:, p]), float(about[p]), condition, spread)


def fit_ols(df: DataFrame, target: str, features: list[str], intercept: bool = True, gates: bool = True) -> Fit:
    """Fit over complete rows, in one pass. A constant feature stands in for the intercept: another is not added."""
    columns = [CONST, *features] if intercept else list(features)
    design = df.select(F.lit(1.0).alias(CONST), *[c for c in features if c != CONST], target)
    names = [CONST, *[c for c in features if c != CONST], target]
    r, n = triangles(design, [], names).get((), (np.zeros((len(names), len(names))), 0))
    return solve(r, n, names, columns, target, gates)


def coefficients(spark, fit: Fit) -> DataFrame:
    rows = [(c, float(b), float(e), float(b / e) if e > 0 else None, p if math.isfinite(p) else None) for c, b, e, p in zip(fit.columns, fit.beta, fit.errors, fit.p_values, strict=True)]
    return spark.createDataFrame(rows, "term string, value double, std_error double, t double, p_value double")


def _x(c: str) -> Column:
    return F.lit(1.0) if c == CONST else F.col(c).cast("double")


def prediction(fit: Fit) -> Column:
    return sum((F.lit(float(b)) * _x(c) for c, b in zip(fit.columns, fit.beta, strict=True)), F.lit(0.0))


def leverage(fit: Fit) -> Column:
    """x (X'X)^-1 x' as a sum of squares of x's products with the columns of the inverse triangle."""
    rows = [sum((F.lit(float(v)) * _x(c) for c, v in zip(fit.columns, column, strict=True) if v), F.lit(0.0)) for column in fit.inverse.T]
    return sum((r * r for r in rows), F.lit(0.0))


def intervals(fit: Fit, level: float = 0.80) -> dict[str, Column]:
    """point, mean_low, mean_high, pred_low, pred_high."""
    point, q, t = prediction(fit), leverage(fit), fit.t_critical(level) * fit.sigma
    mean, pred = F.lit(t) * F.sqrt(q), F.lit(t) * F.sqrt(1 + q)
    return {"point": point, "mean_low": point - mean, "mean_high": point + mean, "pred_low": point - pred, "pred_high": point + pred}


def influence(df: DataFrame, fit: Fit, target: str) -> DataFrame:
    """Adds fitted, residual, standardized, leverage, studentized, cook and the flags of influence; flags never exclude a row."""
    s, p, n = fit.sigma, fit.p, fit.n
    out = df.withColumn("fitted", prediction(fit)).withColumn("leverage", leverage(fit)).withColumn("residual", F.col(target).cast("double") - F.col("fitted"))
    free = F.when(F.col("leverage") < 1, 1 - F.col("leverage"))
    out = out.withColumns({"standardized": F.try_divide(F.col("residual"), F.lit(s)), "studentized": F.try_divide(F.col("residual"), s * F.sqrt(free)), "cook": F.try_divide(F.col("residual") * F.col("residual") * F.col("leverage"), p * s * s * free * free)})
    return out.withColumns({"high_cook": (F.col("cook") > 4.0 / n) | (F.col("cook") > 1.0), "high_residual": F.abs("studentized") > 2.5, "high_leverage": F.col("leverage") > 2.0 * p / n})


def histogram(df: DataFrame, values: dict[str, Column], bins: int | None = None, rule: str = "sturges") -> DataFrame:
    """measure, bin (from 0), low, high and n of every bin of each value, empty ones too: edges from one aggregation, counts from another.

    bins: a number, else by a rule: sturges (of the number of values) or fd (of their quartiles, by a sketch), 512 at most as it is a report. The last bin holds
    its upper end. A measure of one value has one bin; without values it has none."""
    aggs = []
    for i, x in enumerate(values.values()):
        aggs += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}"), F.percentile_approx(x, [0.25, 0.75], 10_000).alias(f"q{i}")]
    row, cut = df.agg(*aggs).first(), {}
    for i, name in enumerate(values):
        n, a, b, q = (row[f"{k}{i}"] for k in "nabq")
        if not n:
            continue
        width = 2 * (q[1] - q[0]) / n ** (1 / 3)
        k = bins or (math.ceil((b - a) / width) if rule == "fd" and width > 0 else math.ceil(math.log2(n)) + 1)
        cut[name] = a, b, 1 if a == b else max(1, min(k, 512))
    place = {m: F.least(F.floor((values[m] - a) / ((b - a) / k)), F.lit(k - 1)) if b > a else F.floor(values[m] * 0) for m, (a, b, k) in cut.items()}
    spark = df.sparkSession
    edges = spark.createDataFrame([(m, i, a + i * (b - a) / k, b if i == k - 1 else a + (i + 1) * (b - a) / k) for m, (a, b, k) in cut.items() for i in range(k)], "measure string, bin bigint, low double, high double")
    if not cut:
        return edges.withColumn("n", F.lit(0).cast("bigint"))
    each = df.select(F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), p.cast("bigint").alias("bin")) for m, p in place.items()]))).where("bin IS NOT NULL")
    counts = each.groupBy("measure", "bin").agg(F.count(F.lit(1)).alias("n"))  # bins, not rows
    return edges.join(F.broadcast(counts), ["measure", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def residual_tables(df: DataFrame, fit: Fit, target: str, bins: int = 20) -> tuple[DataFrame, DataFrame]:
    """Histograms of residuals and standardised residuals, and the grid behind a plot of residuals over fitted values: fitted_bin, residual_bin, n of cells that
    have rows, `bins` a side."""
    point = prediction(fit)
    residual = F.col(target).cast("double") - point
    held = df.select(point.alias("fitted"), residual.alias("residual"), (residual / fit.sigma).alias("standardized"))
    row = held.agg(*[f(c).alias(f"{n}_{c}") for c in ("fitted", "residual") for n, f in (("a", F.min), ("b", F.max))]).first()
    at = {c: F.least(F.floor((F.col(c) - row[f"a_{c}"]) / (((row[f"b_{c}"] - row[f"a_{c}"]) / bins) or 1.0)), F.lit(bins - 1)).cast("int").alias(f"{c}_bin") for c in ("fitted", "residual")} if row["a_fitted"] is not None else {c: F.lit(None).cast("int").alias(f"{c}_bin") for c in ("fitted", "residual")}
    grid = held.where("residual IS NOT NULL").groupBy(*at.values()).agg(F.count(F.lit(1)).alias("n"))
    return histogram(held, {c: F.col(c) for c in ("residual", "standardized")}), grid


def transform_diagnostics(df: DataFrame, key: str, columns: list[str], most: int = 5000) -> DataFrame:
    """column, transform, n, w, p and skewness of every transform that all values of a column allow, before (linear) and after: Shapiro-Wilk over one sample of up to `most` rows (the test's
    limit), drawn by a hash of the key, each transform in a task of its own."""
    from hedra.functions.transforms import domains, transform

    options = domains(df, columns)
    drawn = df.orderBy(F.xxhash64(F.col(key).cast("string")), key).limit(most)  # a partial top-k in every task
    pairs = [F.struct(F.lit(c).alias("column"), F.lit(o).alias("transform"), transform(o, F.col(c)).alias("x")) for c in columns for o in options[c]]
    schema = "column string, transform string, n bigint, w double, p double, skewness double"
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)

    def test(table: pa.Table) -> pa.Table:
        x = table.column("x").to_numpy()
        x = x[np.isfinite(x)]
        w, p = shapiro_wilk(x)
        centred = x - x.mean() if len(x) else x
        spread = math.sqrt(float((centred**2).mean())) if len(x) else 0.0
        skew = float((centred**3).mean()) / spread**3 if spread else None
        known = lambda v: None if not math.isfinite(v) else v
        return pa.table([pa.array([table.column(c)[0].as_py()]) for c in ("column", "transform")] + [pa.array([len(x)], pa.int64()), *(pa.array([v], pa.float64()) for v in (known(w), known(p), skew))], names=[f.split()[0] for f in schema.split(", ")])

    return drawn.select(F.inline(F.array(*pairs))).where("x IS NOT NULL").groupBy("column", "transform").applyInArrow(test, schema)


def exact_fit(df: DataFrame, fit: Fit, target: str) -> bool:
    """No residual exceeds what rounding explains."""
    eps = np.finfo(float).eps
    gamma = fit.p * eps / (1 - fit.p * eps)
    bound = sum((F.abs(F.lit(float(b)) * _x(c)) for c, b in zip(fit.columns, fit.beta, strict=True)), F.lit(0.0)) * gamma + F.abs(F.col(target)) * eps
    return bool(df.agg(F.bool_and(F.abs(F.col(target) - prediction(fit)) <= bound).alias("e")).first()["e"])


def breusch_pagan(df: DataFrame, fit: Fit, target: str) -> tuple[float, float]:
    """n R^2 of squared residuals on the design, and its p-value."""
    squared = df.withColumn("_e2", F.pow(F.col(target) - prediction(fit), 2))
    again = fit_ols(squared, "_e2", [c for c in fit.columns if c != CONST])
    lm = again.n * (1 - again.sse / again.sst)
    return lm, chi2_tail(lm, fit.p - int(fit.intercept))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlations of all pairs, from one triangle; null where a column is constant."""
    names = [CONST, *columns]
    r, n = triangles(df.select(F.lit(1.0).alias(CONST), *columns), [], names).get((), (np.zeros((len(names), len(names))), 0))
    about = r[1:, 1:]
    size = np.sqrt((about**2).sum(0))
    scale = np.sqrt((r[:, 1:] ** 2).sum(0))
    rows = []
    for i, a in enumerate(columns):
        for j, b in enumerate(columns):
            known = n > 1 and size[i] > 1e-12 * scale[i] and size[j] > 1e-12 * scale[j]
            rows.append((a, b, float(about[:, i] @ about[:, j] / (size[i] * size[j])) if known else None))
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def collinear_pairs(df: DataFrame, columns: list[str], gap: float = 1e-10) -> DataFrame:
    return correlations(df, columns).where((F.col("a") < F.col("b")) & (F.abs("r") >= 1 - gap))


def dummy_trap(df: DataFrame, indicators: list[str]) -> bool:
    """A group of indicators that sums to one in every row cannot stand beside an intercept."""
    total = sum((F.col(c) for c in indicators), F.lit(0.0))
    row = df.agg(F.min(total).alias("a"), F.max(total).alias("b")).first()
    return row["a"] is not None and row["a"] == row["b"]


def parameter_ranks(df: DataFrame, features: list[str], tolerance: float = 1e-8) -> dict[str, int]:
    """n_effective, n_columns, and the rank of the features alone and beside an intercept, from one triangle.

    A singular value counts above `tolerance`, and where it is more than rounding: what sums over n rows leave of nothing grows with n, so among columns of length one it must exceed n units of it."""
    r, n = triangles(df.select(F.lit(1.0).alias(CONST), *features), [], [CONST, *features]).get((), (np.zeros((len(features) + 1,) * 2), 0))

    def rank(x: np.ndarray) -> int:
        if not n or not x.size:
            return 0
        size = np.sqrt((x**2).sum(0))
        own, even = (np.linalg.svd(m, compute_uv=False) for m in (x, x / np.where(size > 0, size, 1.0)))
        return int(min((own > tolerance).sum(), (even > even[0] * max(n, len(x)) * np.finfo(float).eps).sum()))

    return {"n_effective": n, "n_columns": len(features), "rank_slopes": rank(r[:, 1:]), "rank_with_intercept": rank(r)}


def disclosure(fit: Fit, durbin_watson: float | None = None) -> list[tuple[str, str, float | None]]:
    """(measure, term, value) of what a report discloses: r and R2 (and how far r squared is from R2), F and its p, p-values, VIF, Durbin-Watson."""
    s = fit.statistics()
    root = math.sqrt(max(s["r2"], 0.0))
    out = [("r", "", root), ("r2", "", s["r2"]), ("r2_gap", "", root * root - s["r2"]), ("f", "", s["f"]), ("f_p", "", s["f_p"]), ("durbin_watson", "", durbin_watson)]
    out += [("p_value", c, p) for c, p in zip(fit.columns, fit.p_values, strict=True)] + [("vif", c, v) for c, v in fit.vif().items() if c != CONST]
    return [(m, t, None if v is None or not math.isfinite(v) else float(v)) for m, t, v in out]


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """W and p of 3 to 5000 values by Royston's approximation; nan outside."""
    from hedra.operators.distributions import normal_cdf, normal_quantile

    x = np.sort(np.asarray(values, float))
    n = len(x)
    if not 3 <= n <= 5000 or x[-1] - x[0] < 1e-300:
        return math.nan, math.nan
    m = np.array([normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u, total = 1 / math.sqrt(n), float(m @ m)
    a = np.zeros(n)
    if n == 3:
        a[[0, 2]] = -math.sqrt(0.5), math.sqrt(0.5)
    else:
        last = np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, m[-1] / math.sqrt(total)], u)
        if n > 5:
            prev = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / math.sqrt(total)], u)
            rest = (total - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * prev**2)
            a[2:-2] = m[2:-2] / math.sqrt(rest)
            a[[-1, -2, 0, 1]] = last, prev, -last, -prev
        else:
            rest = (total - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a[1:-1] = m[1:-1] / math.sqrt(rest)
            a[[-1, 0]] = last, -last
    w = min(1.0, float(a @ x) ** 2 / float(((x - x.mean()) ** 2).sum()))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y = math.log(max(1 - w, 1e-300))
    if n <= 11:
        gamma = -2.273 + 0.459 * n
        if y >= gamma:
            return w, 1e-99
        y = -math.log(gamma - y)
        mu, sd = np.polyval([-0.0006714, 0.025054, -0.39978, 0.544], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        s = math.log(n)
        mu, sd = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], s), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], s))
    return w, 1 - normal_cdf((y - mu) / sd)

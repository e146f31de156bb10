"""Profiles of columns and samples: each is one aggregation over the rows."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedra.functions import parse

#: Levels from which a categorical column counts as high-cardinality, besides half of its rows.
MANY_LEVELS = 20

# Words of column names that say what a column holds, and names and units of areas and prices.
PRICE_TOKENS = {"preco", "preço", "price", "valor"}
IDENTITY_TOKENS = {"nome", "endereco", "endereço", "telefone", "fone", "celular", "email", "e-mail", "cpf", "cnpj", "rg", "contato", "informante", "id", "matricula", "matrícula", "observacao", "observação", "obs"}
NEIGHBOURHOOD = "bairro"
LOCALITIES = ("bairro", "localidade", "municipio", "cidade", "setor")
BASES = {
    "private_area": ("area_privativa", "area_privativo", "m2_privativo", "privative_area"),
    "total_area": ("area_total", "m2_total", "total_area", "area_construida"),
    "total_price": ("preco_total", "valor_total", "preco", "valor"),
    "unit_price": ("preco_m2", "valor_m2", "unit_price", "preco_unitario"),
}
AREA_UNITS = {"m2_privativo", "privative_m2", "m2_total", "total_m2"}


def medians(df: DataFrame, values: dict[str, Column], small: int = 1_000_000) -> dict[str, float | None]:
    """Exact medians of columns (null without values), of which no task holds more than about `small` distinct values, however large they are.

    A quantile sketch puts cuts around the middle of a column of more rows, counts tell between which of them it lies, and only the values there are looked at again.
    All columns share each pass over the rows; a part of one value is the answer whatever its size."""
    values = {c: parse.finite(x.cast("double")) for c, x in values.items()}
    row = df.agg(*[F.count(x).alias(f"n{i}") for i, x in enumerate(values.values())]).first()
    counts = {c: row[f"n{i}"] for i, c in enumerate(values)}
    out: dict[str, float | None] = {c: None for c, n in counts.items() if not n}
    # a place (from 0) is looked for among the values from low to high, before which `before` others stand
    open_ = {(c, k): (None, None, 0, counts[c]) for c in values if counts[c] for k in {(counts[c] - 1) // 2, counts[c] // 2}}
    found: dict[tuple[str, int], float] = {}
    part = lambda c, low, high: F.when((F.lit(True) if low is None else values[c] >= F.lit(low)) & (F.lit(True) if high is None else values[c] <= F.lit(high)), values[c])
    while open_:
        few = {k: v for k, v in open_.items() if v[3] <= small}
        many = {k: v for k, v in open_.items() if v[3] > small}
        aggs = [F.percentile(part(k[0], v[0], v[1]), F.lit((k[1] - v[2]) / max(v[3] - 1, 1))).alias(f"f{i}") for i, (k, v) in enumerate(few.items())]
        # cuts close around the place, by twice what a sketch may miss: the rows between them are a few ten-thousandths, and places of one part share its sketch and cuts
        shared: dict[tuple, list[int]] = {}
        for (c, place), v in many.items():
            shared.setdefault((c, *v), []).append(place)
        near = {p: sorted({0.0, 1.0, *(min(max((k - p[3]) / (p[4] - 1) + d, 0.0), 1.0) for k in places for d in (-2e-4, 2e-4))}) for p, places in shared.items()}
        aggs += [F.percentile_approx(part(*p[:3]), near[p], 10_000).alias(f"m{i}") for i, p in enumerate(shared)]
        row = df.agg(*aggs).first()
        found |= {k: row[f"f{i}"] for i, k in enumerate(few)}
        cuts = {p: sorted(set(row[f"m{i}"])) for i, p in enumerate(shared)}
        open_ = {}
        if cuts:
            # how many values lie below each cut, and how many are equal to it
            sums = [f(values[p[0]], F.lit(x)).alias(f"{n}{i}_{j}") for i, (p, own) in enumerate(cuts.items()) for j, x in enumerate(own) for n, f in (("b", lambda c, x: F.count_if(c < x)), ("e", lambda c, x: F.count_if(c == x)))]
            row = df.agg(*sums).first()
            for i, (p, own) in enumerate(cuts.items()):
                below, equal = ([row[f"{n}{i}_{j}"] for j in range(len(own))] for n in ("b", "e"))
                for place in shared[p]:
                    j = max(j for j in range(len(own)) if below[j] <= place)
                    if place < below[j] + equal[j]:
                        found[p[0], place] = own[j]
                    else:  # strictly between two cuts
                        low, high = float(np.nextafter(own[j], np.inf)), float(np.nextafter(own[j + 1], -np.inf))
                        open_[p[0], place] = (low, high, below[j] + equal[j], below[j + 1] - below[j] - equal[j])
    return out | {c: (found[c, (n - 1) // 2] + found[c, n // 2]) / 2 for c, n in counts.items() if n}


def train_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, n_missing, mean, median, variance (population) and whether it is constant, of numeric columns; NaN and infinities are missing."""
    aggs, middle = [], medians(df, {c: F.col(c) for c in columns})
    for c in columns:
        x = parse.finite(F.col(c).cast("double"))
        aggs.append(F.struct(F.lit(c).alias("column"), F.count(x).alias("n"), F.count_if(x.isNull()).alias("n_missing"), F.avg(x).alias("mean"), F.lit(middle[c]).cast("double").alias("median"), F.var_pop(x).alias("variance"), (F.coalesce(F.min(x) == F.max(x), F.lit(True))).alias("constant")).alias(c))
    return df.agg(F.array(*aggs).alias("x")).select(F.inline("x"))


def category_support(df: DataFrame, columns: list[str], groups: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """column, level, n: trimmed levels after a grouping map; missing marks are no level. All columns in one shuffle."""
    pairs = []
    for c in columns:
        level = parse.category(F.col(c).cast("string"))
        if mapping := (groups or {}).get(c):
            level = F.coalesce(F.create_map(*[F.lit(x) for p in mapping.items() for x in p])[level], level)
        pairs.append(F.struct(F.lit(c).alias("column"), level.alias("level")))
    return df.select(F.inline(F.array(*pairs))).where("level IS NOT NULL").groupBy("column", "level").agg(F.count(F.lit(1)).alias("n"))


def reference_levels(support: DataFrame, requested: dict[str, str] | None = None) -> DataFrame:
    """column and reference: the requested level if it was seen, else the most frequent, ties in alphabetical order; n_levels, high_cardinality."""
    wanted = F.lit(False)
    for c, level in (requested or {}).items():
        wanted = wanted | ((F.col("column") == c) & (F.col("level") == level))
    best = F.min_by("level", F.struct((~wanted).alias("w"), (-F.col("n")).alias("n"), "level")).alias("reference")
    out = support.groupBy("column").agg(best, F.count(F.lit(1)).alias("n_levels"), F.sum("n").alias("n_rows"))
    return out.withColumn("high_cardinality", (F.col("n_levels") >= MANY_LEVELS) | (F.col("n_levels") > F.col("n_rows") / 2))


def looks_non_quantitative(df: DataFrame, columns: list[str]) -> DataFrame:
    """column and flags of text columns: any leading zero, or all values postcodes, dates or phone numbers."""
    x = [F.trim(F.col(c).cast("string")) for c in columns]
    df = df.select(*[F.when(~parse.is_missing(v), v).alias(f"x{i}") for i, v in enumerate(x)])
    aggs = []
    for i, c in enumerate(columns):
        known = F.col(f"x{i}")
        # lengths, which a match must have (line ends after it included), are compared before patterns
        sized = lambda low, high, f: F.when(known.isNotNull(), F.length(known).between(low, high) & f)
        alike = (sized(8, 11, known.rlike(parse.POSTCODE)), sized(10, 21, parse.is_date_shaped(known)), sized(9, 1 << 30, parse.is_phone(known)))
        flags = [F.coalesce(F.bool_or((known >= "00") & (known < "0:")), F.lit(False)), *(F.coalesce(F.bool_and(f), F.lit(False)) for f in alike)]
        aggs.append(F.struct(F.lit(c).alias("column"), *[f.alias(n) for f, n in zip(flags, ("leading_zero", "postcode", "date", "phone"), strict=True)]).alias(c))
    out = df.agg(F.array(*aggs).alias("x")).select(F.inline("x"))
    return out.withColumn("non_quantitative", F.col("leading_zero") | F.col("postcode") | F.col("date") | F.col("phone"))


def _tokens(name: str) -> set[str]:
    """Words of a cleaned name, with their accents and without."""
    words = set(re.split(r"[\W_]+", clean_name(name)))
    return words | {"".join(ch for ch in unicodedata.normalize("NFD", w) if not unicodedata.combining(ch)) for w in words}


def suggest_roles(df: DataFrame, columns: list[str], target: str | None = None) -> DataFrame:
    """column, numeric_share, mean_words and a first guess of the role, from one pass: target, identifier, date or predictor.

    A text column identifies where its name says so, or where under half of what is present looks like a number and there are two words a value
    on average. Without a declared target the first column named like a price is it.
    """
    kinds, aggs = dict(df.dtypes), []
    for c in columns:
        x = F.col(c).cast("string")
        number = F.replace(F.replace(F.replace(x, F.lit("R$"), F.lit("")), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
        words = F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))
        aggs.append(F.struct(F.lit(c).alias("column"), F.avg(F.trim(number).try_cast("double").isNotNull().cast("int")).alias("like"), F.avg(F.when(x.isNotNull(), words)).alias("mean_words"), F.count(x).alias("n"), F.count("*").alias("rows")).alias(c))
    seen = df.agg(F.array(*aggs).alias("x")).select(F.inline("x"))
    # nulls don't look like numbers, and are not counted
    seen = seen.withColumn("numeric_share", F.try_divide(F.col("like") * F.col("rows"), F.col("n")))
    priced = target or next((c for c in columns if PRICE_TOKENS & _tokens(c) and NEIGHBOURHOOD not in _tokens(c)), None)
    text = F.col("column").isin([c for c in columns if kinds[c] == "string"])
    named = F.col("column").isin([c for c in columns if "id" == c.lower() or kinds[c] == "string" and IDENTITY_TOKENS & _tokens(c)])
    wordy = text & F.coalesce((F.col("numeric_share") < 0.5) & (F.col("mean_words") >= 2), F.lit(False))
    role = F.when(F.col("column").eqNullSafe(priced), "target").when(F.col("column").isin([c for c in columns if NEIGHBOURHOOD in _tokens(c)]), "predictor")
    role = role.when(named | wordy, "identifier").when(F.col("column").isin([c for c in columns if kinds[c] in ("date", "timestamp", "timestamp_ntz")]), "date").otherwise("predictor")
    return seen.select("column", "numeric_share", "mean_words", role.alias("role"))


def ambiguous_bases(columns: list[str], units: dict[str, str] | None = None, target_unit: str | None = None) -> list[tuple[str, list[str]]]:
    """(code, columns) of what a table leaves open: private and total areas where no unit says which counts, unit and total prices without a target's unit."""
    known = {"".join(ch for ch in c.lower() if ch.isalnum() or ch == "_"): c for c in columns}
    there = {basis: [known[h] for h in hints if h in known] for basis, hints in BASES.items()}
    said = {u.lower() for u in (units or {}).values()} & AREA_UNITS
    out = []
    if there["private_area"] and there["total_area"] and not said:
        out.append(("ambiguous_area_basis", there["private_area"] + there["total_area"]))
    if there["unit_price"] and there["total_price"] and not target_unit:
        out.append(("ambiguous_price_basis", there["unit_price"] + there["total_price"]))
    return out


def infer_kinds(df: DataFrame, columns: list[str], locale: str = "auto") -> DataFrame:
    """column, n_present, n_parsed and kind: numeric if more than half of what is present parses."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("string")
        here = ~parse.is_missing(x)
        aggs.append(F.struct(F.lit(c).alias("column"), F.count_if(here).alias("n_present"), F.count_if(here & (parse.parse_number(x, locale)["status"] == "parsed")).alias("n_parsed")).alias(c))
    out = df.agg(F.array(*aggs).alias("x")).select(F.inline("x"))
    return out.withColumn("kind", F.when(F.col("n_parsed") * 2 > F.col("n_present"), "numeric").otherwise("categorical"))


def duplicate_identifiers(df: DataFrame, column: str) -> DataFrame:
    """identifier, n of values that several rows share; missing marks are none."""
    x = parse.trim(F.col(column).cast("string"))
    return df.select(x.alias("identifier")).where(~parse.is_missing(F.col("identifier"))).groupBy("identifier").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def observation_kinds(df: DataFrame, column: str) -> DataFrame:
    """n_offer, n_transaction, n_unknown, mixed."""
    kind = parse.observation_kind(F.col(column))
    out = df.agg(F.count_if(kind == "offer").alias("n_offer"), F.count_if(kind == "transaction").alias("n_transaction"), F.count_if(kind.isNull()).alias("n_unknown"))
    return out.withColumn("mixed", (F.col("n_offer") > 0) & (F.col("n_transaction") > 0))


def identities(df: DataFrame, key: str, kind: str | None = None, reference_date: str | None = None) -> DataFrame:
    """key, locality (of the first column so named; null where missing), reference_date, observation_kind and stage of every row."""
    place = next((c for c in df.columns if "".join(ch for ch in c.lower() if ch.isalnum() or ch == "_") in LOCALITIES), None)
    locality = F.lit(None).cast("string") if place is None else F.when(~parse.is_missing(F.col(place).cast("string")), F.col(place).cast("string"))
    said = F.lit(None).cast("string") if kind is None else parse.observation_kind(F.col(kind).cast("string"))
    return df.select(key, locality.alias("locality"), F.lit(reference_date).cast("string").alias("reference_date"), said.alias("observation_kind"), F.lit("interpreted").alias("stage"))


def market_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, min, mean, median, max."""
    aggs, middle = [], medians(df, {c: F.col(c) for c in columns})
    for c in columns:
        x = parse.finite(F.col(c).cast("double"))
        aggs.append(F.struct(F.lit(c).alias("column"), F.count(x).alias("n"), F.min(x).alias("min"), F.avg(x).alias("mean"), F.lit(middle[c]).cast("double").alias("median"), F.max(x).alias("max")).alias(c))
    return df.agg(F.array(*aggs).alias("x")).select(F.inline("x"))


def axis_ranges(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(*[f(parse.finite(F.col(c).cast("double"))).alias(f"{c}|{n}") for c in columns for n, f in (("a", F.min), ("b", F.max))]).first()
    return {c: (row[f"{c}|a"], row[f"{c}|b"]) for c in columns}


def category_axes(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, level and n of categorical axes: every level of the sample with its rows."""
    return category_support(df, columns)


def column_summary(df: DataFrame, columns: list[str], many: int = 50, least: tuple[int, ...] = (15, 20, 30)) -> DataFrame:
    """column, n_rows, n_missing, n_distinct, identification (every present value its own), and warnings: high_cardinality of a text column with more than
    `many` levels, and small_sample_<k> for each number of rows not reached. One aggregation over the rows; distinct values are counted in a shuffle."""
    texts = {c for c, kind in df.dtypes if kind == "string"}
    present = {c: F.when(~parse.is_missing(F.col(c)), F.trim(c)) if c in texts else F.col(c) for c in columns}
    each = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), x.cast("string").alias("value")) for c, x in present.items()])))
    counts = each.groupBy("column", "value").agg(F.count(F.lit(1)).alias("k"))
    out = counts.groupBy("column").agg(F.sum("k").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("k"))), F.lit(0)).alias("n_missing"), F.count("value").alias("n_distinct"))
    out = out.withColumn("identification", (F.col("n_distinct") > 1) & (F.col("n_distinct") == F.col("n_rows") - F.col("n_missing")))
    notes = [F.when(F.col("column").isin(*sorted(texts)) & (F.col("n_distinct") > many), "high_cardinality"), *(F.when(F.col("n_rows") < k, f"small_sample_{k}") for k in least)]
    return out.withColumn("warnings", F.filter(F.array(*notes), lambda x: x.isNotNull()))


# Roles whose columns are never taken for quantities.
NON_QUANTITATIVE_ROLES = ("identifier", "source", "date", "excluded")


def columns_to_convert(flags: dict[str, bool], roles: dict[str, str], target: str | None = None, row_id: str = "row_id") -> dict[str, bool]:
    """Whether each column is parsed as a number: never the row's id or a role that isn't a quantity, always the target, else what doesn't look like a code.
    flags: looks_non_quantitative of each column."""
    return {c: c != row_id and roles.get(c) not in NON_QUANTITATIVE_ROLES and (c == target or roles.get(c) == "target" or not odd) for c, odd in flags.items()}


def normal_frequencies(df: DataFrame, z: Column) -> DataFrame:
    """limit, observed share of |z| within it, and the normal probability."""
    limits = {1.0: 0.6826894921370859, 1.64: 0.8989948330517925, 1.96: 0.9500042097035592}
    shares = [F.struct(F.lit(k).alias("limit"), F.avg(F.when(z.isNotNull(), (F.abs(z) <= k).cast("double"))).alias("observed"), F.lit(p).alias("normal")).alias(str(i)) for i, (k, p) in enumerate(limits.items())]
    return df.agg(F.array(*shares).alias("x")).select(F.inline("x"))


def _floored(df: DataFrame, actual: str, by: list[str]) -> tuple[DataFrame, Column]:
    """The rows and the size under which an actual value is near zero: a millionth of the median size of its group, or 1e-12."""
    size = F.abs(F.col(actual))
    groups = [r.asDict() for r in df.groupBy(*by).agg(F.count(size).alias("_n")).collect()]  # a row a fold
    if all(g.pop("_n") <= 1_000_000 for g in [dict(g) for g in groups]):
        floors = df.groupBy(*by).agg(F.greatest(F.lit(1e-12), 1e-6 * F.median(size)).alias("_floor"))
        return (df.join(F.broadcast(floors), by) if by else df.join(F.broadcast(floors), F.lit(True))), F.col("_floor")  # a row a fold
    within = [reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.lit(g[c])) for c in by), F.lit(True)) for g in groups]
    middle = medians(df, {str(i): F.when(here, size) for i, here in enumerate(within)})
    floor = F.lit(None).cast("double")
    for i, here in enumerate(within):
        floor = F.when(here, F.lit(max(1e-12, 1e-6 * (middle[str(i)] or 0.0)))).otherwise(floor)
    return df, floor


def metrics_together(df: DataFrame, actual: str, predicted: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """n, and mae, rmse, rel_mae and rel_rmse with a prefix for each of several predictions of the same rows, in one aggregation; see `metrics`."""
    df, floor = _floored(df, actual, by or [])
    aggs = [F.count(F.col(actual)).alias("n")]
    for prefix, c in predicted.items():
        e, size = F.col(c) - F.col(actual), F.abs(F.col(actual))
        rel = F.when(size >= floor, e / size)
        aggs += [F.avg(F.abs(e)).alias(f"{prefix}mae"), F.sqrt(F.avg(e * e)).alias(f"{prefix}rmse"), F.avg(F.abs(rel)).alias(f"{prefix}rel_mae"), F.sqrt(F.avg(rel * rel)).alias(f"{prefix}rel_rmse")]
    return df.groupBy(*(by or [])).agg(*aggs)


def metrics(df: DataFrame, actual: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """n, mae, rmse, rel_mae, rel_rmse; relative errors leave out actual values near zero (a millionth of the median size, or 1e-12). `by` are few groups: folds, not keys."""
    by = by or []
    df, floor = _floored(df, actual, by)
    e, size = F.col(predicted) - F.col(actual), F.abs(F.col(actual))
    rel = F.when(size >= floor, e / size)
    return df.groupBy(*by).agg(F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(rel)).alias("rel_mae"), F.sqrt(F.avg(rel * rel)).alias("rel_rmse"))


def fold_statistics(folds: DataFrame, value: str) -> DataFrame:
    """mean, sd (sample; 0 for one fold), min, max, n_folds."""
    return folds.agg(F.avg(value).alias("mean"), F.when(F.count(value) > 1, F.stddev_samp(value)).otherwise(F.lit(0.0)).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n_folds"))


def dispersion(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """n, mean, sd, min, max of a row's values over replicates."""
    return df.groupBy(*key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.when(F.count(value) > 1, F.stddev_samp(value)).otherwise(F.lit(0.0)).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"))


def sample_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """n_rows and an order-free hash of the rows."""
    h = F.xxhash64(*columns)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor(h).alias("xor_hash"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("sum_hash"))


def numeric_fingerprint(df: DataFrame, key: str, columns: list[str], edge: int = 5) -> DataFrame:
    """column, n, sum, mean, sd, and head and tail: the values of the first and the last `edge` rows by key (ties by value), from one aggregation and two
    partial top-k of few rows; whatever the order and the partitions of the rows."""
    x = {c: parse.finite(F.col(c).cast("double")) for c in columns}
    sums = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.count(v).alias("n"), F.sum(v).alias("sum"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd")) for c, v in x.items()]).alias("x")).select(F.inline("x"))

    def ends(up: bool, name: str) -> DataFrame:
        own = df.select(key, *[v.alias(c) for c, v in x.items()])
        few = own.orderBy(*[F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c in (key, *columns)]).limit(edge)  # `edge` rows
        rows = few.agg(F.array_sort(F.collect_list(F.struct(key, *columns))).alias("rows"))
        return rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"rows.{c}").alias(name)) for c in columns])))

    return sums.join(F.broadcast(ends(True, "head")), "column").join(F.broadcast(ends(False, "tail")), "column")  # a row a column


def canonical_state(df: DataFrame, encoder: str = "", roles: dict[str, str] | None = None) -> str:
    """Schema, encoder and roles as one text, the same for the same state."""
    return json.dumps({"schema": [(f.name, f.dataType.simpleString()) for f in df.schema], "encoder": json.loads(encoder) if encoder else None, "roles": roles or {}}, sort_keys=True, ensure_ascii=False)


def dataset_hash(df: DataFrame, key: str, state: str = "") -> DataFrame:
    """SHA-256 of a state (see `canonical_state`) over row keys in two levels: 4096 groups by the first digits of the keys' digests, then the groups' sums. No group holds more than its share of
    distinct keys; the order of rows and columns' partitions don't matter, and any other key, repetition or state gives another hash."""
    leaves = df.select(F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("\0")), 256).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    part = F.conv(F.substring("h", 4, 13), 16, 10).cast("decimal(38,0)") * F.col("n")
    groups = leaves.groupBy(F.substring("h", 1, 3).alias("g")).agg(F.sum(part).alias("s"), F.sum("n").alias("n"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "s", "n"))), lambda x: F.concat_ws(":", x["g"], x["s"].cast("string"), x["n"].cast("string"))), ",")
    return groups.agg(F.sha2(F.concat(F.lit(state), F.lit("|"), line), 256).alias("sha256"))


def preview(df: DataFrame, columns: list[str], levels: int = 200) -> DataFrame:
    """column, sorted first `levels` distinct values, n_levels: the profile shown before a fit (a report feature, so it is limited)."""
    out = []
    for c in columns:
        each = df.select(F.col(c).cast("string").alias("value")).where("value IS NOT NULL").distinct()
        # every task keeps its own first levels only
        shown = each.orderBy("value").limit(levels).agg(F.array_sort(F.collect_list("value")).alias("levels"))
        number = each.agg(F.count(F.lit(1)).alias("n_levels")).where("n_levels > 0")
        out.append(shown.crossJoin(number).select(F.lit(c).alias("column"), "levels", "n_levels"))
    return reduce(DataFrame.unionByName, out)


def clean_name(name: str) -> str:
    """Letters, digits, underscores and spaces only, in lower case, blanks as underscores."""
    return re.sub(r"[^\w\s]", "", str(name)).lower().strip().replace(" ", "_")


def internal_names(names: list[str], reserved: tuple[str, ...] = ("row_id",)) -> list[str]:
    """Internal names in order; clashes get __2, __3; an empty name is col_ and its place."""
    taken, out = set(reserved), []
    for i, name in enumerate(names):
        base = clean_name(name) or f"col_{i}"
        own, k = base, 2
        while own in taken:
            own, k = f"{base}__{k}", k + 1
        taken.add(own)
        out.append(own)
    return out


def column_map(names: list[str], reserved: tuple[str, ...] = ("row_id",)) -> dict[str, str]:
    """Original to internal names; of repeated original names the first counts."""
    out: dict[str, str] = {}
    for name, own in zip(names, internal_names(names, reserved), strict=True):
        out.setdefault(name, own)
    return out

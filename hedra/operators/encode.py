"""Feature encoding: a state learned from training rows only, and its application to any rows as plain expressions."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedra.functions import parse
from hedra.operators.profile import category_support, reference_levels, train_moments

#: Levels up to which indicators are written as expressions; a column with more is refused as high-cardinality.
MOST_LEVELS = 1000


@dataclass
class Encoder:
    """numeric: fill value or null for complete cases; categorical: sorted levels and the reference, which has no indicator."""

    numeric: dict[str, float | None] = field(default_factory=dict)
    levels: dict[str, list[str]] = field(default_factory=dict)
    reference: dict[str, str] = field(default_factory=dict)
    groups: dict[str, dict[str, str]] = field(default_factory=dict)
    dropped: dict[str, str] = field(default_factory=dict)  # column: why it has no feature

    def dumps(self) -> str:
        return json.dumps(asdict(self), sort_keys=True, ensure_ascii=False)

    @staticmethod
    def loads(text: str) -> Encoder:
        return Encoder(**json.loads(text))

    def indicators(self, column: str) -> dict[str, str]:
        return {v: indicator_name(column, v) for v in self.levels[column] if v != self.reference[column]}

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *(n for c in self.levels for n in self.indicators(c).values())]

    def lineage(self) -> list[tuple[str, str, str]]:
        """(feature, source column, how) of every design column."""
        return [*((c, c, "numeric") for c in self.numeric), *((n, c, f"indicator:{v}") for c in self.levels for v, n in self.indicators(c).items())]


def indicator_name(column: str, level: str) -> str:
    return f"{column}_{re.sub(r'[^\w.\-]', '_', re.sub(r'\s+', '_', level))}"


def fit_encoder(train: DataFrame, numeric: list[str], categorical: list[str], impute: str = "complete_case", reference: dict[str, str] | None = None, groups: dict[str, dict[str, str]] | None = None) -> Encoder:
    """Learn levels, references and fill values from training rows, in two aggregations. Constant columns and those without support are dropped with a reason."""
    if impute not in ("complete_case", "mean", "median"):
        raise ValueError(f"missing policy {impute} is not known")
    state = Encoder(groups=groups or {})
    if numeric:
        for r in train_moments(train, numeric).collect():  # a row a column
            if r["n"] == 0:
                state.dropped[r["column"]] = "group_no_support"
            elif r["constant"]:
                state.dropped[r["column"]] = "constant_column"
            else:
                state.numeric[r["column"]] = None if impute == "complete_case" else r[impute]
    if categorical:
        support = category_support(train, categorical, groups).persist()
        for r in reference_levels(support, reference).collect():
            c = r["column"]
            if r["n_levels"] < 2 or r["n_levels"] > MOST_LEVELS:
                state.dropped[c] = "constant_column" if r["n_levels"] < 2 else "high_cardinality"
                continue
            state.levels[c] = sorted(x["level"] for x in support.where(F.col("column") == c).collect())  # MOST_LEVELS at most
            state.reference[c] = r["reference"]
        support.unpersist()
        state.dropped |= {c: "category_no_support" for c in categorical if c not in state.levels and c not in state.dropped}
    return state


def _level(state: Encoder, column: str) -> Column:
    level = parse.category(F.col(column).cast("string"))
    mapping = state.groups.get(column)
    return F.coalesce(F.create_map(*[F.lit(x) for p in mapping.items() for x in p])[level], level) if mapping else level


def feature_columns(df: DataFrame, state: Encoder, locale: str = "auto", read: dict[str, Column] | None = None) -> dict[str, Column]:
    """An expression for every feature. Numbers that are texts are read under the locale; an unknown or missing level leaves all indicators of its
    group null, never zero, which would be the reference. read: levels that are there already."""
    out: dict[str, Column] = {}
    for c, fill in state.numeric.items():
        x = parse.finite(parse.number(df, c, locale))
        out[c] = x if fill is None else F.coalesce(x, F.lit(fill))
    for c, levels in state.levels.items():
        v = read[c] if read else _level(state, c)
        known = F.coalesce(v.isin(levels), F.lit(False))
        out |= {name: F.when(known, (v == level).cast("double")) for level, name in state.indicators(c).items()}
    return out


def apply_encoder(df: DataFrame, state: Encoder, locale: str = "auto") -> DataFrame:
    """Adds the features (see `feature_columns`) and `unsupported` (columns whose value has no encoding)."""
    read = {c: F.col(f"_level_{i}") for i, c in enumerate(state.levels)}
    if read:
        # a text is read once a row, by a generator, as filters on features would put its reading into every indicator
        df = df.select("*", F.inline(F.array(F.struct(*[_level(state, c).alias(f"_level_{i}") for i, c in enumerate(state.levels)]))))
    own = feature_columns(df, state, locale, read)
    odd = [F.when(own[c].isNull(), F.lit(c)) for c in state.numeric]
    odd += [F.when(~F.coalesce(read[c].isin(levels), F.lit(False)), F.lit(c)) for c, levels in state.levels.items()]
    unsupported = F.filter(F.array(*odd), lambda c: c.isNotNull())
    out = df.withColumns({f"_{c}" if c in state.numeric else c: x for c, x in own.items()} | {"unsupported": unsupported})
    for c in state.numeric:
        out = out.drop(c).withColumnRenamed(f"_{c}", c)
    return out.drop(*[f"_level_{i}" for i in range(len(state.levels))])

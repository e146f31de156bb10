"""From a source's texts to interpreted rows: names, roles, target and candidates are resolved, each column is taken for numbers or not, and numbers are
read under the request's locale with a status for every cell. Original texts stay beside what was read from them."""

from __future__ import annotations

import dataclasses
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedra.functions import parse
from hedra.operators.ledger import ingest_summary
from hedra.operators.ordered import number_by_hash, row_ids
from hedra.operators.profile import NON_QUANTITATIVE_ROLES, columns_to_convert, infer_kinds, looks_non_quantitative
from hedra.plans.valuation import ROLES, Request, Valuation, resolve, value
from hedra.sources.shared import shared_dir
from hedra.sources.tabular import read_csv

ROW_ID = "row_id"
#: Codes of cells that are not numbers though their column is one of numbers.
CELL_CODES = {"ambiguous": "ambiguous_number", "malformed": "malformed_number", "non_finite": "non_finite_value"}
#: What was done with a cell.
ACTIONS = {"parsed": "parse_numeric", "ambiguous": "ambiguous_unconverted", "malformed": "malformed_unconverted", "non_finite": "non_finite_rejected"}


@dataclass(frozen=True)
class Source:
    """What to read. roles and target are by original, internal or cleaned names; candidates: None is every column whose role allows it, an empty list is none."""

    target: str | None = None
    roles: dict[str, str] = field(default_factory=dict)
    candidates: list[str] | None = None
    locale: str = "auto"
    position: str | None = None  # internal name of a column that numbers the rows; None: in an order that the texts alone decide


def resolve_roles(roles: dict[str, str], names: dict[str, str]) -> tuple[dict[str, str], list[tuple[str, str]]]:
    """Role of each internal name, and issues (code, name)."""
    out, issues = {}, []
    for name, role in roles.items():
        own = resolve(name, names)
        if own is None:
            issues.append(("role_column_absent", name))
        elif role not in ROLES:
            issues.append(("role_invalid", name))
        else:
            out[own] = role
    return out, issues


def resolve_target(declared: str | None, roles: dict[str, str], names: dict[str, str]) -> tuple[str | None, list[tuple[str, str]]]:
    """Internal name of the target: the declared one, else the only column of that role; no column is presumed."""
    named = [c for c, role in roles.items() if role == "target"]
    if not declared:
        return (named[0], []) if len(named) == 1 else (None, [("target_role_ambiguous" if named else "target_not_declared", ",".join(named))])
    own = resolve(declared, names)
    if own is None:
        return None, [("target_not_found", declared)]
    return own, [("target_role_conflict", own)] if named and own not in named else []


def resolve_candidates(candidates: list[str] | None, roles: dict[str, str], target: str | None, names: dict[str, str]) -> tuple[list[str], list[tuple[str, str]]]:
    """Internal names of predictors: of None all whose role allows it, of a list those of it that exist; an empty one authorises nothing."""
    if candidates is None:
        return [c for c in dict.fromkeys(names.values()) if c != target and roles.get(c) not in (*NON_QUANTITATIVE_ROLES, "target")], [("candidate_selection_auto", "")]
    out, issues = [], [] if candidates else [("empty_candidate_selection", "")]
    for name in candidates:
        own = ROW_ID if name == ROW_ID else resolve(name, names)
        code = "requested_column_absent" if own is None else "candidate_is_row_id" if own == ROW_ID else "candidate_is_target" if own == target else None
        issues += [(code, name)] if code else []
        out += [] if code else [own]
    return out, issues


@dataclass
class Ingested:
    """rows: row_id, every column (numbers of converted ones, texts or null of others), original (struct of the texts), missing_before, cells (changed or refused ones), target_value,
    disposition and reasons. issues: (code, name) of names and roles."""

    rows: DataFrame
    names: dict[str, str]
    roles: dict[str, str]
    target: str | None
    candidates: list[str]
    converted: dict[str, bool]
    issues: list[tuple[str, str]]

    @property
    def numeric(self) -> list[str]:
        return [c for c in self.candidates if self.converted[c]]

    @property
    def categorical(self) -> list[str]:
        return [c for c in self.candidates if not self.converted[c]]

    def changes(self) -> DataFrame:
        """row_id, column, original_column, raw, value, action, locale of every cell that was read as another thing than its text, a row each."""
        original = F.create_map(*[F.lit(x) for own, name in {own: name for name, own in reversed(self.names.items())}.items() for x in (own, name)])
        each = self.rows.select(ROW_ID, F.explode("cells").alias("x")).select(ROW_ID, "x.*")
        action = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
        return each.select(ROW_ID, "column", original[F.col("column")].alias("original_column"), "raw", "value", action[F.col("status")].alias("action"), "locale")

    def cell_issues(self) -> DataFrame:
        """row_id, column, code and raw text of every cell that is no number though its column is one of numbers."""
        code = F.create_map(*[F.lit(x) for pair in CELL_CODES.items() for x in pair])
        each = self.rows.select(ROW_ID, F.explode("cells").alias("x")).select(ROW_ID, "x.column", code[F.col("x.status")].alias("code"), "x.raw")
        return each.where("code IS NOT NULL")

    def summary(self) -> DataFrame:
        return ingest_summary(self.rows)

    def valued(self, request: Request) -> Valuation:
        """A model of the rows whose target was observed. The target and the predictors are those of this ingest where the request names none."""
        named = bool(request.numeric or request.categorical)
        own = dataclasses.replace(request, target=request.target or self.target or "", numeric=request.numeric if named else self.numeric, categorical=request.categorical if named else self.categorical)
        return value(self.rows, own, F.col("disposition") == "observed")


def ingest(texts: DataFrame, names: dict[str, str], source: Source) -> Ingested:
    """Interprets a table of texts (internal names; `names` maps original ones). The texts are read once from their source and written to the shared folder; passes over what is
    there find what each column looks like and number the rows; the interpreted rows are written once, too.

    A missing target is pending, one that is no finite number is rejected, and neither is ever imputed; predictors aren't imputed here. A cell that can't be read without
    a guess has no number: its text stays in `original`, with a reason on its row.
    """
    roles, issues = resolve_roles(source.roles, names)
    target, more = resolve_target(source.target, roles, names)
    if target:
        roles[target] = "target"
    candidates, last = resolve_candidates(source.candidates, roles, target, names)
    columns = texts.columns
    texts = _written(texts if source.position else texts.withColumn("_key", F.xxhash64(*columns)), "texts")
    odd = {r["column"]: r["non_quantitative"] for r in looks_non_quantitative(texts, columns).collect()}  # a row a column
    may = columns_to_convert(odd, roles, target)
    asked = [c for c in columns if may[c] and c != target]
    kinds = {r["column"]: r["kind"] for r in infer_kinds(texts, asked, source.locale).collect()} if asked else {}
    # a column of which at most half is numbers is one of names
    converted = {c: v and (c == target or kinds[c] == "numeric") for c, v in may.items()}
    if source.position:
        rows = row_ids(texts.withColumn("_pos", F.col(source.position).try_cast("bigint")), "_pos", ROW_ID).drop("_pos")
    else:
        numbered, n = number_by_hash(texts, "_key", *columns, name="_pos")
        rows = row_ids(numbered, "_pos", ROW_ID, max(6, len(str(n - 1)))).drop("_pos", "_key")
    said = {c: f"_said_{i}" for i, c in enumerate(columns) if converted[c]}
    rows = rows.withColumns({name: parse.parse_number(F.col(c), source.locale) for c, name in said.items()})
    missing = F.filter(F.array(*[F.when(F.col(f"{said[c]}.status") == "missing" if c in said else parse.is_missing(F.col(c)), F.lit(c)) for c in columns]), lambda c: c.isNotNull())
    cell = lambda c, name: F.when(F.col(f"{name}.status").isin(*ACTIONS), F.struct(F.lit(c).alias("column"), F.col(c).alias("raw"), F.col(f"{name}.value").alias("value"), F.col(f"{name}.status").alias("status"), F.col(f"{name}.locale").alias("locale")))
    cells = F.filter(F.array(*[cell(c, name) for c, name in said.items()]), lambda x: x.isNotNull()) if said else F.array().cast("array<struct<column:string,raw:string,value:double,status:string,locale:string>>")
    of = {c: F.col(f"{said[c]}.value") if c in said else F.when(~F.array_contains("missing_before", c), F.col(c)) for c in columns}
    disposition, why = _disposition(F.col(f"{said[target]}.status")) if target else (F.lit("observed"), F.lit(None).cast("string"))
    codes = F.transform(F.filter("cells", lambda x: x["status"].isin(*CELL_CODES)), lambda x: F.create_map(*[F.lit(v) for pair in CELL_CODES.items() for v in pair])[x["status"]])
    held = rows.withColumns({"cells": cells, "missing_before": missing, "original": F.struct(*columns)})
    held = held.withColumns({"disposition": disposition, "target_value": of[target] if target else F.lit(None).cast("double"), "reasons": F.concat(codes, F.array_compact(F.array(why)))})
    out = held.select(ROW_ID, *[x.alias(c) for c, x in of.items()], "original", "missing_before", "cells", "target_value", "disposition", "reasons")
    out = _written(out, "ingested")  # interpreted once, whatever is fitted and scored from it
    return Ingested(out, names, roles | {ROW_ID: "identifier"}, target, candidates, converted, [*issues, *more, *last])


def _written(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a table in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _disposition(status: Column) -> tuple[Column, Column]:
    """What becomes of a row by its target's status, and why."""
    what = F.when(status == "missing", "pending_target").when(status == "parsed", "observed").when(status == "non_numeric", "pending_target").otherwise("rejected")
    why = F.when(status == "missing", "missing_target").when(status == "non_finite", "non_finite_target").when(status != "parsed", "unusable_target")
    return what, why


def ingest_csv(spark, path: str, source: Source, encoding: str | None = None, delimiter: str | None = None) -> Ingested:
    """Interprets the rows of CSV files."""
    texts, _, names = read_csv(spark, path, encoding, delimiter)
    return ingest(texts, names, source)

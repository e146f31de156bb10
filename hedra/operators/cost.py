"""Reconstruction cost from bills of materials: any number of bills in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedra.functions.parse import is_observation

# Categories of items, and grades by mode of the three cost items.
LAND = ("land", "terreno", "ground")
EXCLUDED = ("exclusion", "excluded", "not_covered")
BUILDING = ("building_component", "component", "item", "quantity", "additional_expense", "expense")
DIRECT_GRADES = {"synthetic_budget": 3, "cub_similar": 2, "cub_adjusted": 1}
BDI_GRADES = {"calculated": 3, "justified": 2, "arbitrated": 1}
DEPRECIATION_GRADES = {"recovery_cost": 3, "new_asset": 3, "technical_method": 2, "arbitrated": 1}


def mode_grade(mode: Column, grades: dict[str, int], source: Column) -> Column:
    """Grade of a mode, which counts only with a source."""
    known = F.create_map(*[F.lit(x) for p in grades.items() for x in p])
    return F.when(F.coalesce(F.trim(source), F.lit("")) != "", known[mode])


def item_issue(currency: str, date: str, location: str) -> Column:
    """Why an item can't be counted, or null; `items` columns: category, quantity, unit_cost, additional_expenses, source, currency, reference_date, location."""
    odd = lambda c: ~is_observation(F.col(c).cast("double")) | (F.col(c) < 0)
    return (
        F.when(~F.coalesce(F.col("category").isin(*LAND, *EXCLUDED, *BUILDING), F.lit(False)), "cost_category_unknown")
        .when(odd("quantity") | odd("unit_cost") | odd("additional_expenses"), "cost_item_amount_invalid")
        .when(F.coalesce(F.trim("source"), F.lit("")) == "", "cost_item_source_missing")
        .when(~F.col("currency").eqNullSafe(F.lit(currency)), "cost_currency_mismatch")
        .when(~F.col("reference_date").eqNullSafe(F.lit(date)), "cost_reference_date_mismatch")
        .when(~F.col("location").eqNullSafe(F.lit(location)), "cost_reference_location_mismatch")
    )


def compound(rates: Column) -> Column:
    return F.aggregate(rates, F.lit(1.0), lambda a, r: a * (1 + r)) - 1


def additive(rates: Column) -> Column:
    return F.aggregate(rates, F.lit(0.0), lambda a, r: a + r)


def bdi_matches(rate: Column, components: Column, formula: Column) -> Column:
    """The declared rate of indirect costs agrees with its components."""
    due = F.when(formula == "additive", additive(components)).when(formula == "compound", compound(components))
    return F.coalesce(F.abs(rate - due) <= F.greatest(F.lit(1e-12), 1e-12 * F.greatest(F.abs(rate), F.abs(due))), F.lit(False))


def depreciation_rate(mode: Column, rate: Column, recovery_cost: Column, new_cost: Column) -> Column:
    """The rate in [0, 1), or null where the mode's evidence is not valid."""
    chosen = (
        F.when(mode == "recovery_cost", F.when((new_cost > 0) & recovery_cost.between(0, new_cost), recovery_cost / new_cost))
        .when(mode == "new_asset", F.when(F.coalesce(rate, F.lit(0.0)) == 0, 0.0))
        .when(mode.isin("technical_method", "arbitrated"), rate)
    )
    return F.when((chosen >= 0) & (chosen < 1), chosen)


def reconstruction_costs(items: DataFrame, bill: str, bdi: Column, depreciation: Column, currency: str, date: str, location: str, depreciated: bool = False) -> DataFrame:
    """bill, direct, land, indirect, building, n_items, n_issues and point: building and land, null if any item has an issue or nothing is counted.

    Land counts only if include_land is true. bdi and depreciation are rates over the bill's column.
    """
    amount = F.col("quantity") * F.col("unit_cost") + F.coalesce("additional_expenses", F.lit(0.0))
    enters = ~F.coalesce(F.col("category").isin(*EXCLUDED), F.lit(False))
    land = F.col("category").isin(*LAND)
    judged = items.withColumn("additional_expenses", F.coalesce("additional_expenses", F.lit(0.0))).where(enters).withColumn("_issue", item_issue(currency, date, location))
    good = F.col("_issue").isNull()
    sums = judged.groupBy(bill).agg(
        F.sum(F.when(good & ~land, amount).otherwise(0.0)).alias("direct"),
        F.sum(F.when(good & land & F.coalesce("include_land", F.lit(False)), amount).otherwise(0.0)).alias("land"),
        F.count_if(good & ~land).alias("n_items"),
        F.count("_issue").alias("n_issues"),
    )
    out = sums.withColumn("indirect", F.col("direct") * bdi).withColumn("building", (F.col("direct") + F.col("indirect")) * (1 - (depreciation if depreciated else F.lit(0.0))))
    return out.withColumn("point", F.when((F.col("n_issues") == 0) & (F.col("n_items") > 0), F.col("building") + F.col("land")))

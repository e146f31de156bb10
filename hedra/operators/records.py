"""Rows of a sample by their ids: in a given order, with gaps, without their target, and as they were read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hedra.operators.ordered import number_rows


def select_in_order(rows: DataFrame, ids: DataFrame, key: str, position: str) -> DataFrame:
    """Rows of the listed ids with their place in the list; ids that the table doesn't have are left out, a repeated id stands as often as listed."""
    return ids.select(key, F.col(position).alias("position")).join(rows, key)


def rows_for_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """One row for every listed id, with empty values where the table doesn't have it, and `present`."""
    return ids.select(key).join(rows.withColumn("present", F.lit(True)), key, "left").withColumn("present", F.coalesce("present", F.lit(False)))


def feature_records(rows: DataFrame, ids: DataFrame, key: str, target: str) -> DataFrame:
    """Rows of the listed ids without the target: what a predictor may see of reserved rows."""
    return rows.drop(target).join(ids.select(key).distinct(), key, "left_semi")


def report_index(rows: DataFrame, used: str, key: str) -> DataFrame:
    """Adds `index`, from 1 over used rows and again over the others, in order of a numeric or time key."""
    parts = [number_rows(rows.where(kind), key, key, name="index").withColumn("index", F.col("index") + 1) for kind in (F.coalesce(F.col(used), F.lit(False)), ~F.coalesce(F.col(used), F.lit(False)))]
    return parts[0].unionByName(parts[1])


def original_record(raw: DataFrame, ledger: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The cells of listed rows as they were read, as a map `values`, beside the ledger's columns about them."""
    cells = [c for c in raw.columns if c != key]
    values = F.map_from_arrays(F.array(*[F.lit(c) for c in cells]), F.array(*[F.col(f"`{c}`").cast("string") for c in cells]))
    wanted = ids.select(key).distinct()
    return raw.join(wanted, key, "left_semi").select(key, values.alias("values")).join(ledger.join(wanted, key, "left_semi"), key)


def changed_cells(raw: DataFrame, parsed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, column, before and after of every cell that reading changed (null and value differ)."""
    a = raw.select(key, *[F.col(c).cast("string").alias(f"a{i}") for i, c in enumerate(columns)])
    b = parsed.select(key, *[F.col(c).cast("string").alias(f"b{i}") for i, c in enumerate(columns)])
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a{i}").alias("before"), F.col(f"b{i}").alias("after")) for i, c in enumerate(columns)])
    return a.join(b, key).select(key, F.inline(each)).where(~F.col("before").eqNullSafe(F.col("after")))


def influence_audit(rows: DataFrame, claimed: DataFrame, key: str) -> DataFrame:
    """One row: rows by each flag of influence, their union, and whether it is what was claimed. Rows without a finite measure make it incomplete."""
    union = F.col("high_cook") | F.col("high_residual") | F.col("high_leverage")
    said = claimed.select(F.col(key).alias("_key")).distinct().withColumn("_said", F.lit(True))
    both = rows.join(said, F.col(key) == F.col("_key"), "full").withColumn("_said", F.coalesce("_said", F.lit(False)))
    whole = F.col("cook").isNotNull() & F.col("studentized").isNotNull() & F.col("leverage").isNotNull()
    known = F.col(key).isNotNull()
    out = both.agg(
        F.count_if(F.col("high_cook")).alias("n_cook"), F.count_if(F.col("high_residual")).alias("n_residual"), F.count_if(F.col("high_leverage")).alias("n_leverage"), F.count_if(union).alias("n_union"),
        F.count_if(known & ~whole).alias("n_incomplete"), F.count_if(F.coalesce(union, F.lit(False)) != F.col("_said")).alias("n_differing"),
    )
    return out.withColumn("union_valid", (F.col("n_incomplete") == 0) & (F.col("n_differing") == 0))


def grouped_ids(issues: DataFrame) -> DataFrame:
    """A row for each origin, code, message and id that it concerns, with the number of ids; groups of any size, as nothing is gathered into one row."""
    each = issues.select("origin", "code", "message", "affected_id").distinct()
    counts = each.groupBy("origin", "code", "message").agg(F.count("affected_id").alias("n"))
    return each.join(counts, ["origin", "code", "message"])

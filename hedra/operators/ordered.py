"""Order over a whole table without a single task: buckets of the order key, windows inside them, and a small table of what crosses their edges."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _place(df: DataFrame, key: str) -> Column:
    kind = df.schema[key].dataType.simpleString()
    return (F.unix_micros(F.col(key).cast("timestamp")) if kind.startswith(("timestamp", "date")) else F.col(key)).cast("double")


def _above(value: Column, cuts: list[float]) -> Column:
    """How many of the sorted cuts are less than the value: by every so-manieth cut first, then within the part that those leave, as a row pays for each cut that it is compared with."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1
    parts = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    less = lambda few: F.size(F.filter(few, lambda c: c < value))
    part = F.greatest(less(F.array(*[F.lit(own[0]) for own in parts])), F.lit(1))
    every = F.array(*[F.array(*[F.lit(c) for c in own]) for own in parts])
    return F.when(value.isNotNull(), F.transform(F.array(part), lambda p: (p - 1) * step + less(F.element_at(every, p)))[0]).otherwise(0)


def buckets(df: DataFrame, key: str, count: int = 200, ties: tuple[str, ...] = ()) -> Column:
    """A number that grows with a numeric or time key and cuts it into about `count` parts of equal rows. Null comes first.

    Equal keys share a bucket, but for hot ones (that fill more than a bucket) where the first of `ties` is a number or time: those are cut by it in turn,
    so that no task gets all rows of one key. Equal ties stay together.
    """
    value = _place(df, key)
    found = df.agg(F.percentile_approx(value, [k / count for k in range(1, count)], 10_000).alias("q")).first()["q"] or []
    cuts = sorted(set(found))
    own = F.coalesce(_above(value, cuts) + 1, F.lit(0)).cast("bigint")
    often = sorted({c for c in cuts if found.count(c) > 1})
    if not often or not ties or df.schema[ties[0]].dataType.simpleString() == "string":
        return own
    tie = _place(df, ties[0])
    rows = df.where(value.isin(often)).groupBy(value.alias("v")).agg(F.percentile_approx(tie, [k / count for k in range(1, count)], 10_000).alias("q")).collect()  # `count` rows at most
    inner = F.lit(0)
    for r in rows:  # rows of a hot key come after the others of its bucket, which are less
        inner = F.when(value == F.lit(r["v"]), F.coalesce(_above(tie, sorted(set(r["q"] or []))) + 2, F.lit(1))).otherwise(inner)
    return own * (count + 2) + inner


def number_rows(df: DataFrame, key: str, *ties: str, name: str = "pos", count: int = 200) -> DataFrame:
    """Gapless row numbers from 0 in order of key and ties."""
    return _numbered(df.withColumn("_bucket", buckets(df, key, count, ties)), key, ties, name)[0]


def number_by_hash(df: DataFrame, key: str, *ties: str, name: str = "pos", bits: int = 12) -> tuple[DataFrame, int]:
    """number_rows by a key that is a 64-bit hash, and the number of rows. Ranges of a hash are even as they are: no pass looks for cuts, and no row is compared with any."""
    return _numbered(df.withColumn("_bucket", F.shiftright(key, 64 - bits)), key, ties, name)


def _numbered(cut: DataFrame, key: str, ties: tuple[str, ...], name: str) -> tuple[DataFrame, int]:
    sizes = sorted((r["_bucket"], r["_n"]) for r in cut.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).collect())  # a row a bucket
    ends = [0, *accumulate(n for _, n in sizes)]
    first = cut.sparkSession.createDataFrame([(b, e) for (b, _), e in zip(sizes, ends, strict=False)], "_bucket bigint, _first bigint")
    inside = Window.partitionBy("_bucket").orderBy(key, *ties)
    return cut.join(F.broadcast(first), "_bucket").withColumn(name, F.col("_first") + F.row_number().over(inside) - 1).drop("_bucket", "_first"), ends[-1]


def row_ids(df: DataFrame, position: str = "pos", name: str = "row_id", digits: int | None = None) -> DataFrame:
    """R and the position, padded with zeros to six digits or as many as the greatest needs. digits: so many in any case, with longer positions cut after them as SQL's lpad does, so that
    ids repeat from 10**digits rows on."""
    digits = digits or max(6, len(str(df.agg(F.max(position).alias("m")).first()["m"] or 0)))
    return df.withColumn(name, F.concat(F.lit("R"), F.lpad(F.col(position).cast("string"), digits, "0")))


def durbin_watson(df: DataFrame, residual: Column, key: str, *ties: str, count: int = 200) -> DataFrame:
    """One row with durbin_watson, null for fewer than two rows or no spread. Only sums and the two edges of each bucket leave a task."""
    own = df.select(buckets(df, key, count, ties).alias("_bucket"), key, *ties, residual.cast("double").alias("_e"))
    inside = Window.partitionBy("_bucket").orderBy(key, *ties)
    stepped = own.withColumn("_d", F.col("_e") - F.lag("_e").over(inside))
    order = F.struct(key, *ties)
    parts = stepped.groupBy("_bucket").agg(F.sum(F.col("_d") * F.col("_d")).alias("num"), F.sum(F.col("_e") * F.col("_e")).alias("den"), F.min_by("_e", order).alias("first"), F.max_by("_e", order).alias("last"), F.count(F.lit(1)).alias("n"))
    jump = F.col("first") - F.lag("last").over(Window.orderBy("_bucket"))  # at most count + 1 rows
    joined = parts.select((F.coalesce("num", F.lit(0.0)) + F.coalesce(jump * jump, F.lit(0.0))).alias("num"), "den", "n")
    total = joined.agg(F.sum("num").alias("num"), F.sum("den").alias("den"), F.sum("n").alias("n"))
    return total.select(F.when(F.col("n") > 1, F.try_divide("num", "den")).alias("durbin_watson"))


def even_chunks(df: DataFrame, position: str, k: int, name: str = "chunk") -> DataFrame:
    """Chunk 0 .. k-1 of gapless positions from 0; the first chunks get one row more."""
    n = df.agg((F.max(position) + 1).alias("n")).first()["n"] or 0
    base, more = divmod(n, k)
    cut = more * (base + 1)
    chunk = F.when(F.col(position) < cut, F.floor(F.col(position) / (base + 1))).otherwise(more + F.floor((F.col(position) - cut) / max(base, 1)))
    return df.withColumn(name, chunk.cast("int"))


def time_buckets(df: DataFrame, time: str) -> DataFrame:
    """Distinct times in order with their rows and the rows from there to the end; equal times are never split."""
    counts = df.where(F.col(time).isNotNull()).groupBy(time).agg(F.count(F.lit(1)).alias("n"))
    cut = counts.withColumn("_bucket", buckets(counts, time))
    sums = cut.groupBy("_bucket").agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_m"))
    whole = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = sums.select("_bucket", F.coalesce(F.sum("_n").over(whole), F.lit(0)).alias("_before"), F.coalesce(F.sum("_m").over(whole), F.lit(0)).alias("_rank"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_all"))
    inside = Window.partitionBy("_bucket").orderBy(time)
    placed = cut.join(F.broadcast(ends), "_bucket")
    so_far = F.col("_before") + F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return placed.select(time, "n", (F.col("_rank") + F.row_number().over(inside) - 1).alias("rank"), (F.col("_all") - so_far + F.col("n")).alias("to_end"))


def temporal_holdout(df: DataFrame, time: str, share: float) -> DataFrame:
    """Adds `role`: test for whole times from the end until they hold the share of rows, train for all before, null without a time."""
    n = df.where(F.col(time).isNotNull()).count()
    want = min(max(round(n * share), 1), max(n - 1, 1))
    cut = time_buckets(df, time).where(F.col("to_end") >= want).agg(F.max(time).alias("cut")).first()["cut"]
    return df.withColumn("role", F.when(F.col(time).isNull(), None).when(F.col(time) >= F.lit(cut), "test").otherwise("train"))


def temporal_folds(df: DataFrame, time: str, k: int) -> DataFrame:
    """fold 1 .. k and role of each row: distinct times in k + 1 even chunks; fold i trains on the chunks before it. Rows repeat over folds."""
    times = even_chunks(time_buckets(df, time), "rank", k + 1)
    placed = df.join(times.select(time, "chunk"), time)
    each = placed.withColumn("fold", F.explode(F.sequence(F.greatest(F.col("chunk"), F.lit(1)), F.lit(k))))
    return each.withColumn("role", F.when(F.col("chunk") == F.col("fold"), "test").otherwise("train")).drop("chunk")


def shifted_by_one(left: DataFrame, right: DataFrame, position: str, value: str) -> DataFrame:
    """One row: equal, and whether the right series is the left one moved by one place forward or back."""
    a, b = left.select(position, F.col(value).alias("_a")), right.select(position, F.col(value).alias("_b"))

    def same(by: int) -> Column:
        return F.bool_and(F.col("_a").eqNullSafe(F.col("_b"))).alias({0: "equal", 1: "forward", -1: "back"}[by])

    found = [a.withColumn(position, F.col(position) + by).join(b, position, "full" if by == 0 else "inner").agg(same(by)) for by in (0, 1, -1)]
    return found[0].join(F.broadcast(found[1]), F.lit(True)).join(F.broadcast(found[2]), F.lit(True))  # one row each

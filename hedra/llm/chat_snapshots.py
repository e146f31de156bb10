"""Chat formatting with collapse of cumulative snapshots, in DataFrame operations only.

A logger that stores a conversation after every turn leaves each state as a conversation of its own. A rolling hash of the turns so far
marks every prefix; a conversation whose whole hash is a proper prefix of a longer one goes by an anti-join, equal conversations keep the
smallest id, and what remains is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hedra.llm.common import pick


def _turns(df: DataFrame) -> DataFrame:
    """Turns in order without repeated rows; pos is gapless from 1. No text is shuffled, only its hashes."""
    role, text = F.coalesce(F.col("role"), F.lit("\0")), F.coalesce(F.col("text"), F.lit("\0"))
    own = df.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", "role", F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), text, role).alias("b"), F.md5(text.cast("binary")).alias("m"))
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "m")
    before = [F.lag(c).over(in_order).eqNullSafe(F.col(c)) for c in ("turn", "a", "b")]
    same = (F.row_number().over(in_order) > 1) & before[0] & before[1] & before[2]
    return own.withColumn("again", same).where(~F.col("again"))


def prefixes(df: DataFrame) -> DataFrame:
    """conv_id, pos, the rolling hash (p, q) of the first pos turns, and the conversation's number of turns."""
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "m")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = _turns(df).withColumn("pos", F.row_number().over(in_order))
    rolled = [F.bit_xor(F.xxhash64("pos", h)).over(so_far).alias(n) for h, n in (("a", "p"), ("b", "q"))]
    return placed.select("conv_id", "pos", *rolled, F.count(F.lit(1)).over(Window.partitionBy("conv_id")).alias("n_turns"))


def render(turns: Column) -> Column:
    """Template: <|role|>, a line end and the text for every turn, with line ends between turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("unknown")), F.lit("|>\n"), F.coalesce(t["text"], F.lit("")))), "\n")


def collapse_snapshots(conversations: DataFrame) -> DataFrame:
    """Maximal conversations, rendered: conv_id, n_turns, n_copies (equal conversations, itself included), text.

    Turns are taken in order of turn, ties by role and the text's MD5; exactly repeated rows count once. Nulls come first in that order; a
    null role renders as `unknown`, a null text as empty, and each differs from any other value in comparison. Rows without conv_id belong
    to no conversation. Equal conversations are pre-aggregated before the anti-join, so that a conversation or first turn which fills a
    third of the table costs one row. Prefixes are told apart by two 64-bit hashes: among a billion of them, odds that any two clash are under 1 in 10**20. An empty table gives an empty result; other columns are ignored.
    """
    own = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    rolled = prefixes(own)
    whole = rolled.where(F.col("pos") == F.col("n_turns")).groupBy("n_turns", "p", "q").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    proper = rolled.where(F.col("pos") < F.col("n_turns")).groupBy(F.col("pos").alias("n_turns"), "p", "q").agg(F.lit(1).alias("one")).drop("one")
    kept = whole.join(proper, ["n_turns", "p", "q"], "left_anti").select("conv_id", F.col("n_turns").cast("bigint").alias("n_turns"), "n_copies")
    lines = own.join(kept, "conv_id").groupBy("conv_id", "n_turns", "n_copies").agg(F.array_sort(F.collect_set(F.struct("turn", "role", F.md5(F.coalesce(F.col("text"), F.lit("\0")).cast("binary")).alias("m"), "text"))).alias("turns"))
    return lines.select("conv_id", "n_turns", "n_copies", render(F.col("turns")).alias("text"))


#: DuckDB twin over `conversations`.
SQL = r"""
WITH d AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, md5(text)) AS pos FROM d),
c AS (SELECT conv_id, count(*) AS n_turns, list({'r': role, 't': text} ORDER BY pos) AS turns FROM p GROUP BY conv_id),
u AS (SELECT turns, n_turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY turns, n_turns),
pre AS (SELECT DISTINCT turns[1:k] AS turns FROM u, LATERAL (SELECT unnest(generate_series(1, n_turns - 1)) AS k))
SELECT conv_id, n_turns, n_copies, array_to_string(list_transform(turns, lambda t: '<|' || coalesce(t.r, 'unknown') || '|>' || chr(10) || coalesce(t.t, '')), chr(10)) AS text
FROM u WHERE turns NOT IN (SELECT turns FROM pre)
"""

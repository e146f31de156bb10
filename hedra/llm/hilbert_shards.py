"""Sharding along a Hilbert curve, in DataFrame operations only.

Several metadata columns are quantised to cells of equal frequency, rows are ordered by their cell's index on the Hilbert curve, and the
order is cut into runs of equal length. Rows of a shard are then near in every dimension, so that minima and maxima of its files prune.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hedra.llm.common import pick


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of a cell whose coordinates have `bits` bits (Skilling's transform), as a bigint."""
    n = len(axes)
    start = F.struct(*[a.cast("bigint").alias(f"x{i}") for i, a in enumerate(axes)])

    def turn(s: Column, q: Column) -> Column:
        p = q - 1
        x = [s[f"x{i}"] for i in range(n)]
        x[0] = F.when(x[0].bitwiseAND(q) != 0, x[0].bitwiseXOR(p)).otherwise(x[0])
        for i in range(1, n):
            t = x[0].bitwiseXOR(x[i]).bitwiseAND(p)
            high = x[i].bitwiseAND(q) != 0
            x[0], x[i] = F.when(high, x[0].bitwiseXOR(p)).otherwise(x[0].bitwiseXOR(t)), F.when(high, x[i]).otherwise(x[i].bitwiseXOR(t))
        return F.struct(*[v.alias(f"x{i}") for i, v in enumerate(x)])

    def gray(s: Column) -> Column:
        x = [s["x0"]]
        for i in range(1, n):
            x.append(x[-1].bitwiseXOR(s[f"x{i}"]))
        t = reduce(lambda a, q: a.bitwiseXOR(F.when(x[-1].bitwiseAND(F.lit(q)) != 0, F.lit(q - 1)).otherwise(F.lit(0))), [1 << k for k in range(bits - 1, 0, -1)], F.lit(0).cast("bigint"))
        x = [v.bitwiseXOR(t) for v in x]
        return sum((F.shiftleft(F.shiftright(v, k).bitwiseAND(F.lit(1)), k * n + n - 1 - i) for k in range(bits) for i, v in enumerate(x)), F.lit(0).cast("bigint"))

    turns = F.array(*[F.lit(1 << k).cast("bigint") for k in range(bits - 1, 0, -1)]) if bits > 1 else F.array().cast("array<bigint>")
    return F.aggregate(turns, start, turn, gray)


def _number(kind: str, c: Column, skip: int) -> Column:
    """An order-preserving number: for strings the seven bytes after the first `skip`, else the value."""
    if kind in ("string", "binary"):
        return F.conv(F.rpad(F.hex(F.substring(c.cast("binary"), skip + 1, 7)), 14, "0"), 16, 10).cast("bigint").cast("double")
    return (F.unix_micros(c.cast("timestamp")) if kind.startswith(("timestamp", "date")) else c).cast("double")


def cells(df: DataFrame, dims: list[str], bits: int) -> list[Column]:
    """Expressions that quantise columns of `df` to 0 .. 2**bits-1 by equal frequency; null is 0. Takes two narrow aggregations, whose results have a fixed size."""
    kinds = {d: df.schema[d].dataType.simpleString() for d in dims}
    text = [d for d in dims if kinds[d] in ("string", "binary")]
    ends = df.agg(*[f(F.col(d).cast("binary")).alias(f"{name}{i}") for i, d in enumerate(text) for name, f in (("low", F.min), ("high", F.max))]).first() if text else None
    skip = {}
    for i, d in enumerate(text):
        low, high = bytes(ends[f"low{i}"] or b""), bytes(ends[f"high{i}"] or b"")
        skip[d] = next((k for k, (a, b) in enumerate(zip(low, high, strict=False)) if a != b), min(len(low), len(high)))
    values = {d: _number(kinds[d], F.col(d), skip.get(d, 0)) for d in dims}
    cuts = [k / (1 << bits) for k in range(1, 1 << bits)]
    found = df.agg(*[F.percentile_approx(values[d], cuts, 1000).alias(f"q{i}") for i, d in enumerate(dims)]).first()
    return [F.coalesce(sum((F.when(values[d] > F.lit(b), 1).otherwise(0) for b in sorted(set(found[f"q{i}"] or []))), F.lit(0)), F.lit(0)) for i, d in enumerate(dims)]


def hilbert_shards(df: DataFrame, key: str, dims: list[str], shards: int, bits: int = 4, block_rows: int = 1000, keep: dict[str, Column] | None = None) -> DataFrame:
    """Put every row into shards 0 .. shards-1 whose row counts differ by one at most.

    Returns key, the columns of `keep`, `hilbert`, `shard` and `slot` (gapless from 0 in each shard). Rows of one cell are ordered by a hash
    of the key; a cell is split by that hash into blocks of about `block_rows` rows, so that a cell that holds a third of all rows is
    numbered by many tasks. Counts of cells, 2**(bits*len(dims)) at most, are all that the driver sees.
    Null dimensions fall into the first cell; null keys and repeated rows are rows like others (equal rows are interchangeable);
    an empty table gives an empty result.
    """
    keep = keep or {}
    grid = hilbert_index(cells(df, dims, bits), bits)
    tie = F.xxhash64(F.col(key), *[F.col(d) for d in dims])
    counted = df.select(grid.alias("hilbert")).groupBy("hilbert").count().orderBy("hilbert").collect()
    rows = sum(r["count"] for r in counted)
    if not rows:
        return df.select(F.col(key), *[c.alias(n) for n, c in keep.items()], F.lit(0).cast("bigint").alias("hilbert"), F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot")).limit(0)
    starts, at = [], 0
    for r in counted:
        starts.append((r["hilbert"], at, max(1, -(-r["count"] // block_rows))))
        at += r["count"]
    # a row a cell, 2**(bits*len(dims)) at most
    first = F.broadcast(df.sparkSession.createDataFrame(starts, "hilbert bigint, first bigint, spread bigint"))
    blocked = lambda d: d.join(first, "hilbert").withColumn("block", F.pmod("tie", "spread")).drop("spread")

    blocks = blocked(df.select(grid.alias("hilbert"), tie.alias("tie"))).groupBy("hilbert", "block").agg(F.count(F.lit(1)).alias("count"), F.first("first").alias("first"))
    before = F.sum("count").over(Window.partitionBy("hilbert").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.withColumn("before", F.coalesce(before, F.lit(0))).select("hilbert", "block", (F.col("first") + F.col("before")).alias("offset"))

    own = blocked(df.select(F.col(key), *[c.alias(n) for n, c in keep.items()], grid.alias("hilbert"), tie.alias("tie"))).drop("first")
    order = Window.partitionBy("hilbert", "block").orderBy("tie", key, *keep)
    rank = F.col("offset") + F.row_number().over(order) - 1
    base, more = divmod(rows, shards)
    cut = more * (base + 1)
    shard = F.when(F.col("rank") < cut, F.floor(F.col("rank") / (base + 1))).otherwise(more + F.floor((F.col("rank") - cut) / max(base, 1))).cast("int")
    began = F.when(F.col("shard") <= more, F.col("shard") * F.lit(base + 1).cast("bigint")).otherwise(cut + (F.col("shard") - more) * F.lit(base).cast("bigint"))
    return own.join(blocks, ["hilbert", "block"]).withColumn("rank", rank).withColumn("shard", shard).select(key, *keep, "hilbert", "shard", (F.col("rank") - began).cast("bigint").alias("slot"))


def shard_documents(docs: DataFrame, dims: list[str], shards: int = 24, bits: int = 4) -> DataFrame:
    """Documents to shards with size (UTF-8 bytes of the text and 8), checksum and place; see hilbert_shards. A null text has size 8 and checksum 0."""
    names = {f"dim{i}": d for i, d in enumerate(dims)}
    own = pick(docs, doc_id="doc_id", text="text", **names)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 8
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    out = hilbert_shards(own, "doc_id", list(names), shards, bits, keep={"size": size, "text_crc32": crc})
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")

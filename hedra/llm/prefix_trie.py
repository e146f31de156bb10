"""A trie of conversation prefixes, built as a compressed (Patricia) tree from sorted sequences.

A conversation becomes a key of 20 bytes a turn: the MD5 of role and text, and the number of the text's words. Equal keys are counted together, so
that a group of copies is one row, and distinct keys are sorted over range partitions. A task goes once through its sorted keys with a stack and makes points at branches, ends and
leaves only, each with the compressed edge above it; members, leaves and words are summed on those points. Turns within an edge are nodes of one
child: they are expanded from suffix sums of the edge's words.

A node whose members lie in several partitions is a prefix that the last key of one shares with the first of the next. Tasks know the lengths of
those shared prefixes, make points of all their depths, and send their shares, which are added up by prefix. What starts in an earlier partition counts
as a node there and not again.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hedra.llm.common import WORD, partitions, pick, stage

#: Bytes of a turn in a key: digest and number of words.
DIGEST, TURN = 16, 20
#: Points that several partitions share, up to which they are broadcast (some 100 bytes each).
BROADCAST_ROWS = 200_000
#: Ids that are joined at a time, as a power of two.
BLOCK = 14
NOTHING = hashlib.sha256(b"").hexdigest()


def sequences(conversations: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """conv_id and key of every rebuilt conversation: the first h original turns of conversation c - c % every (none if it is absent), then its own turns after its
    first h; h is the unsigned CRC-32 of the decimal id modulo `heads`. A remainder has the sign of its id. No text is shuffled."""
    own = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text").where(F.col("conv_id").isNotNull())
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    made = F.concat(digest, F.lpad(F.hex(F.regexp_count(text, F.lit(WORD))), 8, "0"))
    turns = own.select("conv_id", F.struct("turn", role.alias("role"), F.md5(text.cast("binary")).alias("m"), made.alias("t")).alias("x"))
    whole = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]).alias("turns"))
    c = F.col("conv_id")
    head = whole.where(c % every == 0).select(c.alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    h = F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(heads)).cast("int")
    both = whole.join(head, (c - c % every) == F.col("base"), "left").withColumn("h", h)
    rebuilt = F.concat(F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0))))
    return both.select("conv_id", F.unhex(F.array_join(rebuilt, "")).alias("key"))


def id_digests(members: DataFrame) -> DataFrame:
    """sid and sha: the SHA-256 of the ids of each `sid` in order, joined by commas. Ids are joined by blocks of a range, and a task hashes one block
    after another, so that a group of any size takes bounded memory."""
    n = partitions(members.sparkSession)
    ranged = members.select("sid", "conv_id").repartitionByRange(n, "sid", "conv_id").sortWithinPartitions("sid", "conv_id")
    blocks = ranged.withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK)).groupBy("sid", "block").agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha = None, None
        for batch in batches:
            out = []
            for sid, ids in zip(batch.column("sid").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if sha and sid == at:
                    sha.update(b"," + ids.encode())
                    continue
                out += [(at, sha.hexdigest())] if sha else []
                at, sha = sid, hashlib.sha256(ids.encode())
            yield _batch(out, sid=pa.binary(), sha=pa.string())
        if sha:
            yield _batch([(at, sha.hexdigest())], sid=pa.binary(), sha=pa.string())

    texts = blocks.select("sid", "block", F.concat_ws(",", F.col("ids").cast("array<string>")).alias("ids"))
    return texts.repartition(n, "sid").sortWithinPartitions("sid", "block").select("sid", "ids").mapInArrow(run, "sid binary, sha string")


def _batch(rows: list, **kinds: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], names=list(kinds))


def common_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(0, n, TURN) if a[i : i + TURN] != b[i : i + TURN]), n) // TURN


@dataclass
class _Point:
    """A branch, end or leaf on the path to the current key, with what its subtree in this partition adds up to. first: it has the partition's first key."""

    depth: int
    first: bool
    n: int = 0
    conv: int | None = None
    product: int = 0  # of members and words, over nodes
    words: int = 0  # over nodes that start here
    leaves: int = 0
    children: int = 0  # that start here
    bare: bool = True  # no child at all
    ends: str = NOTHING
    waiting: list[list] = field(default_factory=list)  # points below that must learn its conversation


#: What a task sends of a point: the shared prefix's digest or null, sums, suffix sums of the edge's words from the lower end, and the parent's conversation or shared prefix.
POINT = {
    "shared": pa.binary(), "depth": pa.int64(), "conv": pa.int64(), "n": pa.int64(), "children": pa.int64(), "leaves": pa.int64(), "product": pa.int64(), "words": pa.int64(), "ends": pa.string(), "edge": pa.list_(pa.int64()),
    "parent": pa.int64(), "parent_shared": pa.binary(),
}  # fmt: skip
POINT_SQL = "shared binary, depth bigint, conv bigint, n bigint, children bigint, leaves bigint, product bigint, words bigint, ends string, edge array<bigint>, parent bigint, parent_shared binary"


def points(rows: Iterable[tuple[bytes, int, int, str]], left: int = -1, right: int = -1) -> Iterator[list]:
    """Points of the compressed tree of sorted distinct keys: rows of (key, members, least id, digest of ids), none twice. left, right: turns that the first key shares with
    the partition before and the last with the one after; -1: there is none."""
    stack, key, words = [_Point(0, True)], b"", np.zeros(0, np.int64)
    prefix = lambda d: hashlib.md5(key[: d * TURN]).digest()  # noqa: E731

    def close(to: int, last: bool) -> Iterator[list]:
        """Points deeper than `to` come off the stack, each into the one above it; where the path branches at `to`, that becomes a point."""
        while stack[-1].depth > to:
            v = stack.pop()
            top = max(stack[-1].depth, to)
            if top > stack[-1].depth:
                stack.append(_Point(top, v.first))
            u, known = stack[-1], left if v.first else -1
            limit = max(known, right if last else -1)  # nodes up to this depth are shared with other partitions
            v.leaves += v.bare and not (last and v.depth <= right)
            for row in v.waiting:
                row[-2:] = (None, prefix(v.depth)) if v.depth <= limit else (v.conv, None)
                yield row
            lower, children, ends = min(max(top, limit), v.depth), v.children, v.ends
            if lower < v.depth:
                own = int(words[v.depth - 1])
                v.product, v.words = v.product + v.n * own, v.words + own
                edge = np.cumsum(words[lower : v.depth - 1][::-1])
                row = [None, v.depth, v.conv, v.n, children, v.leaves, v.product, v.words, ends, edge.tolist(), None, None]
                if lower > top:
                    row[-1] = prefix(lower)
                    yield row
                else:
                    u.waiting.append(row)
                total = int(edge[-1]) if len(edge) else 0
                v.product, v.words, children, ends = v.product + v.n * total, v.words + total, 1, NOTHING
            for d in range(lower, top, -1):
                own = int(words[d - 1])
                v.product, v.words = v.product + v.n * own, v.words + own * (d > known)
                yield [prefix(d), d, v.conv, v.n, children, v.leaves, v.product, v.words, ends, [], None, prefix(d - 1)]
                children, ends = int(d > known), NOTHING
            u.n, u.conv = u.n + v.n, v.conv if u.conv is None else min(u.conv, v.conv)
            u.product, u.words, u.leaves, u.bare = u.product + v.product, u.words + v.words, u.leaves + v.leaves, False
            u.children += top + 1 > known

    some = False
    for new, n, conv, ends in rows:
        if some:
            yield from close(common_turns(key, new), False)
        key, words = new, np.frombuffer(new, np.dtype([("d", f"S{DIGEST}"), ("w", ">u4")]))["w"].astype(np.int64)
        if new:
            stack.append(_Point(len(words), not some, n, conv, ends=ends))
        else:
            stack[0].n, stack[0].conv, stack[0].ends = n, conv, ends
        some = True
    if some:
        yield from close(0, True)
        root, shared = stack[0], max(left, right) >= 0
        root.leaves += root.bare and right < 0
        for row in root.waiting:
            row[-2:] = (None, prefix(0)) if shared else (root.conv, None)
            yield row
        yield [prefix(0) if shared else None, 0, root.conv, root.n, root.children, root.leaves, root.product, root.words, root.ends, [], None, None]


def prefix_trie(conversations: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """One row for each distinct sequence of first turns: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are taken in order of turn (null first), ties by role and the text's MD5; a null role or text is empty, and repeated rows are turns of their own. Rows
    without a conv_id belong to no conversation. A conversation, rebuilt by `sequences`, without turns is a member of the root alone. Equal sequences
    are one row with a count, whatever their number; a conversation is one key of 20 bytes a turn. An empty table gives an empty result; other columns are ignored.
    """
    rebuilt = stage(sequences(conversations, every, heads).withColumn("sid", F.unhex(F.md5("key"))), "sequences")
    kinds = rebuilt.groupBy("sid", "key").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv"))
    known = kinds.join(id_digests(rebuilt), "sid").select("key", "n", "conv", "sha")
    size = partitions(conversations.sparkSession)
    # which keys a partition got must stay as it is from here on
    ordered = stage(known.repartitionByRange(size, "key").sortWithinPartitions("key").withColumn("part", F.spark_partition_id()), "sorted")

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = zip(*(batch.column(c).to_pylist() for c in ("part", "before", "low")), strict=True)
            yield _batch([(p, -1 if b is None else common_turns(b, k)) for p, b, k in at], part=pa.int32(), turns=pa.int32())

    ends = ordered.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"))  # a row a partition
    before = ends.select("part", "low", F.expr("lag(high) OVER (ORDER BY part)").alias("before"))
    met = {r["part"]: r["turns"] for r in before.mapInArrow(shared, "part int, turns int").collect()}
    after = dict(zip(sorted(met), [*[met[p] for p in sorted(met)][1:], -1], strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("part", "key", "n", "conv", "sha")), strict=True)

        out = []
        for part, own in itertools.groupby(rows(), lambda r: r[0]):
            for p in points((r[1:] for r in own), met[part], after[part]):
                out.append(p)
                if len(out) >= 4096:
                    yield _batch(out, **POINT)
                    out = []
        yield _batch(out, **POINT)

    found = stage(ordered.repartition(size, "part").sortWithinPartitions("part", "key").mapInArrow(run, POINT_SQL), "points")
    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "product", "words")]
    across = found.where(F.col("shared").isNotNull()).groupBy("shared", "depth").agg(F.min("conv").alias("conv"), *sums, F.max(F.when(F.col("ends") != NOTHING, F.col("ends"))).alias("ends"), F.max("parent_shared").alias("parent_shared"))
    across = stage(across.withColumns({"ends": F.coalesce("ends", F.lit(NOTHING)), "edge": F.array().cast("array<bigint>"), "parent": F.lit(None).cast("bigint")}).select(*POINT), "shared")
    above = across.select(F.col("shared").alias("parent_shared"), F.col("conv").alias("above"))
    above = F.broadcast(above) if above.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else above
    alone = found.where(F.col("shared").isNull())
    below = alone.where(F.col("parent_shared").isNotNull()).unionByName(across).join(above, "parent_shared", "left").withColumn("parent", F.col("above")).select(*POINT)
    every_point = alone.where(F.col("parent_shared").isNull()).unionByName(below)
    up, nodes = F.col("up"), every_point.withColumn("up", F.explode(F.sequence(F.lit(0), F.size("edge"))))
    saved = F.col("product") - F.col("words") + F.when(up > 0, (F.col("n") - 1) * F.try_element_at("edge", up)).otherwise(0)
    return nodes.select(
        F.col("conv").alias("conv_id"),
        (F.col("depth") - up).alias("depth"),
        F.when(up < F.size("edge"), F.col("conv")).otherwise(F.col("parent")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(up == 0, F.col("children")).otherwise(1).cast("bigint").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        saved.alias("saved_tokens"),
        F.when(up == 0, F.col("ends")).otherwise(NOTHING).alias("ends_sha256"),
    )


#: DuckDB twin over `conversations`: all prefixes as texts of their turns' digests, without a tree.
SQL = r"""
WITH t AS (SELECT conv_id, md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS m, len(regexp_extract_all(coalesce(text, ''), '[^ 	-]+')) AS w,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'m': m, 'w': w} ORDER BY pos) AS turns FROM t GROUP BY conv_id),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT for x in string_split(conv_id::VARCHAR, '')]), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4 AS h FROM c),
r AS (SELECT h.conv_id, list_concat(coalesce(b.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, len(turns) AS size, d, array_to_string([x.m for x in turns[1:d]], '') AS id, CASE WHEN d > 0 THEN turns[d].w ELSE 0 END AS w FROM r, LATERAL (SELECT unnest(generate_series(0, len(turns))) AS d)),
n AS (SELECT id, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends_sha256 FROM p GROUP BY id, d),
k AS (SELECT left(id, len(id) - 32) AS id, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
s AS (SELECT left(n.id, 32 * a) AS id, count(*) FILTER (k.id IS NULL) AS n_leaves, sum((n_convs - 1) * w) AS saved FROM n LEFT JOIN k USING (id), LATERAL (SELECT unnest(generate_series(0, d)) AS a) GROUP BY 1)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN s USING (id) LEFT JOIN k USING (id) LEFT JOIN n u ON n.d > 0 AND u.id = left(n.id, len(n.id) - 32)
"""

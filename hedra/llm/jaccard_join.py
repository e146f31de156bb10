"""Exact self-join of documents on the Jaccard similarity of their word shingles, by prefix filters under several global orders.

Two sets with similarity t or more share a token among the first n - ceil(t*n) + 1 tokens of each, under any order that all sets follow.
Each order here takes rare shingles first (by powers of two of their document frequency) and breaks ties by a hash of its own; a candidate
pair must share prefix tokens under every order before it is verified. Equal sets are one node. Frequencies are counted in shards of the
shingles' key range, which get packed blocks from slices of documents and answer each slice. Shingles of one set only are never posted.
Shingles are told apart by 40 to 48 bits of a 64-bit hash: two sets seem to share a shingle that they don't with odds of about a in 2**40, a the
product of the numbers of shingles that they don't share (10**-8 for sets of a hundred others each), and only a pair within one shingle of the limit can
be decided otherwise by it; equal sets are told by a 64-bit hash.

Groups of near copies are linked first to pivots, one a posting list, and only sets of different components are then compared with each other:
no link between components is lost, and links within one are not sought.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedra.llm.common import gathered, in_batches, mix64, pack, partitions, pick, stage, stage_counted, text_bytes, text_slices, unpack, word_hashes
from hedra.llm.components import FEW, components

SHINGLE = 5
PERCENT = 75
#: Seeds of the orders.
ORDERS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)
#: Sets of one slice from which a shingle's places stay with the slice.
HEAVY = 64
_P = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(body: np.ndarray, bounds: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and their bounds; a text of fewer words has its whole sequence as one."""
    words, at = word_hashes(body, bounds)
    m = max(len(words) - size + 1, 0)
    run = np.zeros(m, np.uint64)
    for k in range(size):
        run = run * _P + words[k : k + m]
    run = mix64(run)
    sets = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= size:
            sets.append(np.unique(run[a : b - size + 1]))
        elif b > a:
            sets.append(mix64(np.array([reduce(lambda x, w: (x * int(_P) + int(w)) & ((1 << 64) - 1), words[a:b], b - a)], np.uint64)))
        else:
            sets.append(np.empty(0, np.uint64))
    return np.concatenate(sets) if sets else np.empty(0, np.uint64), np.concatenate(([0], np.cumsum([len(s) for s in sets], dtype=np.int64)))


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set; 0 for an empty one."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(values), dtype=np.uint64)))
    return np.where(np.diff(bounds) > 0, mix64(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64)), np.uint64(0))


def set_table(own: DataFrame, size: int = SHINGLE) -> DataFrame:
    """key, n and sig of every row of (key, text)."""
    kind = own.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                values, bounds = shingle_sets(*text_bytes(part.column("text")), size)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(np.diff(bounds)), pa.array(signatures(values, bounds).view(np.int64))], names=["key", "n", "sig"])

    return in_batches(own).mapInArrow(run, f"key {kind}, n bigint, sig bigint")


def _least_common(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-n * percent // 100)


def repeated_shingles(own: DataFrame, shards: int, bits: int, size: int = SHINGLE) -> DataFrame:
    """What each slice of texts learns of its shingles: slice, shard and packed parts.

    A slice sends to the shards of the shingles' range its keys with the places of the sets that hold them; of a key that HEAVY or more of its
    sets hold only their number, so that no shard collects the whole list of a frequent shingle. A shard answers with the keys that two or
    more sets hold in all, and their frequency as a power of two. The slice's row with shard -1 has its sets: signatures and sizes, and the
    frequent keys with their places. Equal sets of one slice are one; those of several slices count as several.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task that runs again must give its slices the same names: some shards may have answered the first run's
        names = itertools.count(TaskContext.get().partitionId() << 32)
        for big in gathered(batches, "text", 4 << 20):
            for part, name in zip((big.slice(i, 60_000) for i in range(0, big.num_rows, 60_000)), names, strict=False):
                values, bounds = shingle_sets(*text_bytes(part.column("text")), size)
                sig, first = np.unique(signatures(values, bounds), return_index=True)
                first = first[sig != 0]
                sig, n = sig[sig != 0], np.diff(bounds)[first]
                own = np.concatenate([values[bounds[i] : bounds[i + 1]] for i in first]) if len(first) else values[:0]
                packed = np.unique(own >> np.uint64(64 - bits) << np.uint64(16) | np.repeat(np.arange(len(first), dtype=np.uint64), n))
                key, place = packed >> np.uint64(16), (packed & np.uint64(0xFFFF)).astype(np.uint16)
                start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
                times = np.diff(np.append(start, len(key)))
                often = np.repeat(times >= HEAVY, times)
                heavy, many = key[start[times >= HEAVY]], times[times >= HEAVY].astype(np.uint32)
                rows = [(-1 - (name ^ name >> 32) % shards, name, [pack(sig), pack(n.astype(np.uint32)), pack(heavy), pack(many), pack(place[often])])]
                key, place = key[~often], place[~often]
                lows = np.array([(s << bits) // shards for s in range(shards)] + [1 << bits], np.uint64)
                edge, edge2 = np.searchsorted(key, lows), np.searchsorted(heavy, lows)
                for s in np.flatnonzero(np.diff(edge) + np.diff(edge2)):
                    (a, b), (c, d) = edge[s : s + 2], edge2[s : s + 2]
                    rows.append((int(s), name, [pack(np.diff(key[a:b], prepend=lows[s])), pack(place[a:b]), pack(np.diff(heavy[c:d], prepend=lows[s])), pack(many[c:d])]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.list_(pa.binary())), strict=True)], names=["shard", "slice", "parts"])

    def count(table: pa.Table) -> pa.Table:
        shard, names, parts = int(table.column("shard")[0].as_py()), table.column("slice").to_pylist(), table.column("parts")
        rows = []
        if shard < 0:
            rows = [(name, -1, p) for name, p in zip(names, parts.to_pylist(), strict=True)]
        else:
            low = np.uint64((shard << bits) // shards)
            kinds, got = (np.uint64, np.uint16, np.uint64, np.uint32), ([], [], [], [])
            for p in parts:
                for c, blob, kind in zip(got, p, kinds, strict=True):
                    c.append(unpack(blob.as_py(), kind))
            each, each2 = [len(x) for x in got[0]], [len(x) for x in got[2]]
            key, heavy = (np.concatenate([np.cumsum(x, dtype=np.uint64) + low for x in got[i]]) for i in (0, 2))
            place, many = np.concatenate(got[1]), np.concatenate(got[3])
            known, at = np.unique(np.append(key, heavy), return_inverse=True)
            total = np.bincount(at, np.append(np.ones(len(key)), many), len(known))
            freq = np.log2(total).astype(np.uint8)[at]
            more = total[at[: len(key)]] > 1
            to, to2 = np.cumsum([0, *each]), len(key) + np.cumsum([0, *each2])
            for i, name in enumerate(names):
                own = np.arange(to[i], to[i + 1])[more[to[i] : to[i + 1]]]
                if len(own) or each2[i]:
                    rows.append((name, shard, [pack(np.diff(key[own], prepend=low)), pack(place[own]), pack(freq[own]), pack(freq[to2[i] : to2[i + 1]])]))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, (pa.int64(), pa.int32(), pa.list_(pa.binary())), strict=True)], names=["slice", "shard", "parts"])

    asked = in_batches(own.select("text")).mapInArrow(emit, "shard int, slice bigint, parts array<binary>")
    return asked.groupBy("shard").applyInArrow(count, "slice bigint, shard int, parts array<binary>")


def prefixes(answers: DataFrame, shards: int, bits: int, percent: int = PERCENT) -> DataFrame:
    """Sets that may have a partner, once each: sig, n, all their repeated shingles (tokens) and those of their prefix under each order (p0, p1, ...)."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("shard", "parts")), strict=True), key=lambda r: r[0])
        columns = [[] for _ in range(3 + len(ORDERS))]
        if rows[0][0] == -1 and len(rows) > 1:
            sig, n, heavy, many, there = (unpack(b, t) for b, t in zip(rows[0][1], (np.uint64, np.uint32, np.uint64, np.uint32, np.uint16), strict=True))
            key, place, freq, freq2 = (np.concatenate(x) for x in zip(*[(np.cumsum(unpack(p[0], np.uint64), dtype=np.uint64) + np.uint64((s << bits) // shards), unpack(p[1], np.uint16), unpack(p[2], np.uint8), unpack(p[3], np.uint8)) for s, p in rows[1:]], strict=True))
            key, place, freq = np.append(key, np.repeat(heavy, many)), np.append(place, there), np.append(freq, np.repeat(freq2, many))
            order = np.lexsort((key, place))
            key, place, freq = key[order], place[order], freq[order]
            start = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
            stop = np.append(start[1:], len(place))
            own = place[start]
            out = []
            for i, a, b, m in zip(own, start, stop, stop - start - _least_common(n[own].astype(np.int64), percent) + 1, strict=True):
                if m > 0:  # shingles of this set only come first in every order
                    mine = key[a:b]
                    tops = [mine[np.lexsort((mix64(mine ^ np.uint64(s)), freq[a:b]))[:m]].view(np.int64) for s in ORDERS]
                    out.append((int(sig[i].view(np.int64)), int(n[i]), mine.view(np.int64), *tops))
            columns = list(zip(*out, strict=True)) if out else columns
        return pa.table([pa.array(c, pa.int64() if i < 2 else pa.list_(pa.int64())) for i, c in enumerate(columns)], names=["sig", "n", "tokens", *[f"p{k}" for k in range(len(ORDERS))]])

    sets = answers.groupBy("slice").applyInArrow(run, "sig bigint, n bigint, tokens array<bigint>, " + ", ".join(f"p{k} array<bigint>" for k in range(len(ORDERS))))
    return sets.dropDuplicates(["sig"])  # equal in every column


def _near_size(a: Column, b: Column, percent: int) -> Column:
    return (a * 100 >= b * percent) & (b * 100 >= a * percent)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components: those (ca, cb) of pairs of sets (a, b), found under the first order, that share a prefix token under every other order as well and are similar enough."""
    more = [f"p{k}" for k in range(1, len(ORDERS))]
    left = sets.select(F.col("sig").alias("a"), F.col("n").alias("n1"), F.col("tokens").alias("t1"), *[F.col(p).alias(f"{p}a") for p in more])
    right = sets.select(F.col("sig").alias("b"), F.col("n").alias("n2"), F.col("tokens").alias("t2"), *[F.col(p).alias(f"{p}b") for p in more])
    both = pairs.join(left, "a").join(right, "b")
    for p in more:
        both = both.where(F.arrays_overlap(f"{p}a", f"{p}b"))
    common = F.size(F.array_intersect("t1", "t2")).cast("bigint")
    return both.where(common * 100 >= (F.col("n1") + F.col("n2") - common) * percent).select(F.col("ca").alias("a"), F.col("cb").alias("b"))


class Block:
    """Many sets, packed: signatures, sizes, components, and the sets' tokens with bits that tell in which prefixes they stand."""

    def __init__(self, parts: list[bytes]) -> None:
        self.sig, self.n, self.comp, counts, self.tokens, self.marks = (np.frombuffer(b, t) for b, t in zip(parts, (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint8), strict=True))
        self.owner = np.repeat(np.arange(len(counts)), counts)

    @staticmethod
    def parts(rows: pa.Table) -> list[bytes]:
        rows = rows.sort_by("sig").combine_chunks()
        flat = lambda c: (np.asarray(pc.list_flatten(rows.column(c))), np.asarray(pc.list_value_length(rows.column(c)), dtype=np.int64))
        tokens, counts = flat("tokens")
        owner, marks = np.repeat(np.arange(len(counts)), counts), np.zeros(len(tokens), np.uint8)
        order = np.lexsort((tokens, owner))
        tokens = tokens[order]
        for k in range(len(ORDERS)):
            prefix, own = flat(f"p{k}")
            of = np.repeat(np.arange(len(own)), own)
            both = np.lexsort((np.append(np.zeros(len(tokens), np.int8), np.ones(len(prefix), np.int8)), np.append(tokens, prefix), np.append(owner, of)))
            hit = np.flatnonzero(both >= len(tokens))  # a prefix token stands right after the same token of its set
            marks[both[hit - 1]] |= np.uint8(1 << k)
        whole = lambda c: np.asarray(rows.column(c), dtype=np.int64).tobytes()
        return [whole("sig"), whole("n"), whole("comp"), counts.tobytes(), tokens.tobytes(), marks.tobytes()]

    def common(self, other: Block, bit: int | None = None, width: int = 2048) -> np.ndarray:
        """Numbers of tokens in common, of all sets here with all sets there; bit: of the prefixes of that order."""
        mine, theirs = (x.marks >> bit & 1 > 0 if bit is not None else np.ones(len(x.tokens), bool) for x in (self, other))
        known = np.intersect1d(self.tokens[mine], other.tokens[theirs])
        total = np.zeros((len(self.sig), len(other.sig)), np.float32)
        sides = []
        for x, use in ((self, mine), (other, theirs)):
            at = np.minimum(np.searchsorted(known, x.tokens[use]), max(len(known) - 1, 0))
            here = known[at] == x.tokens[use] if len(known) else np.zeros(int(use.sum()), bool)
            order = np.argsort(at[here], kind="stable")
            sides.append((at[here][order], x.owner[use][here][order], len(x.sig)))
        for a in range(0, len(known), width):
            dense = []
            for at, owner, n in sides:
                i, j = np.searchsorted(at, [a, a + width])
                m = np.zeros((n, min(width, len(known) - a)), np.float32)
                m[owner[i:j], at[i:j] - a] = 1
                dense.append(m)
            total += dense[0] @ dense[1].T
        return total

    def linked(self, other: Block, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Places here and there of links that join what all links between different components join."""
        may = (self.comp[:, None] != other.comp[None, :]) & (self.n[:, None] * 100 >= other.n[None, :] * percent) & (other.n[None, :] * 100 >= self.n[:, None] * percent)
        for k in range(len(ORDERS)):
            if not may.any():
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            may &= self.common(other, k) > 0
        i, j = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
        if not len(i):
            return i, j
        c = self.common(other)
        a, b = np.nonzero(may & (c * 100 >= (self.n[:, None] + other.n[None, :] - c) * percent))
        top: dict[int, int] = {}

        def root(x: int) -> int:
            while x in top:
                x = top[x]
            return x

        keep = []
        for k, (x, y) in enumerate(zip(self.comp[a].tolist(), other.comp[b].tolist(), strict=True)):
            x, y = root(x), root(y)
            if x != y:
                top[max(x, y)] = min(x, y)
                keep.append(k)
        return a[keep], b[keep]


def block_links(sets: DataFrame, placed: DataFrame, large: DataFrame, percent: int, members: int = 1024, tokens: int = 200_000) -> DataFrame:
    """Edges between different components, of sets that share a token of a long posting list.

    Sets are packed into blocks by the longest list that they stand in, and those of one component apart; only blocks that meet in a list
    and are not of one component are compared, each pair of blocks in a task, by products of 0/1 matrices: no pair of sets is ever a row.
    """
    mine = placed.join(large, "token")
    home = mine.groupBy("sig", "n", "comp").agg(F.max_by("token", F.struct("size", "token")).alias("home"))
    parts = home.groupBy("home", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    parts = parts.withColumn("own", F.when(F.col("c") >= members // 4, F.col("comp")).otherwise(F.lit(0)))
    cuts = parts.groupBy("home", "own").agg(F.greatest(F.ceil(F.sum("c") / members), F.ceil(F.sum("s") / tokens)).alias("cuts"))
    named = home.join(parts.select("home", "comp", "own"), ["home", "comp"]).join(cuts, ["home", "own"])
    named = stage(named.select("sig", "comp", "own", F.xxhash64("home", "own", F.pmod(F.xxhash64("sig"), F.col("cuts"))).alias("block")), "blocked")

    def packed(rows: pa.Table) -> pa.Table:
        return pa.table([pa.array([rows.column("block")[0].as_py()], pa.int64()), pa.array([Block.parts(rows)], pa.list_(pa.binary()))], names=["block", "parts"])

    whole = named.select("sig", "comp", "block").join(sets, "sig")
    blocks = stage(whole.groupBy("block").applyInArrow(packed, "block bigint, parts array<binary>"), "blocks")
    there = mine.select("sig", "token").join(named, "sig").groupBy("token", "block").agg(F.max("own").alias("own"))
    other = there.select("token", F.col("block").alias("block2"), F.col("own").alias("own2"))
    pairs = there.join(other, "token").where((F.col("block") <= F.col("block2")) & ((F.col("own") == 0) | (F.col("own") != F.col("own2")))).select("block", "block2").distinct()
    tasks = pairs.join(blocks, "block").join(blocks.select(F.col("block").alias("block2"), F.col("parts").alias("parts2")), "block2").select("parts", "parts2")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two in zip(batch.column("parts").to_pylist(), batch.column("parts2").to_pylist(), strict=True):
                left, right = Block(one), Block(two)
                i, j = left.linked(right, percent)
                yield pa.RecordBatch.from_arrays([pa.array(left.comp[i]), pa.array(right.comp[j])], names=["a", "b"])

    return tasks.repartition(partitions(sets.sparkSession)).mapInArrow(compare, "a bigint, b bigint")


def classes(sets: DataFrame, percent: int = PERCENT, rounds: int = 2, short: int = 32) -> DataFrame:
    """node (a set's signature) and comp, the smallest node that links of similar sets reach. `sets` is the result of prefixes(), written.

    Links that are found name the components that they join; a graph of those alone, which shrinks, is solved each time. Rounds of
    pivots (first the set of most repeated shingles of each list, then any) link most of a group at the cost of its size. What is still apart is compared within lists: in lists of `short` or fewer by pairs, in longer ones by blocks.
    """
    narrow = sets.select("sig", "n", F.size("p0").alias("m"), "p0")
    nodes = sets.select(F.col("sig").alias("node"))
    comps, known = nodes.withColumn("comp", F.col("node")), False

    def listed(turn: int) -> tuple[DataFrame, DataFrame]:
        """Postings with components, and lists that join different components."""
        # joined before the explosion, so that a set of many tokens is one row there
        placed = narrow.withColumn("comp", F.col("sig")) if not known else narrow.join(comps, F.col("sig") == F.col("node")).drop("node")
        placed = placed.select("sig", "n", "m", "comp", F.explode("p0").alias("token"))
        pivot = F.max_by(F.struct("sig", "comp", "n"), F.struct(F.col("m") if turn == 0 else F.lit(0), F.xxhash64("sig", F.lit(turn)), "sig")).alias("pivot")
        return placed, placed.groupBy("token").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count(F.lit(1)).alias("size"), pivot).where("c1 != c2").drop("c1", "c2")

    def learn(new: DataFrame) -> bool:
        nonlocal comps, known
        new, found = stage_counted(new, "links")
        if not found:
            return False
        more = components(new, found).select(F.col("node").alias("was"), F.col("comp").alias("top"))
        more = F.broadcast(more) if found <= FEW else more  # 16 bytes a node
        comps, known = stage(comps.join(more, F.col("comp") == F.col("was"), "left").select("node", F.coalesce("top", "comp").alias("comp")), "comps"), True
        return True

    def compare(pairs: DataFrame) -> bool:
        # written, so that neither plan is long: the driver plans all that is left anew after each shuffle
        pairs, found = stage_counted(pairs.distinct(), "pairs")
        return found > 0 and learn(verified(pairs, sets, percent))

    for turn in range(rounds):
        placed, lists = listed(turn)
        found = placed.join(lists, "token").select("sig", "n", "comp", "pivot").where((F.col("comp") != F.col("pivot.comp")) & _near_size(F.col("n"), F.col("pivot.n"), percent))
        ends = F.struct("sig", "comp"), F.struct("pivot.sig", "pivot.comp")
        found = found.select(F.least(*ends).alias("x"), F.greatest(*ends).alias("y"))
        if not compare(found.select(F.col("x.sig").alias("a"), F.col("y.sig").alias("b"), F.col("x.comp").alias("ca"), F.col("y.comp").alias("cb"))):
            break
    placed, lists = listed(rounds)
    few = placed.join(lists.where(F.col("size") <= short).select("token"), "token", "left_semi").drop("m")
    other = few.select("token", F.col("sig").alias("s2"), F.col("n").alias("n2"), F.col("comp").alias("c2"))
    near = few.join(other, "token").where((F.col("sig") < F.col("s2")) & (F.col("comp") != F.col("c2")) & _near_size(F.col("n"), F.col("n2"), percent))
    compare(near.select(F.col("sig").alias("a"), F.col("s2").alias("b"), F.col("comp").alias("ca"), F.col("c2").alias("cb")))
    placed, lists = listed(rounds)
    large, found = stage_counted(lists.where(F.col("size") > short).select("token", "size"), "lists")
    if found:
        learn(block_links(sets, placed.drop("m"), large, percent))
    return comps


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """Classes of documents by links of similarity `percent` or more: key, n_shingles and component_id, the smallest key reachable.

    Words are runs without blanks, A-Z in lower case. A text of fewer words than a shingle has its whole sequence as one; a null text, or one
    without words, has none and is linked with nothing. A row with a null key is linked with nothing and its class is null; rows that share
    a key are nodes of their own with that key. An empty table gives an empty result; other columns are ignored. `docs` should come from files (see
    common.stage) and not from a shuffle, whose order can differ where a task runs again.
    """
    own = pick(docs, key=key, text=text)
    table, rows = stage_counted(set_table(own, size), "sets")
    bits = min(48, max(40, math.ceil(math.log2(max(rows, 1))) + 22))
    cores = partitions(docs.sparkSession)
    shards = max(cores, rows // 4000)
    sets = stage(prefixes(repeated_shingles(own, shards, bits, size), shards, bits, percent), "prefixes")
    comps = classes(sets, percent)
    least = table.where("n > 0 AND key IS NOT NULL").groupBy("sig").agg(F.min("key").alias("first"))
    top = least.join(comps, F.col("sig") == F.col("node")).groupBy("comp").agg(F.min("first").alias("top"))
    named = least.join(comps.join(top, "comp").select(F.col("node").alias("sig"), "top"), "sig", "left").select("sig", F.least("first", "top").alias("top"))
    joined = table.join(named, "sig", "left")
    return joined.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("key").isNotNull(), F.col("top")).otherwise(F.col("key")).alias("component_id"))

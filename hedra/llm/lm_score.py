"""Language-model scores from an n-gram trie in shards of Elias-Fano levels.

Texts become slices of token numbers, written once. Each slice sends its distinct n-grams with their training counts: words to the shards of the
words, and pairs of words with everything that follows them to the shards of the pairs. A shard builds its part of the trie level by level in
mapped files (see elias_fano.Level), searches it for what was asked, by successor within the context's range, and answers each slice.

A trie shard begins with pairs, addressed by a hash; below them a node is its index in the level above and a successor's number among words, REL
bits of its hash. Two successors of one context can share a number with odds of their count in 2**REL; then they share their counts. Answers are
quantised probabilities. An n-gram that no other slice asks for gets 0, as the slice has its whole count. Pairs that stand before a large part of
all tokens (a thousand of them at most) are split over several shards by successor.

Smoothing: words by relative frequency, where unseen words share the mass of words seen once (Good-Turing); longer n-grams by a Dirichlet
prior on the shorter ones: p(c|h) = (count(hc) + prior * p(c|h')) / (count(h) + prior). The level of pairs stores count / all tokens, so that a
slice can tell the pair's count, and deeper ones count / (count(h) + prior).
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedra.llm.common import gathered, in_batches, mix64, pack, partitions, pick, stage, text_bytes, unpack, word_hashes
from hedra.llm.elias_fano import Level, dequantise, quantise

ORDER = 3
PRIOR = 40.0
#: The end and the start of a text, as word hashes; words have the upper 56 bits of theirs.
END, START = np.uint64(0x9D2C5680CA3F1B), np.uint64(0x5BD1E995A7F03D)
#: Bits of a successor's number.
REL = 24
#: A pair before one in so many tokens may be split.
HOT = 1024
#: Tokens a shard.
SHARD_TOKENS = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)

_MESSAGE = "slice string, shard int, level int, parts array<binary>"


def _pairs(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix64(mix64(before) * _P + word)


def _before(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each token, START at a text's first, and where texts begin."""
    first = np.zeros(len(hashes), bool)
    first[bounds[:-1]] = True
    return np.where(first, START, np.concatenate((hashes[:1], hashes[:-1]))), first


def token_slices(own: DataFrame, slice_bytes: int) -> DataFrame:
    """Slices of (key, text, train): keys, and as packed parts: word hashes, training counts, tokens (ranks by frequency, small for most), the hashes' places by rank,
    bounds, train; numbers of tokens, training tokens and training texts; pairs that stand before many tokens, and how many."""
    kind = own.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(batches, "text", slice_bytes):
            words, at = word_hashes(*text_bytes(part.column("text")))
            n = part.num_rows
            bounds = at + np.arange(n + 1)
            hashes = np.full(len(words) + n, END, np.uint64)
            is_word = np.ones(len(hashes), bool)
            is_word[bounds[1:] - 1] = False
            hashes[is_word] = words >> np.uint64(8)
            pairs = np.sort(_pairs(_before(hashes, bounds)[0], hashes)[is_word])
            start = np.flatnonzero(np.concatenate((np.ones(min(len(pairs), 1), bool), pairs[1:] != pairs[:-1])))
            times = np.diff(np.append(start, len(pairs)))
            hot = np.flatnonzero(times * HOT >= len(hashes))
            known, tokens = np.unique(hashes, return_inverse=True)
            train = np.asarray(part.column("train").fill_null(False))
            counts = np.bincount(tokens[np.repeat(train, np.diff(bounds))], minlength=len(known))
            by_rank = np.argsort(-np.bincount(tokens, minlength=len(known)), kind="stable")
            rank = np.empty(len(known), np.uint32)
            rank[by_rank] = np.arange(len(known), dtype=np.uint32)
            parts = [pack(np.diff(known, prepend=np.uint64(0))), pack(counts.astype(np.uint32)), pack(rank[tokens]), pack(by_rank.astype(np.uint32)), pack(np.diff(bounds).astype(np.uint32)), pack(train.astype(np.uint8))]
            sizes = [len(hashes), int(counts.sum()), int(train.sum())]
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            yield pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().hex]), one(part.column("key")), pa.array([parts], pa.list_(pa.binary())), *(pa.array([x]) for x in sizes), one(pa.array(pairs[start[hot]].view(np.int64))), one(pa.array(times[hot]))],
                names=["slice", "keys", "parts", "tokens", "trained", "texts", "hot", "times"],
            )

    return in_batches(own).mapInArrow(run, f"slice string, keys array<{kind}>, parts array<binary>, tokens bigint, trained bigint, texts bigint, hot array<bigint>, times array<bigint>")


def _rows(rows: list[tuple]) -> pa.Table:
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.binary()))
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["slice", "shard", "level", "parts"])


def _messages(table: pa.Table) -> list[tuple]:
    return sorted(zip(*(table.column(c).to_pylist() for c in ("slice", "shard", "level", "parts")), strict=True), key=lambda r: (r[2], r[1], r[0]))


def _lows(bits: int, shards: int) -> np.ndarray:
    """The first key of each shard, and the end of the last."""
    return np.array([-(-(s << bits) // shards) for s in range(shards)] + [1 << bits], np.uint64)


def word_level(slices: DataFrame, shards: int) -> DataFrame:
    """Answers of level 1: training count of each word of a slice; the shard's words and its words seen once."""
    lows = _lows(56, shards)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, parts in zip(batch.column("slice").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                known, counts = np.cumsum(unpack(parts[0], np.uint64), dtype=np.uint64), unpack(parts[1], np.uint32)
                edge = np.searchsorted(known, lows)
                rows = []
                for s in np.flatnonzero(np.diff(edge)):
                    a, b = edge[s], edge[s + 1]
                    rows.append((name, int(s), 1, [pack(np.diff(known[a:b], prepend=lows[s])), pack(counts[a:b])]))
                yield from _rows(rows).to_batches()

    def answer(table: pa.Table) -> pa.Table:
        low = lows[table.column("shard")[0].as_py()]
        asked = [(name, shard, np.cumsum(unpack(p[0], np.uint64), dtype=np.uint64), unpack(p[1], np.uint32)) for name, shard, _, p in _messages(table)]
        known, place = np.unique(np.concatenate([x[2] for x in asked]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([x[3] for x in asked])).astype(np.int64)
        learned = counts > 0
        # the words follow the empty context
        level = Level(np.zeros(int(learned.sum()), np.uint64), known[learned], np.ones(int(learned.sum())), counts[learned])
        counts = level.find(np.zeros(len(known), np.uint64), known)[1]
        n1, at, rows = int((counts == 1).sum()), 0, []
        for name, shard, own, _ in asked:
            mine = place[at : at + len(own)]
            at += len(own)
            rows.append((name, shard, 1, [pack(counts[mine].astype(np.uint64)), pack(np.array([level.n, n1], np.int64))]))
        return _rows(rows)

    return slices.select("slice", "parts").mapInArrow(ask, _MESSAGE).groupBy("shard").applyInArrow(answer, _MESSAGE)


class Grams:
    """Distinct n-grams of a slice, level by level: pairs by key, then (place of the context, number of the successor)."""

    def __init__(self, parts: list[bytes], model: dict) -> None:
        """parts: word hashes, tokens, places by rank, bounds, train."""
        known = np.cumsum(unpack(parts[0], np.uint64), dtype=np.uint64)
        self.tokens = unpack(parts[2], np.uint32)[unpack(parts[1], np.uint32)]
        self.bounds = np.concatenate(([0], np.cumsum(unpack(parts[3], np.uint32), dtype=np.int64)))
        self.train = unpack(parts[4], np.uint8).astype(bool)
        learned = np.repeat(self.train, np.diff(self.bounds))
        hashes = known[self.tokens]
        before, self.first = _before(hashes, self.bounds)
        down = np.uint64(64 - model["bits"])
        pair = _pairs(before, hashes) >> down
        rel = (mix64(hashes) >> np.uint64(64 - REL))
        here = np.flatnonzero(~self.first)  # tokens with a pair before them
        context, hot = pair[here - 1], model["hot"]
        part = lambda pair, number: mix64(pair * _P + np.uint64(1) + number) >> down
        split, whole, parts_of = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, context), len(hot) - 1)
            split = np.flatnonzero(hot[at] == context)
            context[split] = part(context[split], rel[here[split]] % model["salts"][at[split]])
            # every part has the pair's count, whatever follows here
            mine = np.unique(at[split])
            salts = model["salts"][mine].astype(np.int64)
            whole = np.repeat(hot[mine], salts)
            parts_of = part(whole, (np.arange(len(whole)) - np.repeat(np.cumsum(salts) - salts, salts)).astype(np.uint64))
        self.keys, place = np.unique(np.concatenate((pair, parts_of)), return_inverse=True)
        place, parts_at = place[: len(pair)], place[len(pair) :]
        counts = np.bincount(place[learned], minlength=len(self.keys)).astype(np.uint32)
        counts[parts_at] = counts[np.searchsorted(self.keys, whole)]
        #: of each level: places of contexts in the level above, successors, training counts; tokens that end one, and their place in the level
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(len(self.keys), np.int64), self.keys, counts)]
        self.ends = [(np.arange(len(pair)), place)]
        parent = place[here - 1]
        parent[split] = np.searchsorted(self.keys, context[split])
        for level in range(3, model["order"] + 1):
            if level > 3:
                where, there = self.ends[-1]
                full = np.full(len(pair), -1, np.int64)
                full[where] = there
                here = np.flatnonzero(~self.first)
                parent = full[here - 1]
                here, parent = here[parent >= 0], parent[parent >= 0]
            both, place = np.unique(parent.astype(np.uint64) << np.uint64(REL) | rel[here], return_inverse=True)
            self.levels.append(((both >> np.uint64(REL)).astype(np.int64), both & np.uint64((1 << REL) - 1), np.bincount(place[learned[here]], minlength=len(both)).astype(np.uint32)))
            self.ends.append((here, place))


def pair_levels(slices: DataFrame, model: dict) -> DataFrame:
    """Answers of level 2: codes of a slice's pairs and of all longer n-grams."""
    lows, prior = _lows(model["bits"], model["shards"]), model["prior"]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, parts in zip(batch.column("slice").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                grams, rows = Grams([parts[0], *parts[2:6]], model), []
                edges = [np.searchsorted(grams.keys, lows)]
                for parent, _, _ in grams.levels[1:]:
                    edges.append(np.searchsorted(parent, edges[-1]))
                for s in np.flatnonzero(np.diff(edges[0])):
                    a, b = edges[0][s : s + 2]
                    message = [pack(np.diff(grams.keys[a:b], prepend=lows[s])), pack(grams.levels[0][2][a:b])]
                    for (parent, rel, counts), edge in zip(grams.levels[1:], edges[1:], strict=True):
                        c, d = edge[s : s + 2]
                        message += [pack(np.bincount(parent[c:d] - a, minlength=b - a).astype(np.uint32)), pack(rel[c:d].astype(np.uint32)), pack(counts[c:d])]
                        a, b = c, d
                    rows.append((name, int(s), 2, message))
                yield from _rows(rows).to_batches()

    def answer(table: pa.Table) -> pa.Table:
        asked = _messages(table)
        low = lows[asked[0][1]]
        inner = [np.cumsum(unpack(m[3][0], np.uint64), dtype=np.uint64) for m in asked]
        known, place = np.unique(np.concatenate(inner), return_inverse=True)
        count = np.bincount(place, np.concatenate([unpack(m[3][1], np.uint32) for m in asked]), len(known))
        times = np.bincount(place, minlength=len(known))
        learned = count > 0
        trie = Level(np.zeros(int(learned.sum()), np.uint64), known[learned], count[learned] / max(model["n"], 1), count[learned])
        code, _, node, _ = trie.find(np.zeros(len(known), np.uint64), known)
        code[times < 2] = 0
        answers, sizes = [[pack(code[place[a : a + len(x)]])] for x, a in zip(inner, np.cumsum([0, *(len(x) for x in inner)]), strict=False)], [len(x) for x in inner]
        for k in range(2, len(asked[0][3]), 3):
            # contexts: their places among the known ones above
            starts = np.cumsum([0, *sizes])
            rels = [unpack(m[3][k + 1], np.uint32) for m in asked]
            above = np.concatenate([np.repeat(place[a : a + n], unpack(m[3][k], np.uint32)) for a, n, m in zip(starts, sizes, asked, strict=False)])
            both, place = np.unique(above.astype(np.uint64) << np.uint64(32) | np.concatenate(rels), return_inverse=True)
            own = np.bincount(place, np.concatenate([unpack(m[3][k + 2], np.uint32) for m in asked]), len(both))
            times = np.bincount(place, minlength=len(both))
            above, rel = (both >> np.uint64(32)).astype(np.int64), both & np.uint64(0xFFFFFFFF)
            # a context that was never learned has no node
            context = np.where(learned[above], node[above], trie.n).astype(np.uint64)
            total, learned = count[above], own > 0
            order = np.lexsort((rel[learned], context[learned]))
            pick_ = lambda x, l=learned, o=order: x[l][o]
            trie = Level(pick_(context), pick_(rel), pick_(own) / (pick_(total) + prior), pick_(own))
            code, _, node, _ = trie.find(context, rel)
            code[times < 2] = 0
            count, sizes = own, [len(x) for x in rels]
            for one, a, n in zip(answers, np.cumsum([0, *sizes]), sizes, strict=False):
                one.append(pack(code[place[a : a + n]]))
        return _rows([(name, shard, 2, one) for (name, shard, _, _), one in zip(asked, answers, strict=True)])

    return slices.select("slice", "parts").mapInArrow(ask, _MESSAGE).groupBy("shard").applyInArrow(answer, _MESSAGE)


def slice_scores(table: pa.Table, model: dict) -> pa.Table:
    """Scores of a slice's texts from its parts (level 0) and all answers."""
    rows = _messages(table)
    kind = table.schema.field("keys").type.value_type
    keys = next(k for k in table.column("keys").to_pylist() if k is not None)
    grams = Grams(next(r[3] for r in rows if r[2] == 0), model)
    n, v, prior = model["n"], model["v"], model["prior"]
    words = np.concatenate([unpack(p[0], np.uint64) for *_, level, p in rows if level == 1])[grams.tokens].astype(np.float64)
    unseen = (model["n1"] + 0.5) / (n + 1)
    p = dequantise(quantise(np.where(words > 0, words / max(n, 1) * (1 - unseen), unseen)))
    total = np.where(grams.first, model["texts"], np.concatenate((words[:1], words[:-1])))  # of the word before
    found = [r[3] for r in rows if r[2] == 2]
    counts = np.zeros(0)
    for k, ((above, _, own), (ends, place)) in enumerate(zip(grams.levels, grams.ends, strict=True)):
        # what no other slice asks for has its whole count here
        base = np.full(len(own), float(max(n, 1))) if k == 0 else counts[above] + prior
        code = np.concatenate([unpack(x[k], np.uint16) for x in found])
        share = dequantise(np.where(code > 0, code, np.where(own > 0, quantise(own / base), 0)).astype(np.uint16))
        counts, before = np.rint(share * base), counts
        if k == 0:
            p = counts[place] / (total + prior) + prior / (total + prior) * p
        else:
            p[ends] = share[place] + (prior / (before[above] + prior))[place] * p[ends]
    sums = lambda x: np.add.reduceat(x, grams.bounds[:-1])  # noqa: E731  every text has an end
    base = np.log10((words + 0.5) / (n + 0.5 * (v + 1)))
    return pa.table([pa.array(keys, kind), pa.array(~grams.train), pa.array(np.diff(grams.bounds)), pa.array(sums((words > 0).astype(np.int64))), pa.array(np.full(len(keys), n, np.int64)), pa.array(sums(base)), pa.array(sums(np.log10(p)) if n else np.zeros(len(keys)))], names=["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score_texts(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", order: int = ORDER, prior: float = PRIOR, slice_bytes: int = 6 << 20, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Scores of every whole text under a model, of n-grams of up to `order` (2 or more) tokens, of the texts where `train` (over column `key`) holds.

    Returns key, held_out, n_tokens, n_known (tokens seen in training), train_tokens, base_score (words alone, half a count added) and score
    (log10 probability). A null or empty text is its end alone; a null `train` is false. With nothing to learn from every score is 0.
    Repeated rows and null keys stay rows of their own; an empty table gives an empty result; other columns are ignored. Memory in a task is
    bounded by `slice_bytes` of text (or the longest text) and by a shard's n-grams, of about `shard_tokens` tokens. The driver gets a few sums, a row
    a shard, and HOT pairs at most.
    """
    spark = docs.sparkSession
    own = pick(docs, key=key, text=text).withColumn("train", train)
    kind = own.schema["key"].dataType.simpleString()
    slices = stage(token_slices(own, slice_bytes), "slices")
    total = slices.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "trained", "texts")]).first()
    shards = max(partitions(spark), total["tokens"] // shard_tokens)
    each = slices.select(F.explode(F.arrays_zip("hot", "times")).alias("x")).groupBy("x.hot").agg(F.sum("x.times").alias("times"))
    large = each.where(F.col("times") * HOT >= total["tokens"]).collect()  # HOT rows at most
    bits = min(56, max(32, round(math.log2(total["tokens"] + 1)) + 15))
    hot = {int(np.array([r["hot"]], np.int64).view(np.uint64)[0]) >> (64 - bits): -(-2 * r["times"] * shards // total["tokens"]) for r in large}
    hot = sorted((k, s) for k, s in hot.items() if s > 1)
    answers = stage(word_level(slices, shards), "words")
    # a row a shard: its words, and those seen once
    seen = answers.groupBy("shard").agg(F.first(F.element_at("parts", 2)).alias("part")).collect()
    sizes = np.array([np.frombuffer(unpack(bytes(r["part"]), np.int64).tobytes(), np.int64) for r in seen], np.int64).reshape(-1, 2).sum(0)
    model = {
        "order": order, "prior": prior, "shards": shards, "bits": bits, "n": total["trained"], "texts": total["texts"], "v": int(sizes[0]), "n1": int(sizes[1]),
        "hot": np.array([k for k, _ in hot], np.uint64), "salts": np.array([s for _, s in hot], np.uint64),
    }
    parts = F.array(*[F.element_at("parts", i) for i in (1, 3, 4, 5, 6)])
    known = slices.select("slice", F.lit(-1).alias("shard"), F.lit(0).alias("level"), parts.alias("parts"), "keys")
    known = known.unionByName(answers, allowMissingColumns=True).unionByName(pair_levels(slices, model), allowMissingColumns=True)
    out: Callable[[pa.Table], pa.Table] = lambda table: slice_scores(table, model)
    done = known.groupBy("slice").applyInArrow(out, f"key {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return done.withColumnRenamed("key", key)

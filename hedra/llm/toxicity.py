"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is an embedding of the word beside one of its character n-grams (with the blanks around it). Two gated recurrent layers read a window
from either end, attention weighs their states, and a linear output judges the window. Windows overlap by half and cover whole texts; a text's score is a
logistic function of its two greatest window outputs and its number of windows.

The network learns from windows of a bounded sample of labelled texts on the driver. A toxic text need not be toxic in every window: after a first
turn, only those of its windows count that the network finds the worst (multiple-instance learning).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedra.llm.common import _LOWER, in_batches, mix64, pick, text_bytes, text_slices, word_hashes

#: Words of a window, and between the starts of two.
WINDOW, STEP = 32, 16
#: Bytes of a character n-gram.
GRAM = 4
#: Words and n-grams with an embedding of their own: the most frequent of those that so many texts of the sample hold. Others share one.
MOST, LEAST_TEXTS = 1 << 14, 8
WORD_DIM, GRAM_DIM, HIDDEN = 8, 8, 8
#: Windows that run through the network together.
TOGETHER = 2048
#: Bytes of a window that is learned from; longer ones, of words without end, are only scored.
LONGEST = 1024

_BARE = _LOWER.copy()
_BARE[[b for b in range(128) if not (97 <= b < 123 or 65 <= b < 91)]] = 32


def tokens(body: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The body in lower case with blanks for all ASCII but letters; hashes, starts and ends of its words (letter runs); where each text's words begin."""
    low = _BARE[body]
    hashes, at = word_hashes(low, bounds)
    first = np.zeros(len(low) + 1, bool)
    first[bounds] = True
    word = low != 32
    starts = np.flatnonzero(word & (first[:-1] | np.concatenate(([True], ~word[:-1])))) if len(low) else np.empty(0, np.int64)
    ends = np.flatnonzero(word & (first[1:] | np.concatenate((~word[1:], [True])))) + 1 if len(low) else starts
    return low, hashes, starts, ends, at


def _row(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Place of each key among the sorted known ones, from 1; 0 for others."""
    at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
    return np.where(known[at] == keys, at + 1, 0) if len(known) else at


class Words:
    """The distinct words of some texts: the place of each word among them in order, and their hashes and n-gram hashes."""

    def __init__(self, low: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        _, first, self.row = np.unique(hashes, return_index=True, return_inverse=True)
        self.word = hashes[first]
        # a blank stands before and after each word
        n = np.maximum(ends[first] - starts[first] + 2 - GRAM + 1, 1)
        self.ends = np.cumsum(n)
        owner = np.repeat(np.arange(len(first)), n)
        at = starts[first][owner] - 1 + np.arange(len(owner)) - (self.ends - n)[owner]
        mixed = np.zeros(len(owner), np.uint64)
        for k in range(GRAM):
            inside = (at + k >= starts[first][owner]) & (at + k < ends[first][owner])
            mixed = mixed * np.uint64(257) + np.where(inside, low[np.clip(at + k, 0, max(len(low) - 1, 0))], 32).astype(np.uint64)
        self.owner, self.gram, self.size = owner, mix64(mixed), n

    def rows(self, p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Embeddings' rows of words and n-grams."""
        return _row(self.word, p["known_words"]), _row(self.gram, p["known_grams"])

    def inputs(self, p: dict[str, np.ndarray]) -> np.ndarray:
        word, gram = self.rows(p)
        grams = np.add.reduceat(p["grams"][gram], self.ends - self.size, axis=0) / np.sqrt(self.size)[:, None]
        return np.hstack((p["words"][word], grams.astype(np.float32)))


def windows(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and number of words of every window; texts without words have none."""
    n = np.diff(at)
    count = np.where(n > 0, np.maximum(1, -(-(n - (WINDOW - STEP)) // STEP)), 0)
    text = np.repeat(np.arange(len(n)), count)
    step = np.arange(len(text)) - (np.cumsum(count) - count)[text]
    return text, at[text] + step * STEP, np.minimum(n[text] - step * STEP, WINDOW)


def frequent(keys: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The sorted keys that LEAST_TEXTS texts hold (MOST at most, the most frequent first)."""
    order = np.lexsort((text, keys))
    fresh = np.append(True, (keys[order][1:] != keys[order][:-1]) | (text[order][1:] != text[order][:-1]))[: len(keys)]
    found, n = np.unique(keys[order][fresh], return_counts=True)
    best = np.lexsort((found, -n))[:MOST]
    return np.sort(found[best[n[best] >= LEAST_TEXTS]])


def fresh(known_words: np.ndarray, known_grams: np.ndarray, seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, size: (rng.standard_normal(shape) * size).astype(np.float32)
    wide, gates = WORD_DIM + GRAM_DIM, 3 * HIDDEN
    p = {"known_words": known_words, "known_grams": known_grams, "words": draw(len(known_words) + 1, WORD_DIM, size=0.1), "grams": draw(len(known_grams) + 1, GRAM_DIM, size=0.1), "x": draw(wide, 2 * gates, size=0.4), "bias": np.zeros(2 * gates, np.float32)}
    p |= {"u0": draw(HIDDEN, gates, size=0.3), "u1": draw(HIDDEN, gates, size=0.3), "attention": draw(2 * HIDDEN, size=0.3), "out": draw(2 * HIDDEN, size=0.3), "base": np.zeros(1, np.float32)}
    return p


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def forward(p: dict[str, np.ndarray], rows: np.ndarray, place: np.ndarray, real: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
    """Output of each window. rows: distinct words' inputs times the input weights; place: (WINDOW, windows) of those rows; real: which places have a word.
    keep: with what the backward pass needs."""
    steps, n = place.shape
    states, kept = np.zeros((steps, n, 2 * HIDDEN), np.float32), []
    mask = real.astype(np.float32)[:, :, None]
    for side in (0, 1):
        h, u, own = np.zeros((n, HIDDEN), np.float32), p[f"u{side}"], rows[:, side * 3 * HIDDEN : (side + 1) * 3 * HIDDEN]
        trace = {}
        for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
            x, g = own[place[t]], h @ u
            gates = _sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
            z, r, inner = gates[:, :HIDDEN], gates[:, HIDDEN:], g[:, 2 * HIDDEN :]
            new = np.tanh(x[:, 2 * HIDDEN :] + r * inner)
            if keep:
                trace[t] = h, z, r, inner, new
            h = (new + z * (h - new)) * mask[t]
            states[t, :, side * HIDDEN : (side + 1) * HIDDEN] = h
        kept.append(trace)
    weight = states @ p["attention"] + (mask[:, :, 0] - 1) * 1e9
    weight = np.exp(weight - weight.max(0))
    weight /= weight.sum(0)
    pooled = (weight[:, :, None] * states).sum(0)
    return pooled @ p["out"] + p["base"][0], (states, weight, pooled, kept, mask) if keep else ()


def gradients(p: dict[str, np.ndarray], words: Words, place: np.ndarray, real: np.ndarray, due: np.ndarray, share: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the mean logistic loss, weighed by `share`, and the windows' outputs."""
    inputs = words.inputs(p)
    said, (states, weight, pooled, kept, mask) = forward(p, inputs @ p["x"] + p["bias"], place, real, True)
    error = ((_sigmoid(said) - due) * share / len(due)).astype(np.float32)
    g = {"out": pooled.T @ error, "base": np.array([error.sum()], np.float32)}
    back = error[:, None] * p["out"]
    toward = (states * back).sum(2)
    toward = weight * (toward - (weight * toward).sum(0))
    g["attention"] = np.einsum("tn,tnh->h", toward, states)
    down = weight[:, :, None] * back + toward[:, :, None] * p["attention"]
    steps, n = place.shape
    moved = np.zeros((steps, n, 6 * HIDDEN), np.float32)
    for side in (0, 1):
        u, du, dh = p[f"u{side}"], np.zeros_like(p[f"u{side}"]), np.zeros((n, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1) if side == 0 else range(steps):
            h, z, r, inner, new = kept[side][t]
            dh = (dh + down[t, :, side * HIDDEN : (side + 1) * HIDDEN]) * mask[t]
            dz, dn = dh * (h - new) * z * (1 - z), dh * (1 - z) * (1 - new * new)
            dr = dn * inner * r * (1 - r)
            moved[t, :, side * 3 * HIDDEN : (side + 1) * 3 * HIDDEN] = np.hstack((dz, dr, dn))
            gates = np.hstack((dz, dr, dn * r))
            du += h.T @ gates
            dh = dh * z + gates @ u.T
        g[f"u{side}"] = du
    flat, order = place.ravel(), np.argsort(place.ravel(), kind="stable")
    some = np.flatnonzero(np.append(True, flat[order][1:] != flat[order][:-1]))
    rows = np.zeros((len(inputs), 6 * HIDDEN), np.float32)
    rows[flat[order][some]] = np.add.reduceat(moved.reshape(-1, 6 * HIDDEN)[order], some, axis=0)
    g["x"], g["bias"], below = inputs.T @ rows, rows.sum(0), rows @ p["x"].T
    g["words"], g["grams"] = np.zeros_like(p["words"]), np.zeros_like(p["grams"])
    word, gram = words.rows(p)
    np.add.at(g["words"], word, below[:, :WORD_DIM])
    np.add.at(g["grams"], gram, (below[:, WORD_DIM:] / np.sqrt(words.size)[:, None])[words.owner])
    return g, said


def placed(words: Words, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(WINDOW, windows) of distinct words' rows, and which of them are words."""
    step = np.arange(WINDOW)[:, None]
    real = step < size
    return words.row[np.where(real, start + step, start)], real


def outputs(p: dict[str, np.ndarray], words: Words, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.zeros(0, np.float32)
    rows = words.inputs(p) @ p["x"] + p["bias"]
    return np.concatenate([forward(p, rows, *placed(words, start[i : i + TOGETHER], size[i : i + TOGETHER]))[0] for i in range(0, len(start), TOGETHER)])


def train(texts: list[bytes], doc: np.ndarray, toxic: np.ndarray, epochs: int = 5, least_steps: int = 180, batch: int = 256, rate: float = 0.01, decay: float = 0.3, seed: int = 1) -> dict[str, np.ndarray]:
    """A network from windows (their texts), the number of the document that each is of, and whether that is toxic."""
    rng, step = np.random.default_rng(seed), 0
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    low, hashes, starts, ends, at = tokens(np.frombuffer(b"".join(texts), np.uint8), bounds)
    use, size = np.arange(len(texts)), np.minimum(np.diff(at), WINDOW)
    everything, owner = Words(low, hashes, starts, ends), doc[np.repeat(np.arange(len(texts)), np.diff(at))]
    docs = doc.max() + 1
    kinds, of = np.divmod(np.unique(everything.row * docs + owner), docs)  # distinct words of each document
    n = everything.size[kinds]
    grams = np.repeat((everything.ends - everything.size)[kinds] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    p = fresh(frequent(everything.word[kinds], of), frequent(everything.gram[grams], np.repeat(of, n)), seed)
    learned = [k for k in p if not k.startswith("known")]
    first, second = ({k: np.zeros_like(p[k]) for k in learned} for _ in range(2))
    turn = -(-len(texts) // batch)  # steps of an epoch
    every, plain = max(epochs, -(-least_steps // turn)), max(1, -(-least_steps // (2 * turn)))
    for epoch in range(every):
        if epoch >= plain:  # of a toxic document, the windows that stand out
            said = outputs(p, everything, at[:-1], size)
            most = np.full(docs, -np.inf)
            np.maximum.at(most, doc, said)
            use = np.flatnonzero(~toxic | (said >= most[doc]))
        share = np.where(toxic[use], 0.5 / max(toxic[use].mean(), 1e-9), 0.5 / max((~toxic[use]).mean(), 1e-9))
        order = rng.permutation(len(use))
        for i in range(0, len(order), batch):
            own = use[order[i : i + batch]]
            each = np.concatenate([np.arange(at[k], at[k] + size[k]) for k in own])
            words = Words(low, hashes[each], starts[each], ends[each])
            begin = np.cumsum(size[own]) - size[own]
            g, _ = gradients(p, words, *placed(words, begin, size[own]), toxic[own].astype(np.float32), share[order[i : i + batch]])
            step += 1
            for k in learned:  # Adam
                first[k] += 0.1 * (g[k] - first[k])
                second[k] += 0.001 * (g[k] * g[k] - second[k])
                p[k] -= rate * ((first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8) + (decay * p[k] if k in ("words", "grams") else 0))
    return p


def judged(p: dict[str, np.ndarray], body: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row a text: its greatest and second greatest window output (the same, if it has one window) and the logarithm of its number of windows; nan without words."""
    low, hashes, starts, ends, at = tokens(body, bounds)
    out = np.full((len(bounds) - 1, 3), np.nan)
    if not len(hashes):
        return out
    text, start, size = windows(at)
    said = outputs(p, Words(low, hashes, starts, ends), start, size)
    order = np.lexsort((-said, text))
    first = np.flatnonzero(np.append(True, text[order][1:] != text[order][:-1]))
    count = np.diff(np.append(first, len(text)))
    out[text[order][first]] = np.column_stack((said[order][first], said[order][first + (count > 1)], np.log(count)))
    return out


def fit_scale(x: np.ndarray, toxic: np.ndarray, share: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights of a logistic function of `judged` rows, the bias last, by Newton's method with a small ridge."""
    x = np.column_stack((np.clip(x, -30, 30), np.ones(len(x))))
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-2] * (x.shape[1] - 1) + [1e-4])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ ((q - toxic) * share) + len(x) * 1e-2 * ridge @ w
        curve = (x * (q * (1 - q) * share)[:, None]).T @ x + len(x) * 1e-2 * ridge + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
    return w


def scale(x: np.ndarray, w: np.ndarray, empty: float) -> np.ndarray:
    said = 1 / (1 + np.exp(-np.clip(np.clip(np.nan_to_num(x), -30, 30) @ w[:-1] + w[-1], -30, 30)))
    return np.where(np.isnan(x[:, 0]), empty, said)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = 2000, per_text: int = 12) -> tuple[dict[str, np.ndarray], np.ndarray, float] | None:
    """Network, scale, and the share of toxic ones among labelled rows, from labels (key, toxic) where `learn` (over `key`) holds and texts of `docs` (key, text).

    The sample: about `per_class` documents of each label, drawn by a hash of the key, once for each distinct text, of each up to `per_text` windows
    of at most LONGEST bytes; three quarters of the texts train the network and the rest the scale, for which all their windows are judged in tasks. None if no label can be learned from."""
    marked = labels.where(learn & F.col("key").isNotNull() & F.col("toxic").isNotNull()).groupBy("key").agg((F.max("toxic") > 0).alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if not totals:
        return None
    drawn = lambda x: F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, per_class / max(totals.get(x, 0), 1)))
    few = marked.where(F.when(F.col("toxic"), drawn(True)).otherwise(drawn(False)))
    kinds = docs.join(F.broadcast(few), "key").where(F.col("text").isNotNull()).select(F.xxhash64("text").alias("hash"), "toxic").groupBy("hash").agg(F.max("toxic").alias("toxic"))
    kinds = kinds.orderBy(F.xxhash64("hash")).limit(4 * per_class)  # 9 bytes a text
    text = docs.withColumn("hash", F.xxhash64("text")).join(F.broadcast(kinds), "hash").groupBy("hash", "toxic").agg(F.first("text").alias("text"))
    rest = F.pmod(F.xxhash64("hash", F.lit(3)), F.lit(4)) == 0

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 20):
                low, _, starts, ends, at = tokens(*text_bytes(part.column("text")))
                own, start, size = windows(at)
                begin, stop = starts[start], ends[start + size - 1]
                hashes = np.asarray(part.column("hash"))
                toxic = part.column("toxic").to_pylist()
                good = stop - begin <= LONGEST
                order = np.lexsort((mix64(hashes.view(np.uint64)[own] + start.astype(np.uint64)), ~good, own))
                nth = np.arange(len(own)) - np.searchsorted(own, own)  # own ascends
                take = order[(nth < per_text) & good[order]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[own[take]]), pa.array([toxic[k] for k in own[take]], pa.bool_()), pa.array([low[a:b].tobytes() for a, b in zip(begin[take], stop[take], strict=True)], pa.binary())], names=["hash", "toxic", "window"]
                )

    got = in_batches(text.where(~rest)).select("hash", "toxic", "text").mapInArrow(cut, "hash bigint, toxic boolean, window binary").toPandas().sort_values(["hash", "window"])
    prior = totals.get(True, 0) / sum(totals.values())
    if not len(got) or got.toxic.nunique() < 2:
        return None
    p = train(got.window.tolist(), np.unique(got.hash.to_numpy(), return_inverse=True)[1], got.toxic.to_numpy(bool))
    shared = docs.sparkSession.sparkContext.broadcast(p)  # tables of bounded size, a few MB at most

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 20):
                x = judged(shared.value, *text_bytes(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("hash"), part.column("toxic"), *(pa.array(c) for c in x.T)], names=["hash", "toxic", "x0", "x1", "x2"])

    seen = in_batches(text.where(rest)).select("hash", "toxic", "text").mapInArrow(judge, "hash bigint, toxic boolean, x0 double, x1 double, x2 double").toPandas().sort_values("hash").dropna()
    w = np.array([1.0, 0.0, 0.0, 0.0])
    if seen.toxic.nunique() == 2:
        toxic = seen.toxic.to_numpy(bool)
        share = np.where(toxic, prior / toxic.mean(), (1 - prior) / (1 - toxic.mean()))  # as frequent as among labels
        w = fit_scale(seen[["x0", "x1", "x2"]].to_numpy(), toxic.astype(float), share)
    return p, w, prior


def score_toxicity(docs: DataFrame, labels: DataFrame, learn: Column | None = None, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = 2000) -> DataFrame:
    """Toxicity of every whole text: key, score (0 to 1), n_windows and worst_window (the greatest output of its windows; null without words).

    Learns from labels whose key fulfils `learn` (over `key`; default: all), see `fit`; of labels that share a key, one toxic one decides. A text without letters, an empty and a null one get
    the share of toxic labels. Without labels of both kinds every text gets that share, or 0. Repeated rows and null keys stay rows of their own;
    an empty table gives an empty result; other columns are ignored.
    """
    own = pick(docs, key=key, text=text)
    found = fit(own, pick(labels, key=key, toxic=label), F.lit(True) if learn is None else learn, per_class)
    kind = own.schema["key"].dataType.simpleString()
    if found is None:
        known = pick(labels, key=key, toxic=label).where(F.lit(True) if learn is None else learn)
        share = float(known.agg(F.avg((F.col("toxic") > 0).cast("int"))).first()[0] or 0.0)
        return own.select(F.col("key").alias(key), F.lit(share).alias("score"), F.lit(None).cast("bigint").alias("n_windows"), F.lit(None).cast("double").alias("worst_window"))
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, w, prior = shared.value
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 20):
                x = judged(p, *text_bytes(part.column("text")))
                none = np.isnan(x[:, 0])
                n = np.where(none, 0, np.rint(np.exp(np.nan_to_num(x[:, 2])))).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(scale(x, w, prior)), pa.array(n), pa.array(x[:, 0], mask=none)], names=[key, "score", "n_windows", "worst_window"])

    return in_batches(own).mapInArrow(run, f"`{key}` {kind}, score double, n_windows bigint, worst_window double")

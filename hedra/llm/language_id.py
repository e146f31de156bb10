"""Hierarchical language identification: a language family first, then one-versus-one linear support vector machines within the family.

Features are hashed byte n-grams of whole texts, counted by numpy over many texts at once. The machines are fitted on the driver from a
bounded sample of labelled rows; prediction runs over all rows in Arrow batches.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedra.llm.common import _LOWER, in_batches, pick, text_bytes, text_slices

# Families of some language codes; a code not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc ast",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "uralic": "fi et hu",
    "indic": "hi bn mr gu pa ne ur sa",
    "turkic": "tr az kk uz ky tk",
    "semitic": "ar he am mt",
}
DIMS = 1 << 12
ORDERS = (2, 3)
#: Texts whose counts are held at once, each a row of DIMS.
ROWS = 512
#: Kids of a node: more of them are dealt over nodes between.
MOST_KIDS = 16

_LETTER = _LOWER.copy()
_LETTER[[b for b in range(128) if not (97 <= b < 123 or 65 <= b < 91)]] = 32


def family_of(code: str) -> str:
    base = code.lower().replace("_", "-").split("-")[0]
    return next((f for f, codes in FAMILIES.items() if base in codes.split()), f"own:{base}")


def vectors(body: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Unit vectors of square roots of hashed n-gram counts, one row a text; letters in lower case, other ASCII a space, case of Latin-1 letters folded."""
    n, low = len(bounds) - 1, _LETTER[body]
    after = np.flatnonzero(body[:-1] == 0xC3) + 1
    after = after[(body[after] >= 0x80) & (body[after] <= 0x9E) & (body[after] != 0x97)]
    low[after] += 32
    text = np.repeat(np.arange(n, dtype=np.int64), np.diff(bounds))
    wide, total = low.astype(np.uint32), np.zeros(n * DIMS)
    for order in ORDERS:
        if len(low) < order:
            continue
        m = len(low) - order + 1
        h = wide[:m].copy()
        for k in range(1, order):
            h = h * np.uint32(0x01000193) + wide[k : k + m]
        h = (h * np.uint32(0x9E3779B1) + np.uint32(order)) >> np.uint32(20)
        whole = text[:m] == text[order - 1 :]
        blank = (low[:m] == 32) & (low[1 : m + 1] == 32)
        use = whole & ~blank
        total += np.bincount((text[:m] * DIMS + h)[use], minlength=n * DIMS)
    x = np.sqrt(total.reshape(n, DIMS)).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 8.0, rounds: int = 12) -> np.ndarray:
    """Squared-hinge linear SVM by dual coordinate descent; y is -1 or 1; rows weigh so that both sides count alike. Last weight: the bias."""
    x = np.hstack((x, np.full((len(x), 1), 0.3, np.float32))).astype(np.float64)
    share = np.where(y > 0, (y > 0).mean(), (y < 0).mean())
    soft = share / cost
    norm, alpha, w = (x * x).sum(1) + soft, np.zeros(len(x)), np.zeros(x.shape[1])
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            step = max(alpha[i] - (y[i] * (w @ x[i]) - 1 + soft[i] * alpha[i]) / norm[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * x[i]
    return w


@dataclass
class Node:
    """A choice between kids (nodes or languages): the machines of their pairs stand from `first` on, pair after pair."""

    kids: list[Node | str]
    first: int = 0

    def leaves(self) -> list[str]:
        return [c for k in self.kids for c in ([k] if isinstance(k, str) else k.leaves())]


def node_of(kids: list[Node | str]) -> Node | str:
    """One node over the kids, or, where they are more than MOST_KIDS, over nodes of so many."""
    while len(kids) > MOST_KIDS:
        kids = [node_of(kids[i : i + MOST_KIDS]) for i in range(0, len(kids), MOST_KIDS)]
    return kids[0] if len(kids) == 1 else Node(kids)


class Model:
    """A tree of families and languages. As no node has more than MOST_KIDS kids, machines grow with the number of languages and not with its square."""

    def __init__(self, x: np.ndarray, langs: np.ndarray) -> None:
        self.langs = sorted(set(langs.tolist()))
        families = sorted({family_of(c) for c in self.langs})
        self.root = node_of([node_of([c for c in self.langs if family_of(c) == f]) for f in families])
        self.machines: list[np.ndarray] = []
        self._fit(self.root, x, langs)
        weights = np.array(self.machines, np.float32).reshape(len(self.machines), x.shape[1] + 1)
        self.weights, self.bias = np.ascontiguousarray(weights[:, :-1].T), 0.3 * weights[:, -1].astype(np.float64)
        del self.machines

    def _fit(self, node: Node | str, x: np.ndarray, langs: np.ndarray) -> None:
        if isinstance(node, str):
            return
        node.first = len(self.machines)
        own = [np.isin(langs, [k] if isinstance(k, str) else k.leaves()) for k in node.kids]
        for a, b in itertools.combinations(own, 2):
            use = a | b
            self.machines.append(fit_svm(x[use], np.where(a[use], 1.0, -1.0)))
        for k in node.kids:
            self._fit(k, x, langs)

    def _vote(self, margins: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the kid with most pairwise wins (then the largest sum of margins), and its least squashed margin."""
        wins, least = np.zeros((len(margins), n)), np.ones((len(margins), n))
        for m, (i, j) in zip(margins.T, itertools.combinations(range(n), 2), strict=True):
            p = 1 / (1 + np.exp(-3 * np.clip(m, -20, 20)))
            wins[:, i] += (m >= 0) + p / 1e3
            wins[:, j] += (m < 0) + (1 - p) / 1e3
            least[:, i], least[:, j] = np.minimum(least[:, i], p), np.minimum(least[:, j], 1 - p)
        best = wins.argmax(1)
        return best, least[np.arange(len(best)), best]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language, family and score of each row."""
        margins = x @ self.weights + self.bias
        lang, score = np.empty(len(x), object), np.ones(len(x))

        def walk(node: Node | str, at: np.ndarray) -> None:
            if isinstance(node, str):
                lang[at] = node
            elif len(at):
                n = len(node.kids)
                best, sure = self._vote(margins[at, node.first : node.first + n * (n - 1) // 2], n)
                score[at] *= sure
                for k, kid in enumerate(node.kids):
                    walk(kid, at[best == k])

        walk(self.root, np.arange(len(x)))
        family = {c: family_of(c) for c in self.langs}
        return lang, np.array([family[c] for c in lang], object), score


def fit(docs: DataFrame, train: Column, per_language: int = 400, most_languages: int = 400, most_rows: int = 16_000) -> Model | None:
    """Fit on rows of (text, lang) where `train` holds and lang is not null: of distinct pairs, all of a language that has up to `per_language`
    (less, where `most_rows` over all languages comes first), else about so many, taken by a hash of the pair. The sample bounds what can be learned: of
    more labels than `most_languages`, those with most distinct texts are (ties by name), and rows of others get the learned language that is
    nearest. None if no row is fit to learn from."""
    own = docs.where(train & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("draw", F.xxhash64("text", "lang"))
    texts = own.select("lang", "draw").distinct().groupBy("lang").count()
    counts = {r["lang"]: r["count"] for r in texts.orderBy(F.desc("count"), "lang").limit(most_languages).collect()}
    if not counts:
        return None
    most = min(per_language, most_rows // len(counts))
    share = F.create_map(*[F.lit(v) for c, n in sorted(counts.items()) for v in (c, min(1 << 30, int((1 << 30) * most / n)))])[F.col("lang")]
    # one row a pair, so the driver gets about `most` rows a language whatever is copied
    taken = own.where(share > F.pmod("draw", F.lit(1 << 30))).groupBy("lang", "draw").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 20):
                for at in range(0, part.num_rows, ROWS):
                    few = part.slice(at, ROWS)
                    x = vectors(*text_bytes(few.column("text")))
                    yield pa.RecordBatch.from_arrays([few.column("lang"), pa.array([v.tobytes() for v in x.astype(np.float16)], pa.binary())], names=["lang", "x"])

    got: pd.DataFrame = in_batches(taken.select("text", "lang")).mapInArrow(run, "lang string, x binary").orderBy("lang", "x").toPandas()
    if not len(got):
        return None
    return Model(np.frombuffer(b"".join(got.x), np.float16).reshape(len(got), DIMS).astype(np.float32), got.lang.to_numpy(object))


def identify_languages(docs: DataFrame, train: Column | None = None, key: str = "doc_id", per_language: int = 400, keep: tuple[str, ...] = ()) -> DataFrame:
    """Language of every whole text: key, lang_pred, family_pred, score (0 to 1) and the columns of `keep`.

    Learns from text and lang of rows where `train` (over columns `key`, default: all) holds, see `fit`; lang is never read in prediction.
    A null text or one without a letter is `und` with score 0, as is every text if there is nothing to learn from. Repeated rows and null
    keys stay rows of their own; an empty table gives an empty result; other columns are ignored.
    """
    own = pick(docs, key=key, text="text", lang="lang", **{f"keep{i}": c for i, c in enumerate(keep) if c != "text"})
    kept = ["text" if c == "text" else f"keep{i}" for i, c in enumerate(keep)]  # a kept text goes to Python once
    kinds = "".join(f"{c} {own.schema[c].dataType.simpleString()}, " for c in ("key", *kept))
    back = [F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)]
    model = fit(own, F.lit(True) if train is None else train, per_language)
    known = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return own.select(F.col("key").alias(key), F.lit("und").alias("lang_pred"), F.lit("und").alias("family_pred"), F.lit(0.0).alias("score"), *back)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some 8 machines of DIMS floats a language, most_languages at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 20):
                for at in range(0, part.num_rows, ROWS):
                    few = part.slice(at, ROWS)
                    lang, family, score = shared.value.predict(vectors(*text_bytes(few.column("text"))))
                    yield pa.RecordBatch.from_arrays([*(few.column(c) for c in ("key", *kept)), few.column("known"), pa.array(lang, pa.string()), pa.array(family, pa.string()), pa.array(score.astype(np.float64))], names=["key", *kept, "known", "lang_", "family_", "score_"])

    said = in_batches(own.select("key", *dict.fromkeys([*kept, "text"]), known.alias("known"))).mapInArrow(run, f"{kinds}known boolean, lang_ string, family_ string, score_ double")
    chosen = lambda c, other: F.when(F.col("known"), F.col(c)).otherwise(F.lit(other))
    return said.select(F.col("key").alias(key), chosen("lang_", "und").alias("lang_pred"), chosen("family_", "und").alias("family_pred"), chosen("score_", 0.0).alias("score"), *back)

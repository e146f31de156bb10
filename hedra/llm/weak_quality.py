"""Quality and toxicity by weak labels.

Overlapping heuristic labellers vote on every document (bad, abstain, good); one of them is a lexicon of words that a bounded sample of
labelled rows shows to be toxic. Expectation-maximisation over the counts of vote patterns, of
which there are at most 3 to the number of labellers, estimates how each labeller votes given the truth; the posteriors label a bounded
sample that trains a hashed linear scorer; both judge every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hedra.llm.common import _LOWER, in_batches, mix64, pick, text_bytes, text_slices, word_hashes

# Frequent function words of four languages, and insults.
STOP_WORDS = "the of and to in a is that for on with as was by be this are or from at it not le la les de des et un une en que qui dans par pour sur au est du il pas der die das und ist von den mit zu ein eine nicht auf im sich des dem auch el los las y en por con para una su del se al lo como"
HARD_INSULTS = "idiot idiots moron morons scum bastard bastards retard retards imbecile cretin asshole assholes bitch bitches whore slut cunt dickhead shithead motherfucker nigger faggot kike subhuman vermin idiote connard salope imbécile arschloch idioten hurensohn wichser gilipollas imbécil puta cabrón"
SOFT_INSULTS = "stupid trash pathetic worthless disgusting loser losers clown clowns dumb dumbass stupidity garbage filthy filth shit crap fool fools jerk pig pigs lunatic freak hideous repulsive despicable coward cowards liar liars ugly useless dumm ekelhaft abschaum stupide ordure pathétique dégoûtant estúpido basura asqueroso"

QUALITY = ("symbols", "capitals", "variety", "table", "word_length", "function_words", "runs")
TOXICITY = ("hard", "soft", "learned", "several")
DIMS = 1 << 18

_BARE = _LOWER.copy()
_BARE[[b for b in range(128) if not (97 <= b < 123 or 65 <= b < 91)]] = 32
_IS = {
    "letter": np.array([97 <= b < 123 or 65 <= b < 91 or b >= 128 for b in range(256)]),
    "upper": np.array([65 <= b < 91 for b in range(256)]),
    "symbol": np.array([33 <= b < 127 and chr(b) in "!#$%&*+/<=>@[\\]^_`{|}~" for b in range(256)]),
    "pipe": np.array([b in (124, 9) for b in range(256)]),
}


def _hashes(words: str) -> np.ndarray:
    body = np.frombuffer(" ".join(words.split()).encode(), np.uint8)
    return np.unique(word_hashes(body, np.array([0, len(body)]))[0])


_STOP, _HARD, _SOFT = _hashes(STOP_WORDS), _hashes(HARD_INSULTS), _hashes(SOFT_INSULTS)


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return known[at] == h


def _per_text(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(x, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def votes(body: np.ndarray, bounds: np.ndarray, words: np.ndarray, at: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Votes of all labellers, a row a text: -1, 0 or 1. Quality: 1 is good; toxicity: 1 is toxic. Texts too short for a labeller get 0. words: hashes of letter runs, at: their bounds."""
    share = {k: _per_text(t[body], bounds) for k, t in _IS.items()}
    chars, n = np.maximum(np.diff(bounds), 1), np.diff(at)
    some, text = np.maximum(n, 1), np.repeat(np.arange(len(n)), n)
    order = np.lexsort((words, text))
    fresh = np.ones(len(words), bool)
    fresh[1:] = (words[order][1:] != words[order][:-1]) | (text[order][1:] != text[order][:-1])
    distinct = np.bincount(text[order][fresh], minlength=len(n))
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
    stop, hard, soft, learned = (_per_text(_among(words, k), at) if len(k) else np.zeros(len(n), np.int64) for k in (_STOP, _HARD, _SOFT, lexicon))
    vote = lambda bad, counts=True: np.where(counts, np.where(bad, -1, 1), 0).astype(np.int8)
    enough, letters, most = n >= 20, share["letter"], chars >= 20
    length, kinds = letters / some, distinct / np.sqrt(2.0 * some)
    quality = [
        vote(share["symbol"] > 0.06 * chars, most),
        vote(share["upper"] > 0.4 * letters, most & (letters > 10)),
        vote(kinds < 1, enough),
        vote(share["pipe"] > 0.2 * n, enough),
        vote((length < 2) | (length > 14), enough),
        vote(stop < 0.02 * n, enough & (stop > 0)),
        vote(_per_text(again, at) > 0.3 * n, enough),
    ]
    hits = hard + soft + learned
    toxic = [-vote(x > 0) for x in (hard, soft, learned)] + [-vote(hits > 1, hits != 1)]
    return np.stack(quality, 1), np.stack(toxic, 1)


class LabelModel:
    """Two classes, and for each labeller the chances of its three votes given the class; fitted to counted patterns."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, alarm: int, rounds: int = 40) -> None:
        m = patterns.shape[1]
        alarmed = (patterns == alarm).any(1)
        p = np.where(alarmed == (alarm > 0), 0.9, 0.1)  # chance of class 1; at first one vote `alarm` decides
        seen = np.stack([patterns == v for v in (-1, 0, 1)], 2).astype(float)  # pattern, labeller, vote
        # pseudo-counts: a labeller is better than chance
        lean = {1: np.array([0.2, 0, 1.0]), 0: np.array([1.0, 0, 0.2])}
        for _ in range(rounds):
            chances = []
            for k, q in ((1, p), (0, 1 - p)):
                c = np.einsum("i,ijv->jv", counts * q, seen) + lean[k]
                c[:, 1] = 0  # who abstains says nothing
                chances.append(np.log(np.where(c, c / c.sum(1, keepdims=True), 1)))
            share = np.clip((counts @ p + 1) / (counts.sum() + 2), 1e-4, 1 - 1e-4)
            self.weights, self.base = chances[0] - chances[1], float(np.log(share / (1 - share)))
            p = self.posterior(patterns)
        assert self.weights.shape == (m, 3)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        odds = self.base + self.weights[np.arange(patterns.shape[1]), patterns.astype(int) + 1].sum(1)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def fit_scorer(texts: list[np.ndarray], labels: np.ndarray, rounds: int = 80) -> np.ndarray:
    """Logistic regression of soft labels on hashed words, each text's counts over the root of its words; both classes weigh alike. Last weight: the bias."""
    n = np.array([len(t) for t in texts])
    flat, row = np.concatenate(texts).astype(np.int64), np.repeat(np.arange(len(texts)), n)
    value = 1 / np.sqrt(np.maximum(n, 1))[row]
    share = np.clip(labels.mean(), 0.02, 0.98)
    weight = labels / share + (1 - labels) / (1 - share)
    w, speed = np.zeros(DIMS + 1), np.full(DIMS + 1, 1e-3)
    for _ in range(rounds):  # AdaGrad
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[flat] * value, len(texts)) + w[-1], -30, 30)))
        error = (p - labels) * weight / len(texts)
        g = np.append(np.bincount(flat, error[row] * value, DIMS), error.sum()) + 1e-6 * w
        speed += g * g
        w -= 0.1 * g / np.sqrt(speed)
    return w


def toxic_lexicon(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label_rows: int = 20_000, least: int = 6, share: int = 1500, purity: float = 0.9) -> np.ndarray:
    """Sorted hashes of words that at least `least` toxic documents (and one for every `share` drawn) hold, and hardly any other. Learned from about `label_rows` labelled
    documents, drawn by a hash of the key; documents that share their smallest word-pair hash, copies that is, count once."""
    marked = pick(labels, id=key, toxic="toxic").where(F.col("toxic").isNotNull() & F.col("id").isNotNull())
    total = marked.count()
    if not total:
        return np.empty(0, np.uint64)
    drawn = marked.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * min(1, label_rows / total))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    own = pick(docs, id=key, text=text).join(F.broadcast(drawn), "id").select("text", F.col("toxic").cast("int").alias("toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 20):
                body, bounds = text_bytes(part.column("text"))
                words, at = word_hashes(_BARE[body], bounds)
                for a, b, toxic in zip(at[:-1], at[1:], part.column("toxic").to_pylist(), strict=True):
                    if b > a:
                        own = words[a:b]
                        pair = mix64(own[:-1] * np.uint64(3) + own[1:]).min() if b - a > 1 else own[0]
                        own = np.unique(own)
                        yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.full(len(own), pair, np.uint64).view(np.int64)), pa.array(np.full(len(own), toxic, np.int32))], names=["word", "pair", "toxic"])

    each = own.mapInArrow(run, "word bigint, pair bigint, toxic int").groupBy("word", "pair").agg(F.max("toxic").alias("toxic"))
    found = each.groupBy("word").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n")).where((F.col("bad") >= max(least, min(total, label_rows) // share)) & (F.col("bad") >= purity * F.col("n")))
    return np.sort(np.array([r["word"] for r in found.select("word").collect()], np.int64).view(np.uint64))


def judge_quality(docs: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", text: str = "text", sample_rows: int = 6000, longest: int = 16_384) -> DataFrame:
    """Judgement of every whole text: key, keep, quality and toxicity (posterior and scorer together, 0 to 1), and the four parts.

    `labels` (key, toxic) may mark some documents; see toxic_lexicon. The scorer learns from about `sample_rows` distinct texts (twice as many at most) of up to `longest` bytes that have a word, drawn by a hash; longer ones are judged all the same, and votes are counted over all. keep: quality is at least
    and toxicity under a half. A null or empty text has no words: its votes abstain or say bad, and its scores are the scorer's bias. Equal
    texts get equal judgement, repeated rows and null keys stay rows of their own; an empty table gives an empty result; other columns are
    ignored.
    """
    own = pick(docs, key=key, text=text)
    kind, spark = own.schema["key"].dataType.simpleString(), docs.sparkSession
    lexicon = np.empty(0, np.uint64) if labels is None else toxic_lexicon(docs, labels, key, text)
    ballot = ", ".join(f"{n} tinyint" for n in (*QUALITY, *TOXICITY))

    def seen(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for part in text_slices(batch, "text", 1 << 20):
            body, bounds = text_bytes(part.column("text"))
            words, at = word_hashes(_BARE[body], bounds)
            q, t = votes(body, bounds, words, at, lexicon)
            yield part, (words >> np.uint64(46)).astype(np.int64), at, q, t

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, q, t in seen(batch):
                found, n = np.unique(np.hstack((q, t)), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int8()) for c in found.T), pa.array(n.astype(np.int64))], names=[*QUALITY, *TOXICITY, "n"])

    counted = in_batches(own.select("text")).mapInArrow(vote, f"{ballot}, n bigint").groupBy(*QUALITY, *TOXICITY).agg(F.sum("n").alias("n")).toPandas()  # 3**11 patterns at most
    if not len(counted):
        return own.select(F.col("key").alias(key), F.lit(True).alias("keep"), *[F.lit(0.0).alias(c) for c in ("quality", "toxicity", "quality_posterior", "toxic_posterior", "quality_score", "toxic_score")]).limit(0)
    n = counted.n.to_numpy(float)
    models = LabelModel(counted[list(QUALITY)].to_numpy(int), n, -1), LabelModel(counted[list(TOXICITY)].to_numpy(int), n, 1)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, words, at, q, t in seen(batch):
                texts = [words[a:b].astype(np.int32).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), *(pa.array(m.posterior(v)) for m, v in zip(models, (q, t), strict=True))], names=["words", "q", "t"])

    # of distinct texts with a word, so that neither empty texts nor copies crowd out others
    some = own.where((F.octet_length("text") <= longest) & F.col("text").rlike(r"[A-Za-z]|[^\x00-\x7F]")).select("text", F.xxhash64("text").alias("hash"))
    kinds = some.select("hash").distinct().count()
    draw = some.where(F.pmod(F.xxhash64("hash", F.lit(1)), F.lit(1 << 30)) < int((1 << 30) * min(1, sample_rows / max(kinds, 1))))
    once = draw.groupBy("hash").agg(F.first("text").alias("text")).orderBy(F.xxhash64("hash", F.lit(2))).limit(2 * sample_rows)
    drawn = in_batches(once.select("text")).mapInArrow(learn, "words binary, q double, t double").toPandas()
    drawn = drawn.sort_values(["words", "q", "t"])
    texts = [np.frombuffer(b, np.int32) for b in drawn.words]
    zero = np.zeros(DIMS + 1)
    scorers = [fit_scorer(texts, drawn[c].to_numpy()) if len(texts) else zero for c in ("q", "t")]
    shared = spark.sparkContext.broadcast((models, [w.astype(np.float32) for w in scorers]))  # two times DIMS weights
    names = [key, "keep", "quality", "toxicity", "quality_posterior", "toxic_posterior", "quality_score", "toxic_score"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, scorers = shared.value
        odds = lambda p: np.log(p / (1 - p))
        for batch in batches:
            for part, words, at, q, t in seen(batch):
                root = np.sqrt(np.maximum(np.diff(at), 1))
                post = [m.posterior(v) for m, v in zip(models, (q, t), strict=True)]
                line = [np.add.reduceat(np.append(w[words], 0), np.minimum(at[:-1], len(words))) * (np.diff(at) > 0) / root + w[-1] for w in scorers]
                score = [1 / (1 + np.exp(-np.clip(x, -6, 6))) for x in line]
                both = [1 / (1 + np.exp(-(odds(np.clip(p, 1e-6, 1 - 1e-6)) + odds(s) / 2))) for p, s in zip(post, score, strict=True)]
                keep = (both[0] >= 0.5) & (both[1] < 0.5)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(keep), *(pa.array(np.asarray(x, np.float64)) for x in (*both, *post, *score))], names=names)

    return own.mapInArrow(judge, f"`{key}` {kind}, keep boolean, " + ", ".join(f"{x} double" for x in names[2:]))

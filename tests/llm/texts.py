"""Small tables with the cases that every operator must bear."""

import random
import re

import pandas as pd

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _text string, c0 string"


def words(text):
    """Words as the operators see them."""
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, size=5):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def vocabulary(seed, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def sentence(rng, vocab, n):
    return " ".join(rng.choice(vocab) for _ in range(n))


def edge_rows():
    """Nulls, empty and blank texts, ties, repeated rows, a very long text, and columns whose names clash with inner ones."""
    rng, vocab = random.Random(4), vocabulary(1)
    long = sentence(rng, vocab, 20_000)
    texts = [None, "", " \t\n", "a", "A b\nC d", "A b\nC d", "ünï ©ode 日本語 \U0001f600", "x" * 5000, "\n".join(sentence(rng, vocab, 30) for _ in range(40)), long]
    rows = [(i, t, "en", "s", None if t is None else len(t), "clash", None) for i, t in enumerate(texts)]
    return [*rows, rows[4], (None, "no key here at all, or so it seems", None, None, 1, None, None), (None, None, None, None, None, None, None)]


def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def corpus(seed=9, n=120):
    """doc_id and text: a few families of near copies among other texts."""
    rng, vocab = random.Random(seed), vocabulary(seed)
    base = [sentence(rng, vocab, rng.randint(40, 120)) for _ in range(4)]
    out = []
    for i in range(n):
        w = rng.choice(base).split() if i % 3 else sentence(rng, vocab, rng.randint(1, 150)).split()
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        out.append((i, " ".join(w)))
    return out


def frame(rows):
    return pd.DataFrame(rows, columns=["doc_id", "text"])

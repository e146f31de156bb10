"""Product codes of vectors, with exact integer arithmetic and conservative lower bounds.

Vectors become integers and are cut into parts; every part is assigned to the nearest entry of its position's codebook. Means of ever smaller blocks
of a part bound its distance to an entry from below, and so do, with them, the norms of what is left beside the means. Entries whose bound exceeds a
distance that is reached already are filtered; those that survive the finest blocks get exact integer distances.

Codebooks have a few numbers a component. Each round is a pass over the vectors that sends sums and counts of each entry, so that neither the driver
nor a task gets vectors together.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hedra.llm.common import pick, stage

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components up to this size keep all squares and sums in 64 bits; beyond it Python's integers take over.
SMALL = 1 << 26
#: Sums travel in limbs of so many bits, so that adding them never overflows.
LIMB = 30
#: Distinct labels up to which their sums are broadcast (16 bytes each).
BROADCAST_ROWS = 1_000_000
#: Vectors that a task holds at once.
ROWS = 4096


def quantise(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite numbers, exactly: 64-bit integers, or Python's where a component is too large for SMALL."""
    if not x.size or float(np.abs(x).max()) * scale < SMALL:
        return np.floor(x.astype(np.float64) * scale).astype(np.int64)
    whole = lambda v: int(v) * scale if abs(v) >= 2.0**53 else math.floor(v * scale)
    return np.array([[whole(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def levels(width: int) -> list[np.ndarray]:
    """Starts of the blocks of each level: one block, then each halved, while blocks have two components."""
    out, n = [], 1
    while n == 1 or width // n >= 2:
        out.append(np.unique(np.arange(n) * width // n))
        n *= 2
    return out


def _blocks(v: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of blocks, their sizes, and the norm of what is left of each row when its blocks' means are taken away."""
    size = np.diff(np.append(starts, v.shape[1])).astype(np.float64)
    total = np.add.reduceat(v, starts, axis=1).astype(np.float64)
    rest = (v.astype(np.float64) ** 2).sum(1) - (total**2 / size).sum(1)
    return total, size, np.sqrt(np.maximum(rest, 0))


def nearest(v: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of the nearest entry (ties to the lower one), its squared distance, and how many exact distances that took."""
    n, k = len(v), len(book)
    if not v.shape[1]:
        return np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    exact = lambda row, entry: ((v[row] - book[entry]) ** 2).sum(1)
    if v.dtype == object or book.dtype == object:
        row, entry, spent = np.repeat(np.arange(n), k), np.tile(np.arange(k), n), 0
    else:
        # doubles carry some nine digits more than is taken off the bounds
        slack = lambda x: 1e-6 * (x.astype(np.float64) ** 2).sum(1)
        mine, theirs = slack(v), slack(book)
        one, *finer = levels(v.shape[1])
        (s, size, rest), (t, _, left) = _blocks(v, one), _blocks(book, one)
        bound = (s - t.T) ** 2 / size + (rest[:, None] - left) ** 2 - (mine[:, None] + theirs + 1)
        guess = bound.argmin(1)  # the entry of least bound sets what others must reach
        best, spent = exact(np.arange(n), guess), n
        row, entry = np.nonzero(bound <= best[:, None])
        for starts in finer:
            (s, size, rest), (t, _, left) = _blocks(v, starts), _blocks(book, starts)
            bound = ((s[row] - t[entry]) ** 2 / size).sum(1) + (rest[row] - left[entry]) ** 2
            use = bound - (mine[row] + theirs[entry] + 1) <= best[row]
            row, entry = row[use], entry[use]
    distance = exact(row, entry)
    # rows keep their order and entries ascend within each
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    least = np.minimum.reduceat(distance, first)
    hit = np.flatnonzero(distance == np.repeat(least, np.diff(np.append(first, len(row)))))
    _, at = np.unique(row[hit], return_index=True)
    return entry[hit[at]].astype(np.int64), least, spent + len(row)


def cuts(width: int, parts: int) -> list[slice]:
    """Consecutive parts; the first ones are longer by one where the width is no multiple."""
    ends = np.cumsum([0, *(len(x) for x in np.array_split(np.arange(width), parts))])
    return [slice(int(a), int(b)) for a, b in zip(ends, ends[1:], strict=False)]


def _rows(batch: pa.RecordBatch, width: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        x = part.column("x").flatten().to_numpy(zero_copy_only=False)
        yield part, quantise(x.reshape(part.num_rows, width), scale)


def _limbs(total: int) -> list[int]:
    out = []
    while not -(1 << LIMB) < total < 1 << LIMB:
        out.append(total & ((1 << LIMB) - 1))
        total >>= LIMB
    return [*out, total]


def fit_codebooks(vectors: DataFrame, first: np.ndarray, parts: int = PARTS, rounds: int = ROUNDS, scale: int = SCALE) -> list[np.ndarray]:
    """One codebook a part position, started from the integer rows `first`; `vectors` has x, finite and of one width. A round is one pass."""
    width = first.shape[1]
    where = cuts(width, parts)
    books = [first[:, s] for s in where]
    if not len(first):
        return books
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], books: list[np.ndarray] = books) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros((len(first), width), object), np.zeros((parts, len(first)), np.int64)
            for batch in batches:
                for _, v in _rows(batch, width, scale):
                    for p, s in enumerate(where):
                        entry = nearest(v[:, s], books[p])[0]
                        counts[p] += np.bincount(entry, minlength=len(first))
                        for e in np.unique(entry):
                            sums[e, s] += v[entry == e, s].sum(0)
            # cell: the entry's component; a negative one counts the entry's parts
            rows = [(int(e * width + c), k, x) for (e, c), total in np.ndenumerate(sums) for k, x in enumerate(_limbs(int(total))) if x]
            rows += [(-1 - int(p * len(first) + e), 0, int(n)) for (p, e), n in np.ndenumerate(counts) if n]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64()))], names=["cell", "limb", "n"])

        sums, counts = np.zeros((len(first), width), object), np.zeros((parts, len(first)), object)
        for r in vectors.select("x").mapInArrow(run, "cell bigint, limb int, n bigint").groupBy("cell", "limb").agg(F.sum("n").alias("n")).collect():  # a few rows a component of an entry
            if r["cell"] < 0:
                counts[divmod(-1 - r["cell"], len(first))] += r["n"]
            else:
                sums[divmod(r["cell"], width)] += r["n"] << (LIMB * r["limb"])
        new = []
        for p, s in enumerate(where):
            rows = [[int(t) // int(counts[p, e]) for t in sums[e, s]] if counts[p, e] else [int(c) for c in books[p][e]] for e in range(len(first))]
            new.append(_integers(rows, s.stop - s.start))
        books = new
    return books


def _integers(rows: list[list[int]], width: int) -> np.ndarray:
    large = any(abs(c) > SMALL for row in rows for c in row)
    return np.array(rows, object if large else np.int64).reshape(len(rows), width)


def compress_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """Codes of all vectors: key, code (two hexadecimal digits a part), error (squared distances summed over parts), label_error (errors of the
    same label, nulls together) and codebooks_sha256.

    Rows whose vector is null or holds a null or non-finite component go, as the contract says. Codebooks start from the rows of the least keys
    (null keys last, ties by vector; all, if there are fewer than `entries`). The first kept row of that order sets the width: a vector of another width, which can't be
    compared, has neither code nor error. A width that is no multiple of `parts` gives the first parts one component more; parts without one are equal. Repeated rows and null
    keys stay rows of their own; an error that no long holds is null; an empty table gives an empty result; other columns are ignored.
    """
    own = pick(df, key=key, x=vector, label=label)
    odd = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    own = own.where(F.col("x").isNotNull() & ~odd)
    first = own.orderBy(F.col("key").asc_nulls_last(), "x").select("x").limit(entries).collect()  # `entries` vectors
    width = len(first[0]["x"]) if first else 0
    start = [r["x"] for r in first if len(r["x"]) == width]
    alike = F.size("x") == width
    begun = _integers([[int(c) for c in row] for row in quantise(np.array(start, np.float64).reshape(len(start), width), scale)], width)
    books = fit_codebooks(own.where(alike), begun, parts, rounds, scale)
    where = cuts(width, parts)
    digest = hashlib.sha256(",".join(str(int(c)) for b in books for row in b for c in row).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = pc.equal(pc.list_value_length(batch.column("x")), width)
            other = batch.filter(pc.invert(alike))
            yield pa.RecordBatch.from_arrays([other.column("key"), other.column("label"), pa.nulls(other.num_rows, pa.string()), pa.nulls(other.num_rows, pa.int64())], names=["key", "label", "code", "error"])
            for part, v in _rows(batch.filter(alike), width, scale):
                found = [nearest(v[:, s], b) for s, b in zip(where, books, strict=True)]
                code = np.stack([f[0] for f in found], 1).astype(np.uint8)
                error = sum(f[1] for f in found)
                held = [int(e) if e < 1 << 63 else None for e in error] if error.dtype == object else error
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("label"), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(held, pa.int64())], names=["key", "label", "code", "error"])

    kinds = {c: own.schema[c].dataType.simpleString() for c in ("key", "label")}
    coded = stage(own.mapInArrow(run, f"key {kinds['key']}, label {kinds['label']}, code string, error bigint"), "codes")
    sums = coded.groupBy(F.col("label").alias("label2")).agg(F.try_sum("error").alias("label_error"))
    same = F.col("label").eqNullSafe(F.col("label2"))
    if sums.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        both = coded.join(F.broadcast(sums), same)
    else:  # labels by the million are no hot ones but for a few, which are dealt over salts
        salts = 64
        many = sums.withColumn("salt2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salted = coded.withColumn("salt", F.pmod(F.xxhash64("key", "code"), F.lit(salts)).cast("int"))
        both = salted.join(many, same & (F.col("salt") == F.col("salt2")))
    return both.select(F.col("key").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """DuckDB twin over `embeddings`: a table for each round, in long form. Divisions go down by taking the remainder off first."""
    steps = [
        "k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0)",
        f"x AS MATERIALIZED (SELECT r, (i - 1) * {parts} // len(e) AS p, i AS c, CAST(floor(4096 * CAST(e[i] AS DOUBLE)) AS BIGINT) AS v FROM k, LATERAL (SELECT unnest(generate_series(1, len(e))) AS i))",
        f"b0 AS MATERIALIZED (SELECT p, r - 1 AS j, c, v AS m FROM x WHERE r <= {entries})",
    ]
    for n in range(rounds + 1):
        steps.append(f"d{n} AS (SELECT r, p, j, sum((v - m) * (v - m)) AS d FROM x JOIN b{n} USING (p, c) GROUP BY r, p, j)")
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, p, CAST(min(d * {entries} + j) % {entries} AS BIGINT) AS j, CAST(min(d) AS BIGINT) AS d FROM d{n} GROUP BY r, p)")
        if n < rounds:
            steps.append(f"s{n} AS (SELECT p, j, c, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM x JOIN a{n} USING (r, p) GROUP BY p, j, c)")
            steps.append(f"b{n + 1} AS MATERIALIZED (SELECT b.p, b.j, b.c, coalesce((s - ((s % n) + n) % n) // n, m) AS m FROM b{n} b LEFT JOIN s{n} s USING (p, j, c))")
    steps.append(f"h AS (SELECT sha256(string_agg(CAST(m AS VARCHAR), ',' ORDER BY p, j, c)) AS codebooks_sha256 FROM b{rounds})")
    steps.append(f"o AS (SELECT r, string_agg(printf('%02x', j), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN o USING (r), h"


SQL = _sql()

"""Column picking, the shared folder, and vectorised text helpers that the operators use."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from hedra.sources.shared import shared_dir

#: Delimiters of words: space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Columns by exact name under new names; other columns, even of clashing names, are left out."""
    at = df.columns
    flat = df.toDF(*[f"c{i}" for i in range(len(at))])
    return flat.select(*[F.col(f"c{at.index(old)}").alias(new) for new, old in names.items()])


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_counted(df: DataFrame, name: str, what: Column | None = None) -> tuple[DataFrame, int]:
    """stage(), and the number of rows of which `what` holds (null: all), counted while they are written: no job of its own."""
    seen = Observation()
    done = stage(df.observe(seen, F.count_if(F.lit(True) if what is None else what).alias("n")), name)
    return done, seen.get["n"]


def in_batches(df: DataFrame, most: str = "8m") -> DataFrame:
    """The same rows, with Arrow batches of about `most` bytes to Python, whatever their texts' lengths: sets the session's bound where it is left at its
    default, since Spark takes it when the plan runs."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name) == "67108864b":
        conf.set(name, most)
    return df


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a record batch of about `most` bytes of text each; one longer text stands alone."""
    size = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
    total, at = np.cumsum(size), 0
    while at < len(size):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def gathered(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Record batches of about `most` bytes of text each, across the batches given; one longer text stands alone."""
    held, size = [], 0
    for batch in batches:
        for part in text_slices(batch, column, most):
            n = pc.sum(pc.binary_length(part.column(column))).as_py() or 0
            if held and size + n > most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and each text's bounds in them (one more than rows); a null text is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    body = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and bounds[-1] > bounds[0] else np.empty(0, np.uint8)
    return body, bounds - bounds[0]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, as far as asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            m = max(n, 1 << 16)
            for name, p in (("up", _PRIME), ("down", _INVERSE)):
                x = np.full(m, p, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up, self.down


_POWERS = Powers()


def word_hashes(body: np.ndarray, bounds: np.ndarray, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts (A-Z in lower case), and where each text's words begin (one more than rows). Works on whole texts
    of about `most` bytes at a time, so that its scratch memory stays small."""
    found, starts, n, at = [np.empty(0, np.uint64)], [np.zeros(1, np.int64)], 0, 0
    while at < len(bounds) - 1:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        words, own = _some_word_hashes(body[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at])
        found.append(words), starts.append(own[1:] + n)
        n, at = n + len(words), to
    return np.concatenate(found), np.concatenate(starts)


def _some_word_hashes(body: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(body):
        return np.empty(0, np.uint64), np.zeros(len(bounds), np.int64)
    low = _LOWER[body]
    blank = _BLANK[low]
    first = np.zeros(len(body) + 1, bool)
    first[bounds] = True  # a text's first byte begins a word, whatever stands before it
    word = ~blank
    start = word & (first[:-1] | np.concatenate(([True], blank[:-1])))
    end = word & (first[1:] | np.concatenate((blank[1:], [True])))
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    up, down = _POWERS.to(len(body) + 1)
    total = np.zeros(len(body) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(low)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts]), np.searchsorted(starts, bounds)


def pack(x: np.ndarray) -> bytes:
    """Small integers as compressed byte planes."""
    x = np.ascontiguousarray(x)
    if not len(x):
        return b""
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T
    return zlib.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack(b: bytes, kind: type) -> np.ndarray:
    if not b:
        return np.empty(0, kind)
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zlib.decompress(b), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)

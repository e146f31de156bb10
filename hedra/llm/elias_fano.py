"""Elias-Fano sequences and one level of an n-gram trie, laid out in a file that is mapped into memory."""

from __future__ import annotations

import tempfile
from typing import BinaryIO

import numpy as np

#: Quantised probabilities: codes 1 .. 65535 are equal steps of log10 from -LOWEST to 0; code 0 is no entry.
LOWEST = 16.0
CODES = 65534


def quantise(p: np.ndarray) -> np.ndarray:
    return (1 + np.rint((1 + np.maximum(np.log10(np.maximum(p, 1e-300)), -LOWEST) / LOWEST) * CODES)).astype(np.uint16)


def dequantise(code: np.ndarray) -> np.ndarray:
    """Probabilities of codes; 0 for no entry."""
    return np.where(code > 0, 10.0 ** (((code.astype(np.float64) - 1) / CODES - 1) * LOWEST), 0.0)


class Writer:
    """A file of sections, which are mapped once all are written."""

    def __init__(self) -> None:
        self.file: BinaryIO = tempfile.TemporaryFile()  # noqa: SIM115  unlinked at once: nothing stays behind a task
        self.at, self.map = 0, None

    def put(self, x: np.ndarray) -> tuple[int, np.dtype, tuple[int, ...]]:
        x = np.ascontiguousarray(x)
        self.file.write(b"\0" * (-self.at % 8))
        place = (self.at + -self.at % 8, x.dtype, x.shape)
        self.file.write(x.tobytes())
        self.at = place[0] + x.nbytes
        return place

    def get(self, place: tuple[int, np.dtype, tuple[int, ...]]) -> np.ndarray:
        at, kind, shape = place
        if not np.prod(shape):
            return np.empty(shape, kind)
        if self.map is None:
            self.file.flush()
            self.map = np.memmap(self.file, np.uint8, "r")
        return self.map[at : at + int(np.prod(shape)) * kind.itemsize].view(kind).reshape(shape)


class EliasFano:
    """A sorted sequence: low bytes as they are, high parts in unary. Whole bytes are taken so that numpy reads them in place."""

    def __init__(self, values: np.ndarray, out: Writer) -> None:
        self.n, self.out = len(values), out
        values = values.astype(np.uint64)
        wide = (int(values[-1]) // max(self.n, 1)).bit_length() if self.n else 0
        self.bytes = min(7, -(-wide // 8))
        self.low = out.put(values.view(np.uint8).reshape(-1, 8)[:, : self.bytes])
        high = (values >> np.uint64(8 * self.bytes)).astype(np.int64)
        bits = np.zeros((int(high[-1]) if self.n else 0) + self.n + 1, np.uint8)
        bits[high + np.arange(self.n)] = 1
        self.upper = out.put(np.packbits(bits))
        self._high: np.ndarray | None = None

    def high(self) -> np.ndarray:
        """High parts of all entries, unpacked for a batch of searches."""
        if self._high is None:
            at = np.flatnonzero(np.unpackbits(self.out.get(self.upper)))
            self._high = at - np.arange(self.n)
        return self._high

    def _low(self, i: np.ndarray) -> np.ndarray:
        low, total = self.out.get(self.low), np.zeros(len(i), np.uint64)
        for k in range(self.bytes):
            total |= low[i, k].astype(np.uint64) << np.uint64(8 * k)
        return total

    def access(self, i: np.ndarray) -> np.ndarray:
        return self.high()[i].astype(np.uint64) << np.uint64(8 * self.bytes) | self._low(i)

    def successor(self, q: np.ndarray) -> np.ndarray:
        """Index of the first entry that is not less than q, n if there is none."""
        high = (q >> np.uint64(8 * self.bytes)).astype(np.int64)
        a, b = np.searchsorted(self.high(), high, "left"), np.searchsorted(self.high(), high, "right")
        low = q & np.uint64((1 << 8 * self.bytes) - 1)
        while len(open_ := np.flatnonzero(a < b)):
            mid = (a[open_] + b[open_]) // 2
            less = self._low(mid) < low[open_]
            a[open_[less]] = mid[less] + 1
            b[open_[~less]] = mid[~less]
        return a


class Level:
    """Successors of contexts: context nodes, monotone pointers to their ranges, relative successor ids, quantised probabilities, counts."""

    def __init__(self, nodes: np.ndarray, rel: np.ndarray, prob: np.ndarray, count: np.ndarray) -> None:
        """Entries in order of (node, rel), without repeats."""
        self.out, self.n = Writer(), len(nodes)
        start = np.flatnonzero(np.concatenate(([True], nodes[1:] != nodes[:-1]))) if self.n else np.zeros(0, np.int64)
        self.span = int(rel.max()) + 1 if self.n else 1
        if len(start) * self.span >= 1 << 63:
            raise OverflowError("a shard with so many contexts and successors needs more shards")
        self.contexts = EliasFano(nodes[start], self.out)
        self.pointers = EliasFano(np.append(start, self.n).astype(np.uint64), self.out)
        owner = np.repeat(np.arange(len(start), dtype=np.uint64), np.diff(np.append(start, self.n)))
        self.successors = EliasFano(owner * np.uint64(self.span) + rel, self.out)
        self.codes, self.counts = self.out.put(quantise(prob)), self.out.put(count.astype(np.uint64))

    def find(self, nodes: np.ndarray, rel: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Code (0: no such entry), count, index, and rank among the context's successors, of every (node, rel) asked for."""
        code, count = np.zeros(len(nodes), np.uint16), np.zeros(len(nodes), np.uint64)
        at, rank = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
        c = self.contexts.successor(nodes)
        ask = np.flatnonzero((c < self.contexts.n) & (rel < self.span))
        ask = ask[self.contexts.access(c[ask]) == nodes[ask]]
        c = c[ask]
        begin, end = self.pointers.access(c).astype(np.int64), self.pointers.access(c + 1).astype(np.int64)
        want = c.astype(np.uint64) * np.uint64(self.span) + rel[ask]  # relative to the context's place
        i = self.successors.successor(want)
        there = i < end
        there[there] = self.successors.access(i[there]) == want[there]
        ask, i, begin = ask[there], i[there], begin[there]
        code[ask], count[ask], at[ask], rank[ask] = self.out.get(self.codes)[i], self.out.get(self.counts)[i], i, i - begin
        return code, count, at, rank

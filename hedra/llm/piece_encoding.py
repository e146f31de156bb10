"""SentencePiece (BPE) encoding that keeps offsets, and decoding.

A text is normalised by the longest prefix that the model's compiled character map knows (else one character), while every normalised byte
keeps the place of its source. Normalised stretches that no piece can cross go to the library's merging, each distinct one once a task, with
the library's own normaliser switched off; every piece is projected through the alignment to the original bytes.
"""

from __future__ import annotations

import itertools
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import SentencePieceProcessor

from hedra.llm.common import in_batches, pick, text_bytes, text_slices

#: The sign that stands for a space in pieces.
SIGN = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message: number and value."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = {1: 8, 5: 4}[kind]
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class CharMap:
    """The compiled character map: a double-array trie over UTF-8 prefixes, and the strings that replace them."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Length and replacement of the longest known prefix of data[at:]; length 0 if there is none."""
        units, best = self.units, (0, b"")
        if not units:
            return best
        offset = lambda u: (u >> 10) << ((u & 0x200) >> 6)
        node = offset(units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            unit = units[node] if node < len(units) else 0xFFFFFFFF
            if unit & 0x800000FF != data[k]:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                best = (k + 1 - at, self.texts[start : self.texts.index(b"\0", start)])
        return best


class PieceModel:
    """A SentencePiece BPE model read from its file."""

    def __init__(self, data: bytes) -> None:
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.scores: list[float] = []
        self.dummy = self.squeeze = self.escape = True
        self.fallback, self.unk_surface, chars = False, " ⁇ ", b""
        for number, value in _fields(data):
            if number == 1:
                piece, kind, score = "", NORMAL, 0.0
                for n, v in _fields(value):
                    piece = v.decode() if n == 1 else piece
                    score = struct.unpack("<f", v)[0] if n == 2 else score
                    kind = v if n == 3 else kind
                self.pieces.append(piece), self.kinds.append(kind), self.scores.append(score)
            elif number == 2:
                for n, v in _fields(value):
                    if n == 3 and v != 2:
                        raise ValueError("only BPE models are known")
                    self.fallback = bool(v) if n == 35 else self.fallback
                    self.unk_surface = v.decode() if n == 44 else self.unk_surface
            elif number == 3:
                for n, v in _fields(value):
                    chars = v if n == 2 else chars
                    self.dummy = bool(v) if n == 3 else self.dummy
                    self.squeeze = bool(v) if n == 4 else self.squeeze
                    self.escape = bool(v) if n == 5 else self.escape
        if USER in self.kinds or UNUSED in self.kinds:
            raise ValueError("models with user-defined or unused pieces are not known")
        self.chars = CharMap(chars)
        self.unknown = self.kinds.index(UNKNOWN)
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        inner = {(a, b) for p in self.ids for a, b in zip(p, p[1:], strict=False)}
        self.words = not any(b == SIGN and a != SIGN for a, b in inner)
        self.lines = not any("\n" in x for x in inner)
        # a later field of the same message wins: no dummy prefix, no squeezing, no character map
        self.merger = SentencePieceProcessor(model_proto=data + b"\x1a\x08\x12\x00\x18\x00\x20\x00\x28\x01")
        surfaces = [bytes((int(p[3:5], 16),)) if k == BYTE else b"" if k == CONTROL else (self.unk_surface if k == UNKNOWN else p.replace(SIGN, " ")).encode() for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.surfaces, self.surface_sizes = np.frombuffer(b"".join(surfaces), np.uint8), np.array([len(x) for x in surfaces], np.int64)
        self.sizes = np.array([1 if k == BYTE else len(p.encode()) for p, k in zip(self.pieces, self.kinds, strict=True)], np.int64)
        self.signed = np.array([p.startswith(SIGN) for p in self.pieces])

    # -- normalisation ------------------------------------------------------------------------------------------------

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes (and its end) the source byte."""
        data = text.encode()
        if not data:
            return "", np.zeros(1, np.int32)
        out, where, at = bytearray(), [], 0
        space = SIGN.encode() if self.escape else b" "

        def step(at: int) -> tuple[int, bytes]:
            size, new = self.chars.longest(data, at)
            if not size:
                first = data[at]
                size = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                new = data[at : at + size]
            return size, new

        if self.squeeze:
            while at < len(data):
                size, new = step(at)
                if new.strip(b" "):
                    break
                at += size
            if at == len(data):
                return "", np.zeros(1, np.int32)
        if self.dummy:
            out += space
            where += [at] * len(space)
        gap = self.squeeze
        while at < len(data):
            size, new = step(at)
            if gap:
                new = new.lstrip(b" ")
            if new:
                for b in new:
                    part = space if b == 32 else bytes((b,))
                    out += part
                    where += [at] * len(part)
                gap = self.squeeze and new.endswith(b" ")
            at += size
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :]
                at = where[len(out)]
                del where[len(out) :]
        where.append(at)
        return out.decode(), np.array(where, np.int32)

    # -- decoding ------------------------------------------------------------------------------------------------------

    def decode(self, ids: list[int], first: bool = True) -> str:
        """Text of ids; `first`: they begin a text, whose dummy space goes."""
        out, run = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):  # like the library: one replacement sign for each byte that begins no character
                for size in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + size]).decode())
                        at += size
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            run.clear()

        strip = first and (self.dummy or self.squeeze)
        for i in ids:
            kind, p = self.kinds[i], self.pieces[i]
            if kind == BYTE:
                run.append(int(p[3:5], 16))
                strip = False
                continue
            flush()
            if kind == CONTROL:
                continue
            if kind == UNKNOWN:
                out.append(self.unk_surface)
            else:
                if strip and p.startswith(SIGN):
                    p = p[1:]
                out.append(p.replace(SIGN, " "))
            strip = False
        flush()
        return "".join(out)


@lru_cache(maxsize=4)
def load(data: bytes) -> PieceModel:
    return PieceModel(data)


class Encoder:
    """Encodes many texts; keeps the ids of the stretches seen, up to `most` of them and `most_chars` characters, then begins anew."""

    def __init__(self, model: PieceModel, most: int = 200_000, most_chars: int = 4 << 20) -> None:
        if not model.fallback:
            raise ValueError("only models with byte fallback are known")
        self.model, self.most, self.most_chars = model, most, most_chars
        tail = r"\n" if model.lines else ""
        self.cut = re.compile(f"{SIGN}+[^{SIGN}{tail}]*|[^{SIGN}{tail}]+" + (r"|\n" if tail else "")) if model.words and model.escape else re.compile(r"(?s).+")
        self.plain = not model.chars.units and not model.squeeze and model.escape and model.dummy
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.counts, self.ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]

    def learn(self, stretches: list[str]) -> None:
        new = list({s: None for s in stretches if s not in self.known})
        found = self.model.merger.encode(new, num_threads=1)
        self.counts.append(np.array([len(x) for x in found], np.int64))
        self.ids.append(np.fromiter(itertools.chain.from_iterable(found), np.int32))
        self.chars += sum(map(len, new))
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, their bounds by text, begin and end of every piece in its text's bytes, decoded bytes and their bounds by text."""
        if len(self.known) > self.most or self.chars > self.most_chars:
            self.reset()
        model, stretches, per_text, maps = self.model, [], [], []
        for t in texts:
            if self.plain:
                normal = SIGN + t.replace(" ", SIGN) if t else ""
            else:
                normal, where = model.normalise(t)
                maps.append(where)
            found = self.cut.findall(normal)
            stretches += found
            per_text.append(len(found))
        self.learn(stretches)
        at = np.fromiter(map(self.known.__getitem__, stretches), np.int64, len(stretches))
        self.counts, self.ids = [np.concatenate(self.counts)], [np.concatenate(self.ids)]
        ids, bounds = _gather(self.ids[0], self.counts[0], at, per_text)
        end = np.cumsum(model.sizes[ids])
        base = np.concatenate(([0], end))[bounds[:-1]]
        end -= np.repeat(base, np.diff(bounds))
        begins, ends = self._project(texts, maps, end - model.sizes[ids], end, bounds)
        decoded, to = _gather(model.surfaces, model.surface_sizes, ids, np.diff(bounds))
        if model.dummy or model.squeeze:  # the dummy space goes
            own = np.flatnonzero(np.diff(bounds))
            own = own[model.signed[ids[bounds[own]]]]
            decoded = np.delete(decoded, to[own])
            gone = np.zeros(len(texts) + 1, np.int64)
            gone[own + 1] = 1
            to = to - np.cumsum(gone)
        return ids, bounds, begins, ends, decoded, to

    def _project(self, texts: list[str], maps: list[np.ndarray], begin: np.ndarray, end: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.plain:  # every byte is itself, a space has three, and three stand before the text
            maps = []
            for t in texts:
                raw = np.frombuffer(t.encode(), np.uint8)
                maps.append(np.concatenate((np.zeros(3 if len(raw) else 0, np.int32), np.repeat(np.arange(len(raw), dtype=np.int32), np.where(raw == 32, 3, 1)), [len(raw)])))
        first = np.cumsum([0, *(len(m) for m in maps)])[:-1]
        where = np.concatenate(maps) if maps else np.zeros(0, np.int32)
        shift = np.repeat(first, np.diff(bounds))
        return where[begin + shift].astype(np.int32), where[end + shift].astype(np.int32)


def _gather(pool: np.ndarray, counts: np.ndarray, at: np.ndarray, per_text: list[int] | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated pool entries `at`, of so many items each, and their bounds by text."""
    starts = np.concatenate(([0], np.cumsum(counts)))
    own = counts[at]
    to = np.concatenate(([0], np.cumsum(own)))
    out = pool[np.repeat(starts[at] - to[:-1], own) + np.arange(to[-1])]
    return out, to[np.concatenate(([0], np.cumsum(per_text, dtype=np.int64)))]


def encode_pieces(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text", slice_bytes: int = 1 << 20) -> DataFrame:
    """Pieces of whole texts under a model (the bytes of its file).

    Returns key, ids, begins and ends (byte spans of the original text, one for each id; a byte id has its own byte) and decoded. A null or empty text has no ids and decodes to an empty text.
    Repeated rows and null keys stay rows of their own; an empty table gives an empty result; other columns are ignored. Memory in a task
    is bounded by `slice_bytes` of text (or the longest text) and the cache of stretches. Where a model's character map is empty (as that of the given one), texts are not
    normalised but for their spaces, and every byte is aligned with itself.
    """
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a file of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(load(shared.value))
        for batch in batches:
            for part in text_slices(batch, "text", slice_bytes):
                ids, bounds, begins, ends, decoded, to = encode(part.column("text").fill_null("").to_pylist())
                lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, pa.int32())) for x in (ids, begins, ends)]
                texts = pa.StringArray.from_buffers(len(to) - 1, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(decoded)))
                yield pa.RecordBatch.from_arrays([part.column("key"), *lists, texts], names=[key, "ids", "begins", "ends", "decoded"])

    return in_batches(pick(docs, key=key, text=text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>, begins array<int>, ends array<int>, decoded string")

"""Telephony audio columns: bytes are stored as mu-law samples in WAV files, read back, expanded, and stored again as resampled PCM.

Expansion of mu-law and A-law is a table lookup; ADPCM is decoded by numpy across all blocks of a batch at once, so that the loop runs over
the samples of one block only.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hedra.llm.common import text_bytes, text_slices

RATE = 8000
UNIT = 64
#: Format tags of WAV files.
PCM, MULAW = 1, 7

# Fixed values of IMA ADPCM: step sizes and index changes.
STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157,
    173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707,
    1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899,
    15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]
CHANGES = [-1, -1, -1, -1, 2, 4, 6, 8]


def _mulaw() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 255
    size = ((((code & 15) << 3) + 132) << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    part, low = code >> 4 & 7, (code & 15) << 4
    size = np.where(part == 0, low + 8, (low + 264) << np.maximum(part - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW_TABLE, ALAW_TABLE = _mulaw(), _alaw()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """IMA ADPCM, one channel: rows of equal length (first sample, step index, a spare byte, then two codes a byte) to rows of samples."""
    steps, changes = np.array(STEPS, np.int32), np.array(CHANGES, np.int32)
    now = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    out = np.empty((1 + 2 * (blocks.shape[1] - 4), len(blocks)), np.int16)
    out[0] = now
    codes = np.ascontiguousarray(blocks[:, 4:].T).astype(np.int32)
    for k in range(1, len(out)):
        byte = codes[(k - 1) // 2]
        code = byte & 15 if k % 2 else byte >> 4
        size, step = code & 7, steps[index]
        jump = (step >> 3) + (step & -(size & 1)) // 4 + (step & -(size >> 1 & 1)) // 2 + (step & -(size >> 2))
        now = np.clip(now + np.where(code & 8, -jump, jump), -32768, 32767)
        index = np.clip(index + changes[size], 0, len(STEPS) - 1)
        out[k] = now
    return out.T


def double_rate(samples: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Twice the rate by the four-point half-band filter (-1, 9, 9, -1)/16; a clip's ends are held. Clips don't mix."""
    counts = np.diff(bounds)
    low, high = np.repeat(bounds[:-1], counts), np.repeat(bounds[1:] - 1, counts)
    at, x = np.arange(len(samples)), samples.astype(np.int32)
    between = (9 * (x + x[np.minimum(at + 1, high)]) - x[np.maximum(at - 1, low)] - x[np.minimum(at + 2, high)] + 8) >> 4
    out = np.empty(2 * len(samples), np.int16)
    out[0::2], out[1::2] = samples, np.clip(between, -32768, 32767)
    return out


def wav(data: bytes, tag: int, rate: int, bits: int) -> bytes:
    """A WAV file of one channel; formats other than PCM have an extension size and a fact chunk."""
    form = struct.pack("<HHIIHH", tag, 1, rate, rate * bits // 8, bits // 8, bits) + (b"" if tag == PCM else b"\0\0")
    fact = b"" if tag == PCM else b"fact" + struct.pack("<II", 4, len(data) * 8 // bits)
    rest = b"WAVEfmt " + struct.pack("<I", len(form)) + form + fact + b"data" + struct.pack("<I", len(data) & 0xFFFFFFFF) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(rest) & 0xFFFFFFFF) + rest


def unwav(file: bytes) -> tuple[int, int, memoryview]:
    """Format tag, rate and sample bytes of a WAV file."""
    if file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, tag, rate = 12, 0, 0
    while at + 8 <= len(file):
        name, size = file[at : at + 4], struct.unpack_from("<I", file, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", file, at + 8)
        elif name == b"data":
            return tag, rate, memoryview(file)[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data in the WAV file")


def _sums(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums over each clip; no clip is empty."""
    return np.add.reduceat(x, bounds[:-1])


def features(payload: np.ndarray, bounds: np.ndarray, pcm: np.ndarray) -> list[str]:
    """For each clip the mean square of its samples read as mu-law, A-law and ADPCM, its sign changes, and a checksum of the resampled samples."""
    counts, said = np.diff(bounds), []
    squares = [_sums(np.square(t[payload].astype(np.int64)), bounds) // counts for t in (MULAW_TABLE, ALAW_TABLE)]
    by_block = np.empty(len(payload) // UNIT, np.int64)
    for at in range(0, len(by_block), 1 << 13):
        part = decode_adpcm(payload[at * UNIT : (at + (1 << 13)) * UNIT].reshape(-1, UNIT))
        by_block[at : at + len(part)] = np.square(part.astype(np.int64)).sum(1)
    squares.append(_sums(by_block, bounds // UNIT) // (counts // UNIT * (2 * UNIT - 7)))
    sign = MULAW_TABLE[payload] < 0
    turn = np.concatenate(([False], sign[1:] != sign[:-1]))
    turn[bounds[:-1]] = False
    turns, raw = _sums(turn.astype(np.int64), bounds), pcm.astype("<i2", copy=False)
    for i in range(len(counts)):
        said.append(f"mulaw={squares[0][i]};alaw={squares[1][i]};adpcm={squares[2][i]};turns={turns[i]};pcm16k={zlib.crc32(raw[2 * bounds[i] : 2 * bounds[i + 1]]):08x}")
    return said


def pad(body: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Clips with zero bytes up to a positive multiple of UNIT."""
    counts = np.diff(bounds)
    full = np.maximum(-(-counts // UNIT), 1) * UNIT
    to = np.concatenate(([0], np.cumsum(full)))
    out = np.zeros(to[-1], np.uint8)
    out[np.arange(len(body)) + np.repeat(to[:-1] - bounds[:-1], counts)] = body
    return out, to


def store_telephony(docs: DataFrame, key: str = "doc_id", text: str = "text", slice_bytes: int = 1 << 20) -> DataFrame:
    """Texts (UTF-8; null: empty) as telephony audio.

    Returns key, n_bytes (unpadded), media (mu-law WAV file of the padded bytes), payload (the bytes as read back from media), pcm (16-bit
    WAV file of twice the rate, from the expanded samples) and feature. An empty text is one unit of zeros; equal texts give equal values;
    repeated rows and null keys stay rows of their own; an empty table gives an empty result; other columns are ignored. Memory in a task
    is about 40 times `slice_bytes` of text, or of the longest text.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", slice_bytes):
                body, bounds = text_bytes(part.column("text"))
                samples, to = pad(body, bounds)
                files = [wav(samples[a:b].tobytes(), MULAW, RATE, 8) for a, b in zip(to[:-1], to[1:], strict=True)]
                back = [unwav(f)[2] for f in files]
                payload = np.frombuffer(b"".join(back), np.uint8)
                pcm = double_rate(MULAW_TABLE[payload], to)
                stored = [wav(pcm[2 * a : 2 * b].astype("<i2").tobytes(), PCM, 2 * RATE, 16) for a, b in zip(to[:-1], to[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(np.diff(bounds)), pa.array(files, pa.binary()), pa.array([bytes(b) for b in back], pa.binary()), pa.array(stored, pa.binary()), pa.array(features(payload, to, pcm))],
                    names=[key, "n_bytes", "media", "payload", "pcm", "feature"],
                )

    from hedra.llm.common import pick

    return pick(docs, key=key, text=text).mapInArrow(run, f"`{key}` {kind}, n_bytes bigint, media binary, payload binary, pcm binary, feature string")

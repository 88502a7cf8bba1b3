"""Vectorised words and word windows of whole texts, shared by the operators on shingles.

A word is a maximal run of bytes other than space and 0x09 to 0x0D. All hashes are 64-bit polynomials over random byte
(or word) codes modulo 2**64, finished by a bit mixer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in slices of about so many bytes (whole texts; a longer one is a slice of its own).
SLICE_BYTES = 1 << 19
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Bit mixer over uint64 (a bijection for each salt)."""
    z = x + U64((salt * 0xD1B54A32D192ED03 + 0x9E3779B97F4A7C15) % (1 << 64))
    z = (z ^ (z >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U64(27))) * U64(0x94D049BB133111EB)
    return z ^ (z >> U64(31))


BYTE_CODES = mix(np.arange(256, dtype=U64), 1)
BYTE_CODES_LOWER = BYTE_CODES.copy()
BYTE_CODES_LOWER[65:91] = BYTE_CODES[97:123]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, U64)

    def need(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(n, base, U64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=U64))


_POWERS = _Powers()


class Rolling:
    """Hashes of any windows of one flat sequence of codes in constant time each."""

    def __init__(self, codes: np.ndarray):
        _POWERS.need(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, U64)
        np.cumsum(codes * _POWERS.up[: len(codes)], out=self.sums[1:])

    def windows(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * _POWERS.down[start], 2)


@dataclass
class Words:
    """Words of a slice of texts: byte bounds in ``data``, and the first word of each text in ``first``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # length texts + 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, lower: bool = False) -> np.ndarray:
        rolled = Rolling((BYTE_CODES_LOWER if lower else BYTE_CODES)[self.data])
        return rolled.windows(self.start, self.end)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array, and the offsets of each text in it; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    if data is None or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), bounds - bounds[0]
    return np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]], bounds - bounds[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of whole rows with about ``limit`` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def split_words(texts: pa.Array, apart: np.ndarray = IS_SPACE) -> Words:
    """Words between bytes that ``apart`` marks."""
    data, bounds = text_bytes(texts)
    inside = ~apart[data]
    before = np.zeros(len(data), bool)  # the byte before belongs to the same text and to a word
    after = np.zeros(len(data), bool)
    if len(data):
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        cuts = bounds[(bounds > 0) & (bounds < len(data))]
        before[cuts] = False
        after[cuts - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, start, end, np.searchsorted(start, bounds))


def word_windows(hashes: np.ndarray, first: np.ndarray, size: int, whole_if_short: bool = True
                 ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words: (text number, first word of the window, hash).

    With ``whole_if_short`` a text of 1 to ``size`` - 1 words has one window, its whole sequence.
    """
    counts = np.diff(first)
    per_text = np.maximum(counts - size + 1, 0)
    if whole_if_short:
        per_text = np.where((counts > 0) & (counts < size), 1, per_text)
    text = np.repeat(np.arange(len(counts)), per_text)
    at = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text) + first[:-1][text]
    return text, at, Rolling(hashes).windows(at, np.minimum(at + size, first[1:][text]))


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 as the signed integers that Spark stores."""
    return x.view(np.int64)

"""Vectorised passes over the UTF-8 bytes of an Arrow text column: slices of documents, runs of bytes, their 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import SLICE_BYTES

_RNG = np.random.default_rng(20240607)
#: A random odd word for each byte, the base of the hash, and its inverse modulo 2**64.
BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1); a process keeps those of a slice, longer ones are made anew."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        _POWERS[base] = have if n <= SLICE_BYTES + 1 else have[: SLICE_BYTES + 1].copy()
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: A random word for each place of a run's first bytes and each byte there.
PLACES = 64
_PLACED = mix(np.arange(PLACES * 256, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D))


def run_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run buf[start:end] that depends on its bytes alone: a sum of random words, one for each place and
    byte (tabulation). No structure of texts makes two of them meet, as it does in a polynomial modulo 2^64, whose value is
    the same for a Thue-Morse word and its complement."""
    lens = ends - starts
    at = np.arange(len(buf), dtype=np.int64)
    at[:] -= np.repeat(np.append(0, starts), np.diff(np.concatenate([[0], starts, [len(buf)]])))
    words = _PLACED[((at & (PLACES - 1)) << 8) | buf]
    far = np.flatnonzero(at >= PLACES)  # later places have words of their own
    words[far] = mix(words[far] + at[far].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(words, out=sums[1:])
    return mix(sums[ends] - sums[starts] + lens.astype(np.uint64))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column without a copy of the bytes; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def doc_slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """(first, last) document of runs of about ``most`` bytes; a longer document stands alone."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last

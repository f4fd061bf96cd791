"""Hashes of words and of word windows, from the bytes of a column of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RANDOM = np.random.default_rng(20260101).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = _RANDOM.copy()
_LOWER[65:91] = _RANDOM[97:123]
#: Texts that are copied at a time.
ROWS = 512
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def byte_grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash) of every run of k bytes of a word and the mark before it; A-Z count as a-z."""
    values = np.full(len(data) + 1, np.uint64(0x1234567), np.uint64)
    values[1:] = np.where(outside[data], values[0], _LOWER[data])
    counts = np.maximum(0, ends - starts + 2 - k)
    stops = np.cumsum(counts)
    total = int(stops[-1]) if len(stops) else 0
    places = np.arange(total) + np.repeat(starts - stops + counts, counts)
    return np.repeat(np.arange(len(starts)), counts), windows(values, k)[places] if total else np.empty(0, np.uint64)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of k values, in order: h of length n gives n - k + 1."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    up, down = _power(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mixed((total[k:] - total[:-k]) * down[: len(h) - k + 1])


def flat_texts(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of texts; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8), offsets


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A hash of the bytes of every span."""
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER if lower else _RANDOM)[data] * up[: len(data)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def hashed(texts: pa.Array, lower: bool, most: int = 1 << 20, outside: np.ndarray = _SPACE) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Word hashes of stretches of texts of about ``most`` bytes (a longer text is a stretch of its own).

    Words are runs of bytes other than those ``outside`` (ASCII white space); with ``lower`` A-Z count as a-z. Yields
    (first text, words of each text, hashes of all words in turn, bytes, first byte and end of each word).
    Null texts have no words.
    """
    if len(texts) > ROWS:  # copies that a batch needs stay small
        for low in range(0, len(texts), ROWS):
            for at, *rest in hashed(texts.slice(low, ROWS), lower, most, outside):
                yield low + at, *rest
        return
    data, offsets = flat_texts(texts)
    at = 0
    while at < len(offsets) - 1:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        low, high = int(offsets[at]), int(offsets[end])
        own, cuts = data[low:high], offsets[at : end + 1] - low
        n = len(own)
        inside = ~outside[own]
        first = np.zeros(n + 1, bool)
        first[cuts] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        before &= ~first[:n]
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after &= ~first[1:]
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        yield at, np.diff(np.searchsorted(starts, cuts)), spans(own, starts, ends, lower), own, starts, ends
        at = end

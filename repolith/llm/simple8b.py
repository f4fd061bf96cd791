"""Simple-8b coding of id lists: 64-bit words of a 4-bit selector and 60 bits of payload."""

from __future__ import annotations

import struct

import numpy as np

#: Fixed values, by selector: ids in a word, bits of each. Selector 0 is an escape: its payload is
#: the place of a 64-bit id in the list of escapes.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1], np.int64)
WIDTHS = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60], np.int64)
LAST = 14
BLOCK = 4096
_HEAD = struct.Struct("<4sIIIII")
MAGIC = b"S8B1"


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bits of each id."""
    out = np.zeros(len(ids), np.uint8)
    if len(ids) and ids.max() < 1 << 24:  # a float of 32 bits holds these exactly
        return np.where(ids > 0, (ids.astype(np.float32).view(np.uint32) >> np.uint32(23)).astype(np.int32) - 126, 0).astype(np.uint8)
    for width in np.unique(WIDTHS[1:]).tolist():  # only these widths matter
        np.copyto(out, np.uint8(width + 1), where=ids >> np.uint64(width) != 0)
    return out


def pack(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """Any unsigned 64-bit ids; each block of ``block`` ids starts a new word, whose place the block offsets tell."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    blocks = -(-n // block)
    padded = np.zeros(blocks * block + 64, np.uint64)
    padded[:n] = ids
    # bits of each id, a row per block; what stands past a block's end has none, so that its last word may hold fewer
    bits = np.zeros((blocks, block + 64), np.uint8)
    bits[:, :block] = _bits(padded[: blocks * block]).reshape(blocks, block)
    best = np.zeros((blocks, block), np.int8)
    widest, span = bits, 1  # the widest of ``span`` ids from each place on
    for selector in range(LAST, 0, -1):  # the last that holds is the one with most ids
        count = int(COUNTS[selector])
        while span < count:
            step = min(span, count - span)
            widest = np.maximum(widest[:, :-step], widest[:, step:])
            span += step
        np.copyto(best, np.int8(selector), where=widest[:, :block] <= WIDTHS[selector])
    best = best.ravel()
    best[n:] = 0
    room = (np.minimum((np.arange(blocks) + 1) * block, n)).repeat(block) - np.arange(blocks * block)
    # all blocks step from word to word together
    here = np.arange(blocks, dtype=np.int64) * block
    till = np.minimum(here + block, n)
    steps: list[np.ndarray] = []
    live = np.arange(blocks)
    while len(live):
        steps.append(here[live])
        here[live] += COUNTS[best[here[live]]]
        live = live[here[live] < till[live]]
    places = np.sort(np.concatenate(steps)) if steps else np.empty(0, np.int64)
    chosen = best[places]
    words = chosen.astype(np.uint64)
    for selector in range(1, LAST + 1):
        own = np.flatnonzero(chosen == selector)
        if not len(own):
            continue
        first, count, width = places[own], int(COUNTS[selector]), int(WIDTHS[selector])
        free = room[first]
        value = np.zeros(len(own), np.uint64)
        for j in range(count):
            value |= np.where(j < free, padded[first + j], np.uint64(0)) << np.uint64(j * width)
        words[own] |= value << np.uint64(4)
    escaped = np.flatnonzero(chosen == 0)
    escapes = padded[places[escaped]]
    words[escaped] |= np.arange(len(escaped), dtype=np.uint64) << np.uint64(4)
    offsets = np.searchsorted(places, np.arange(blocks) * block).astype("<u4")
    return b"".join((
        _HEAD.pack(MAGIC, n, block, blocks, len(words), len(escapes)),
        offsets.tobytes(), words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes(),
    ))


def unpack(data: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The ids from ``start`` to ``stop``; only their blocks are decoded."""
    magic, n, block, blocks, n_words, n_escapes = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b list")
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.empty(0, np.uint64)
    at = _HEAD.size
    offsets = np.append(np.frombuffer(data, "<u4", blocks, at), n_words).astype(np.int64)
    at += 4 * blocks
    low, high = start // block, -(-stop // block)
    words = np.frombuffer(data, "<u8", offsets[high] - offsets[low], at + 8 * offsets[low])
    escapes = np.frombuffer(data, "<u8", n_escapes, at + 8 * n_words)
    selectors = (words & np.uint64(15)).astype(np.int64)
    counts = COUNTS[selectors]
    # what a word at a block's end has room for
    of = np.repeat(np.arange(low, high), np.diff(offsets[low : high + 1]))
    ends = np.cumsum(counts)
    first_word = offsets[of] - offsets[low]
    begun = ends - counts - (ends - counts)[first_word]
    counts = np.minimum(counts, np.minimum(block, n - of * block) - begun)
    ends = np.cumsum(counts)
    out = np.empty(int(ends[-1]), np.uint64)
    payload = words >> np.uint64(4)
    for selector in np.unique(selectors):
        own = np.flatnonzero(selectors == selector)
        width = np.uint64(WIDTHS[selector])
        mask = np.uint64((1 << int(width)) - 1)
        for j in range(int(COUNTS[selector])):
            has = own[counts[own] > j]
            if not len(has):
                break
            value = payload[has] >> (np.uint64(j) * width) & mask
            out[ends[has] - counts[has] + j] = escapes[value.astype(np.int64)] if selector == 0 else value
    return out[start - low * block : stop - low * block]

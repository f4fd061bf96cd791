"""Token ids of whole texts, by the tokenizers library."""

from __future__ import annotations

import ctypes
import gc
import json
import os
from collections.abc import Callable, Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa

from .words import ROWS, flat_texts, spans

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x0A]] = True
_OTHER = np.zeros(256, bool)
_OTHER[[0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F]] = True
#: White space beyond ASCII. Its UTF-8 bytes as numbers, and the bytes that they begin with.
_WIDE = np.array([int.from_bytes(chr(c).encode().ljust(3, b"\0"), "big") for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)])
_LEADS = np.zeros(256, bool)
_LEADS[_WIDE >> 16] = True


def _odd_spaces(own: np.ndarray) -> np.ndarray:
    """Places of white space other than blanks and line ends."""
    lead = np.flatnonzero(_LEADS[own])
    padded = np.append(own, [np.uint8(0)] * 2).astype(np.int64) if len(lead) else own
    code = (padded[lead] << 16) + (padded[lead + 1] << 8) + np.where(own[lead] == 0xC2, 0, padded[lead + 2]) if len(lead) else lead
    return np.concatenate([np.flatnonzero(_OTHER[own]), lead[np.isin(code, _WIDE)]])

#: A character that texts hardly hold.
MARK = "\u2042"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Places:
    """A growing open-addressing table from 64-bit hashes to numbers; lookups and inserts are vectorised."""

    def __init__(self, bits: int = 16) -> None:
        self.bits, self.n = bits, 0
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.empty(1 << bits, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int32)
        at = np.arange(len(h))
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(at):
            held = self.keys[slot]
            hit = held == h[at]
            out[at[hit]] = self.values[slot[hit]]
            go = ~hit & (held != 0)
            at, slot = at[go], (slot[go] + 1) & (len(self.keys) - 1)
        return out

    def add(self, h: np.ndarray, values: np.ndarray) -> None:
        while 2 * (self.n + len(h)) > len(self.keys):
            own = np.flatnonzero(self.keys)
            h, values = np.concatenate([self.keys[own], h]), np.concatenate([self.values[own], values])
            self.__init__(self.bits + 1)
        self.n += len(h)
        at = np.arange(len(h))
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(at):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[at[free]]
            done = self.keys[slot] == h[at]
            self.values[slot[done]] = values[at[done]]
            at, slot = at[~done], (slot[~done] + 1) & (len(self.keys) - 1)


class SegmentEncoder:
    """The ids that ``Tokenizer.encode`` gives for texts, from a cache of their segments.

    A segment is a run of blanks or line ends with the word after it. Pre-tokenizers of the
    vocabularies used here always cut before white space that follows another character, so the ids
    of a text are those of its segments in turn. Segments are known by 64-bit hashes, at most
    ``most`` of them. A text with other white space is encoded in one call.
    """

    def __init__(self, path: str, most: int = 700_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        self.sizes = self._token_sizes(json.loads(self.tokenizer.to_str()))
        self.mark = self._mark_ids() if self.sizes is None else None
        self._clear()

    def _token_sizes(self, rules: dict) -> np.ndarray | None:
        """Bytes of text that each id stands for, where the vocabulary is of bytes and nothing changes them; else None."""
        if rules["normalizer"] or (rules["pre_tokenizer"] or {}).get("type") != "ByteLevel" or rules["pre_tokenizer"].get("add_prefix_space"):
            return None
        special = {x["content"] for x in rules["added_tokens"]}
        known = self.tokenizer.get_vocab()
        sizes = np.zeros(max(known.values()) + 1, np.int64)
        for token, i in known.items():
            sizes[i] = len(token.encode()) if token in special else len(token)
        return sizes

    def _clear(self) -> None:
        self.places = _Places()
        self.flat = np.empty(1 << 16, np.uint32)
        self.starts = np.empty(1 << 16, np.int64)
        self.lengths = np.empty(1 << 16, np.int32)
        self.used = self.known = 0

    def _mark_ids(self) -> np.ndarray | None:
        """The ids of MARK, where white space gives no ids and ends what stands before it; else None."""
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        mark = ids(MARK)
        drops = all(ids(f"{a}{space}{b}") == ids(a) + ids(b) for a in ("word", "Two", "7", "-") for b in ("word", MARK) for space in (" ", "  ", "\n ", " \n"))
        return np.array(mark, np.uint32) if drops and mark else None

    def _marked_ids(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same as _ids by a few calls: each segment stands with MARK after it, whose ids cut them apart."""
        mark = MARK.encode()
        texts = [b" ".join(chain.from_iterable((x, mark) for x in segments[low : low + 256])).decode() for low in range(0, len(segments), 256)]
        lists = [x.ids for low in range(0, len(texts), 64) for x in self.tokenizer.encode_batch_fast(texts[low : low + 64], add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(lists), np.uint32, sum(map(len, lists)))
        n = len(self.mark)
        here = np.ones(max(0, len(flat) - n + 1), bool)
        for k, i in enumerate(self.mark):
            here &= flat[k : k + len(here)] == i
        at = np.flatnonzero(here)
        if len(at) != len(segments):  # one holds the mark itself
            return self._ids(segments)
        lengths = np.diff(at, prepend=-n) - n
        return np.delete(flat, (at[:, None] + np.arange(n)).ravel()), lengths

    def _ids(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all segments in turn, how many each has)."""
        lists = [x.ids for low in range(0, len(segments), 4096) for x in self.tokenizer.encode_batch_fast([x.decode() for x in segments[low : low + 4096]], add_special_tokens=False)]
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.uint32, int(lengths.sum())), lengths

    def _joined_ids(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same of segments that may stand one after another in a text: a few calls for all, cut by the bytes of each id."""
        texts = [b"".join(segments[low : low + 256]).decode() for low in range(0, len(segments), 256)]
        lists = [x.ids for low in range(0, len(texts), 64) for x in self.tokenizer.encode_batch_fast(texts[low : low + 64], add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(lists), np.uint32, sum(map(len, lists)))
        ends = np.cumsum(np.fromiter(map(len, segments), np.int64, len(segments)))
        token_ends = np.cumsum(self.sizes[flat])
        stops = np.searchsorted(token_ends, ends)
        if len(token_ends) and (int(token_ends[-1]) != int(ends[-1]) or (token_ends[stops] != ends).any()):
            return self._ids(segments)
        return flat, np.diff(stops + 1, prepend=0)

    def _learn(self, h: np.ndarray, segments: list[bytes]) -> None:
        if self.sizes is None:
            flat, lengths = self._ids(segments) if self.mark is None else self._marked_ids(segments)
        else:
            # a segment that begins with its blanks and ends with a word may follow any other such
            joins = np.array([len(x) > 1 and _BLANK[x[0]] and not _BLANK[x[-1]] for x in segments], bool)
            order = np.concatenate([np.flatnonzero(joins), np.flatnonzero(~joins)])
            h, segments, n = h[order], [segments[i] for i in order.tolist()], int(joins.sum())
            (one, some), (two, more) = self._joined_ids(segments[:n]), self._ids(segments[n:])
            flat, lengths = np.concatenate([one, two]), np.concatenate([some, more])
        at, n = self.known, len(segments)
        while len(self.flat) < self.used + len(flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while len(self.starts) < at + n:
            self.starts, self.lengths = (np.concatenate([x, np.empty_like(x)]) for x in (self.starts, self.lengths))
        self.flat[self.used : self.used + len(flat)] = flat
        self.starts[at : at + n] = self.used + np.cumsum(lengths) - lengths
        self.lengths[at : at + n] = lengths
        self.places.add(h, np.arange(at, at + n, dtype=np.int32))
        self.used, self.known = self.used + len(flat), at + n

    def encode(self, texts: pa.Array, most: int = 1 << 20) -> Iterator[np.ndarray]:
        """The ids of each text in turn; null texts have none."""
        if len(texts) > ROWS:
            for low in range(0, len(texts), ROWS):
                yield from self.encode(texts.slice(low, ROWS), most)
            return
        data, offsets = flat_texts(texts)
        at = 0
        while at < len(offsets) - 1:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield from self._stretch(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
            at = end

    def _stretch(self, own: np.ndarray, cuts: np.ndarray) -> Iterator[np.ndarray]:
        raw = own.tobytes()
        whole = set((np.searchsorted(cuts, _odd_spaces(own), "right") - 1).tolist())
        blank = _BLANK[own]
        first = np.zeros(len(own) + 1, bool)
        first[cuts[:-1]] = True
        starts_here = first[: len(own)]
        starts_here[1:] |= blank[1:] & ~blank[:-1]
        starts = np.flatnonzero(starts_here)
        ends = np.append(starts[1:], len(own)) if len(starts) else starts
        h = spans(own, starts, ends)
        h[h == 0] = 1
        if len(whole):
            of = np.searchsorted(cuts, starts, "right") - 1
            keep = ~np.isin(of, list(whole))
            starts, ends, h = starts[keep], ends[keep], h[keep]
        index = self.places.find(h)
        for again in (False, True):
            missing = np.flatnonzero(index < 0)
            if not len(missing):
                break
            new, place = np.unique(h[missing], return_index=True)
            if self.known + len(new) > self.most and not again:
                self._clear()
                index[:] = -1
                continue
            place = missing[place]
            self._learn(new, [raw[a:b] for a, b in zip(starts[place].tolist(), ends[place].tolist())])
            index[missing] = self.places.find(h[missing])
            break
        lengths = self.lengths[index].astype(np.int64)
        stops = np.cumsum(lengths)
        total = int(stops[-1]) if len(stops) else 0
        ids = self.flat[np.arange(total) + np.repeat(self.starts[index] - stops + lengths, lengths)]
        text_cuts = np.append(0, stops)[np.searchsorted(starts, cuts)].tolist()
        for i, (low, high) in enumerate(zip(text_cuts, text_cuts[1:])):
            if i in whole:
                text = raw[cuts[i] : cuts[i + 1]].decode()
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            else:
                yield ids[low:high]


def checksum(ids: np.ndarray) -> int:
    return crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


_encoders: dict[str, SegmentEncoder] = {}


def tidy(keep: str | None = None) -> None:
    """For the start of a task: Python workers serve one operator after another, so encoders other than ``keep`` go and freed memory returns to the system."""
    for path in [x for x in _encoders if x != keep]:
        del _encoders[path]
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def trimmed(run: Callable[..., Iterator], keep: str | None = None) -> Callable[..., Iterator]:
    """``run`` for mapInArrow, by a worker that gives memory back before and after: idle workers stay."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy(keep)
        try:
            yield from run(batches)
        finally:
            tidy(keep)

    return whole


def encoder(path: str) -> SegmentEncoder:
    """One per process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = SegmentEncoder(path)
    return _encoders[path]

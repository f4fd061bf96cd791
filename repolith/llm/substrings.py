"""Substring dedup of whole word windows, by difference-cover anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, saved, table
from .exchange import ASKED, answered, answers_of, asked_rows, by_bucket, make_blocks, open_block, rows_of, with_answers
from .words import hashed, mixed, windows

#: A perfect difference cover modulo 21. For any two places there is a shift below 21
#: that brings both onto the cover.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)


class _Text:
    """The words of one text and the places of its windows and anchors."""

    def __init__(self, h: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        self.h, self.data, self.starts, self.ends = h, data, starts, ends


def _texts(texts: pa.Array) -> Iterator[_Text]:
    for _, counts, h, data, starts, ends in hashed(texts, lower=False):
        stops = np.cumsum(counts)
        for stop, n in zip(stops.tolist(), counts.tolist()):
            own = slice(stop - n, stop)
            yield _Text(h[own], data, starts[own], ends[own])


def _anchors(text: _Text, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors at cover places; none in texts shorter than a window."""
    if len(text.h) < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = windows(text.h, window - PERIOD + 1)
    places = np.flatnonzero(np.isin(np.arange(PERIOD), COVER)[np.arange(len(h)) % PERIOD])
    return places, h[places]


def _candidates(text: _Text, window: int, repeated: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold an anchor of ``repeated`` places."""
    n = len(text.h) - window + 1
    steps = np.zeros(max(n, 0) + 1, np.int64)
    np.add.at(steps, np.clip(repeated - (PERIOD - 1), 0, n), 1)
    np.add.at(steps, np.clip(repeated + 1, 0, n), -1)
    return np.flatnonzero(np.cumsum(steps)[:n] > 0)


def _window_keys(text: _Text, window: int, starts: np.ndarray) -> np.ndarray:
    """128 bits for each window: two independent hashes."""
    out = np.empty((len(starts), 2), np.uint64)
    out[:, 0] = windows(text.h, window)[starts]
    out[:, 1] = windows(mixed(text.h ^ np.uint64(0x5851F42D4C957F2D)), window)[starts]
    return out


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct rows, whether each comes twice or more, place of each input row among them)."""
    if not len(keys):
        return keys, np.empty(0, bool), np.empty(0, np.int64)
    order = np.lexsort(keys.T[::-1])
    ranked = keys[order]
    new = np.append(True, (ranked[1:] != ranked[:-1]).any(axis=1))
    index = np.empty(len(keys), np.int64)
    index[order] = np.cumsum(new) - 1
    return ranked[new], np.diff(np.append(np.flatnonzero(new), len(keys))) > 1, index


def _ask(block: int, keys: np.ndarray, buckets: int) -> pa.RecordBatch:
    distinct, twice, _ = _distinct(keys)
    order, cuts = by_bucket(distinct[:, 0], buckets)
    return asked_rows(block, cuts, lambda low, high: twice[order[low:high]].tobytes() + distinct[order[low:high]].tobytes())


def _told(keys: np.ndarray, buckets: int, answers: dict[int, bytes]) -> np.ndarray:
    """For each key, whether any block has it again."""
    distinct, _, index = _distinct(keys)
    order, cuts = by_bucket(distinct[:, 0], buckets)
    out = np.zeros(len(distinct), bool)
    for bucket, bits in answers.items():
        low, high = cuts[bucket], cuts[bucket + 1]
        out[order[low:high]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=high - low).astype(bool)
    return out[index]


def _repeats(width: int):
    """The answer of a bucket: which of a block's keys come again, there or in another block."""

    def answer(_: int, payloads: list[bytes]) -> list[bytes]:
        each = 1 + 8 * width
        sizes = [len(p) // each for p in payloads]
        twice = np.concatenate([np.frombuffer(p, bool, n) for p, n in zip(payloads, sizes)])
        keys = np.concatenate([np.frombuffer(p, np.uint64, n * width, n) for p, n in zip(payloads, sizes)]).reshape(-1, width)
        distinct, again, index = _distinct(keys)
        np.logical_or.at(again, index, twice)
        ends = np.cumsum(sizes)
        return [np.packbits(again[index[e - n : e]]).tobytes() for e, n in zip(ends.tolist(), sizes)]

    return answer


def substring_dedup(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4 << 20, more: tuple[str, ...] = ()) -> DataFrame:
    """Removes every word that a window of ``window`` words covers whose words also start anywhere else.

    Words are runs of characters other than ASCII white space, as they are. Only windows of
    window - 20 words at places of a difference cover modulo 21 are hashed as anchors: two equal long
    windows always share one. Blocks ask which of their anchors repeat; around these all windows
    are candidates, and their 128-bit hashes are asked for next. A window that repeats in the same
    document counts, and all windows are judged on the input. Keys are distinct per block, so a
    passage that fills the corpus is one entry a block.

    One row per input row: id, n_words, n_removed, kept_sha256 and kept (its text: the words that
    stay, joined by blanks, or as it is if all stay), then the columns ``more``. Null texts have no words; texts of fewer than ``window`` words lose
    none; repeated rows remove each other's words; an empty table gives no rows; other columns are
    ignored.
    """
    if window < PERIOD:
        raise ValueError(f"windows have {PERIOD} words at least")
    spark = docs.sparkSession
    buckets = partitions(spark)
    blocks = make_blocks(docs, id_col, text_col, block_bytes, more)

    def anchors_of(texts: pa.Array) -> np.ndarray:
        found = [_anchors(t, window)[1] for t in _texts(texts)]
        return np.concatenate([np.empty(0, np.uint64), *found])[:, None]

    def ask_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            yield _ask(row["block"], anchors_of(open_block(row["payload"])[1]), buckets)

    def window_keys(texts: pa.Array, answers: dict[int, bytes]) -> tuple[list[_Text], list[np.ndarray], np.ndarray]:
        parts = list(_texts(texts))
        found = [_anchors(t, window) for t in parts]
        again = _told(np.concatenate([np.empty(0, np.uint64), *(h for _, h in found)])[:, None], buckets, answers)
        starts, at = [], 0
        for text, (places, _) in zip(parts, found):
            starts.append(_candidates(text, window, places[again[at : at + len(places)]]) if len(places) else np.empty(0, np.int64))
            at += len(places)
        keys = np.concatenate([np.empty((0, 2), np.uint64), *(_window_keys(t, window, s) for t, s in zip(parts, starts) if len(s))])
        return parts, starts, keys

    def ask_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            _, _, keys = window_keys(open_block(row["payload"])[1], answers_of(row))
            if len(keys):
                yield _ask(row["block"], keys, buckets)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            ids, texts, *others = open_block(row["payload"])
            parts, starts, keys = window_keys(texts, answers_of(row))
            again = _told(keys, buckets, {x["bucket"]: x["answer"] for x in row["more"] or ()})
            at, lengths, removed, kept = 0, [], [], []
            for text, own in zip(parts, starts):
                n = len(text.h)
                hit = own[again[at : at + len(own)]]
                at += len(own)
                steps = np.zeros(n + 1, np.int64)
                np.add.at(steps, hit, 1)
                np.add.at(steps, hit + window, -1)
                stays = np.flatnonzero(np.cumsum(steps[:n]) == 0)
                whole = text.data[int(text.starts[0]) : int(text.ends[-1])].tobytes() if n == len(stays) and n else b""
                words = whole.split() if whole else [text.data[a:b].tobytes() for a, b in zip(text.starts[stays].tolist(), text.ends[stays].tolist())]
                lengths.append(n)
                removed.append(n - len(stays))
                kept.append(b" ".join(words))
            sums = pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())
            texts = pc.if_else(pc.equal(pa.array(removed, pa.int64()), 0), texts, pa.array(kept, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(lengths, pa.int64()), pa.array(removed, pa.int64()), sums, texts, *others],
                names=["id", "n_words", "n_removed", "kept_sha256", "kept", *(f"more_{i}" for i in range(len(more)))],
            )

    repeated = answered(blocks.mapInArrow(ask_anchors, ASKED), _repeats(1))
    schema = docs.sparkSession.createDataFrame([], "id long, n_words long, n_removed long, kept_sha256 string, kept string").schema
    for i, c in enumerate(more):
        schema = schema.add(f"more_{i}", docs.schema[c].dataType)
    repeated = saved(repeated, "anchors")
    once = with_answers(blocks, repeated)
    again = answered(once.mapInArrow(ask_windows, ASKED), _repeats(2))
    lists = again.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", F.col("payload").alias("answer")))).alias("more"))
    out = with_answers(blocks, repeated).join(lists, "block", "left").mapInArrow(cut, schema)
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256", "kept", *(F.col(f"more_{i}").alias(c) for i, c in enumerate(more)))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("kept")


OP9_SQL = """
WITH w AS (SELECT doc_id, COALESCE(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS words FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(words) - 33)) AS i, words FROM w WHERE len(words) >= 35),
h AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) AS h FROM p),
r AS (SELECT doc_id, i FROM (SELECT *, COUNT(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1),
x AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS place, unnest(words) AS word FROM w),
c AS (SELECT x.doc_id, x.place, x.word, m.i FROM x ASOF LEFT JOIN r m ON x.doc_id = m.doc_id AND x.place >= m.i),
k AS (SELECT doc_id, COUNT(*) FILTER (i IS NOT NULL AND place < i + 35) AS n_removed, string_agg(word, ' ' ORDER BY place) FILTER (i IS NULL OR place >= i + 35) AS kept FROM c GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, COALESCE(n_removed, 0) AS n_removed, sha256(COALESCE(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""

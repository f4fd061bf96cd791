"""Best-fit packing of token lists into fixed-size sequences, with swap-based local search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import saved, table


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Best-fit decreasing: the bin of each length; a bit set of the free spaces in use finds the tightest bin."""
    bins = np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces, n = 0, 0
    order = np.argsort(-lengths, kind="stable")
    for item, length in zip(order.tolist(), lengths[order].tolist()):
        rest = spaces >> length
        if rest:
            space = length + (rest & -rest).bit_length() - 1
            at = free[space].pop()
            if not free[space]:
                spaces ^= 1 << space
        else:
            space, at, n = capacity, n, n + 1
        bins[item] = at
        if left := space - length:
            if not free[left]:
                spaces |= 1 << left
            free[left].append(at)
    return bins


class _Search:
    """Bins that exchange items so that squared fill grows, with indexes that an exchange keeps up to date.

    The items of all bins stand in one array. Pairs, for two-for-one exchanges, stand in another: a bin
    has one for each two of its distinct lengths, or twice one length, which covers all pairs of its
    items; bins of 2048 have 63 distinct lengths at most. A changed bin's old pairs are void by its version.
    """

    def __init__(self, lengths: np.ndarray, bins: np.ndarray, capacity: int) -> None:
        self.lengths, self.bins, self.capacity = lengths, bins, capacity
        self.fill = np.bincount(bins, weights=lengths).astype(np.int64)
        order = np.argsort(bins, kind="stable")
        self.items = [x.tolist() for x in np.split(order, np.searchsorted(bins[order], np.arange(1, len(self.fill))))]
        self.version = np.zeros(len(self.fill), np.int64)
        self.open = self.fill < capacity
        self.touched: set[int] = set()
        self._gather()

    def _pairs_of(self, b: int) -> list[tuple[int, int, int, int, int]]:
        by_length: dict[int, list[int]] = {}
        for item in self.items[b]:
            by_length.setdefault(int(self.lengths[item]), []).append(item)
        own = sorted(by_length.items())
        version = int(self.version[b])
        out = [(b, version, 2 * n, same[0], same[1]) for n, same in own if len(same) > 1]
        return out + [(b, version, n + m, one[0], other[0]) for k, (n, one) in enumerate(own) for m, other in own[:k]]

    def _gather(self) -> None:
        """Singles and pairs of the bins that have room, in arrays."""
        rows = [p for b in np.flatnonzero(self.open & (self.fill > 0)).tolist() for p in self._pairs_of(b)]
        self.pairs = np.array(rows, np.int64).reshape(-1, 5)
        self.added: list[tuple[int, int, int, int, int]] = []
        self.singles = np.flatnonzero(self.open[self.bins])

    def _candidates(self, low: int) -> tuple[np.ndarray, ...]:
        """What bins other than ``low``, fuller than it, could give back: (bin, tokens, first item, second item or -1); nothing counts too, where a bin has room."""
        if len(self.added) > 256 + len(self.pairs) // 8:
            self._gather()
        pairs = np.concatenate([self.pairs, np.array(self.added, np.int64).reshape(-1, 5)]) if self.added else self.pairs
        pairs = pairs[(self.version[pairs[:, 0]] == pairs[:, 1])]
        singles = self.singles
        empty = np.flatnonzero(self.open & (self.fill > 0))
        at = np.concatenate([empty, self.bins[singles], pairs[:, 0]])
        tokens = np.concatenate([np.zeros(len(empty), np.int64), self.lengths[singles], pairs[:, 2]])
        one = np.concatenate([np.full(len(empty), -1), singles, pairs[:, 3]])
        two = np.concatenate([np.full(len(empty) + len(singles), -1), pairs[:, 4]])
        ok = (at != low) & (self.fill[at] >= self.fill[low]) & (self.fill[at] < self.capacity)
        return at[ok], tokens[ok], one[ok], two[ok]

    def givers_to(self, b: int) -> np.ndarray:
        """Bins that have an exchange with ``b`` to make."""
        if not (self.open[b] and self.fill[b]):
            return np.empty(0, np.int64)
        back = np.array(sorted({0, *(int(self.lengths[i]) for i in self.items[b]), *(p[2] for p in self._pairs_of(b))}))
        at = self.bins[self.singles]
        ok = self.open[at] & (self.fill[at] <= self.fill[b]) & (at != b)
        at, own = at[ok], self.lengths[self.singles[ok]]
        # the least that it could move: its length without the largest that may come back for it
        moved = own - back[np.searchsorted(back, own, "left") - 1]
        return np.unique(at[moved <= self.capacity - self.fill[b]])

    def exchange(self, low: int) -> bool:
        """The exchange of the largest gain in squared fill that moves tokens out of ``low``; False if there is none."""
        at, tokens, one, two = self._candidates(low)
        room, lead = self.capacity - self.fill[at], self.fill[at] - self.fill[low]
        best, chosen = 0, None
        for length, item in {int(self.lengths[i]): i for i in self.items[low]}.items():
            moved = length - tokens
            gain = np.where((moved > 0) & (moved <= room), moved * (lead + moved), 0)
            k = int(np.argmax(gain)) if len(gain) else 0
            if len(gain) and gain[k] > best:
                best, chosen = int(gain[k]), (item, int(at[k]), [int(x) for x in (one[k], two[k]) if x >= 0])
        if chosen is None:
            return False
        item, to, back = chosen
        for i, b, other in [(item, to, low), *((i, low, to) for i in back)]:
            self.items[other].remove(i)
            self.items[b].append(i)
            self.bins[i] = b
            self.fill[b] += self.lengths[i]
            self.fill[other] -= self.lengths[i]
        for b in (low, to):
            self.version[b] += 1
            if self.open[b] and self.fill[b] < self.capacity:
                self.added += self._pairs_of(b)
            self.open[b] = self.fill[b] < self.capacity
        self.touched |= {low, to}
        return True


def pack(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bins by best fit, then local search: the emptiest bins give documents to fuller ones while squared fill grows.

    Each bin in turn, the emptiest first, makes exchanges as a giver until it is empty or none
    increases squared fill; the search ends when no bin has such an exchange, or when the bins are as
    few as the total over the capacity, rounded up. Squared fill grows with each exchange, so it ends.
    """
    bins = best_fit(lengths, capacity)
    if not len(bins):
        return bins
    search = _Search(lengths, bins, capacity)
    least = -(-int(lengths.sum()) // capacity)
    tried = np.zeros(len(search.fill), bool)
    while np.count_nonzero(search.fill) > least:
        givers = np.flatnonzero((search.fill > 0) & search.open & ~tried)
        if not len(givers):
            break
        low = int(givers[np.argmin(search.fill[givers])])
        while search.fill[low] and search.exchange(low):
            pass
        tried[low] = True
        for b in search.touched:  # who may give to a bin that has changed is asked again
            tried[search.givers_to(b)] = False
        search.touched.clear()
    return np.unique(search.bins, return_inverse=True)[1]


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids of each whole text with ``end_id`` after it, cut at multiples of ``capacity``: id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(vocabulary)
        for batch in batches:
            rows = []
            for name, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1))):
                ids = np.append(ids, np.uint32(end_id))
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((name, piece, start, len(part), tokens.checksum(part)))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["id", "piece", "start", "length", "ids_crc32"],
            )

    schema = "id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(tokens.trimmed(cut, vocabulary), schema)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, shard_rows: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs whole texts into sequences of at most ``capacity`` tokens.

    Texts are encoded once, where they are read; only lengths go on. Pieces are dealt by hash to
    shards of about ``shard_rows``, whose number grows with the table, and each shard is packed by
    itself; a shard leaves about one sequence that is not full.

    One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts
    are one piece, the end id; repeated rows are packed each; an empty table gives no rows; other
    columns are ignored.
    """
    cut = saved(pieces(docs, vocabulary, capacity, id_col=id_col, text_col=text_col), "pieces")
    shards = cut.count() // shard_rows + 1

    def place(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["length", "id", "piece", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        bins = pack(shard["length"].to_numpy(np.int64), capacity)
        shard["sequence_id"] = shard["shard"] * (1 << 32) + bins
        shard["offset"] = shard.groupby("sequence_id")["length"].cumsum() - shard["length"]
        return shard.drop(columns="shard")

    schema = "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(place, schema).withColumnRenamed("id", id_col)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokens.vocabulary("word_bpe_49k.json"))

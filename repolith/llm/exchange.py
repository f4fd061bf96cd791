"""Blocks of documents that ask buckets of keys, and get their answers back.

A block is a few megabytes of documents as one compressed row. It sends each bucket the distinct
keys that it has there, sorted, so that a key that fills the corpus costs one entry a block; the
answer of a bucket lists a value for each key in the same order and needs no keys itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups, partitions, saved
from .tokens import tidy, trimmed

ASKED = "block long, bucket int, payload binary"


def make_blocks(docs: DataFrame, id_col: str, text_col: str, size: int = 4 << 20, more: tuple[str, ...] = ()) -> DataFrame:
    """(block, payload): documents in blocks of about ``size`` bytes of text, written once, so that a block never changes; ``more`` columns go with them."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, held_size = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(rows)
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + n], pa.int64()), pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["block", "payload"])

        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            low, before = 0, 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(sizes, before + size - held_size, "right")))
                held.append(batch.slice(low, high - low))
                held_size += int(sizes[high - 1]) - before
                low, before = high, int(sizes[high - 1])
                if held_size >= size or low < batch.num_rows:
                    yield block()
                    n, held, held_size = n + 1, [], 0
        if held:
            yield block()

    return saved(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"more_{i}") for i, c in enumerate(more))).mapInArrow(trimmed(gather), "block long, payload binary"), "blocks")


def open_block(payload: bytes) -> tuple[pa.Array, ...]:
    """Ids and texts of a block, then its other columns."""
    rows = pa.ipc.open_stream(payload).read_all().combine_chunks()
    return tuple(pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in rows.columns)


def by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, cuts): sorted keys in order of bucket, and where each bucket begins."""
    bucket = (keys >> np.uint64(40)) % np.uint64(buckets)
    order = np.argsort(bucket.astype(np.int32), kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def asked_rows(block: int, cuts: np.ndarray, payload: Callable[[int, int], bytes]) -> pa.RecordBatch:
    full = np.flatnonzero(np.diff(cuts))
    rows = [payload(int(cuts[b]), int(cuts[b + 1])) for b in full]
    return pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), pa.array(full.astype(np.int32)), pa.array(rows, pa.binary())], names=["block", "bucket", "payload"])


def answered(asked: DataFrame, answer: Callable[[int, list[bytes]], list[bytes]]) -> DataFrame:
    """``answer`` gets a bucket's number and the payloads of all blocks, and returns one payload for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in groups(batches, "bucket"):
            out = answer(bucket["bucket"][0].as_py(), bucket["payload"].to_pylist())
            blocks, number = bucket["block"].combine_chunks(), bucket["bucket"].combine_chunks()
            for low in range(0, len(out), 256):
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.concat_arrays(x.chunks) for x in (blocks.slice(low, 256), number.slice(low, 256))] + [pa.array(out[low : low + 256], pa.binary())], names=["block", "bucket", "payload"])

    n = partitions(asked.sparkSession)
    return asked.repartition(n, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(trimmed(run), ASKED)


def with_answers(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """(block, payload, answers): each block with its buckets' answers by bucket number; none where it asked nothing."""
    lists = answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", F.col("payload").alias("answer")))).alias("answers"))
    return blocks.join(lists, "block", "left")


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time: they are megabytes each."""
    tidy()
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]
    tidy()


def answers_of(row: dict) -> dict[int, bytes]:
    return {x["bucket"]: x["answer"] for x in row["answers"] or ()}

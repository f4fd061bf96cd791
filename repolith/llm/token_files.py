"""Token-id files: documents as Simple-8b shards in ascending id order, and their reader."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simple8b, tokens
from .common import fresh, partitions, table
from .exchange import rows_of

SHARDS = "part int, before long, n_ids long, doc_ids binary, no_id binary, n_tokens binary, payload binary"


def write_token_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, shard_ids: int = 1 << 19, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of every whole text, each with ``end_id`` after it, by ascending id (null first).

    Documents are dealt to tasks by ranges of ids; each task encodes its sorted texts as a stream and
    writes a shard whenever ``shard_ids`` ids are gathered. A shard is a row of Parquet, so Spark's
    commit protocol keeps files whole when a task is run again, and a row group of its own, so
    that Parquet's writer and reader hold one at a time and not all of a task; packed words gain nothing from
    dictionaries and 4 % from compression, so neither makes copies of them. It has a document table (ids,
    numbers of tokens) and one Simple-8b list with block offsets; ``before`` counts the ids that the
    same task wrote earlier. Null and empty texts are the end id alone; rows with equal ids are
    written each, ordered by text; an empty table writes no shards.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(vocabulary)
        part, before, names, lists, held = TaskContext.get().partitionId(), 0, [], [], 0

        def shard() -> pa.RecordBatch:
            lengths = np.fromiter(map(len, lists), "<u8", len(lists))
            ids = np.array([0 if x is None else x for x in names], "<i8")
            row = [part, before, int(lengths.sum()), ids.tobytes(), bytes(x is None for x in names), lengths.tobytes(), simple8b.pack(np.concatenate(lists))]
            return pa.RecordBatch.from_arrays(
                [pa.array([row[0]], pa.int32()), pa.array([row[1]], pa.int64()), pa.array([row[2]], pa.int64()), *(pa.array([x], pa.binary()) for x in row[3:])],
                names=["part", "before", "n_ids", "doc_ids", "no_id", "n_tokens", "payload"],
            )

        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1))):
                names.append(name)
                lists.append(np.append(ids, np.uint32(end_id)))
                held += len(lists[-1])
                if held >= shard_ids:
                    yield shard()
                    before, names, lists, held = before + held, [], [], 0
        if lists:
            yield shard()

    (
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        .repartitionByRange(partitions(docs.sparkSession), "id").sortWithinPartitions("id", "text")
        .mapInArrow(tokens.trimmed(encode, vocabulary), SHARDS).write.options(**{"parquet.block.row.count.limit": 1, "parquet.enable.dictionary": False, "compression": "none"}).parquet(path)
    )


def read_token_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document; start counts the ids of all before it.

    Only one number per writing task comes to the driver: the ids that it wrote. Shards are decoded
    one at a time. Without ``with_ids`` the ids are decoded and checked, but only their checksum leaves a task.
    """
    shards = spark.read.schema(SHARDS).parquet(path)
    written = {r["part"]: r["n"] for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    base, total = {}, 0
    for part in sorted(written):
        base[part], total = total, total + written[part]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            lengths = np.frombuffer(row["n_tokens"], "<u8").astype(np.int64)
            ends = np.cumsum(lengths)
            ids = simple8b.unpack(row["payload"]).astype("<u4")
            missing = np.frombuffer(row["no_id"], np.uint8).astype(bool)
            columns = {
                "doc_id": pa.array(np.frombuffer(row["doc_ids"], "<i8"), pa.int64(), mask=missing), "start": pa.array(ends - lengths + base[row["part"]] + row["before"]), "n_tokens": pa.array(lengths),
                "ids_crc32": pa.array([tokens.checksum(ids[b - n : b]) for b, n in zip(ends.tolist(), lengths.tolist())], pa.int64()),
            }
            if with_ids:
                columns["ids"] = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int64)))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return shards.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "token-ids")
    write_token_ids(table(spark, sf_dir, "documents"), path, tokens.vocabulary("byte_bpe_50k.json"))
    return read_token_ids(spark, path, with_ids=False)

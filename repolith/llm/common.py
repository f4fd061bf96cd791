"""What the operators share: shared-folder tables and streaming over sorted groups."""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from repolith.session import shared_folder, ship

_RUN = uuid.uuid4().hex
_cleaned: set[str] = set()
#: Paths of fresh() that drop() has not removed.
written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in a local session, as in tests, one of its own where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    return f"{(base or shared_folder(spark)).rstrip('/')}/repolith-{_RUN}"


def fresh(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder. What is written there outlives lost executors and goes when the driver ends."""
    root = shared_dir(spark)
    path = f"{root}/{label}-{uuid.uuid4().hex}"
    written.append(path)
    if root not in _cleaned:
        _cleaned.add(root)
        atexit.register(_remove, spark, root)
    return path


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage and is never computed twice."""
    spark = df.sparkSession
    path = fresh(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, label: str, key: str, buckets: int) -> DataFrame:
    """As saved(), in buckets by ``key``: joins on it with as many partitions don't shuffle these rows."""
    spark = df.sparkSession
    name = f"repolith_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).sortBy(key).option("path", fresh(spark, label)).saveAsTable(name)
    return spark.table(name)


def _remove(spark: SparkSession, root: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session has ended already
        pass


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Removes tables of saved() that nothing reads any more."""
    for path in paths:
        _remove(spark, path)
        if path in written:
            written.remove(path)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of frames that nothing refers to any more, as it does when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    """Partitions of a shuffle: the session's setting, which the operator of the cluster sizes to the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole groups, one at a time, from batches in which rows with equal ``key`` stand together."""
    held: list[pa.RecordBatch] = []
    at: object = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        column = batch.column(batch.schema.get_field_index(key))
        codes = column.to_numpy(zero_copy_only=False)
        cuts = [0, *((codes[1:] != codes[:-1]).nonzero()[0] + 1).tolist(), len(codes)]
        for low, high in zip(cuts, cuts[1:]):
            value = codes[low]
            if held and value != at:
                yield pa.Table.from_batches(held)
                held = []
            at = value
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)

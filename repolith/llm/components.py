"""Connected components of an edge table, without the driver and without one task that holds them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, partitions, saved, written
from .tokens import trimmed


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node each reaches) of edges a-b."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task, every node once with the smallest it reaches there."""
    held_a, held_b, n = [], [], 0

    def shrink() -> None:
        nonlocal held_a, held_b, n
        nodes, low = local_components(np.concatenate(held_a), np.concatenate(held_b))
        held_a, held_b, n = [nodes[nodes != low]], [low[nodes != low]], 0

    for batch in batches:
        held_a.append(batch.column(0).to_numpy(zero_copy_only=False))
        held_b.append(batch.column(1).to_numpy(zero_copy_only=False))
        n += batch.num_rows
        if n > 1_000_000:
            shrink()
    if held_a:
        shrink()
        yield pa.RecordBatch.from_arrays([pa.array(held_a[0], pa.int64()), pa.array(held_b[0], pa.int64())], names=["a", "b"])


def with_group(df: DataFrame, key: str, *values: Column) -> DataFrame:
    """``df`` with aggregates of its groups, null keys left out.

    The aggregates are shuffled once more, so that the join is one of two plain shuffles: AQE splits such a join where a key is hot.
    """
    found = df.where(F.col(key).isNotNull()).groupBy(key).agg(*values)
    return df.join(found.repartition(partitions(df.sparkSession)), key)


def _unsettled(edges: DataFrame) -> int | None:
    """How many edges (a, b) there are, b the smaller; None once they are stars: every a has one b, and no b is an a."""
    ends = edges.select("a", F.lit(1).alias("out"), F.lit(0).alias("into")).unionAll(edges.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("a").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))
    n, bad = nodes.agg(F.sum("out"), F.sum(((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0))).cast("int"))).first()
    return n if bad else None


def connected_components(edges: DataFrame, found: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """(node, component) for every node of an edge, component the smallest node it reaches; no edges give no rows.

    ``edges`` has two long columns, nulls excluded; with ``found`` they are what that makes of its batches. Each task first reduces its edges to a forest;
    then large-star and small-star steps alternate until the edges are stars. Every round is
    written to the shared folder, so lineage stays short and a lost executor costs a round.
    """
    if found is None:
        a, b = edges.columns[:2]
        edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    spark = edges.sparkSession
    now = saved(edges.mapInArrow(trimmed(lambda batches: _forest(found(batches) if found else batches)), "a long, b long"), "edges")
    while (edges_left := _unsettled(now)) is not None:
        old = written[-1]
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_group(both, "a", F.least(F.min("b"), F.first("a")).alias("m")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = with_group(large, "a", F.min("b").alias("m")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        # a few edges don't make a file for each partition
        now = saved(small.coalesce(max(12, edges_left // 20_000)), "edges")
        drop(spark, [old])
    return now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

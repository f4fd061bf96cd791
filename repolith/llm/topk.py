"""Exact top-k by inner product with a KD-tree per shard."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, saved, table
from .tokens import trimmed
from .vectors import matrix, usable


MOST = (1 << 63) - 1


class KDTree:
    """Median splits along the widest side; every node keeps the tight box of its vectors.

    The largest inner product that a query can have in a box is the sum over components of the
    larger of q * low and q * high; a best-first search opens nodes by that bound and stops when it
    falls below the kth score so far. Integers are exact: below 2^53 in doubles, else as Python ints.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = 64) -> None:
        order, boxes, self.left, self.right, self.span = np.arange(len(ids)), [], [], [], []
        todo = [(0, len(ids), -1, False)]
        while todo:
            low, high, parent, right = todo.pop()
            at = len(boxes)
            own = vectors[order[low:high]]
            least, most = own.min(axis=0), own.max(axis=0)
            boxes.append((least, most))
            self.left.append(-1)
            self.right.append(-1)
            self.span.append((low, high))
            if parent >= 0:
                (self.right if right else self.left)[parent] = at
            side = int(np.argmax(most - least)) if vectors.shape[1] else 0
            if high - low > leaf and vectors.shape[1] and most[side] > least[side]:
                middle = (low + high) // 2
                order[low:high] = order[low:high][np.argpartition(own[:, side], middle - low)]
                todo += [(low, middle, at, False), (middle, high, at, True)]
        self.ids, self.vectors = ids[order], vectors[order]
        self.low, self.high = (np.array(x) for x in zip(*boxes))

    def search(self, queries: np.ndarray, own_ids: np.ndarray, floors: list[float], k: int) -> list[list[tuple[int, int]]]:
        """For each query up to k (score, id), best first, ties to smaller id; what scores below its floor may be left out."""
        bounds = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        out = []
        for q, own, floor, bound in zip(queries, own_ids.tolist(), floors, bounds):
            heap, best = [(-bound[0], 0)], []
            kth = floor
            while heap:
                top, node = heapq.heappop(heap)
                if -top < kth:
                    break
                if self.left[node] >= 0:
                    for child in (self.left[node], self.right[node]):
                        if bound[child] >= kth:
                            heapq.heappush(heap, (-bound[child], child))
                    continue
                low, high = self.span[node]
                scores = self.vectors[low:high] @ q
                for i in np.flatnonzero(scores >= kth).tolist():
                    name = int(self.ids[low + i])
                    if name != own:
                        item = (int(scores[i]), -name)
                        if len(best) < k:
                            heapq.heappush(best, item)
                        elif item > best[0]:
                            heapq.heapreplace(best, item)
                if len(best) == k:
                    kth = max(kth, best[0][0])
            out.append([(score, -name) for score, name in sorted(best, reverse=True)])
        return out


def _exact(values: np.ndarray) -> np.ndarray:
    """floor(1024 x): doubles where sums of products stay below 2^53, else Python ints."""
    scaled = np.floor(values * 1024.0)
    if scaled.size and scaled.shape[1] * float(np.abs(scaled).max()) ** 2 >= 2.0**53:
        return np.array([[int(x) for x in row] for row in scaled], dtype=object).reshape(scaled.shape)
    return scaled


def _search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best k of each query in the shard it stands with. vectors: shard, id, v; queries: shard, id, v, floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, tree = None, [], None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            shards, kinds = (rows[c].to_numpy() for c in ("shard", "kind"))
            cuts = np.flatnonzero((shards[1:] != shards[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shards)]):
                if low == high:
                    continue
                if shards[low] != shard:
                    shard, held, tree = shards[low], [], None
                part = rows.slice(low, high - low)
                if kinds[low] == 0:
                    held.append(part)
                    continue
                if not held:
                    continue
                asked = matrix(part["v"])
                if tree is None:
                    own = pa.concat_tables(held)
                    values = matrix(own["v"], asked.shape[1])
                    tree = KDTree(own["id"].to_numpy(), _exact(values))
                    if not len(tree.ids):
                        continue
                width = tree.vectors.shape[1]
                asked = _exact(asked[:, :width] if asked.shape[1] >= width else np.pad(asked, ((0, 0), (0, width - asked.shape[1]))))
                names = part["id"].to_numpy()
                floors = [-np.inf if x is None else x for x in part["floor"].to_pylist()]
                found = tree.search(asked, names, floors, k)
                flat = [(q, name, min(max(score, -MOST - 1), MOST)) for q, best in zip(names.tolist(), found) for score, name in best]
                if flat:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*flat)], names=["query_id", "vec_id", "score"])

    none = F.lit(None).cast("long")
    both = vectors.select("shard", F.lit(0).alias("kind"), "id", "v", none.alias("floor")).unionByName(queries.select("shard", F.lit(1).alias("kind"), "id", "v", F.col("floor").cast("long")))
    return both.repartition(partitions(both.sparkSession), "shard").sortWithinPartitions("shard", "kind", "id").mapInArrow(trimmed(run), "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, chosen: Column, k: int = 10, shard_rows: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k highest integer inner products of floor(1024 x) for every row that ``chosen`` holds for, against all other rows.

    Rows are dealt by hash to shards of about ``shard_rows``, each with a KD-tree. A query first asks
    one shard; its kth score there goes with it to all others, whose searches stop at boxes that
    cannot reach it. Queries go to shards as rows, so a task holds one tree and streams its queries.

    Columns query_id, rank (from 1), vec_id, score; ties to the smaller id. Null vectors and those
    with null or non-finite components take no part, nor do rows without an id; vectors of unequal
    lengths are compared as if the shorter had zeros; a query leaves out rows of its own id; rows
    with repeated ids are candidates each; scores beyond 64 bits are given as the nearest long; an empty table gives no rows; other columns are ignored.
    """
    rows = vectors.where(usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(chosen, F.lit(False)).alias("asks"))
    rows = saved(rows, "topk-rows")
    shards = rows.count() // shard_rows + 1
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    asking = rows.where("asks").dropDuplicates(["id"])
    first = saved(_search(rows, asking.withColumn("floor", F.lit(None)), k), "topk-first")
    floors = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    asking = asking.join(floors, F.col("id") == F.col("query_id"), "left").select("id", "v", F.col("shard").alias("home"), F.when(F.col("n") >= k, F.col("least")).alias("floor"))
    others = asking.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<int>"))).where("shard != home")
    ranks = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        first.unionByName(_search(rows, others, k))
        .withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP7_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

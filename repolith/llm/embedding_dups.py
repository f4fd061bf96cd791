"""Near-duplicate embeddings: HNSW graphs per shard, audited beams, exact cosine, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, saved, table
from .components import connected_components, local_components
from .hnsw import HNSW
from .tokens import trimmed
from .vectors import matrix, usable


class _Shard:
    """The graph of one shard and the beam width that its audits asked for."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray, least: float) -> None:
        self.ids, self.copies, self.least, self.norms = ids, copies, least, np.linalg.norm(vectors, axis=1)
        self.vectors, self.units = vectors, vectors / self.norms[:, None]
        self.graph = HNSW(self.units)
        self.width = 32

    def _true(self, units: np.ndarray, asked: np.ndarray, own: bool) -> np.ndarray:
        true = units[asked] @ self.units.T >= self.least
        if own:
            true[np.arange(len(asked)), asked] = False
        return true

    def widen(self, units: np.ndarray, own: bool, recall: float, audit: int, block: int) -> None:
        """Doubles the beam until ``audit`` of the queries that have links find ``recall`` of them.

        They come from all queries if these are the shard's ``own``, whose matches with themselves
        don't count, and else from ``block`` of them.
        """
        drawn = np.random.default_rng(len(units)).permutation(len(units))
        drawn = drawn if own else drawn[:block]
        parts = [drawn[i : i + block] for i in range(0, len(drawn), block)]
        asked = np.concatenate([p[self._true(units, p, own).any(axis=1)] for p in parts])[:audit]
        true = self._true(units, asked, own)
        while self.width < len(self.ids):
            row, node = self._beam(units[asked], self.width)
            if true[row, node].sum() >= recall * true.sum():
                break
            self.width *= 2

    def _beam(self, units: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs that may be links, from the graph. For a query whose beam is full of links there may be more: it asks again with a wider one, and is compared with the whole shard where that would hold a quarter of it."""
        found, rows, n = [], np.arange(len(units)), len(self.ids)
        width = min(width, n)
        while len(rows):
            nodes, sims = self.graph.search(units[rows], width)
            full = (sims[:, -1] >= self.least - 1e-4) & (width < n)
            r, c = np.nonzero((sims >= self.least - 1e-4) & ~full[:, None])
            found.append((rows[r], nodes[r, c]))
            rows, width = rows[full], width * 4
            if len(rows) and 4 * width >= n:
                r, node = np.nonzero(units[rows] @ self.units.T >= self.least - 1e-4)
                found.append((rows[r], node))
                break
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))

    def links(self, ids: np.ndarray, vectors: np.ndarray, recall: float, audit: int, block: int, own: bool) -> np.ndarray:
        """Whether each query is linked with each node: their cosine in doubles reaches the threshold, and a search found it."""
        norms = np.linalg.norm(vectors, axis=1)
        units = vectors / norms[:, None]
        self.widen(units, own, recall, audit, block)
        out = np.zeros((len(ids), len(self.ids)), bool)
        for start in range(0, len(ids), block):
            row, node = self._beam(units[start : start + block], self.width)
            row += start
            for low in range(0, len(row), 1 << 18):
                r, n = row[low : low + (1 << 18)], node[low : low + (1 << 18)]
                cosine = np.einsum("pd,pd->p", vectors[r], self.vectors[n]) / (norms[r] * self.norms[n])
                ok = (cosine >= self.least) & (self.ids[n] != ids[r])
                out[r[ok], n[ok]] = True
        return out


def credited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of two shards, what the searches of either found in the other: each link counts once for both its ends. (a, a, links of a, counting copies) and a forest (a, b, 0)."""
    for batch in batches:
        for row in batch.column(batch.schema.get_field_index("found")).to_pylist():
            linked = None
            for x in row:
                asking, nodes = (np.frombuffer(x[k], np.int64).reshape(2, -1) for k in ("asking", "nodes"))
                n = asking.shape[1] * nodes.shape[1]
                bits = np.frombuffer(pa.Codec("zstd").decompress(x["links"], -(-n // 8), asbytes=True), np.uint8)
                one = np.unpackbits(bits, count=n).view(bool).reshape(asking.shape[1], nodes.shape[1])
                if x["turned"]:
                    one, asking, nodes = one.T, nodes, asking
                linked = one if linked is None else linked | one
            if x["within"]:
                linked = linked | linked.T
            (a, a_copies), (b, b_copies) = asking, nodes
            ids, counts = [a], [linked @ b_copies]
            if not x["within"]:
                ids, counts = [a, b], [counts[0], a_copies @ linked]
            ids, counts = np.concatenate(ids), np.concatenate(counts)
            ids, counts = ids[counts > 0], counts[counts > 0]
            left, right = np.nonzero(linked)
            nodes, low = local_components(a[left], b[right])
            joins = nodes != low
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([ids, nodes[joins]])), pa.array(np.concatenate([ids, low[joins]])), pa.array(np.concatenate([counts, np.zeros(int(joins.sum()), np.int64)])),
            ], names=["a", "b", "linked"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, pa.Table]]:
    """(unit, kind, home, rows) of rows in that order."""
    at, held = None, []
    for batch in batches:
        keys = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("unit", "kind", "home")], axis=1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
            if low == high:
                continue
            key = tuple(keys[low].tolist())
            if held and key != at:
                yield *at, pa.Table.from_batches(held)
                held = []
            at = key
            held.append(batch.slice(low, high - low))
    if held:
        yield *at, pa.Table.from_batches(held)


def near_duplicate_vectors(
    vectors: DataFrame, least: float = 0.98, shard_rows: int = 3000, recall: float = 0.99, audit: int = 64, block: int = 512, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """Links between vectors of one label with cosine ``least`` or more, and their components.

    Equal vectors of a label become one, with a count. The rest are dealt by hash to shards of about
    ``shard_rows`` within their label; each shard has an HNSW graph, and every vector of the label
    asks every shard, as a stream of rows. A shard widens its beam until ``audit`` vectors with links
    find ``recall`` of those that brute force finds in it, of its own vectors and then of each other
    shard's. What is found is verified in doubles. A pair counts for both ends, whichever search
    found it: of two shards the links found either way meet as bits, and only counts and a forest
    go on, so a dense group gives rows in proportion to its vectors.

    One row per input row: id, n_links (other rows linked directly), component_id (smallest id
    reachable), kept (it is its own component's). Null, empty and zero vectors, those with null or
    non-finite components, and rows without label or id link with nothing (component_id is the id).
    Vectors of unequal lengths don't link. Rows with repeated ids count as rows of one component.
    Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    ok = usable("v", nonzero=True) & F.col("label").isNotNull() & F.col("id").isNotNull()
    # -0.0 and 0.0 are one value
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumn("same", F.when(ok, F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.to_json(F.struct("v"))), 256)))
    reps = saved(
        rows.where("same IS NOT NULL").groupBy("same").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"), F.first("label").alias("label")),
        "vectors",
    )
    sizes = reps.groupBy(F.col("label"), F.size("v").alias("dim")).agg((F.floor(F.count(F.lit(1)) / shard_rows) + 1).cast("int").alias("shards"))
    placed = reps.withColumn("dim", F.size("v")).join(sizes, ["label", "dim"])
    unit = lambda shard: F.xxhash64(F.col("label").cast("string"), "dim", shard)
    placed = placed.withColumn("base", F.xxhash64(F.col("label").cast("string"), "dim")).withColumn("home", F.pmod(F.xxhash64("same"), F.col("shards").cast("long")))
    stored = placed.select(unit(F.col("home")).alias("unit"), F.lit(0).alias("kind"), "base", F.col("home").alias("shard"), "home", "rep", "same", "copies", "v")
    asking = placed.withColumn("shard", F.explode(F.expr("sequence(0L, shards - 1L)"))).select(unit(F.col("shard")).alias("unit"), F.lit(1).alias("kind"), "base", "shard", "home", "rep", "same", "copies", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard, nodes = None, None, None
        for unit, kind, home, rows in _parts(batches):
            ids, copies, vectors = rows["rep"].to_numpy(), rows["copies"].to_numpy(), matrix(rows["v"])
            if kind == 0:
                at, shard, nodes = unit, _Shard(ids, copies, vectors, least), np.concatenate([ids, copies]).tobytes()
                continue
            if unit != at:
                continue
            to = rows["shard"][0].as_py()
            linked = shard.links(ids, vectors, recall, audit, block, home == to)
            if linked.any():
                bits = pa.Codec("zstd").compress(np.packbits(linked).tobytes(), asbytes=True)
                row = (rows["base"][0].as_py(), min(home, to), max(home, to), home > to, home == to, np.concatenate([ids, copies]).tobytes(), nodes, bits)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=["base", "low", "high", "turned", "within", "asking", "nodes", "links"])

    # a vector of a shard has the same place among its nodes and among its queries
    units = stored.unionByName(asking).repartition(partitions(spark), "unit").sortWithinPartitions("unit", "kind", "home", "rep", "same")
    either = units.mapInArrow(trimmed(run), "base long, low long, high long, turned boolean, within boolean, asking binary, nodes binary, links binary")
    pairs = either.groupBy("base", "low", "high").agg(F.collect_list(F.struct("turned", "within", "asking", "nodes", "links")).alias("found"))
    found = saved(pairs.select("found").mapInArrow(trimmed(credited), "a long, b long, linked long"), "links")
    linked = found.where("a = b").groupBy("a").agg(F.sum("linked").alias("linked"))
    components = connected_components(found.where("a <> b").select("a", "b"))
    told = (
        reps.select("same", "rep", "copies").join(linked, F.col("rep") == linked["a"], "left").join(components, F.col("rep") == F.col("node"), "left")
        .select("same", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    return rows.select("id", "same").join(told, "same", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"),
        (F.col("id") == F.coalesce("component_id", "id")).alias("kept"),
    )


def op6_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.98),
r AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a),
c AS (SELECT node, MIN(seen) AS component_id FROM r GROUP BY node),
n AS (SELECT a, COUNT(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, COALESCE(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept FROM embeddings e JOIN c ON c.node = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""

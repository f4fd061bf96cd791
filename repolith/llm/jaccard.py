"""N-gram Jaccard join: MinHash bands, Bayesian pruning, exact verification in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import groups, partitions, saved, table
from .components import connected_components, local_components, with_group
from .tokens import trimmed
from .words import hashed, mixed, windows

BANDS, ROWS = 25, 5
HASHES = BANDS * ROWS
_rng = np.random.default_rng(88)
_FACTORS = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDED = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the word k-grams of one text; a text of fewer words is one shingle, a text of none has none."""
    return windows(h, min(k, len(h))) if len(h) else np.empty(0, np.uint64)


def signatures(lists: list[np.ndarray]) -> np.ndarray:
    """MinHash values, a row per list; lists are not empty."""
    flat = np.concatenate(lists)
    starts = np.cumsum([0, *map(len, lists[:-1])])
    out = np.empty((len(lists), HASHES), np.uint32)
    for i in range(HASHES):
        out[:, i] = np.minimum.reduceat((flat * _FACTORS[i] + _ADDED[i]) >> np.uint64(32), starts)
    return out


def least_matches(n: int, similarity: float, tolerance: float) -> int:
    """Fewest matches among n MinHash values at which similarity or more stays possible.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1); its mass above the threshold is
    the chance of at most m successes in n + 1 trials.
    """
    mass = 0.0
    for m in range(n + 1):
        mass += comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
        if mass >= tolerance:
            return m
    return n + 1


def survivors(left: np.ndarray, right: np.ndarray | None, similarity: float, tolerance: float, step: int = 25, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that the posterior never gives up; within ``left`` if right is None. ``most`` pairs are held at a time."""
    other = left if right is None else right
    columns = np.ascontiguousarray(other.T)
    least = {n: least_matches(n, similarity, tolerance) for n in range(step, HASHES + 1, step)}
    out: list[tuple[np.ndarray, np.ndarray]] = []
    slab = max(1, most // max(1, len(other)))
    for low in range(0, len(left), slab):
        own = left[low : low + slab]
        live = np.ones((len(own), len(other)), bool)
        if right is None:
            live = np.triu(live, low + 1)
        matches, i, j = np.zeros(live.shape, np.uint8), None, None
        for n in least:
            values = range(n - step, n)
            if i is None:
                for v in values:
                    matches += own[:, v, None] == columns[v]
                live &= matches >= least[n]
                if 8 * np.count_nonzero(live) < live.size:  # the rest one by one
                    i, j = np.nonzero(live)
                    matches = matches[i, j]
            elif len(i):
                matches = matches + (own[i, n - step : n] == other[j, n - step : n]).sum(axis=1, dtype=np.uint8)
                ok = matches >= least[n]
                i, j, matches = i[ok], j[ok], matches[ok]
        if i is None:
            i, j = np.nonzero(live)
        out.append((i + low, j))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 2


def _with_survivors(values: np.ndarray, row: int, similarity: float, tolerance: float) -> np.ndarray:
    """Whether each row stays a candidate of one of them."""
    out = np.zeros(len(values), bool)
    out[survivors(values[row : row + 1], values, similarity, tolerance)[1]] = True
    return out


def shared_shingles(left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of left[i] with right[j]: a pair at a time, or where most pairs are asked for by a matrix product."""
    if 64 * len(i) < len(left) * len(right):
        return np.array([len(np.intersect1d(left[a], right[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist())], np.int64)
    return intersections(left + right, len(left))[i, j]


def intersections(sets: list[np.ndarray], split: int, columns: int = 4096) -> np.ndarray:
    """Sizes of intersections of sets[:split] with sets[split:]."""
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    _, index, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts[index] > 1
    row, index = row[shared], index[shared]
    _, index = np.unique(index, return_inverse=True)
    order = np.argsort(index, kind="stable")
    row, index = row[order], index[order]
    n = len(sets)
    right = slice(split, n)
    out = np.zeros((split, right.stop - right.start), np.float32)
    top = int(index[-1]) + 1 if len(index) else 0
    for low in range(0, top, columns):
        a, b = np.searchsorted(index, [low, low + columns])
        block = np.zeros((n, columns), np.float32)
        block[row[a:b], index[a:b] - low] = 1
        out += block[:split] @ block[right].T
    return out.astype(np.int64)


def shared_with(one: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of one set with each of others; all are sorted and not empty."""
    flat = np.concatenate(sets)
    hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    return np.add.reduceat(hit, np.cumsum([0, *map(len, sets[:-1])]), dtype=np.int64)


def pivots(n: int, linked: Callable[[int], np.ndarray], most: int = 2) -> np.ndarray:
    """For each row of a block one that stands for it: itself, or one of ``most`` pivots that is linked with it.

    The block's own unit finds these links. Where it meets another block, pivots take the place of
    their rows, so that many dense blocks don't name each row once for every block they meet.
    """
    of, free = np.arange(n), np.ones(n, bool)
    for _ in range(most):
        left = np.flatnonzero(free)
        if len(left) < 2:
            break
        hit = linked(int(left[0])) & free
        of[hit], free[hit], free[left[0]] = left[0], False, False
    return of


def _table(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _in_blocks(members: DataFrame, key: str) -> DataFrame:
    """Members of a key, dealt by hash to its ``blocks``: every pair of a key meets in one unit, of one block or two (cross)."""
    rows = members.withColumn("own", F.pmod(F.xxhash64("node"), "blocks")).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return rows.withColumn("unit", F.xxhash64(key, low, high)).withColumn("side", (F.col("own") > F.col("other")).cast("int")).withColumn("cross", F.col("own") != F.col("other"))


def jaccard_join(
    docs: DataFrame, similarity: float = 0.8, k: int = 5, tolerance: float = 1e-5, block: int = 256, block_exact: int = 1024, block_words: int = 1 << 19, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Links between texts whose sets of word k-grams have a Jaccard similarity of ``similarity`` or more.

    Words are split at ASCII white space, A-Z as a-z. Texts of equal words become one class with a
    count. Classes whose MinHash values agree on a band of ROWS are candidates (at 0.8, a pair meets
    in none of the BANDS with a chance of 5e-5). Members of a bucket are compared in blocks, value by
    value: a pair goes when its posterior chance of reaching the similarity falls below
    ``tolerance``. What survives forms groups. A group is dealt by hash to blocks of about
    ``block_exact`` rows and ``block_words`` words; for each two blocks the pairs that survive the
    same test are verified exactly by their shared shingles. Only counts and a forest of each block
    leave a task, so a large group gives rows in proportion to its members.

    One row per input row: id, n_links (other rows linked), class_id (smallest id reachable by
    links), kept (the first row of its class by id). Null texts and texts without words link with
    nothing and are kept; a text of fewer than k words links with its copies only. A null id comes
    after all others: it is kept only in a class without ids, and rows that share an id are kept or
    not together, so give rows ids of their own where that matters. Repeated rows count each; an
    empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    n = partitions(spark)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, counts, h, *_ in hashed(batch.column(1), lower=True):
                ends = np.cumsum(counts)
                texts = [h[e - c : e] for e, c in zip(ends.tolist(), counts.tolist())]
                full = [i for i, t in enumerate(texts) if len(t)]
                nodes: list[int | None] = [None] * len(texts)
                values: list[bytes | None] = [None] * len(texts)
                if full:
                    rows = signatures([shingles(texts[i], k) for i in full])
                    for i, row in zip(full, rows):
                        nodes[i] = xxhash.xxh3_64_intdigest(texts[i].tobytes()) - (1 << 63)
                        values[i] = row.tobytes()
                yield _table({"id": batch.column(0).slice(at, len(texts)), "digest": batch.column(2).slice(at, len(texts)), "node": pa.array(nodes, pa.int64()), "words": pa.array(counts, pa.int64()), "values": pa.array(values, pa.binary())})

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("digest"))
    signed = saved(plain.mapInArrow(trimmed(sign), "id long, digest long, node long, words long, values binary"), "signed")
    # of equal rows any will do: the text of the least id, or of any row if no copy has an id
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "digest")).alias("rep")
    classes = saved(
        signed.where("node IS NOT NULL").groupBy("node").agg(first, F.count(F.lit(1)).alias("copies"), F.first("words").alias("words"), F.first("values").alias("values"))
        .select("node", "rep.id", "rep.digest", "copies", "words", "values").withColumnRenamed("id", "rep"),
        "classes",
    )

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = np.broadcast_to(mixed(np.arange(1, BANDS + 1, dtype=np.uint64)), rows.shape[:2])
            for j in range(ROWS):
                key = mixed(key ^ rows[:, :, j])
            nodes = batch.column(0).to_numpy()
            yield _table({"key": pa.array(key.ravel().astype(np.int64)), "node": pa.array(np.repeat(nodes, BANDS))})

    bands = saved(classes.select("node", "values").mapInArrow(trimmed(band), "key long, node long"), "bands")
    buckets = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(7))).alias("y")).where("n > 1")
    distinct = buckets.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n")
    distinct = distinct.withColumn("blocks", F.expr(f"(n + {block - 1}) div {block}"))
    units = _in_blocks(bands.join(distinct, "key"), "key").select("unit", "side", "cross", "node").join(classes.select("node", "values"), "node")

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in groups(batches, "unit"):
            nodes, sides = unit["node"].to_numpy(), unit["side"].to_numpy()
            values = np.frombuffer(b"".join(unit["values"].to_pylist()), np.uint32).reshape(len(nodes), HASHES)
            left, right = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
            cross = unit["cross"][0].as_py()
            i, j = survivors(values[left], values[right] if cross else None, similarity, tolerance)
            if len(i):
                if cross:
                    i, j = (pivots(len(x), lambda p, x=x: _with_survivors(values[x], p, similarity, tolerance))[k] for x, k in ((left, i), (right, j)))
                a, b = local_components(nodes[left][i], nodes[right if cross else left][j])
                yield _table({"a": pa.array(a[a != b]), "b": pa.array(b[a != b])})

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(n, "unit").sortWithinPartitions("unit")

    near = connected_components(dealt(units.select("unit", "side", "cross", "node", "values")), trimmed(prune))
    near = saved(near.withColumnRenamed("component", "near").join(classes, "node"), "near")
    blocks = F.expr(f"greatest((count(1) + {block_exact - 1}) div {block_exact}, (sum(words) + {block_words - 1}) div {block_words})").alias("blocks")
    members = _in_blocks(with_group(near, "near", blocks), "near").select("unit", "side", "cross", "node", "rep", "digest", "copies", "values")
    nameless = plain.where("id IS NULL").groupBy("digest").agg(F.first("text").alias("text")).select(F.lit(None).cast("long").alias("id"), "text", "digest")
    sources = plain.where("id IS NOT NULL").unionByName(nameless)
    # a shuffle join at every size: the members grow with the table
    texts = members.join(sources.alias("t").hint("merge"), (members["digest"] == F.col("t.digest")) & F.col("rep").eqNullSafe(F.col("id")))
    texts = texts.select("unit", "side", "cross", "node", "copies", "values", "text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in groups(batches, "unit"):
            nodes, sides, copies, sets, values = [], [], [], [], []
            seen = set()
            for at, counts, h, *_ in hashed(unit["text"], lower=True):
                ends = np.cumsum(counts)
                for r, (e, c) in enumerate(zip(ends.tolist(), counts.tolist()), at):
                    node = unit["node"][r].as_py()
                    own = h[e - c : e]
                    # repeated rows of one id
                    if node in seen or xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63) != node:
                        continue
                    seen.add(node)
                    nodes.append(node)
                    sides.append(unit["side"][r].as_py())
                    copies.append(unit["copies"][r].as_py())
                    values.append(unit["values"][r].as_py())
                    sets.append(np.unique(shingles(own, k)))
            names, weights, sides = np.array(nodes, np.int64), np.array(copies, np.int64), np.array(sides, np.int64)
            signs = np.frombuffer(b"".join(values), np.uint32).reshape(len(nodes), HASHES)
            cross = unit["cross"][0].as_py()
            left = np.flatnonzero(sides == 0)
            right = np.flatnonzero(sides == 1) if cross else left
            i, j = survivors(signs[left], signs[right] if cross else None, similarity, tolerance)
            if not len(i):
                continue
            shared = shared_shingles([sets[x] for x in left.tolist()], [sets[x] for x in right.tolist()], i, j)
            i, j = left[i], right[j]
            lengths = np.array(list(map(len, sets)))
            linked = shared / np.maximum(lengths[i] + lengths[j] - shared, 1) >= similarity
            i, j = i[linked], j[linked]
            if not len(i):
                continue
            totals = np.bincount(i, weights=weights[j], minlength=len(names)) + np.bincount(j, weights=weights[i], minlength=len(names))
            some = np.flatnonzero(totals)
            if cross:
                whole = np.arange(len(names))
                for own in (left, right):
                    own_sets, own_lengths = [sets[x] for x in own.tolist()], lengths[own]

                    def linked_with(p: int) -> np.ndarray:
                        shared = shared_with(own_sets[p], own_sets)
                        return (shared / (own_lengths + own_lengths[p] - shared) >= similarity) & _with_survivors(signs[own], p, similarity, tolerance)

                    whole[own] = own[pivots(len(own), linked_with)]
                i, j = whole[i], whole[j]
            a, b = local_components(names[i], names[j])
            a, b = a[a != b], b[a != b]
            yield _table({
                "a": pa.array(np.concatenate([names[some], a])), "b": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(b)]),
                "links": pa.concat_arrays([pa.array(totals[some].astype(np.int64)), pa.nulls(len(a), pa.int64())]),
            })

    found = saved(dealt(texts).mapInArrow(trimmed(verify), "a long, b long, links long"), "verified")
    links = found.where("b IS NULL").groupBy("a").agg(F.sum("links").alias("links"))
    components = connected_components(found.where("b IS NOT NULL").select("a", "b"))
    known = saved(
        classes.select("node", "rep", "copies").join(links, F.col("node") == F.col("a"), "left").join(components.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
        .select("node", "rep", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component")),
        "known",
    )
    told = with_group(known, "component", F.min("rep").alias("class_id")).select("node", "n_links", "class_id")
    return signed.select("id", "node").join(told, "node", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce(F.col("id") == F.col("class_id"), F.col("class_id").isNull()).alias("kept"),
    )


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_links", "class_id", "kept")


OP8_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w WHERE len(words) > 0),
z AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE shared::DOUBLE / (x.n + y.n - shared) >= 0.8),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a),
c AS (SELECT node, MIN(seen) AS class_id FROM r GROUP BY node),
n AS (SELECT a, COUNT(*) AS n FROM l GROUP BY a)
SELECT d.doc_id, COALESCE(n.n, 0) AS n_links, c.class_id, d.doc_id = c.class_id AS kept FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.a = d.doc_id
"""

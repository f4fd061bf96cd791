"""Mixing sources to target weights with a low-discrepancy schedule; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

GOLDEN = 0.6180339887498949
WORD = r"[^\x20\x09-\x0D]+"
CELLS = 4096
CHUNK = 16384


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, limit: float) -> DataFrame:
    """One row per source: sid, source_size, target.

    Sources by code point, null last, take ``weights`` in turn. ``share`` times all words is dealt
    by weight; a target stops at ``limit`` times its source and the excess goes to the others. With
    sources by limit over weight, those that stop are a prefix, so one pass of running sums finds
    the level. The table has a row per source, so one partition orders it.
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    by_name = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.partitionBy().orderBy("ratio", "sid").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    return (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("sid", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(cycle, (F.col("sid") - 1) % len(weights) + 1).cast("double"))
        .withColumn("most", F.col("source_size") * F.lit(float(limit)))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("left_over", F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("most").over(by_ratio), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0)))
        .withColumn("level", F.col("left_over") / F.col("left_weight"))
        .withColumn("level", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "sid", "level"))).over(every)["level"])
        .withColumn("target", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))))
        .select("sid", "source", "source_size", "target")
    )


def _slots(spark: SparkSession, sources: DataFrame, n: int, total: int) -> DataFrame:
    """(sid, rank): slot i goes to the source whose stretch of the cumulative targets holds the golden-ratio point frac(i * phi).

    The stretches are cut into CELLS cells of equal length, so that the lookup is an equi-join with
    even keys. Ranks count per chunk of CHUNK slots and add the counts of the chunks before.
    """
    whole = Window.partitionBy().orderBy("sid")
    stretch = (
        sources.withColumn("words", F.round("target").cast("long"))
        .withColumn("high", F.sum("words").over(whole))
        .withColumn("low", F.col("high") - F.col("words"))
        .where("words > 0")
        .select("sid", "low", "high", F.explode(F.expr(f"sequence(low * {CELLS} div {total}, (high - 1) * {CELLS} div {total})")).alias("cell"))
    )
    # i * phi in two parts keeps the fraction exact to 1e-10 for any i
    part = (1 << 20) * GOLDEN % 1.0
    turn = F.expr(f"(id div {1 << 20}) * {part!r}D") % 1.0 + F.expr(f"(id % {1 << 20}) * {GOLDEN!r}D") % 1.0
    points = (
        spark.range(n).withColumn("at", F.least(F.floor((turn % 1.0) * F.lit(total)), F.lit(total - 1)))
        .withColumn("cell", F.expr(f"at * {CELLS} div {total}"))
    )
    dealt = (
        points.join(stretch, "cell").where("at >= low AND at < high")
        .select("sid", "id", F.expr(f"id div {CHUNK}").alias("chunk"))
        .withColumn("nth", F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("id")))
    )
    before = (
        dealt.groupBy("sid", "chunk").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("sid").orderBy("chunk")) - F.col("n"))
    )
    return dealt.join(before, ["sid", "chunk"]).select("sid", (F.col("before") + F.col("nth") - 1).alias("rank"))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with what a mix needs of each row: ``size``, the words of its text, and ``digest``, which shuffles the rows."""
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    return docs.withColumns({"size": size, "digest": F.md5(F.concat_ws("#", F.lit("mix"), F.col(id_col).cast("string")))})


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    limit: int = 2,
    slots: int = 1 << 20,
    block_words: tuple[int, int] = (16, 4096),
    row_col: str | None = None,
    is_measured: bool = False,
) -> DataFrame:
    """How many words a mix by target weights takes of each document.

    The words of a source, its documents shuffled by md5, form a stream that is cut into blocks of
    equal size (the mix over ``slots``, within ``block_words``). A golden-ratio schedule deals slots
    to sources; slot number r of a source takes its block r, and after the last block the stream
    begins again, ``limit`` times at most. Running positions are summed per (source, leading digits
    of the md5), then over those digits, so that a source with most of the rows is no single task.

    One row per input row: id, source, size, source_size, target, taken, and taken_first,
    taken_again (first and later passes), then ``row_col`` if that is given, a column of distinct
    longs that tells rows with equal ids apart. Null text and text without words have size 0 and take 0;
    a null source is one source, the last; repeated rows count each; an empty table gives no rows;
    other columns are ignored. Documents of one source with equal ids follow each other by size.
    ``is_measured``: ``docs`` is a stored table with the columns of measured(), so that sizes need no table of their own.
    """
    spark = docs.sparkSession
    row = F.col(row_col).cast("long") if row_col else F.lit(None).cast("long")
    sizes = docs if is_measured else measured(docs, id_col, text_col)
    sizes = sizes.select(F.col(id_col).alias("id"), row.alias("row"), F.col(source_col).cast("string").alias("source"), "size", "digest")
    sizes = sizes if is_measured else saved(sizes, "mix-sizes")
    sources = saved(source_targets(sizes, weights, share, limit), "mix-sources")
    total = sources.agg(F.sum(F.round("target").cast("long"))).first()[0] or 0
    block = max(block_words[0], min(block_words[1], total // slots + 1))
    by_digits = Window.partitionBy("source", "digits").orderBy("digest", "id", "size", "row")
    placed = (
        sizes.withColumn("digits", F.substring("digest", 1, 3))
        .withColumn("nth", F.row_number().over(by_digits))
        .withColumn("run", F.sum("size").over(by_digits.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    )
    offsets = (
        sizes.groupBy("source", F.substring("digest", 1, 3).alias("digits")).agg(F.sum("size").alias("words"))
        .withColumn("before", F.sum("words").over(Window.partitionBy("source").orderBy("digits")) - F.col("words"))
    )
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    offsets = (
        offsets.alias("o").join(sources.alias("s"), F.expr("o.source <=> s.source"))
        .select("o.source", "o.digits", "o.before", "s.sid", "s.source_size", "s.target")
    )
    rows = (
        placed.join(offsets, same(placed, offsets) & (placed["digits"] == offsets["digits"]))
        .select("id", "row", placed["source"], "size", "source_size", "target", "sid", placed["digits"], "nth", (F.col("before") + F.col("run")).alias("start"))
    )
    blocks = F.expr(f"(source_size + {block - 1}) div {block}")
    pieces = (
        rows.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(limit - 1))))
        .withColumn("block", F.explode(F.expr(f"CASE WHEN size > 0 THEN sequence(start div {block}, (start + size - 1) div {block}) ELSE array(-1L) END")))
        .withColumn("rank", F.when(F.col("block") >= 0, F.col("pass") * blocks + F.col("block")).otherwise(F.lit(-1)))
        .withColumn("words", F.expr(f"CASE WHEN block >= 0 THEN least(start + size, (block + 1) * {block}) - greatest(start, block * {block}) ELSE 0 END"))
    )
    if total:
        chosen = _slots(spark, sources, (total + block - 1) // block, total).withColumn("chosen", F.lit(True))
        pieces = pieces.join(chosen, ["sid", "rank"], "left")
    else:
        pieces = pieces.withColumn("chosen", F.lit(None).cast("boolean"))
    words: Column = F.when(F.col("chosen"), F.col("words")).otherwise(F.lit(0))
    return (
        pieces.groupBy("sid", "digits", "nth", "id", "row", "source", "size", "source_size", "target")
        .agg(F.sum(F.when(F.col("pass") == 0, words).otherwise(0)).alias("taken_first"), F.sum(F.when(F.col("pass") > 0, words).otherwise(0)).alias("taken_again"))
        .select(F.col("id").alias(id_col), "source", "size", "source_size", "target", (F.col("taken_first") + F.col("taken_again")).alias("taken"), "taken_first", "taken_again", *([F.col("row").alias(row_col)] if row_col else []))
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


#: The same schedule in closed form: with k slots a source's first pass takes its first k blocks.
OP3_SQL = """
WITH d AS (SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
             md5('mix#' || CAST(doc_id AS VARCHAR)) AS digest FROM documents),
p AS (SELECT *, CAST(SUM(size) OVER (PARTITION BY source ORDER BY digest, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS start FROM d),
s0 AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM s0),
s2 AS (SELECT *, CAST([5, 2, 1][(sid - 1) % 3 + 1] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS most FROM s1),
s3 AS (SELECT *, most / weight AS ratio, SUM(source_size) OVER () * 1.5::DOUBLE
         - COALESCE(SUM(most) OVER (ORDER BY most / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
         SUM(weight) OVER () - COALESCE(SUM(weight) OVER (ORDER BY most / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_weight FROM s2),
lv AS (SELECT left_over / left_weight AS level FROM s3 WHERE ratio > left_over / left_weight ORDER BY ratio, sid LIMIT 1),
s4 AS (SELECT *, least(most, COALESCE((SELECT level FROM lv) * weight, most)) AS target FROM s3),
s5 AS (SELECT *, CAST(SUM(CAST(round(target) AS BIGINT)) OVER (ORDER BY sid) AS BIGINT) AS high, CAST(round(target) AS BIGINT) AS words FROM s4),
tt AS (SELECT CAST(SUM(words) AS BIGINT) AS total, greatest(16, least(4096, CAST(SUM(words) AS BIGINT) // 1048576 + 1)) AS block FROM s5),
n AS (SELECT unnest(range((total + block - 1) // block)) AS i, total FROM tt),
g AS (SELECT least(CAST(floor((((i // 1048576) * {part} % 1.0 + (i % 1048576) * 0.6180339887498949::DOUBLE % 1.0) % 1.0) * total) AS BIGINT), total - 1) AS spot FROM n),
k AS (SELECT sid, COUNT(*) AS k FROM g JOIN s5 ON spot >= high - words AND spot < high GROUP BY sid),
j AS (SELECT p.*, s5.source_size AS ss, s5.target, COALESCE(k.k, 0) AS k, block, (s5.source_size + block - 1) // block AS nb
      FROM p JOIN s5 ON p.source IS NOT DISTINCT FROM s5.source LEFT JOIN k USING (sid) CROSS JOIN tt)
SELECT doc_id, size, ss AS source_size, target, CAST(greatest(0, least(start + size, k * block) - start)
  + greatest(0, least(start + size, (k - nb) * block) - start) AS BIGINT) AS taken FROM j
""".replace("{part}", f"{(1 << 20) * GOLDEN % 1.0!r}::DOUBLE")

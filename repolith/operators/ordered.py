"""Global numbering without one task that sorts everything."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repolith.session import checkpointed


def numbered(rows: DataFrame, order: str | list[str], name: str) -> DataFrame:
    """``name``: 1, 2, 3 ... in ``order``. Rows are sorted by ranges; each range counts for itself and adds the sizes of those before."""
    order = [order] if isinstance(order, str) else order
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = checkpointed(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sizes = {r["_part"]: r["count"] for r in sorted_.groupBy("_part").count().collect()}  # a number for each task
    before, total = {}, 0
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]
    if not before:
        return sorted_.drop("_part").withColumn(name, F.lit(0).cast("long"))
    base = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("_part"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return sorted_.withColumn(name, (base + nth).cast("long")).drop("_part")

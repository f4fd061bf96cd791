"""python -m repolith QUERY SF_DIR [OUT]: runs a query and prints it, or writes it as Parquet. Exit 2 for an unknown query."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from repolith.plans.registry import QUERIES


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in QUERIES:
        print(f"{__doc__}\nQueries: {', '.join(sorted(QUERIES))}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    rows = QUERIES[args[0]](spark, args[1])
    rows.write.mode("overwrite").parquet(args[2]) if len(args) > 2 else rows.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

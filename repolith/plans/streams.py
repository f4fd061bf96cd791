"""Queries for the streaming extensions, over the events table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from repolith.plans.base import query, table
from repolith.session import shared_folder
from repolith.streaming import events


@query("SELECT time_bucket(INTERVAL '10 minutes', ts) AS start, event_type, COUNT(*) AS n, round(SUM(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark, d):
    return events.tumbling(table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("""WITH x AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS opens FROM events),
y AS (SELECT *, SUM(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT user_id, MIN(ts) AS start, COUNT(*) AS n FROM y GROUP BY user_id, s""")
def session_windows(spark, d):
    return events.sessions(table(spark, d, "events")).select("user_id", "start", "n")


@query("SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type")
def streamed_counts(spark, d):
    """The events table as a stream of files, processed to its end; counts of what arrived."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema(table(spark, d, "events").schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events*")
    events.run_available(source, f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))

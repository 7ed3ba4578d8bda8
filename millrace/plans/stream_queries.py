"""Streams over the events table, drained and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.staging import shared_dir
from ..streaming import pipelines
from .registry import Registry

query = Registry()
QUERIES, SQL = query.queries, query.sql


def shared(spark) -> str:
    return f"{shared_dir(spark)}/millrace-streams"


def events(spark, sf_dir):
    stream = pipelines.files(spark, f"{sf_dir}/events.parque[t]")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(spark, sf_dir):
    return pipelines.drain(pipelines.first_seen(events(spark, sf_dir).select("user_id", "event_type"), ["user_id", "event_type"]), shared(spark))


@query("SELECT epoch_us(date_trunc('day', ts)) // 1000000 AS start_s, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    out = pipelines.drain(pipelines.event_windows(events(spark, sf_dir), "ts", "1 day", ["event_type"]), shared(spark), "complete")
    return out.select(F.unix_seconds("start").alias("start_s"), "event_type", "n")


@query("""WITH r AS (SELECT event_type, user_id, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 50 AS w FROM events)
    SELECT event_type, CAST(w AS INTEGER) AS window_no, CAST(count(DISTINCT user_id) AS INTEGER) AS n_distinct FROM r GROUP BY ALL HAVING count(*) = 50""")
def stream_count_windows(spark, sf_dir):
    return pipelines.drain(pipelines.count_windows(events(spark, sf_dir), "event_type", "user_id", 50, "event_id"), shared(spark))

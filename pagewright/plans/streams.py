"""Queries that run streams with keyed state over the stored events, and give the rows of the batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.crawl import shared_folder
from ..streaming import states
from .registry import query, table


@query("""SELECT user_id AS key, event_id AS number, coalesce(seen > ts - INTERVAL 6 HOUR, FALSE) AS hit, CASE WHEN seen > ts - INTERVAL 6 HOUR THEN content END AS content FROM (
  SELECT user_id, event_id, ts, event_type, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER w AS content, last_value(CASE WHEN event_type = 'view' THEN ts END IGNORE NULLS) OVER w AS seen FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE event_type <> 'view'""")
def cache_stream(spark, sf_dir):
    """Views fill a cache by user, everything else reads it: a stream in three parts, each a restart from the checkpoint."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("number"), (F.col("event_type") == "view").alias("write"), F.col("event_id").alias("content"))
    return states.replayed(rows, lambda s: states.cache_reads(s, "6 hours"), f"{shared_folder(spark)}/cache-stream-{uuid.uuid4().hex}", "at")


#: A run is a user's events up to a gap of more than 36 hours: each event finds one thing and, but for errors, finishes one.
@query("""WITH e AS (SELECT user_id, event_id, ts, event_type <> 'error' AS ok, coalesce(ts - lag(ts) OVER w > INTERVAL 36 HOUR, FALSE) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  g AS (SELECT *, sum(gap::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS stretch FROM e),
  f AS (SELECT *, coalesce(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, stretch ORDER BY ts, event_id), 0) AS failed, max(ts) OVER (PARTITION BY user_id, stretch) AS last_ts FROM g)
  SELECT user_id AS run, epoch_us(ts) AS ended_us, 'done' AS reason, 1::BIGINT AS done FROM f WHERE failed = 0
  UNION ALL SELECT user_id, epoch_us(max(last_ts)) + 36 * 3600 * 1000000::BIGINT, 'idle', count(*) FILTER (ok) FROM f WHERE failed > 0 GROUP BY user_id, stretch HAVING max(last_ts) + INTERVAL 36 HOUR < (SELECT max(ts) FROM events) - INTERVAL 1 SECOND""")
def run_end_stream(spark, sf_dir):
    """Ends of runs, by completion or by idleness, from timers."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("run"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("number"), F.lit(1).alias("found"), (F.col("event_type") != "error").cast("int").alias("finished"))
    return states.replayed(rows, lambda s: states.run_ends(s, "36 hours"), f"{shared_folder(spark)}/run-end-stream-{uuid.uuid4().hex}", "at")

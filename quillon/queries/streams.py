"""Streams over the events' files."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.queries._registry import query, r6
from quillon.streaming import windows as W


@query("stream_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) + 0 AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    found = W.tumbling(W.event_stream(spark, sf_dir), "1 hour", "1 day", F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), by=("event_type",))
    done = W.drained(found, "tumbling")
    return done.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", (F.round("total", 4) + F.lit(0.0)).alias("total"))


@query("stream_sliding", "WITH w AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL (30 * k) MINUTE AS start, value FROM events, range(2) t(k)) SELECT start, count(*) AS n FROM w GROUP BY start")
def stream_sliding(spark, sf_dir):
    found = W.sliding(W.event_stream(spark, sf_dir), "1 hour", "30 minutes", "1 day", F.count(F.lit(1)).alias("n"))
    return W.drained(found, "sliding").select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query(
    "stream_sessions",
    """WITH l AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM l) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM g GROUP BY user_id, g""",
)
def stream_sessions(spark, sf_dir):
    found = W.sessions(W.event_stream(spark, sf_dir), "6 hours", "1 day", "user_id", F.count(F.lit(1)).alias("n"))
    done = W.drained(found, "sessions")
    return done.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("stream_scored", "SELECT event_id, round(0.5::DOUBLE * value + 1, 6) + 0 AS score FROM events")
def stream_scored(spark, sf_dir):
    """A linear model's score on every event as it arrives."""
    found = W.scored(W.event_stream(spark, sf_dir), lambda df: df.select("event_id", r6(F.col("value") * F.lit(0.5) + F.lit(1.0)).alias("score")))
    return W.drained(found, "scored", "append")

"""Batch twins of the streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketweave.plans.registry import query
from ticketweave.streaming import jobs

C, L = F.col, F.lit


@query("m02_volume", "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS volume FROM events GROUP BY 1, 2")
def _(t):
    return jobs.volume(t.events, "ts", "1 day", ["event_type"])


@query("m03_spikes", """WITH w AS (SELECT unnest([b, b - INTERVAL 6 HOUR, b - INTERVAL 12 HOUR, b - INTERVAL 18 HOUR]) AS window_start FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS b FROM events)), c AS (SELECT window_start, count(*) AS volume FROM w GROUP BY 1), s AS (SELECT avg(volume) AS m, stddev_samp(volume) AS s FROM c)
SELECT window_start, volume, CASE WHEN volume > m THEN 'spike' ELSE 'drop' END AS direction, round((volume - m) / s, 4) AS z FROM c, s WHERE abs((volume - m) / s) >= 1.8""")
def _(t):
    return jobs.score_spikes(jobs.sliding_volume(t.events, "ts"))


@query("m04_sessions", """WITH k AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM k) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, count(*) AS n_events FROM s GROUP BY user_id, sid""")
def _(t):
    return jobs.sessions(t.events, "user_id", "ts")


@query("m05_signatures", "SELECT md5(concat(event_type, '|', user_id % 20)) AS sig, count(*) AS frequency, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1")
def _(t):
    sig = F.md5(F.concat_ws("|", "event_type", (C("user_id") % 20).cast("string")).cast("binary"))
    return jobs.signatures(t.events.withColumn("sig", sig), "sig", "ts")


@query("m08_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def _(t):
    return jobs.dedupe(t.events, ["user_id", "event_type"], "ts").select("user_id", "event_type")


@query("m10_enrich", "SELECT event_id, coalesce(s_name, 'unknown') AS s_name FROM events LEFT JOIN supplier ON s_suppkey = user_id")
def _(t):
    cat = t.supplier.select(C("s_suppkey").alias("user_id"), "s_name")
    return jobs.enrich(t.events, cat, "user_id", {"s_name": "unknown"}).select("event_id", "s_name")

"""Streams over the events table, run to the end of what is there; each is held against the batch SQL of the same meaning."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from helixframe.catalog import register
from helixframe.plans.common import r, t
from helixframe.streaming import operators as S


def stream(spark, d, where="true"):
    batch = t(spark, d, "events")
    return S.source(spark, os.path.join(d, "events.parquet"), batch).filter(where)


@register("stream_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    s = S.tumbling(stream(spark, d), "ts", "1 day", ["event_type"], [F.count("*").alias("n"), r(F.sum("value"), 4).alias("total")])
    return S.run_complete(spark, s)


@register("stream_sliding", """
SELECT w AS start, w + INTERVAL 6 HOUR AS "end", count(*) AS n FROM (SELECT ts, unnest([time_bucket(INTERVAL 3 HOUR, ts), time_bucket(INTERVAL 3 HOUR, ts) - INTERVAL 3 HOUR]) AS w FROM events) GROUP BY ALL""")
def stream_sliding(spark, d):
    return S.run_complete(spark, S.sliding(stream(spark, d), "ts", "6 hours", "3 hours", [], [F.count("*").alias("n")]))


@register("stream_session", """
WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS k FROM events), g AS (SELECT *, sum(k) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM x)
SELECT min(ts) AS start, max(ts) + INTERVAL 4 HOUR AS "end", user_id, count(*) AS n FROM g GROUP BY user_id, g""")
def stream_session(spark, d):
    return S.run_complete(spark, S.sessions(stream(spark, d), "ts", "4 hours", ["user_id"], [F.count("*").alias("n")]))


@register("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, d):
    """Within a watermark as long as the table, each key comes once."""
    s = S.deduplicated(stream(spark, d).select("ts", "user_id", "event_type"), "ts", ["user_id", "event_type"], "400 days")
    return S.run(spark, s.drop("ts"))


@register("stream_map", "SELECT event_id, CAST(floor(value / 10) AS BIGINT) AS bin, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type <> 'error'")
def stream_map(spark, d):
    s = stream(spark, d, "event_type <> 'error'").select("event_id", F.floor(F.col("value") / 10).cast("long").alias("bin"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    return S.run(spark, s)


@register("stream_join", """
SELECT a.user_id, a.event_id, b.event_id AS other FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'signup' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 2 HOUR""")
def stream_join(spark, d):
    a = stream(spark, d, "event_type = 'signup'").select("user_id", "event_id", "ts")
    b = stream(spark, d, "event_type = 'purchase'").select("user_id", F.col("event_id").alias("other"), F.col("ts").alias("then"))
    return S.run(spark, S.joined(a, b, ["user_id"], "ts", "then", "2 hours", "60 days").select("user_id", "event_id", "other"))


@register("stream_enrich", "SELECT event_id, n_name FROM events JOIN nation ON n_nationkey = user_id % 25")
def stream_enrich(spark, d):
    n = F.broadcast(t(spark, d, "nation", "n_nationkey", "n_name"))
    s = stream(spark, d).select("event_id", (F.col("user_id") % 25).cast("int").alias("n_nationkey"))
    return S.run(spark, S.enriched(s, n, ["n_nationkey"], "inner").select("event_id", "n_name"))


@register("stream_running_totals", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_running_totals(spark, d):
    s = S.running_totals(stream(spark, d).select("user_id", "value"), "user_id", "value")
    return S.run_latest(spark, s, ["user_id"]).withColumn("total", r(F.col("total"), 4))


@register("stream_watermarked_groups", """
WITH m AS (SELECT max(ts) AS top FROM events), g AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day, user_id, count(*) AS n, max(value) AS most FROM events GROUP BY ALL)
SELECT g.* FROM g, m WHERE g.day + INTERVAL 1 DAY <= m.top - INTERVAL 2 DAY""")
def stream_watermarked_groups(spark, d):
    """Groups that the watermark has closed: a day is final two days after it ends."""
    return S.run(spark, S.adjacent_groups(stream(spark, d), "ts", "user_id", "value", "2 days"))
